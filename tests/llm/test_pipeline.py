import corpus_pipeline
from minutemill.llm.registry import ORACLE, QUERIES

from tests.conftest import SF_DIR


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = docs.selectExpr("*", "1 AS kept", "'x' AS _hash").limit(60)
    names, counts = docs.columns + ["kept", "_hash"], [60]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        extra = stage(spark, extra, SF_DIR)
        assert extra.columns == names
        extra = spark.createDataFrame(extra.toPandas(), extra.schema)
        counts.append(extra.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 20
    packed = corpus_pipeline.STAGES[-1][1](spark, extra, SF_DIR)
    assert packed.select("doc_id").distinct().count() == extra.count()


def test_every_number_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
