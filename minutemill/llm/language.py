"""Language identification by blended-spectrum string kernels and Nystroem kernel ridge regression.

A text's features are the character n-grams of 1 to `longest` characters that occur in its words, by
presence. The kernel of two texts is the number of n-grams both have over the root of the product of the
numbers each has. A text is compared with `landmarks` texts only; one ridge regression for each
language gives the weights of the landmarks (one versus rest). n-grams are told apart by 64-bit hashes; only those of the
landmarks are kept in a table, and of other texts' n-grams the number is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minutemill.llm.common import id_and_text, id_remainder, map_batches, read_documents, slices

ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str, longest: int) -> np.ndarray | None:
    """Sorted distinct hashes of the n-grams of a text; None if it has no letter.

    Letters are taken in lower case; every run of other characters becomes one space, also at both ends.
    """
    chars = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    distinct, inverse = np.unique(chars, return_inverse=True) if len(chars) < 64 else _distinct(chars)
    letter = np.array([chr(c).isalpha() for c in distinct.tolist()], bool)
    if not letter.any():
        return None
    folded = np.where(letter, distinct, 32).astype(np.uint32)[inverse]
    keep = np.ones(len(folded) + 2, bool)
    padded = np.full(len(folded) + 2, 32, np.uint32)
    padded[1:-1] = folded
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    padded = padded[keep].astype(np.uint64)
    code, found = np.zeros(len(padded), np.uint64), []
    for n in range(1, longest + 1):
        end = len(padded) - n + 1
        if end <= 0:
            break
        code = (code[:end] + padded[n - 1 :] + np.uint64(n)) * ODD
        code ^= code >> np.uint64(31)
        found.append(code)
    every = np.concatenate(found)
    every.sort()
    first = np.ones(len(every), bool)
    first[1:] = every[1:] != every[:-1]
    return every[first]


def _distinct(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse by way of a table, for characters up to the largest in the text."""
    table = np.zeros(int(chars.max()) + 1, np.int32)
    table[chars] = 1
    distinct = np.nonzero(table)[0]
    table[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, table[chars]


class Landmarks:
    """n-grams of the landmarks, each with the landmarks that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets or [np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.holders = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.grams, counts = np.unique(every, return_counts=True)
        self.starts = np.concatenate(([0], np.cumsum(counts)))

    def kernel(self, own: np.ndarray) -> np.ndarray:
        """Common n-grams of a text with each landmark over the root of the product of their numbers."""
        at = np.searchsorted(self.grams, own)
        at = at[self.grams[np.minimum(at, len(self.grams) - 1)] == own]
        size = self.starts[at + 1] - self.starts[at]
        places = np.arange(int(size.sum())) + np.repeat(self.starts[at] - np.cumsum(size) + size, size)
        common = np.bincount(self.holders[places], minlength=len(self.sizes))
        return common / np.sqrt(len(own) * self.sizes)


def labelled_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(text, lang, _place): at most `per_language` texts of each language, those of the smallest hash of id."""
    seed = F.xxhash64(F.lit("sample"), "doc_id", F.xxhash64("text"))
    ranked = docs.filter("lang IS NOT NULL").withColumn("_seed", seed)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_seed"))
    return ranked.withColumn("_place", place).filter(F.col("_place") <= per_language).select("text", "lang", "_place")


class Model:
    def __init__(self, languages: list[str], marks: Landmarks, weights: np.ndarray, longest: int):
        self.languages, self.marks, self.weights, self.longest = languages, marks, weights, longest

    def scores(self, own: np.ndarray) -> np.ndarray:
        return self.marks.kernel(own) @ self.weights


def fit(texts: list[str], langs: list[str], longest: int = 3, landmarks: int = 160, ridge: float = 1e-3) -> Model:
    """Landmarks are the first texts of each language in turn, one of each at least; the rest only shape the weights.

    Without labelled texts the model knows no language, and every text is `und`.
    """
    sets = [grams(t, longest) for t in texts]
    usable = np.array([own is not None for own in sets], bool)
    names = sorted({lang for lang, ok in zip(langs, usable) if ok})
    if not names:
        return Model([], Landmarks([]), np.zeros((0, 0)), longest)
    langs_of = np.array([names.index(lang) if ok else -1 for lang, ok in zip(langs, usable)])
    turn = sorted((int((langs_of[:i] == k).sum()), k, i) for i, k in enumerate(langs_of) if k >= 0)
    chosen = [i for _, _, i in turn[: max(landmarks, len(names))]]
    targets = langs_of[usable]
    marks = Landmarks([sets[i] for i in chosen])
    between = np.array([marks.kernel(own) for own in sets if own is not None])
    among = np.array([marks.kernel(sets[i]) for i in chosen])
    # Languages weigh alike, however many texts each has.
    weight = 1.0 / np.bincount(targets, minlength=len(names))[targets] / len(names)
    want = (targets[:, None] == np.arange(len(names))[None, :]).astype(np.float64)
    left = between.T @ (weight[:, None] * between) + ridge * among + 1e-9 * np.eye(len(chosen))
    weights = np.linalg.lstsq(left, between.T @ (weight[:, None] * want), rcond=None)[0]
    return Model(names, marks, weights, longest)


def fit_documents(docs: DataFrame, per_language: int = 300, most: int = 2000, **options) -> Model:
    """Fit on a sample of labelled texts: `per_language` each and `most` in all; longer texts count whole.

    Every language gets its first text before any gets its second, and so on; it has one however many there are.
    """
    languages = docs.filter("lang IS NOT NULL").select("lang").distinct().count()
    rows = labelled_sample(docs, per_language).orderBy("_place", "lang").limit(max(most, languages)).collect()
    return fit([r.text for r in rows], [r.lang for r in rows], **options)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): the language whose regression answers highest, and that answer in 0..1.

    `und` with score 0 if text is null or has no letter. A null doc_id stays null. Repeated rows give
    repeated rows, other columns are left behind, an empty table gives an empty one. Equal answers go to
    the language that sorts first.
    """

    def run(batch):
        import os

        os.environ.setdefault("OMP_NUM_THREADS", "1")
        for rows in slices(batch):
            langs, scores = predict_texts(model, rows.column("text").to_pylist())
            yield {"doc_id": rows.column("doc_id"), "lang_pred": langs, "score": scores}

    return map_batches(id_and_text(docs), run, "doc_id long, lang_pred string, score double")


def predict_texts(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for text in texts:
        own = grams(text, model.longest) if model.languages else None
        if own is None:
            langs.append("und")
            scores.append(0.0)
            continue
        answers = model.scores(own)
        best = int(answers.argmax())
        langs.append(model.languages[best])
        scores.append(min(1.0, max(0.0, float(answers[best]))))
    return langs, scores


def keep_identified(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """Documents with a language: not `und`, and an answer of `least_score` or more. Columns as they came.

    The model is fitted on a sample of the labelled rows of the input; without any, all rows with a letter
    stay.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    labelled = docs.select("doc_id", F.col("text"), "lang").filter("text IS NOT NULL")
    model = fit_documents(labelled)
    target, at = to_arrow_schema(docs.schema), docs.columns.index("text")

    def run(batches):
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if model.languages:
                langs, scores = predict_texts(model, texts)
                keep = [i for i, (k, s) in enumerate(zip(langs, scores)) if k != "und" and s >= least_score]
            else:
                keep = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(keep, pa.int64())).columns, schema=target)

    return docs.mapInArrow(run, docs.schema)


def op3_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    held = (id_remainder(3) == 1).alias("held_out")
    model = fit_documents(id_and_text(docs, "lang", held).filter("NOT held_out"))
    predicted = predict(docs, model)
    return predicted.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_string_kernel_language": op3_string_kernel_language}
ORACLE: dict[str, str] = {}
