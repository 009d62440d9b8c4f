"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, a proof for each row.

Rows are ranked inside their group by a range sort and cut into blocks of a power of the fanout. A block hashes
its own subtree. The levels above are climbed by a butterfly exchange: in round r a block swaps the digest of
its ancestor with one block of each sibling subtree, the one that has the same place there, and all hash the
common parent. So every block ends with the root and its whole upper proof, and nothing has to be
passed down again. A round moves at most fanout - 1 short rows to a block and no key has more than
fanout of them, however many rows one group holds.

Digests are lowercase hex texts of sha256. A path is a text with one step for each level, from the leaf up:
the place in the run, the length of the run (one digit each) and the digests of the others, left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minutemill.llm.common import arrow_schema, id_remainder, read_documents, to_batch
from minutemill.session import scratch_path

FANOUT = 3
# Leaves of a block: the largest power of the fanout up to this many.
BLOCK_LEAVES = 3**7
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def hashed(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """H of the values, each as UTF-8 byte count, colon and text, or `-` if null."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def _written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Nodes (tree, key, digest, carried) with `rank`, the place of a node in its tree by key, from 0, and
    `size`, the nodes of the tree. Ties of key go by digest; a null tree or key comes first.

    One range shuffle; of the ranges, only their counts for each tree are brought together.
    """
    numbered = _written(spark, nodes.withColumn("_row", F.monotonically_increasing_id()), "nodes")
    by = ["tree", "key", "digest", "_row"]
    placed = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    placed = _written(spark, placed.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")  # one row for each range that holds a part of the tree
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        F.col("tree").alias("_tree"), "_part", F.sum("_n").over(tree).alias("size"),
        (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_offset"),
    )
    same = placed["tree"].eqNullSafe(F.col("_tree")) & (F.shiftright(placed["_at"], 33) == F.col("_part"))
    joined = placed.join(starts, same)
    return joined.select(*nodes.columns, (F.col("_at") - F.col("_offset")).alias("rank"), "size")


def _block_leaves(fanout: int) -> int:
    leaves = fanout
    while leaves * fanout <= BLOCK_LEAVES:
        leaves *= fanout
    return leaves


def climb(level: list[str], fanout: int, levels: int | None = None) -> list[list[str]]:
    """All levels of the tree over `level`: up to one node, or exactly `levels` above it."""
    tree = [level]
    while len(tree[-1]) > 1 if levels is None else len(tree) <= levels:
        below = tree[-1]
        tree.append([hashed(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return tree


def path_of(tree: list[list[str]], place: int, fanout: int) -> str:
    steps = []
    for level in tree[:-1]:
        start = place - place % fanout
        run = level[start : start + fanout]
        steps.append(f"{place - start}{len(run)}" + "".join(run[: place - start] + run[place - start + 1 :]))
        place //= fanout
    return "".join(steps)


def steps_of(path: str) -> Iterator[tuple[int, list[str]]]:
    """(place, digests of the others) from the leaf up."""
    at = 0
    while at < len(path):
        place, others = int(path[at]), int(path[at + 1]) - 1
        at += 2
        yield place, [path[at + _HEX * i : at + _HEX * (i + 1)] for i in range(others)]
        at += _HEX * others


def fold(digest: str, path: str) -> str:
    """The root that a leaf and a path lead to."""
    for place, others in steps_of(path):
        digest = hashed([*others[:place], digest, *others[place:]])
    return digest


def _levels(size: int, leaves: int, fanout: int) -> int | None:
    """Levels inside a block: all of the tree if it has one block only."""
    if size <= leaves:
        return None
    levels = 0
    while fanout**levels < leaves:
        levels += 1
    return levels


def _in_blocks(rows: DataFrame, leaves: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("rank") / leaves).cast("long"))


def _streamed(rows: DataFrame, per_block, schema: str) -> DataFrame:
    """per_block(list of row dicts) -> list of row dicts, on rows sorted by (tree, block, rank). A block is
    bounded, so a task holds one block and one Arrow batch."""
    target = arrow_schema(schema)

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                    made += per_block(held)
                    held = []
                held.append(row)
            if made:
                yield _as_batch(made, target)
        if held:
            yield _as_batch(per_block(held), target)

    return rows.mapInArrow(run, schema)


def _as_batch(rows: list[dict], target: pa.Schema) -> pa.RecordBatch:
    return to_batch({name: [r[name] for r in rows] for name in target.names}, target)


def block_roots(leaves_ranked: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, blocks, digest, path): one row for each block, `path` still empty."""
    leaves = _block_leaves(fanout)

    def root(rows: list[dict]) -> list[dict]:
        size = rows[0]["size"]
        tree = climb([r["digest"] for r in rows], fanout, _levels(size, leaves, fanout))
        return [{"tree": rows[0]["tree"], "block": rows[0]["block"], "blocks": -(-size // leaves), "digest": tree[-1][0]}]

    rows = _in_blocks(leaves_ranked.select("tree", "digest", "rank", "size"), leaves)
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return _streamed(dealt, root, "tree string, block long, blocks long, digest string").withColumn("path", F.lit(""))


def butterfly(spark: SparkSession, blocks: DataFrame, fanout: int) -> DataFrame:
    """Every block with the root of its tree in `digest` and its upper proof in `path`.

    Before round r a block holds the digest of its ancestor of fanout^(r-1) blocks, as do all blocks of
    that subtree. It meets the blocks with its own place (`low`) in the sibling subtrees. Where the last
    subtree is smaller, its blocks stand in for the places that it lacks. Every round is written, which
    cuts the lineage; there are as many as the largest tree has levels above its blocks.
    """
    blocks = _written(spark, blocks, "butterfly")
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        blocks = _written(spark, _exchange(blocks, width, fanout), "butterfly")
        width *= fanout
    return blocks


def _exchange(blocks: DataFrame, width: int, fanout: int) -> DataFrame:
    ancestor = F.floor(F.col("block") / width).cast("long")
    placed = blocks.withColumns({"_low": F.col("block") % width, "_group": F.floor(ancestor / fanout).cast("long"),
                                 "_slot": (ancestor % fanout).cast("int")})
    climbing = F.col("blocks") > width  # trees of one node are done
    held = F.least(F.lit(width), F.col("blocks") - (F.col("block") - F.col("_low")))
    # A smaller last subtree of a run with others serves all their places, else only its own.
    served = F.when(F.col("_slot") > 0, F.sequence("_low", F.lit(width - 1).cast("long"), held)).otherwise(F.array("_low"))
    sent = placed.filter(climbing).select("tree", "_group", "_slot", "digest", F.explode(served).alias("_low"))
    run = F.sort_array(F.collect_list(F.struct("_slot", "digest")))
    runs = sent.groupBy("tree", "_group", "_low").agg(run.alias("_run"))
    runs = runs.select(F.col("tree").alias("_tree"), F.col("_group").alias("_g"), F.col("_low").alias("_l"), "_run")
    meets = (
        climbing & F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_group") == F.col("_g")) & (F.col("_low") == F.col("_l"))
    )
    joined = placed.join(runs, meets, "left")
    digests = F.transform("_run", lambda node: node["digest"])
    others = F.transform(F.filter("_run", lambda node: node["_slot"] != F.col("_slot")), lambda node: node["digest"])
    step = F.concat(F.col("_slot").cast("string"), F.size("_run").cast("string"), F.array_join(others, ""))
    return joined.select(
        "tree", "block", "blocks",
        F.coalesce(F.sha2(F.array_join(digests, ""), 256), "digest").alias("digest"),
        F.concat("path", F.coalesce(step, F.lit(""))).alias("path"),
    )


_PROOF = "tree string, key long, name string, leaf string, carried string, subroot string, path string, root string"


def proofs(leaves_ranked: DataFrame, tops: DataFrame, fanout: int) -> DataFrame:
    """Rows of _PROOF for each node: `tops` has (tree, block, subroot, path, root), the path above the block.

    The row of a block travels with its leaves and sorts before them, so it is not copied to each of them.
    """
    leaves = _block_leaves(fanout)
    none = F.lit(None)
    rows = _in_blocks(leaves_ranked, leaves).select(
        "tree", "block", "rank", "size", "key", "name", "digest", "carried", none.cast("string").alias("path"),
        none.cast("string").alias("root"),
    )
    heads = tops.select(
        "tree", "block", F.lit(-1).cast("long").alias("rank"), F.lit(0).cast("long").alias("size"),
        none.cast("long").alias("key"), none.cast("string").alias("name"), F.col("subroot").alias("digest"),
        none.cast("string").alias("carried"), "path", "root",
    )

    def prove(block: list[dict]) -> list[dict]:
        head, *rows = block
        levels = _levels(rows[0]["size"], leaves, fanout)
        tree = climb([r["digest"] for r in rows], fanout, levels)
        shared = {"subroot": head["digest"], "root": head["root"]}
        return [
            {**{c: r[c] for c in ("tree", "key", "name", "carried")}, "leaf": r["digest"], **shared,
             "path": path_of(tree, i, fanout) + head["path"]}
            for i, r in enumerate(rows)
        ]

    dealt = rows.unionAll(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return _streamed(dealt, prove, _PROOF)


def dataset_manifest(
    docs: DataFrame, group: str = "source", order: str = "doc_id", columns: tuple[str, ...] = LEAF_COLUMNS,
    fanout: int = FANOUT, carried: Column | None = None,
) -> DataFrame:
    """(order, group, leaf, path, subroot, root, carried) for each row of a table.

    Leaves of a group ascend by `order` (a whole number), groups by their UTF-8 bytes, null first in both; rows
    with equal order go by their leaf. A group with one row has its leaf as subroot, a table with
    one group its subroot as root. `path` leads from the leaf to the root (see `fold`). `carried` is any
    text, for example the leaf of a copy that is to be verified. Values may be null, empty or long: texts are
    hashed where they are read and do not move. An empty table gives an empty manifest.
    """
    if not 2 <= fanout <= 9:
        raise ValueError("fanout must be between 2 and 9")
    spark = docs.sparkSession
    nodes = docs.select(
        F.col(group).cast("string").alias("tree"), F.col(order).cast("long").alias("key"),
        F.lit(None).cast("string").alias("name"), leaf_digest(*[F.col(c) for c in columns]).alias("digest"),
        (F.lit(None) if carried is None else carried).cast("string").alias("carried"),
    )
    leaves = _written(spark, ranked(spark, nodes), "leaves")
    below = butterfly(spark, block_roots(leaves, fanout), fanout)
    # The groups' roots are the nodes of one more tree, in which a group's place is that of its name.
    groups = below.filter("block = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("tree").alias("name"), "digest", F.lit(None).cast("string").alias("carried")
    )
    top = _written(spark, ranked(spark, groups), "groups").withColumn("key", F.col("rank"))
    above = butterfly(spark, block_roots(top, fanout), fanout)
    heads = above.select("tree", "block", F.col("digest").alias("subroot"), "path", F.col("digest").alias("root"))
    to_root = proofs(top, heads, fanout).select(F.col("name").alias("_name"), F.col("path").alias("_above"), "root")
    tops = below.join(to_root, below["tree"].eqNullSafe(F.col("_name"))).select(
        "tree", "block", F.col("digest").alias("subroot"), F.concat("path", "_above").alias("path"), "root"
    )
    made = proofs(leaves, tops, fanout)
    return made.select(F.col("key").alias(order), F.col("tree").alias(group), "leaf", "path", "subroot", "root", "carried")


def verify(manifest: DataFrame, order: str = "doc_id") -> DataFrame:
    """The manifest with `proof_sha256` (H of the digests of the path), `folded_root`, to which the carried
    leaf leads along the path, and `verified`. A null carried leaf leads nowhere and is not verified."""
    fields = f"{order} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    target = arrow_schema(fields)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["proof_sha256"] = hashed([d for _, others in steps_of(row["path"]) for d in others])
                row["folded_root"] = None if row["carried"] is None else fold(row["carried"], row["path"])
                row["verified"] = row["folded_root"] == row["root"]
            if rows:
                yield _as_batch(rows, target)

    return manifest.select(order, "leaf", "path", "subroot", "root", "carried").mapInArrow(run, fields)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second id by crc32 presents a text without its line breaks, which must not pass."""
    docs = read_documents(spark, sf_dir)
    tampered = F.when(id_remainder(2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    presented = leaf_digest(*[tampered if c == "text" else F.col(c) for c in LEAF_COLUMNS])
    return verify(dataset_manifest(docs, carried=presented))


def _sql() -> str:
    """Levels one by one, as many as 3^12 nodes of one tree need."""
    part = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')".format
    text = "CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    columns = [part(f"CAST({c} AS VARCHAR)") for c in LEAF_COLUMNS[:-1]]
    levels = 12
    ctes = [
        # crc32 bit by bit: DuckDB has no such function.
        """ids AS (SELECT DISTINCT doc_id FROM documents)""",
        """crcs AS (
      SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT,
          list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
        lambda h, b: list_reduce(list_prepend(xor(h, b), list_transform(range(8), lambda x: CAST(x AS UBIGINT))),
          lambda r, x: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END)), 4294967295::UBIGINT) AS crc
      FROM ids)""",
        f"""leaves AS (
      SELECT doc_id, source, sha256({" || ".join([*columns, part("text")])}) AS leaf,
        sha256({" || ".join([*columns, part(f"({text})")])}) AS presented
      FROM documents JOIN crcs USING (doc_id))""",
        """s0 AS MATERIALIZED (
      SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, leaf AS digest,
        count(*) OVER (PARTITION BY source) AS n FROM leaves)""",
        """p0 AS MATERIALIZED (
      SELECT doc_id, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, leaf,
        presented AS folded, '' AS proof FROM leaves)""",
    ]

    def climbing(nodes: str, walk: str, last: int) -> None:
        for k in range(last):
            ctes.append(f"""{nodes}{k + 1} AS MATERIALIZED (
      SELECT tree, CASE WHEN n > 1 THEN i // 3 ELSE 0 END AS i,
        CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY {nodes}{k}.i)) ELSE max(digest) END AS digest,
        (max(n) + 2) // 3 AS n FROM {nodes}{k} GROUP BY tree, CASE WHEN n > 1 THEN i // 3 ELSE 0 END)""")
            ctes.append(f"""{walk}{k + 1} AS MATERIALIZED (
      SELECT doc_id, any_value(w.tree) AS tree, w.i // 3 AS i, any_value(leaf) AS leaf,
        CASE WHEN max(n) > 1 THEN sha256(string_agg(CASE WHEN s.i = w.i THEN folded ELSE digest END, '' ORDER BY s.i))
             ELSE any_value(folded) END AS folded,
        any_value(proof) || CASE WHEN max(n) > 1 THEN coalesce(string_agg(digest, '' ORDER BY s.i) FILTER (WHERE s.i <> w.i), '')
                                 ELSE '' END AS proof
      FROM {walk}{k} w JOIN {nodes}{k} s ON s.tree IS NOT DISTINCT FROM w.tree AND s.i // 3 = w.i // 3
      GROUP BY doc_id, w.i // 3)""")

    climbing("s", "p", levels)
    ctes.append(f"""sources AS (
      SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i,
        count(*) OVER () AS n FROM s{levels})""")
    ctes.append("t0 AS MATERIALIZED (SELECT 0 AS tree, i, subroot AS digest, n FROM sources)")
    ctes.append(f"""q0 AS MATERIALIZED (
      SELECT doc_id, 0 AS tree, x.i, leaf, folded, proof FROM p{levels} p JOIN sources x ON x.tree IS NOT DISTINCT FROM p.tree)""")
    climbing("t", "q", levels)
    return f"""WITH {", ".join(ctes)}
    SELECT q.doc_id, q.leaf, x.subroot, t.digest AS root, sha256(q.proof) AS proof_sha256, q.folded AS folded_root,
      q.folded = t.digest AS verified
    FROM q{levels} q JOIN p0 ON p0.doc_id = q.doc_id JOIN sources x ON x.tree IS NOT DISTINCT FROM p0.tree
    CROSS JOIN t{levels} t"""


ORACLE = {"op13_merkle_manifest": _sql()}
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
