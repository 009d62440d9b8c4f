"""Exact Jaccard self-join of documents on word shingles, with skipping by set relations.

1. Tasks hash shingles and send each distinct hash of a block of documents once, with its count, to the
   bucket of the hash; buckets send back the hashes that occur in two documents or more. Shingles of one
   document only can match nothing, and a document needs 80 % of its set shared to be linked at all.
   Hashes met twice within a block stay with the block and are counted only, so a hash that every
   document has costs one entry for each block.
2. Documents left over with equal sets are one class, whose first document stands for it.
3. Shingles are ordered rarest first; two linked sets share one among the first |x| - ceil(0.8 |x|) + 1 of
   each. The lists of these prefix shingles are sorted by set size and cut into blocks. A block's
   first set is its pivot and is compared with the block only; pairs that sizes and positions
   rule out are skipped.
4. A set linked with a pivot takes over the pivot's answers: sets that are connected already need no
   comparison. Components that still meet in a list are compared part by part, sets sorted by size and parts
   skipped by size; the common counts of a set are derived from those of the set before it. Tasks return
   links that connect components and no pairs, and no pair is left out that could change a component.
5. Links are counted, or named, inside the components found, between cells of similar sizes, with the same derived
   counts; a class counts once, with the number of its documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minutemill.llm.chunks import release
from minutemill.llm.common import arrow_schema, components, id_and_text, read_documents, shingle_hashes, to_batch
from minutemill.session import scratch_path

# Documents, and shingles, of a block; sets of a block of a prefix list; sets of a part of a group; shingles of a cell.
BLOCK_DOCS, BLOCK_SHINGLES, LIST_BLOCK, PART_SETS, PART_TOKENS = 60_000, 1 << 19, 64, 512, 1 << 19
LOCAL = 0xFFFF  # in place of a document's number: the block knows the documents itself

_PARCEL = "target long, kind int, block long, hashes binary, numbers binary, counts binary"
_SETS = "doc_id long, n_shingles long, tokens binary, digest binary"


def _blob(values, dtype) -> bytes:
    return np.ascontiguousarray(values, dtype).tobytes()


def _coded(values: np.ndarray, dtype: str) -> bytes:
    """Compressed planes of two bytes, or of one; sorted hashes of one bucket share their upper planes. May be empty."""
    import zstandard

    plane = np.dtype("<u2" if dtype == "<u8" else "u1")
    columns = np.ascontiguousarray(values, dtype).view(plane).reshape(-1, np.dtype(dtype).itemsize // plane.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(columns.T).tobytes())


def _decoded(blob: bytes, dtype: str) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u2" if dtype == "<u8" else "u1")
    planes = np.dtype(dtype).itemsize // flat.itemsize
    return np.ascontiguousarray(flat.reshape(planes, -1).T).reshape(-1).view(dtype)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, sets, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(doc_id)
            sets.append(shingle_hashes(text, size))
            held += len(sets[-1])
            if len(ids) >= BLOCK_DOCS or held >= BLOCK_SHINGLES:
                yield ids, sets
                ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def shared_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, tokens, digest) of every document.

    tokens: the hashes that other documents have as well, rarest first, if they are `percent` of the set
    or more; else null. digest: equal for equal sets.
    """
    spark = docs.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parcel, sets_schema = arrow_schema(_PARCEL), arrow_schema(_SETS)

    def send(batches):
        from pyspark import TaskContext

        release()
        base = TaskContext.get().partitionId() << 24
        for number, (ids, sets) in enumerate(_blocks(batches, size)):
            block = base + number
            sizes = np.array([len(s) for s in sets], np.int64)
            hashes = np.concatenate(sets)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            first = np.ones(len(hashes), bool)
            first[1:] = hashes[1:] != hashes[:-1]
            at = np.nonzero(first)[0]
            counts = np.diff(np.append(at, len(hashes)))
            several = np.repeat(counts > 1, counts)
            # Documents and what they share within the block go straight to the block's own place.
            rows = {c: [] for c in parcel.names}

            def add(*values):
                for c, v in zip(parcel.names, values):
                    rows[c].append(v)

            known = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
            add(block % buckets, 0, block, _blob(known, "<i8"), _blob(sizes, "<i8"), b"")
            add(block % buckets, 1, block, _coded(hashes[several], "<u8"), _coded(owner[several], "<u2"), b"")
            unique, number_of = hashes[at], np.where(counts > 1, LOCAL, owner[at])
            # A bucket is a range of hashes, so what a block sends to it is in order.
            place = ((unique >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            ends = np.searchsorted(place, np.arange(buckets + 1))
            for b in np.nonzero(np.diff(ends))[0].tolist():
                part = slice(ends[b], ends[b + 1])
                add(b, 2, block, _coded(unique[part], "<u8"), _coded(number_of[part], "<u2"), _coded(counts[part], "<u4"))
            yield to_batch(rows, parcel)

    def count(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind"))
        passed = table.filter(pa.array(kinds < 2))
        counted = table.filter(pa.array(kinds == 2))
        if counted.num_rows == 0:
            return passed
        parts = [_decoded(x, "<u8") for x in counted.column("hashes").to_pylist()]
        hashes = np.concatenate(parts)
        counts = np.concatenate([_decoded(x, "<u4") for x in counted.column("counts").to_pylist()])
        numbers = np.concatenate([_decoded(x, "<u2") for x in counted.column("numbers").to_pylist()])
        order = np.argsort(hashes, kind="stable")
        at = np.ones(len(order), bool)
        at[1:] = hashes[order][1:] != hashes[order][:-1]
        group = np.cumsum(at) - 1
        total = np.zeros(len(order), np.int64)
        total[order] = np.bincount(group, counts[order])[group]
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        rows = {c: [] for c in parcel.names}
        for i, block in enumerate(counted.column("block").to_pylist()):
            part = slice(ends[i], ends[i + 1])
            keep = total[part] > 1
            if keep.any():
                found = (hashes[part][keep], "<u8"), (numbers[part][keep], "<u2"), (total[part][keep], "<u4")
                for c, v in zip(parcel.names, (0, 2, block, *(_coded(*x) for x in found))):
                    rows[c].append(v)
        return pa.concat_tables([passed, pa.Table.from_batches([to_batch(rows, parcel)])])

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs_row = next(r for r in rows if r["kind"] == 0)
        local = next(r for r in rows if r["kind"] == 1)
        ids, sizes = np.frombuffer(docs_row["hashes"], "<i8"), np.frombuffer(docs_row["numbers"], "<i8")
        back = [r for r in rows if r["kind"] == 2]
        hashes = np.concatenate([_decoded(r["hashes"], "<u8") for r in back] or [np.zeros(0, "<u8")])
        owner = np.concatenate([_decoded(r["numbers"], "<u2") for r in back] or [np.zeros(0, "<u2")])
        total = np.concatenate([_decoded(r["counts"], "<u4") for r in back] or [np.zeros(0, "<u4")])
        several = owner == LOCAL
        order = np.argsort(hashes[several])
        local_hashes = _decoded(local["hashes"], "<u8")
        where = np.searchsorted(hashes[several][order], local_hashes)
        hashes = np.concatenate((hashes[~several], local_hashes))
        owner = np.concatenate((owner[~several], _decoded(local["numbers"], "<u2")))
        total = np.concatenate((total[~several], total[several][order][where]))
        order = np.lexsort((hashes, total, owner))
        hashes = hashes[order]
        ends = np.searchsorted(owner[order], np.arange(len(ids) + 1))
        tokens, digests = [], []
        for i, n in enumerate(sizes.tolist()):
            own = hashes[ends[i] : ends[i + 1]]
            enough = n > 0 and 100 * len(own) >= percent * n
            blob = own.tobytes() if enough else None
            tokens.append(blob)
            digests.append(hashlib.blake2b(blob, digest_size=16).digest() if enough and len(own) == n else None)
        null = ids == -(1 << 63)
        columns = {
            "doc_id": pa.array(ids, mask=null), "n_shingles": sizes, "tokens": tokens, "digest": digests,
        }
        return pa.Table.from_batches([to_batch(columns, sets_schema)])

    parcels = id_and_text(docs).mapInArrow(send, _PARCEL)
    answered = parcels.groupBy("target").applyInArrow(count, _PARCEL)
    return answered.groupBy("block").applyInArrow(gather, _SETS)


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Common shingles that sets of n and m must have: ceil(percent (n + m) / (100 + percent))."""
    return F.floor((percent * (n + m) + (99 + percent)) / (100 + percent))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, place): prefix shingles of each set; place counts all shingles before it."""

    def run(batches):
        target = arrow_schema("token long, node long, n long, place long")
        for batch in batches:
            columns = {c: [] for c in target.names}
            for node, n, blob in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "tokens"))):
                own = np.frombuffer(blob, "<i8")
                alone = n - len(own)
                length = max(0, n - -(-percent * n // 100) + 1 - alone)
                own = own[:length]
                columns["token"].append(own)
                columns["node"].append(np.full(len(own), node))
                columns["n"].append(np.full(len(own), n))
                columns["place"].append(alone + np.arange(len(own)))
            yield to_batch({c: np.concatenate(v or [np.zeros(0, np.int64)]) for c, v in columns.items()}, target)

    rows = sets.mapInArrow(run, "token long, node long, n long, place long")
    # A prefix shingle of one set only leads nowhere.
    alone = Window.partitionBy("token")
    return rows.withColumn("_sets", F.count(F.lit(1)).over(alone)).filter("_sets > 1").drop("_sets")


def _linked(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of pairs whose sets are similar enough, by exact intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("tokens").alias("_ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("tokens").alias("_tb"))
    both = pairs.join(right, "b").join(left, "a")

    def run(batches):
        target = arrow_schema("a long, b long")
        for batch in batches:
            keep = []
            for na, nb, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("_na", "_nb", "_ta", "_tb"))):
                x, y = np.frombuffer(ta, "<u8"), np.frombuffer(tb, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (na + nb - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=target).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _compared(spark: SparkSession, sets: DataFrame, lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a list, as few as connect them: (a, b).

    Components that meet in lists form a group. Its sets are sorted by size and cut into parts of
    PART_SETS; every two parts whose sizes can match go to one task, which returns links but no pairs.
    """
    named = lists.join(labels.select("node", "component"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    over = Window.partitionBy("token")
    least, most = F.min("component").over(over).alias("least"), F.max("component").over(over).alias("most")
    path = scratch_path(spark, "jaccard-open")
    named.select("node", "n", "component", least, most).filter("least <> most").distinct().write.parquet(path)
    open_ = spark.read.schema("node long, n long, component long, least long, most long").parquet(path)
    groups = components(spark, open_.select(F.col("component").alias("a"), F.col("least").alias("b")).filter("a <> b"))
    members = open_.select("node", "n", "component").distinct().join(
        groups.select(F.col("node").alias("component"), F.col("component").alias("team")), "component"
    )
    place = F.row_number().over(Window.partitionBy("team").orderBy("n", "node")) - 1
    path = scratch_path(spark, "jaccard-teams")
    members.withColumn("part", F.floor(place / PART_SETS)).write.parquet(path)
    members = spark.read.schema("component long, node long, n long, team long, part long").parquet(path)
    sizes = members.groupBy("team", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = sizes.select("team", F.col("part").alias("part2"), F.col("low").alias("low2"))
    pairs = sizes.join(other, "team").filter((F.col("part2") >= F.col("part")) & (100 * F.col("high") >= percent * F.col("low2")))
    pairs = pairs.select("team", "part", "part2")
    near = members.join(pairs, ["team", "part"]).select("team", "part", "part2", "node", "component", F.lit(1).alias("side"))
    far = pairs.filter("part < part2").join(members.withColumnRenamed("part", "part2"), ["team", "part2"])
    sent = near.union(far.select("team", "part", "part2", "node", "component", F.lit(2))).join(sets, "node")
    return sent.groupBy("team", "part", "part2").applyInArrow(lambda table: _links_of(table, percent), "a long, b long")


def _common_counts(node: np.ndarray, side: np.ndarray, tokens: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, common shingles with every set of the other side) for the sets of side 1, of the part itself if it is alone.

    The common counts of a set with all others come from those of the set before it: plus the lists of the
    shingles it has gained, minus the lists of those it has lost. Only where more than half
    of a set differs are they counted anew.
    """
    lengths = np.array([len(t) for t in tokens])
    distinct, at = np.unique(np.concatenate(tokens), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    second = np.nonzero(side == 2)[0] if (side == 2).any() else np.arange(len(node))
    holder = np.repeat(np.arange(len(node)), lengths)
    listed = np.isin(holder, second)
    order = np.argsort(at[listed], kind="stable")
    lists = holder[listed][order]
    starts = np.searchsorted(at[listed][order], np.arange(len(distinct) + 1))

    def count(which: np.ndarray) -> np.ndarray:
        size = starts[which + 1] - starts[which]
        places = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[which], size)
        return np.bincount(lists[places], minlength=len(node))

    last, common = np.zeros(0, np.int64), np.zeros(len(node), np.int64)
    has = np.zeros(len(distinct), bool)
    for i in np.nonzero(side == 1)[0].tolist():
        mine = at[ends[i] : ends[i + 1]]
        gained = mine[~has[mine]]
        has[last] = False
        has[mine] = True
        lost = last[~has[last]]
        if 2 * (len(gained) + len(lost)) < len(mine):
            common = common + count(gained) - count(lost)
        else:
            common = count(mine)
        last = mine
        yield i, common


def _links_of(table: pa.Table, percent: int) -> pa.Table:
    """Links that join components among the sets of one part, or between those of two."""
    rows = table.sort_by([("side", "ascending"), ("node", "ascending")])
    node, own, n, side = (np.array(rows.column(c)) for c in ("node", "component", "n", "side"))
    tokens = [np.frombuffer(x, "<u8") for x in rows.column("tokens").to_pylist()]
    root = {c: c for c in own.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    a, b = [], []
    for i, common in _common_counts(node, side, tokens):
        linked = np.nonzero(100 * common >= percent * (n[i] + n - common))[0]
        for j in linked[own[linked] != own[i]].tolist():
            x, y = top(int(own[i])), top(int(own[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(int(node[i]))
                b.append(int(node[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _paired(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(component, cell, cell2, side, node, n, tokens): the sets of every component, dealt to pairs of cells.

    Linked sets share a component and their sizes differ by a factor of 100 / percent at most, so they lie in one
    band of sizes or in neighbouring ones. A band of more than PART_TOKENS shingles is cut into cells by
    hash. Only cells of one band or of neighbouring bands meet, two at a time.
    """
    ratio = 1.000001 * math.log(100 / percent) if percent < 100 else 1.0  # a little more, for rounding
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio)).cast("int")
    several = labels.groupBy("component").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1").select("component")
    held = sets.join(labels, "node").withColumn("band", band)
    shingles = F.ceil(F.sum("n") / PART_TOKENS).cast("int").alias("cells")
    bands = held.select("component", "band", "n").groupBy("component", "band").agg(shingles)
    bands = bands.join(several, "component", "left_semi")
    cells = bands.select("component", "band", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    other = cells.select("component", F.col("band").alias("band2"), F.col("cell").alias("cell2"))
    meet = (F.col("band2") == F.col("band") + 1) | ((F.col("band2") == F.col("band")) & (F.col("cell2") >= F.col("cell")))
    pairs = cells.join(other, "component").filter(meet)
    first = pairs.withColumn("side", F.lit(1))
    second = pairs.filter("band <> band2 OR cell <> cell2").select(
        "component", F.col("band2").alias("band"), F.col("cell2").alias("cell"),
        F.col("band").alias("band2"), F.col("cell").alias("cell2"), F.lit(2).alias("side"),
    )
    # Both sides of a pair are called by the cells of its first side.
    mine = held.join(bands, ["component", "band"]).withColumn("cell", F.pmod(F.xxhash64("node"), "cells").cast("int"))
    dealt = mine.join(first.unionByName(second), ["component", "band", "cell"])
    one, two = F.struct("band", "cell"), F.struct(F.col("band2").alias("band"), F.col("cell2").alias("cell"))
    name = F.when(F.col("side") == 1, F.struct(one.alias("x"), two.alias("y"))).otherwise(F.struct(two.alias("x"), one.alias("y")))
    return dealt.select("component", name.alias("pair"), "side", "node", "n", "weight", "tokens")


def _counted_of(table: pa.Table, percent: int) -> pa.Table:
    """(node, links): documents linked with each set, among the sets of one cell or between those of two."""
    node, n, weight, linked = _all_linked(table, percent)
    links = np.zeros(len(node), np.int64)
    for i, others, both_ways in linked:
        links[i] += weight[others].sum()
        if both_ways:
            links[others] += weight[i]
    return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(links)})


def _named_of(table: pa.Table, percent: int) -> pa.Table:
    """(a, b): linked sets, a the smaller, among the sets of one cell or between those of two."""
    node, _, _, linked = _all_linked(table, percent)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, others, both_ways in linked:
        found = node[others] if both_ways else node[others][node[others] > node[i]]
        a.append(np.minimum(found, node[i]))
        b.append(np.maximum(found, node[i]))
    return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def _all_linked(table: pa.Table, percent: int):
    """(node, n, weight, iterator of (i, places of the sets linked with it, whether i is not met again from there))."""
    rows = table.sort_by([("side", "ascending"), ("n", "ascending"), ("node", "ascending")])
    node, n, weight, side = (np.array(rows.column(c)) for c in ("node", "n", "weight", "side"))
    tokens = [np.frombuffer(x, "<u8") for x in rows.column("tokens").to_pylist()]
    both_ways = bool((side == 2).any())

    def linked():
        for i, common in _common_counts(node, side, tokens) if (side == 1).any() else ():
            found = (common > 0) & (100 * common >= percent * (n[i] + n - common)) & (node != node[i])
            yield i, np.nonzero(found)[0], both_ways

    return node, n, weight, linked()


def _joined(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All sets, (a, b): documents and the first document of their class, class sets, component labels."""
    spark = docs.sparkSession
    path = scratch_path(spark, "jaccard-sets")
    shared_sets(docs.filter("doc_id IS NOT NULL"), size, percent).write.parquet(path)
    all_sets = spark.read.schema(_SETS).parquet(path)
    shared = all_sets.filter("tokens IS NOT NULL")

    classes = shared.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"))
    same_path = scratch_path(spark, "jaccard-same")
    named = shared.select("doc_id", "digest").distinct().join(classes, "digest")
    named.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).write.parquet(same_path)
    same = spark.read.schema("a long, b long").parquet(same_path)
    firsts = shared.join(classes.select(F.col("node").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    sets_path = scratch_path(spark, "jaccard-classes")
    chosen = firsts.select(*shared.columns).union(shared.filter("digest IS NULL"))
    chosen.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "tokens").write.parquet(sets_path)
    sets = spark.read.schema("node long, n long, tokens binary").parquet(sets_path)

    lists_path = scratch_path(spark, "jaccard-lists")
    by_size = Window.partitionBy("token").orderBy("n", "node")
    place = (F.row_number().over(by_size) - 1) / LIST_BLOCK
    _prefixes(sets, percent).withColumn("part", F.floor(place)).write.parquet(lists_path)
    lists = spark.read.schema("token long, node long, n long, place long, part long").parquet(lists_path)

    n, m = F.col("n"), F.col("m")
    fits = (100 * m >= percent * n) & (100 * n >= percent * m)
    # After a common shingle at these places no more than the shorter rest can be common.
    reachable = 1 + F.least(n - F.col("place") - 1, m - F.col("q") - 1) + F.least("place", "q")
    within = Window.partitionBy("token", "part").orderBy("n", "node")
    pivoted = lists.select(
        F.first("node").over(within).alias("a"), F.col("node").alias("b"), F.first("n").over(within).alias("m"),
        F.first("place").over(within).alias("q"), "n", "place",
    )
    stars = pivoted.filter(fits & (reachable >= _needed(n, m, percent)) & (F.col("a") != F.col("b")))
    links_path = scratch_path(spark, "jaccard-links")
    _linked(sets, stars.select("a", "b").distinct(), percent).union(same.filter("a <> b")).write.parquet(links_path)
    links = spark.read.schema("a long, b long").parquet(links_path)
    labels = components(spark, links)

    late_path = scratch_path(spark, "jaccard-late")
    _compared(spark, sets, lists, labels, percent).write.parquet(late_path)
    late = spark.read.schema("a long, b long").parquet(late_path)
    if not late.isEmpty():
        labels = components(spark, links.union(late))
    return all_sets, same, sets, labels


def _with_component(all_sets: DataFrame, labels: DataFrame) -> DataFrame:
    found = all_sets.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _weighted(sets: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets with the number of documents of their class, those numbers)."""
    weights = same.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("weight"))
    joined = sets.join(weights, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))
    return joined, weights


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links).

    component_id: the smallest doc_id that a document reaches over links. class_id: the smallest doc_id with an
    equal set. n_links: how many other documents it links with, copies included.

    Two documents link when 100 * common shingles >= percent * all shingles of both. A text without words
    and a null text have no shingles and link with nothing, not even with each other. Rows with a null
    doc_id take no part and are left out. Rows with the same doc_id are one document in the result's
    links but keep a row each; if their texts differ, the links of all are counted for each of their classes.
    Other columns are left behind, an empty table gives an empty one.

    Links are counted inside components only, cell by cell of similar sizes, and classes count once, with the number
    of their documents: n equal copies cost one set. n different texts that are all similar have n^2 / 2 links, which
    are counted without a row for each.
    """
    all_sets, same, sets, labels = _joined(docs, size, percent)
    weighted, weights = _weighted(sets, same)
    dealt = _paired(weighted, labels, percent).groupBy("component", "pair")
    counted = dealt.applyInArrow(lambda table: _counted_of(table, percent), "node long, links long")
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    inside = weights.join(counted, "node", "full").select(
        F.col("node").alias("class_id"),
        (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )
    classes = same.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("class_id"))
    found = _with_component(all_sets, labels).join(classes, "doc_id", "left")
    found = found.withColumn("class_id", F.coalesce("class_id", "doc_id")).join(inside, "class_id", "left")
    return found.select("doc_id", "n_shingles", "component_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_links(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(a, b): every link between documents with different sets that stand for their classes, a < b.

    With class_id of jaccard_components this names all links: documents of one class link with each other, and with
    all documents of a linked class. Rows are treated as there.
    """
    _, same, sets, labels = _joined(docs, size, percent)
    dealt = _paired(_weighted(sets, same)[0], labels, percent).groupBy("component", "pair")
    return dealt.applyInArrow(lambda table: _named_of(table, percent), "a long, b long").distinct()


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Documents that are the first of their component, as they came; a null doc_id stays."""
    all_sets, _, _, labels = _joined(docs, size, percent)
    found = _with_component(all_sets, labels)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_documents(spark, sf_dir))


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLE = {
    "op7_jaccard_join": rf"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM worded)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s)
      WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS (
      SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
      WHERE 100 * c >= 80 * (p.n + q.n - c)),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (
      SELECT doc_id AS node, doc_id AS root FROM documents
      UNION
      SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node WHERE r.root < l.b),
    partners AS (SELECT a AS doc_id, count(*) AS n_links FROM both_ways GROUP BY a),
    equal AS (
      SELECT b AS doc_id, min(a) AS class_id FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
      WHERE c = p.n AND c = q.n GROUP BY b)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id,
      coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
    FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN partners USING (doc_id) LEFT JOIN equal USING (doc_id)
    JOIN reach ON node = d.doc_id GROUP BY d.doc_id, n, class_id, n_links
    """
}
