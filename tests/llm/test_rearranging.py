"""Fill-in-the-middle, line de-duplication and the Merkle manifest on odd inputs, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from minutemill.llm import fill_middle, line_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, tree string, print string, digest string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COMMON = "This very line stands in many of the documents here."


def _frame(spark, rows, partitions=3):
    full = [(i, t, "en" if i else None, source, len(t or ""), "x", None, "y", "z") for i, t, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def odd_rows():
    """Null and repeated ids, null, empty, blank and very long texts, sentinels, shared lines, a hot source."""
    rng = random.Random(5)
    words = "alpha beta gamma delta é🙂 straße Ünit".split()
    lines = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 8, 9, 12, 15, 20, 30, 9, 11, 14)]

    def text(i):
        own = f"{i} own line with enough characters to count as one"
        return "\n".join([rng.choice(lines).upper() if rng.random() < 0.2 else "  " + rng.choice(lines) for _ in range(8)] + [own])

    rows = [(i, text(i), f"s{rng.randrange(4)}") for i in range(60)]
    rows += [(100 + i, f"{COMMON}\n{i}\n \t{COMMON.lower()}\x0b", "hot") for i in range(70)]
    rows += [(200, None, None), (201, "", None), (202, " \n\t", ""), (203, "a <M> b", "é"), (204, "é" * 39 + "\n" + "é" * 40, "z")]
    rows += [(205 + i, "é" * 39 + "\n" + "É" * 40, "z") for i in range(6)]
    rows += [(220, "x y " * 60_000, "s1"), (221, "w" * 100_000, "s1"), (222, "  lead", "s2"), (223, "trail \n\n", "s2")]
    rows += [(3, rows[3][1], "s9"), (3, "other text of id 3\n" + COMMON, "s9"), (None, COMMON, "s1"), (None, None, "s1")]
    return rows


def _tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_middle(spark, odd_rows):
    def brute(i, text):
        text = text or ""
        units = UNIT.findall(text)
        digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
            return i, len(units), "plain", None, None, text, text
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "spm" if h4 % 100 < 80 else "psm"
        made = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
        return i, len(units), form, len(p), len(m), made, text

    found = _tuples(fill_middle.restore_texts(fill_middle.fill_in_middle(_frame(spark, odd_rows))))
    assert found == sorted((brute(i, t) for i, t, _ in odd_rows), key=repr)
    assert {row[2] for row in found} == {"plain", "psm", "spm"}


def test_rates_of_forms():
    forms = collections.Counter(fill_middle.transform(i, b"a b c")[1] for i in range(4_000))
    assert 0.46 < forms["plain"] / 4_000 < 0.54 and 0.75 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.85
    assert {fill_middle.transform(i, b"a b c", rate=0)[1] for i in range(50)} == {"plain"}
    assert {fill_middle.transform(i, b"a b c", rate=100, spm_rate=0)[1] for i in range(50)} == {"psm"}


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_rotation_and_its_inverse(monkeypatch, block):
    monkeypatch.setattr(fill_middle, "SWAPPED_BYTES", block)
    rng = random.Random(block)
    for _ in range(50):
        data = rng.randbytes(rng.randrange(1, 200))
        start, split, end = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        buffer = bytearray(data)
        fill_middle.rotate(buffer, start, split, end)
        assert buffer == data[:start] + data[split:end] + data[start:split] + data[end:]
        fill_middle.rotate(buffer, start, start + end - split, end)
        assert buffer == data


def _kept_lines(rows, least_chars, least_documents):
    """doc_id, lines, dropped, kept text."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    def place(i):
        return -(2**63) if i is None else i

    holders = collections.defaultdict(set)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(place(i))
    result = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [
            line for line in lines
            if len(key(line)) < least_chars or len(held := holders[key(line)]) < least_documents or max(held) == place(i)
        ]
        result.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(result, key=repr)


@pytest.mark.parametrize("partitions, least", [(1, 5), (4, 2), (23, 5)])
def test_line_dedup(spark, odd_rows, partitions, least):
    """With many ranges, the common line fills several of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = _frame(spark, odd_rows)
        bitmaps = line_dedup.keep_bitmaps(docs, least_documents=least)
        expected = _kept_lines(odd_rows, 40, least)
        assert _tuples(line_dedup.kept_texts(docs, bitmaps)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(row[2] for row in expected) >= 2


def test_keep_bitmaps(spark, odd_rows):
    bitmaps = line_dedup.keep_bitmaps(_frame(spark, odd_rows))
    rows = bitmaps.collect()
    assert len(rows) == len(odd_rows) and bitmaps.columns == ["doc_id", "print", "n_lines", "n_dropped", "keep"]
    for row in rows:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(row.keep), np.uint8), count=row.n_lines, bitorder="little")
        assert row.n_lines - bits.sum() == row.n_dropped


@pytest.mark.parametrize("seed", range(4))
def test_ranges_settle_every_key(seed):
    """Any cut of the sorted lines into ranges, read in pieces of any size, gives the same drops."""
    rng = random.Random(seed)
    lines = sorted((rng.choice([1, 1, 1, 2, 3, 4, 5, 6]), 7, -rng.randrange(12), 0, p) for p in range(120))
    lines = np.array([(h, w, -d, x, p) for h, w, d, x, p in lines], np.int64)
    documents = collections.defaultdict(set)
    for h, _, d, _, _ in lines.tolist():
        documents[h].add(d)
    expected = sorted(p for h, _, d, _, p in lines.tolist() if len(documents[h]) >= 4 and d != max(documents[h]))
    changes = [i for i in range(1, len(lines)) if tuple(lines[i, [0, 2]]) != tuple(lines[i - 1, [0, 2]])]
    cuts = sorted(rng.sample(changes, 6))
    dropped, opened, spread = [], [], collections.defaultdict(list)
    for part in np.split(lines, cuts):
        state, at, held = line_dedup._Range(4), 0, []
        while at < len(part):
            step = rng.randrange(1, 9)
            held += list(state.read(part[at : at + step]))
            at += step
        held += list(state.finish())
        for kind, rows, n in held:
            if kind == line_dedup._SUMMARY:
                spread[int(rows[0, 0])].append((int(rows[0, 2]), n))
            else:
                (dropped if kind == line_dedup._DROP else opened).extend(rows.tolist())
    assert sum(map(len, spread.values())) <= 2 * 7
    late = [
        r for r in opened if sum(n for _, n in spread[r[0]]) >= 4 and r[2] < max(d for d, _ in spread[r[0]])
    ]
    assert sorted(r[4] for r in dropped + late) == expected


def _brute_manifest(rows, fanout=3):
    """doc_id, leaf, subroot, root, proof digests of each row."""
    def part(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def up(level):
        return [_sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]

    def proof(level, place):
        others = []
        while len(level) > 1:
            start = place - place % fanout
            others += [d for k, d in enumerate(level[start : start + fanout], start) if k != place]
            level, place = up(level), place // fanout
        return others, level[0]

    groups = collections.defaultdict(list)
    for i, text, source in rows:
        leaf = _sha("".join(map(part, (i, source, "en" if i else None, len(text or ""), text))))
        groups[source].append(((i is not None, i or 0), leaf, i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: [leaf for _, leaf, _ in sorted(groups[s])] for s in names}
    subroots = {s: proof(leaves[s], 0)[1] for s in names}
    result = []
    for place, s in enumerate(names):
        above, root = proof(list(subroots.values()), place)
        for k, (_, leaf, i) in enumerate(sorted(groups[s])):
            result.append((i, leaf, subroots[s], root, _sha("".join(proof(leaves[s], k)[0] + above))))
    return sorted(result, key=repr)


@pytest.mark.parametrize("block, fanout", [(3, 3), (3**7, 3), (4, 2)])
def test_manifest(spark, odd_rows, monkeypatch, block, fanout):
    """Small blocks make the sources climb several rounds with smaller last subtrees."""
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", block)
    manifest = merkle.dataset_manifest(_frame(spark, odd_rows), fanout=fanout, carried=F.col("lang"))
    found = merkle.verify(manifest.withColumn("carried", F.col("leaf")))
    assert found.filter("NOT verified OR folded_root <> root").isEmpty()
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256"]
    assert _tuples(found.select(columns)) == _brute_manifest(odd_rows, fanout)


def test_trees_of_every_shape(spark, monkeypatch):
    """Sources of many sizes, so that subtrees of all shapes meet in every round."""
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 3)
    sizes = [1, 2, 3, 4, 8, 9, 10, 27, 28, 31, 55, 82]
    rows = [(1000 * n + i, f"text {i}", f"of {n}") for n in sizes for i in range(n)]
    found = merkle.verify(merkle.dataset_manifest(_frame(spark, rows)).withColumn("carried", F.col("leaf")))
    assert _tuples(found.select("doc_id", "leaf", "subroot", "root", "proof_sha256")) == _brute_manifest(rows)
    assert found.filter("NOT verified").isEmpty()


def test_tampered_leaf_is_found(spark, odd_rows):
    docs = _frame(spark, odd_rows)
    changed = F.when(F.col("doc_id") == 5, F.lit("changed")).otherwise(F.col("text"))
    presented = merkle.leaf_digest(*[changed if c == "text" else F.col(c) for c in merkle.LEAF_COLUMNS])
    found = merkle.verify(merkle.dataset_manifest(docs, carried=presented))
    assert [r.doc_id for r in found.filter("NOT verified").collect()] == [5]
    assert merkle.verify(merkle.dataset_manifest(docs)).filter("verified").isEmpty()  # nothing was presented


def test_empty_tables(spark):
    none = _frame(spark, [], 1)
    assert fill_middle.restore_texts(fill_middle.fill_in_middle(none)).isEmpty()
    assert line_dedup.kept_texts(none, line_dedup.keep_bitmaps(none)).isEmpty()
    assert merkle.verify(merkle.dataset_manifest(none)).isEmpty()


@pytest.mark.parametrize("query", [fill_middle.op11_fill_in_middle, line_dedup.op12_line_dedup, merkle.op13_merkle_manifest])
def test_registered_queries_equal_their_sql(spark, query):
    from tests.conftest import SF_DIR
    from tools.compare import connect, difference

    sql = {**fill_middle.ORACLE, **line_dedup.ORACLE, **merkle.ORACLE}[query.__name__]
    assert difference(query(spark, SF_DIR).toPandas(), connect(SF_DIR).execute(sql).df()) is None
