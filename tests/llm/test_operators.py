"""The ten operators on small odd inputs, against brute force, round trips or held-out accuracy."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from minutemill.llm import (
    bpe, bwt, common, hamming, jaccard, language, licenses, orc_ids, packing, pitman_yor, quality, suffix_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, tokens string, node long"
WORDS = "the of and to in a is that it for on was be with as by at from this have".split()


def _frame(spark, rows, partitions=3):
    full = [(i, t, lang, None, None, "x", None, 5) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


@pytest.fixture(scope="module")
def odd_rows():
    """Null and repeated ids, null, empty, blank and long texts, copies, shared passages, odd characters."""
    rng = random.Random(3)
    prose = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(90)) for _ in range(12)]
    rows = [(i, text, "en") for i, text in enumerate(prose)]
    rows += [(20 + i, text, "en") for i, text in enumerate(prose[:4])]
    rows += [(30 + i, text.replace(" ", "  ", 3) + "\nlast line.", "en") for i, text in enumerate(prose[:6])]
    rows += [(40 + i, f"{i} start " + prose[7][100:300] + f" end {i}" * 9, "en") for i in range(5)]
    rows += [(50, None, "en"), (51, "", None), (52, " \t\n", "de"), (53, "one two", "de"), (54, "One TWO", "de")]
    rows += [(55, "a" * 3000, "fr"), (56, "é🙂ß " * 200, "fr"), (57, "x\x00y\x1f   z\xa0", "fr"), (58, "\n".join(["same line here."] * 30), "fr")]
    rows += [(None, prose[0], "en"), (None, None, None), (3, prose[3], "en"), (60, " ".join(prose), "en")]
    return rows


def _tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _words(text):
    return (text or "").encode().lower().split()


def test_empty_table(spark):
    none = _frame(spark, [], 1)
    model = language.fit([], [])
    ranks = {bytes([b]): b for b in range(256)}
    codes = hamming.binary_codes(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    results = [
        quality.quality_rules(none), quality.clean_documents(none), language.predict(none, model), language.keep_identified(none),
        bpe.encode_documents(none, bpe.serialise_model(ranks), r"\w+|\W+"), jaccard.jaccard_components(none),
        jaccard.keep_one_of_each(none), suffix_dedup.removed_passages(none), suffix_dedup.remove_repeats(none),
        packing.pack_documents(none, packing.production_model()), licenses.scan_licenses(none, licenses.TEMPLATES),
        pitman_yor.score_documents(none, F.lit(True)), hamming.nearest_codes(codes, codes, 3),
        orc_ids.token_rows(none, packing.production_model()),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_quality_counts(spark, odd_rows):
    def brute(text):
        text = text or ""
        words = text.encode().split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        lines = [line for line in text.split("\n") if line.encode().split()]
        return len(words), len(again), len(lines) - len(set(lines))

    found = quality.quality_rules(_frame(spark, odd_rows)).select("doc_id", "n_words", "n_repeat_words", "n_dup_lines")
    assert _tuples(found) == sorted([(i, *brute(t)) for i, t, _ in odd_rows], key=repr)


@pytest.mark.parametrize(
    "line, fails",
    [("A plain line of prose.", False), ("Home | About | Contact", True), ("Sign in", True), ("All rights reserved.", True),
     ("so!!! many!!! marks!!!", True), ("He said: \"well, yes.\"", False), ("Alle Rechte vorbehalten.", True),
     ("Tous droits réservés.", True), ("  Política de privacidad", True), ("Conditions d'utilisation", True), ("Impressum", True),
     ("word " * 300 + "See our privacy policy for details.", False)],
)
def test_line_rules(line, fails):
    assert quality.line_fails(line) is fails


def test_cleaning_keeps_columns_and_cuts_lines(spark):
    prose = " ".join(f"word{i}" for i in range(40)) + "."
    rows = [(1, prose + "\nAll rights reserved.\n" + prose.upper(), "en"), (2, "Home | A | B | C\n" * 20, "en"), (None, prose, None)]
    docs = _frame(spark, rows)
    out = quality.clean_documents(docs)
    assert out.columns == docs.columns
    assert _tuples(out.select("doc_id", "text")) == sorted([(1, prose + "\n" + prose.upper()), (None, prose)], key=repr)


def test_bpe_equals_tiktoken_and_comes_back(spark, odd_rows):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "B", "12", "'s", "é", "　", "\x1c", "\xa0", "!", "🙂", "日本", "<|endoftext|>", "\x00"]
    rows = odd_rows + [(100 + i, "".join(rng.choices(parts, k=rng.randrange(40))), None) for i in range(300)]
    docs = _frame(spark, rows)
    found = bpe.encode_documents(docs, bpe.serialise_model(bpe.read_ranks(path)), public_tokenizers.PATTERN)
    got = sorted(((i, bytes(ids), bytes(back)) for i, ids, back in found.collect()), key=repr)
    want = [(i, np.array(reference.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows]
    assert got == sorted(want, key=repr)


def test_string_kernel_language(spark):
    rng = random.Random(2)
    parts = {"en": "the ing tion and wh er", "de": "sch der ung ein ö über", "fr": "eau que les é oi ment"}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join(rng.choice(parts[lang].split()) + rng.choice(parts[lang].split()) for _ in range(30)), lang))
    docs = _frame(spark, rows)
    held = common.id_remainder(3) == 1
    model = language.fit_documents(docs.filter(~held), per_language=40)
    found = {r[0]: r for r in language.predict(docs.filter(held), model).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows if i in found)
    odd = _frame(spark, [(1, None, None), (2, "123 !!", "en"), (3, "", "de"), (None, "der schung einung über", None)])
    assert _tuples(language.predict(odd, model).drop("score")) == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "de")], key=repr)
    assert [r.doc_id for r in language.keep_identified(docs.union(odd)).filter("doc_id is null").collect()] == [None]


def test_rare_languages_stay_in_the_model(spark):
    rows = [(100 * k + i, f"{'abcdefgh'[k] * 3} word", f"l{k}") for k in range(8) for i in range(60)]
    rows += [(5000 + i, "zzz rare", "rare") for i in range(3)]
    model = language.fit_documents(_frame(spark, rows), per_language=30, most=100)
    assert model.languages == [f"l{k}" for k in range(8)] + ["rare"]
    assert language.predict_texts(language.fit_documents(_frame(spark, rows), most=4, landmarks=2), ["zzz"])[0] == ["rare"]


def test_long_texts_of_many_characters():
    rng = np.random.default_rng(4)

    def text(first, n):
        return "".join(map(chr, first + (rng.zipf(1.3, n) - 1) % 3000))

    short, long = [text(0x4E00, 300) for _ in range(6)], [text(0x6000, 3000) for _ in range(6)]
    model = language.fit(short + long, ["zh"] * 6 + ["ja"] * 6)
    asked = [text(0x4E00, 500_000), text(0x6000, 500_000), text(0x4E00, 300)]
    assert language.predict_texts(model, asked)[0] == ["zh", "ja", "zh"]
    sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 1 - n)} for t in (f" {x} " for x in (asked[0], *short, *long))]
    want = [len(sets[0] & x) / math.sqrt(len(sets[0]) * len(x)) for x in sets[1:]]
    assert sorted(model.marks.kernel(language.grams(asked[0], 3))) == pytest.approx(sorted(want))


def _brute_components(rows):
    sets = {}
    for i, text, _ in rows:
        if i is not None:
            w = _words(text)
            sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted((i, len(s), top(i)) for i, own in sets.items() for s in own)


def test_jaccard_components(spark, odd_rows):
    rng = random.Random(8)
    base = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(120)]
    near = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
        near.append((200 + i, " ".join(words[: rng.randrange(95, 121)]), "en"))
    rows = odd_rows + near
    found = jaccard.jaccard_components(_frame(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == _brute_components(rows)
    kept = jaccard.keep_one_of_each(_frame(spark, rows))
    wanted = {i for i, _, c in _brute_components(rows) if i == c}
    assert {r.doc_id for r in kept.collect()} == wanted | {None} and len(kept.columns) == 8


def test_jaccard_links(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_TOKENS", 300)  # several cells in each band of sizes
    rng = random.Random(18)
    rows = [r for r in odd_rows if [x[0] for x in odd_rows].count(r[0]) == 1 and r[0] is not None]
    for group in range(4):
        base = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.choice([9, 40, 150]))]
        for i in range(25):
            words = base[: rng.randrange(len(base) * 3 // 4, len(base) + 1)]
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(3))
            rows += [(1000 + 100 * group + 4 * i + k, " ".join(words), "en") for k in range(rng.choice([1, 1, 3]))]
    sets = {}
    for i, text, _ in rows:
        w = _words(text)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links = {(a, b) for a in sets for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    class_of = {i: min([i, *(a for a in sets if sets[i] and sets[a] == sets[i])]) for i in sets}
    found = jaccard.jaccard_components(_frame(spark, rows)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == {i: (class_of[i], sum(a == i for a, _ in links)) for i in sets}
    assert len(found) == len(rows) and len(links) > 500
    between = {tuple(sorted((class_of[a], class_of[b]))) for a, b in links if class_of[a] != class_of[b]}
    assert sorted(map(tuple, jaccard.jaccard_links(_frame(spark, rows)).collect())) == sorted(between)


@pytest.mark.parametrize("dtype", ["<u8", "<u2", "<u4"])
@pytest.mark.parametrize("n", [0, 1, 1000])
def test_jaccard_coding(dtype, n):
    values = np.random.default_rng(n).integers(0, 1 << 16, n).astype(dtype)
    back = jaccard._decoded(jaccard._coded(values, dtype), dtype)
    assert back.dtype == np.dtype(dtype) and back.tolist() == values.tolist()


def test_jaccard_blocks_that_share_nothing(spark):
    """A task for each row makes blocks of one document, whose shingles occur elsewhere, nowhere or don't exist."""
    rng = random.Random(31)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(40)) for _ in range(7)]
    rows = [(i, text, "en") for i, text in enumerate([*texts, texts[0], texts[3] + " more", "", None, " ", "one"])]
    found = jaccard.jaccard_components(_frame(spark, rows, len(rows))).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == _brute_components(rows)


def _brute_removed(rows):
    first, known = {}, [(i, (t or "").encode()) for i, t, _ in rows if i is not None]
    for i, t in known:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    for i, t in known:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        yield i, len(t), sum(gone), sum(g and not gone[k - 1] if k else g for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def test_removed_passages(spark, odd_rows):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab c") for _ in range(300)) for _ in range(4)]
    rows = odd_rows + [
        (100 + i, "".join(rng.choice(base)[(x := rng.randrange(200)) : x + rng.randrange(100)] for _ in range(rng.randrange(6))), None)
        for i in range(60)
    ]
    assert sorted(map(tuple, suffix_dedup.removed_passages(_frame(spark, rows)).collect())) == sorted(_brute_removed(rows))
    docs = _frame(spark, rows)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    lengths = {i: n - gone for i, n, gone, _, _ in _brute_removed(rows) if i not in (3, 56)}
    assert all(len((r.text or "").encode()) == lengths[r.doc_id] for r in out.collect() if r.doc_id in lengths)


def test_merged_transform_intervals():
    rng = random.Random(9)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(30))).encode() for _ in range(25)]
    values = np.array([rng.randrange(100) for _ in strings])
    for depth in (1, 3, 8):
        found = bwt.window_minimum(strings, values, depth, shards=3)
        for s, minimum in zip(strings, found):
            want = [min(v for t, v in zip(strings, values) if s[k : k + depth] in t) for k in range(len(s) - depth + 1)]
            assert minimum.tolist() == want


def test_packing_places_each_id_once(spark, odd_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(packing.production_model())
    rows = [r for r in odd_rows if r[0] is not None]
    pieces = packing.pack_documents(_frame(spark, rows), packing.production_model()).toPandas()
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = pieces[pieces.doc_id == i].sort_values("start")
        joined = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert joined == ids * (len(joined) // len(ids)) or sorted(joined) == sorted(ids * (len(joined) // len(ids)))
        assert all(zlib.crc32(x) == c for x, c in zip(own.ids, own.ids_crc32)) and (own.doc_tokens == len(ids)).all()
    for _, one in pieces.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *one.length.cumsum().tolist()[:-1]] and one.length.sum() <= 1024


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(4).integers(1, 257, 1000)
    window, count = packing.pack(sizes, 1024)
    sums = np.bincount(window, sizes, count)
    assert sums.max() <= 1024 and count <= -(-sizes.sum() // 1024) + 2 and sums.max() - sums.min() < 40


def test_orc_round_trip(spark, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(packing.production_model())
    rows = [r for r in odd_rows if r[0] not in (None, 3)]
    path = str(tmp_path / "ids")
    orc_ids.write_ids(orc_ids.token_rows(_frame(spark, rows), packing.production_model()), path)
    found, start = {r.doc_id: r for r in orc_ids.read_ids(spark, path).collect()}, 0
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids) == (start, len(ids), ids)
        start += len(ids)
    one = orc_ids.look_up(spark, path, [55])
    assert [r.doc_id for r in one.collect()] == [55]
    assert "doc_id" in one._jdf.queryExecution().toString().split("PushedFilters")[1][:80]


def test_orc_rows_ask_for_a_word_once(spark, monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    from minutemill.llm import chunks

    asked = []

    def encode_many(parts):
        asked.extend(parts)
        return [np.frombuffer(part.encode(), np.uint8).astype("<u4").tobytes() for part in parts]

    encoder = chunks.PartEncoder(encode_many)
    monkeypatch.setattr(orc_ids, "map_batches", lambda df, fn, schema: fn)
    monkeypatch.setattr(orc_ids, "shared", lambda key, make: encoder)
    task = SimpleNamespace(taskAttemptId=lambda: -7, partitionId=lambda: 3)
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: task))
    encode = orc_ids.token_rows(_frame(spark, [(1, "", "en")]), "{}")
    texts, start = ["one word, a word.", "", "a word: word"], 0
    for ids in ([5, 6, 7], [8, 8, 9]):
        batch = pa.record_batch({"doc_id": pa.array(ids), "text": pa.array(texts)})
        for columns in encode(batch):
            assert columns["ids"].to_pylist() == [[*t.encode(), 0] for t in texts]
            assert columns["n_tokens"].tolist() == [len(t) + 1 for t in texts] and columns["part"].tolist() == [3, 3, 3]
            assert columns["local_start"].tolist() == [start, start + 18, start + 19]
            start += 32
    assert sorted(asked) == sorted(["one", "a", " a", " word", ",", ".", ":"])


def test_pitman_yor_counts_and_gain(spark, odd_rows):
    rng = random.Random(6)
    rows = odd_rows + [(300 + i, " ".join(rng.choices(WORDS, k=60)), "en") for i in range(60)]
    scored = pitman_yor.score_documents(_frame(spark, rows), common.id_remainder(5) != 1)
    learnt = collections.Counter()
    for i, text, _ in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            learnt.update([*_words(text), b""])
    n, v = sum(learnt.values()), len(learnt)
    want = collections.Counter()
    for i, text, _ in rows:
        tokens = [*_words(text), b""]
        base = sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[(i, len(tokens), sum(learnt[w] > 0 for w in tokens), n, round(base, 6))] += 1
    got = collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored.collect())
    assert got == want
    for row in pitman_yor.perplexity(scored).collect():
        assert row.perplexity < row.base_perplexity


def test_pitman_yor_has_a_restaurant_for_each_word(spark):
    """Words with the same last bytes are contexts of their own, and totals of all buckets meet."""
    learnt = [(i, ("proof alpha", "roof beta", "of gamma")[i % 3], "en") for i in range(90)]
    asked = [(100 + 3 * c + w, f"{a} {b}", "de") for c, a in enumerate(("proof", "roof", "of")) for w, b in enumerate(("alpha", "beta", "gamma"))]
    scored = pitman_yor.score_documents(_frame(spark, learnt + asked), F.col("lang") == "en")
    score = {r.doc_id: r.score for r in scored.filter("held_out").collect()}
    for c in range(3):
        for w in range(3):
            # The words before and behind are the same or as frequent: a share of 40 / 41 against what is left.
            assert c == w or score[100 + 3 * c + c] - score[100 + 3 * c + w] > (0.9 if w < 2 else 0.5)


def test_pitman_yor_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    word, context = (x.ravel() for x in np.meshgrid(np.arange(6), np.array([0x6161, 0x6261, 0x6162]), indexing="ij"))
    count = rng.integers(0, 5, len(word))
    count[word == 5] = 0
    seating = pitman_yor._Seating(6, word, context, count)
    for _ in range(3):
        customers, tables = zip(*seating.totals())
        totals = pitman_yor.Totals(5, customers, tables, (0.5, 0.6, 0.7))
        seating.sweep(totals, rng)
    customers, tables = zip(*seating.totals())
    _, _, pairs = seating.probabilities(pitman_yor.Totals(5, customers, tables, (0.5, 0.6, 0.7)))
    for c in np.unique(context):
        assert abs(pairs[context == c].sum() - 1) < 1e-9


def test_seating_matches_urn():
    """Mean number of tables of one dish alone: the exact urn against the parties of large counts."""
    rng, n, discount = np.random.default_rng(1), 400, 0.6
    tables = np.ones(2000)
    for i in range(1, n):
        weight = pitman_yor.STRENGTH + discount * tables
        tables += rng.random(2000) < weight / (weight + i - discount * tables)
    found = pitman_yor.seat(np.full(2000, n), np.ones(2000, int), np.zeros(2000), np.ones(2000), discount, rng)
    assert abs(found.mean() - tables.mean()) < 0.03 * tables.mean()


def test_parts_of_texts_have_the_ids_of_the_whole():
    """Line breaks between words, beside spaces, doubled, at the ends, and odd white space, in any order of learning."""
    from minutemill.llm import chunks

    encoder = chunks.tokenizers_encoder(packing.production_model(), limit=40)
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(packing.production_model())
    library.encode_special_tokens = True
    rng = random.Random(11)
    pieces = ["\n", "\n", " ", " ", "word", "it's", "Next", "42", ".", "\t", "\r", "\u00a0", "\x1c", "\u2028", "\u4e00", "<|endoftext|>", "'s", "\x85"]
    texts = ["", "\n", " ", "a\nb", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "a\t\nb\n'll c"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(3000)]
    for i in range(0, len(texts), 50):
        some = texts[i : i + 50]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        assert encoder(some) == want


def test_a_part_is_encoded_once_for_all_its_places_and_marks():
    """One request for a word, whichever mark stands behind it, in however many texts; ids as of whole texts."""
    import pyarrow as pa

    from minutemill.llm import chunks

    asked = []

    def encode_many(parts):
        asked.extend(parts)
        return [np.frombuffer(part.encode(), np.uint8).astype("<u4").tobytes() for part in parts]

    encoder = chunks.PartEncoder(encode_many)
    texts = pa.array(["dropped", "", "a word, a word. a word", "a word: a\nword;", "", "word\u00e9, word!x"]).slice(1)
    ids, bounds = encoder.encode(texts)
    assert ids.astype(np.uint8).tobytes().decode() == "".join(texts.to_pylist())
    assert bounds.tolist() == [0, *np.cumsum([len(t.encode()) for t in texts.to_pylist()])]
    assert sorted(asked) == sorted(["a", " a", " word", "\nword", ",", ".", ":", ";", "word\u00e9,", " word!x"])
    assert encoder(["", ""]) == [b"", b""] and encoder([]) == []


def test_parts_beside_white_space_of_two_and_three_bytes():
    from tokenizers import Tokenizer

    from minutemill.llm import chunks

    model = packing.production_model()
    encoder, library = chunks.tokenizers_encoder(model, limit=60), Tokenizer.from_str(model)
    library.encode_special_tokens = True
    rng = random.Random(12)
    pieces = [" ", " ", "\n", "a", "B2", "don't", ",", ".", "!?", "'", "\u00a0", "\u00e9", "\u00c2", "\u1680", "\u180e", "\u1e00",
              "\u2003", "\u2014", "\u202f", "\u205f", "\u3000", "\u3042", "\U0001f600", "\x7f", "\x1f", "\ufeff", "\u0085"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(6000)]
    for i in range(0, len(texts), 60):
        some = texts[i : i + 60]
        assert encoder(some) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_buckets_follow_the_bytes_of_text(spark):
    rows = [(1, "x" * 100, "en"), (2, "\u00e9" * 50, "en"), (3, None, "en"), (4, "", None)]
    assert common.buckets_for(_frame(spark, rows), each=30, least=2) == 7
    assert common.buckets_for(_frame(spark, rows)) == 64
    assert common.buckets_for(_frame(spark, rows[2:]), each=1, least=3) == 3


def _table_chances(n: int, parent: float, others: int, discount: float, most: int) -> np.ndarray:
    """Chances of 1 to `most` tables of one dish's n customers, straight from the weights of all seatings."""
    stirling = np.full(most + 2, -np.inf)
    stirling[1] = 0.0
    t = np.arange(1, most + 2)
    for seated in range(1, n):
        stay = np.log(np.maximum(seated - discount * t, 1e-300))
        stirling[1:] = np.logaddexp(stirling[:-1], stay + stirling[1:])
    opened = np.log(parent * (pitman_yor.STRENGTH + discount * (others + np.arange(most))))
    weights = stirling[1 : most + 1] + np.cumsum(opened)
    chances = np.exp(weights - weights.max())
    return chances / chances.sum()


@pytest.mark.parametrize(
    "n, parent, others, discount",
    [(2, 0.3, 3, 0.5), (20, 0.1, 0, 0.6), (20, 0.001, 1000, 0.7), (64, 0.2, 50, 0.8), (200, 0.01, 50, 0.7), (900, 0.05, 400, 0.3),
     (1500, 0.01, 50, 0.7), (6000, 0.02, 300, 0.5), (6000, 0.0005, 20_000, 0.85)],
)
def test_seating_draws_from_the_exact_conditional(n, parent, others, discount):
    rng, repeats = np.random.default_rng(3), 20_000 if n <= pitman_yor.ROWS else 800
    chances = _table_chances(n, parent, others, discount, min(n, 600))
    mean = chances @ np.arange(1, len(chances) + 1)
    spread = math.sqrt(chances @ np.arange(1, len(chances) + 1) ** 2 - mean**2)
    customers, tables = np.full(repeats, n), np.ones(repeats, np.int64)
    for number in range(4):
        tables = pitman_yor.seat(customers, tables, np.full(repeats, others), np.full(repeats, parent), discount, rng, number == 0)
    assert abs(tables.mean() - mean) < 0.01 * mean + 4 * spread / math.sqrt(repeats)
    assert tables.min() >= 1 and tables.max() <= n


def test_seating_leaves_the_conditional_as_it_is():
    """Draws block by block keep numbers that spread over several blocks at their exact distribution."""
    rng, n, repeats, discount = np.random.default_rng(5), 1000, 8000, 0.8
    chances = _table_chances(n, 0.9, 200, discount, n)
    exact = rng.choice(np.arange(1, n + 1), repeats, p=chances)
    others, parent = np.full(repeats, 200), np.full(repeats, 0.9)
    drawn = pitman_yor.seat(np.full(repeats, n), exact, others, parent, discount, rng, False)
    assert abs(drawn.mean() - exact.mean()) < 5 * exact.std() / math.sqrt(repeats)
    assert abs(drawn.std() - exact.std()) < 0.05 * exact.std()


def test_license_scan(spark, odd_rows):
    rows = odd_rows + [(400, "x " * 33 + licenses.TEMPLATES["MIT"].upper() + ". y", "en"), (401, "released under the", None)]
    rows += [(410 + i, f"{'w ' * i}{text}\nmore", "en") for i, text in enumerate(licenses.TEMPLATES.values())]
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(_frame(spark, rows), licenses.TEMPLATES).collect()}
    assert (400, "MIT") in got and not any(i == 401 for i, _ in got)
    assert {(410 + i, name) for i, name in enumerate(licenses.TEMPLATES)} <= got


def test_short_license_notices_are_all_found(spark):
    """One shingle among others is the least of a window in no band for about one copy in eight."""
    rng = random.Random(9)
    notices = [("All rights reserved.", "All rights reserved"), ("SPDX-License-Identifier: MIT", "SPDX MIT")]
    rows = []
    for i in range(200):
        prose = [rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(30)]
        rows.append((i, " ".join(prose[:15]) + f"\n{notices[i % 2][0]}\n" + " ".join(prose[15:]), "en"))
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(_frame(spark, rows), {name: text for text, name in notices}).collect()}
    assert got == {(i, notices[i % 2][1]) for i in range(200)}
    assert {name for _, name in notices} | {"GPL-2.0", "LGPL notice", "AGPL notice", "ISC grant", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense"} <= set(licenses.TEMPLATES)


def test_license_scan_has_no_python(spark, odd_rows):
    plan = licenses.scan_licenses(_frame(spark, odd_rows), licenses.TEMPLATES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


def test_multi_index_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    vectors = [(int(i), rng.standard_normal(32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(30)] + [(2000, None), (None, vectors[0][1]), (2001, [1.0] * 5), (2002, [None] * 32)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    codes = hamming.binary_codes(rows)
    got = collections.defaultdict(list)
    for r in hamming.nearest_codes(codes, codes.filter("vec_id % 20 = 0"), 10).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append((r.distance, r.neighbor_id))
    bits = {i: [x is not None and x > 0 for x in v] + [False] * (32 - len(v)) for i, v in vectors if v is not None and i is not None}
    for i in bits:
        if i % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(bits[i], bits[j])), j) for j in bits if j != i)
            assert got[i] == near[:10]


def test_nearest_codes_over_parts_and_splits(spark, monkeypatch):
    """Several parts of the index, each searched for several splits of the queries; codes repeat."""
    monkeypatch.setattr(hamming, "PART", 40)
    monkeypatch.setattr(hamming, "QUERIES_OF_A_PART", 25)
    monkeypatch.setattr(hamming, "QUERIES_AT_ONCE", 7)
    rng = random.Random(9)
    codes = [bytes(rng.choice([0, 1, 3, 255]) for _ in range(4)) for _ in range(120)]
    rows = [(i, rng.choice(codes)) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, code binary").repartition(5)
    asked = table.filter("vec_id % 3 = 0")
    found = collections.defaultdict(list)
    for r in hamming.nearest_codes(table, asked, 4).orderBy("vec_id", "rank").collect():
        found[r.vec_id].append((r.distance, r.neighbor_id))
    for i, code in rows[::3]:
        near = sorted((sum((x ^ y).bit_count() for x, y in zip(code, other)), j) for j, other in rows if j != i)
        assert found[i] == near[:4]
