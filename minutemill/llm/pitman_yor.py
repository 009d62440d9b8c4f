"""Hierarchical Pitman-Yor language model over words, with Chinese-restaurant seating by Gibbs sampling.

The context of a word is the word before it. The restaurant of a word has that of the word's last two bytes as
parent, which has the root, the words without context, as parent; the root's base is uniform over the known words
and one unknown word. Restaurants of words grow with the corpus as dishes (words) and customers do; only those of two
bytes, 65,536 at most, and the root go to the driver.

1. Tasks count (word, context, document) in blocks and send them to the bucket of the word. A word that is
   frequent in a block sends its counts there once for each context, and the block keeps the rest.
2. A sweep seats the customers of every bucket again, given the totals of all restaurants of the sweep
   before: first the restaurants of words, whose tables are the customers of their parents, and so
   on. Totals of the restaurants of words are added up in Spark, by a hash of the context, and sent back to the buckets
   that hold customers of them; after the first time a bucket sends numbers in a fixed order and no context. A
   sweep's tables are written out. Sampling is seeded by bucket and sweep, so a lost task gives the same again.
3. The predictive probabilities of the last `samples` sweeps are averaged; buckets return sums per document.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutemill.llm.common import arrow_schema, buckets_for, id_and_text, id_remainder, read_documents, to_batch
from minutemill.session import scratch_path

BLOCK_TOKENS, BLOCK_DOCS = 2 << 20, 60_000
# Entries of one word in a block from which on its documents stay with the block.
FREQUENT = 1024
HOME = 0xFFFF  # in place of a document's number: the block asks for the probabilities
NO_WORD = 0x2020  # no word has white space in it
STRENGTH = 1.0
LEVELS = 3
# Customers of a dish up to which all numbers of tables are weighed; numbers weighed above; customers with a row of Stirling numbers.
FULL, BLOCK, ROWS = 64, 128, 1024

_PARCEL = "target long, kind int, block long, words binary, at binary, contexts binary, before binary, docs binary, counts binary"
_PARTIAL = "block long, kind int, docs binary, words binary, contexts binary, known binary, base binary, score binary"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def _blob(values, dtype, steps: bool = False) -> bytes:
    """Numbers, or their differences, compressed with all first bytes together, then all second ones, and so on."""
    import zstandard

    values = np.ascontiguousarray(values, dtype)
    if steps:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _values(blob: bytes, dtype, steps: bool = False) -> np.ndarray:
    import zstandard

    if not blob:
        return np.zeros(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if steps else values


class _Block:
    """Words of some documents as numbers."""

    def __init__(self):
        self.known: dict[bytes, int] = {b"": 0}  # the end of a text
        self.ids: list = []
        self.train: list[bool] = []
        self.words: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id, train: bool, text: str) -> None:
        words = text.encode().lower().split()
        known = self.known
        for word in set(words).difference(known):
            known[word] = len(known)
        numbers = np.zeros(len(words) + 1, np.int64)
        numbers[:-1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.ids.append(doc_id)
        self.train.append(train)
        self.words.append(numbers)
        self.tokens += len(numbers)

    def full(self) -> bool:
        return self.tokens >= BLOCK_TOKENS or len(self.ids) >= BLOCK_DOCS

    def entries(self) -> tuple[np.ndarray, ...]:
        """Hash of each word in order, and its key as a context; word and context of each pair; pair, document and count of distinct entries.

        A key has the last two bytes of the word in its last 16 bits and 48 bits of the hash before them.
        """
        import xxhash

        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.known), np.uint64, len(self.known))
        tails = np.fromiter((w[-1] | (w[-2] if len(w) > 1 else 0x20) << 8 if w else NO_WORD for w in self.known), np.uint64, len(self.known))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = rank[np.concatenate(self.words)]
        sizes = np.array([len(w) for w in self.words])
        before = np.empty(len(words), np.int64)
        before[1:] = words[:-1]
        before[np.cumsum(sizes) - sizes] = rank[0]
        pairs, at = np.unique(words * len(order) + before, return_inverse=True)
        del words, before
        entries, counts = np.unique(at << 16 | np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
        hashes, keys = hashes[order], (hashes >> np.uint64(16) << np.uint64(16) | tails)[order]
        found = pairs // len(order), pairs % len(order), entries >> 16, entries & 0xFFFF, counts
        return hashes, keys, *(x.astype(np.int32) for x in found)


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, target = TaskContext.get().partitionId() << 24, arrow_schema(_PARCEL)

    def parcels(block: _Block) -> pa.RecordBatch:
        hashes, keys, pair_word, pair_context, at, doc, count = block.entries()
        rows = {c: [] for c in target.names}

        def add(*values):
            for c, v in zip(target.names, values):
                rows[c].append(v)

        train = np.array(block.train)
        ids = np.array([-(1 << 63) if i is None else i for i in block.ids], np.int64)
        sizes = np.array([len(w) for w in block.words])
        home = number % buckets
        add(home, 0, number, _blob(ids, "<i8"), b"", b"", b"", _blob(train, "u1"), _blob(sizes, "<i8"))
        often = (np.bincount(pair_word[at], minlength=len(hashes)) >= FREQUENT)[pair_word]
        kept, own, number_of = often[at], np.nonzero(often)[0], np.cumsum(often, dtype=np.int32) - 1
        kept_at, kept_doc, kept_count = number_of[at[kept]], doc[kept], count[kept]
        add(home, 1, number, _blob(hashes[pair_word[own]], "<u8", True), _blob(kept_at, "<u4", True), _blob(keys[pair_context[own]], "<u8", True),
            b"", _blob(kept_doc, "<u2"), _blob(kept_count, "<u4"))
        # Of frequent words the bucket gets what the documents to learn from have, and each context once.
        learnt = np.bincount(kept_at, kept_count * train[kept_doc], len(own)).astype(np.int32)
        rest = ~kept
        word = np.concatenate((pair_word[at[rest]], pair_word[own]))
        context = np.concatenate((pair_context[at[rest]], pair_context[own]))
        flags = doc[rest] | train[doc[rest]].astype(np.int32) << 16
        doc = np.concatenate((flags, np.full(len(own), HOME | 1 << 16, np.int32)))
        count = np.concatenate((count[rest], learnt))
        place = (hashes >> np.uint64(24)) % np.uint64(buckets)
        place = place.astype(np.int32)[word]
        del pair_word, pair_context, at, kept_at, kept_doc, kept_count
        order = np.lexsort((context, word, place))
        word, context, doc, count, place = (x[order] for x in (word, context, doc, count, place))
        ends = np.searchsorted(place, np.arange(buckets + 1))
        for b in np.nonzero(np.diff(ends))[0].tolist():
            part = slice(ends[b], ends[b + 1])
            (own, at), (before, which) = (np.unique(x[part], return_inverse=True) for x in (word, context))
            add(b, 2, number, _blob(hashes[own], "<u8", True), _blob(at, "<u4", True), _blob(keys[before], "<u8", True), _blob(which, "<u4"),
                _blob(doc[part], "<u4"), _blob(count[part], "<u4"))
        return to_batch(rows, target)

    block = _Block()
    for batch in batches:
        for doc_id, text, learn in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "learn"))):
            block.add(doc_id, learn, text)
            if block.full():
                yield parcels(block)
                block, number = _Block(), number + 1
    if block.ids:
        yield parcels(block)


def _collect(table: pa.Table) -> pa.Table:
    """Parcels of one target as rows of the store: the blocks' own rows, and the bucket."""
    target = arrow_schema(_STORE)
    rows = {c: [] for c in target.names}
    words, contexts, docs, counts, blocks = [], [], [], [], []
    bucket = None
    for row in table.to_pylist():
        if row["kind"] < 2:
            filled = {"kind": row["kind"], "bucket": row["block"], "words": row["words"], "contexts": row["contexts"]}
            filled |= {"entry_pair": row["at"], "entry_doc": row["docs"], "entry_count": row["counts"]}
            for c in rows:
                rows[c].append(filled.get(c))
            continue
        bucket = row["target"]
        words.append(_values(row["words"], "<u8", True)[_values(row["at"], "<u4", True)])
        contexts.append(_values(row["contexts"], "<u8", True)[_values(row["before"], "<u4")])
        docs.append(_values(row["docs"], "<u4"))
        counts.append(_values(row["counts"], "<u4"))
        blocks.append((row["block"], len(docs[-1])))
    if bucket is not None:
        word, context, doc, count = (np.concatenate(x) for x in (words, contexts, docs, counts))
        unique, at = np.unique(word, return_inverse=True)
        before, which = np.unique(context, return_inverse=True)
        keys, pair = np.unique(at * len(before) + which, return_inverse=True)
        learnt = np.bincount(pair, count * (doc >> 16), len(keys)).astype(np.int64)
        filled = {
            "kind": 2, "bucket": bucket, "words": _blob(unique, "<u8", True), "contexts": _blob(before, "<u8", True),
            "pair_word": _blob(keys // len(before), "<u4", True), "pair_context": _blob(keys % len(before), "<u4"), "pair_count": _blob(learnt, "<i8"),
            "entry_pair": _blob(pair, "<u4", True), "entry_doc": _blob(doc & 0xFFFF, "<u2"), "entry_count": _blob(count, "<u4"),
            "entry_block": _blob([b for b, _ in blocks], "<i8"), "entry_size": _blob([n for _, n in blocks], "<i8"),
        }
        for c in rows:
            rows[c].append(filled[c])
    return pa.Table.from_batches([to_batch(rows, target)])


_STORE = (
    "kind int, bucket long, words binary, contexts binary, pair_word binary, pair_context binary, pair_count binary, "
    "entry_pair binary, entry_doc binary, entry_count binary, entry_block binary, entry_size binary"
)


def _first_tables(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables to begin sampling from: customers come one by one, from the 33rd on in parties of an eighth of those seated."""
    out = np.ones(len(customers), np.int64)
    order = np.argsort(-customers, kind="stable")
    count, base, slope = customers[order], (STRENGTH + discount * others[order]) * parent[order], discount * parent[order]
    t, seated = np.ones(len(order)), 1
    while (n := int(np.searchsorted(-count, -(seated + 1), side="right"))) > 0:
        party = max(1, seated // 8) if seated >= 32 else 1
        new = base[:n] + slope[:n] * t[:n]
        t[:n] += rng.binomial(np.minimum(party, count[:n] - seated), new / (new + seated - discount * t[:n]))
        seated += party
    out[order] = t.astype(np.int64)
    return out


@lru_cache(maxsize=8)
def _log_stirling(discount: float) -> np.ndarray:
    """Log of the generalised Stirling numbers S(n, t) for n and t up to ROWS: S(n + 1, t) = S(n, t - 1) + (n - discount t) S(n, t)."""
    out = np.full((ROWS + 1, ROWS + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, ROWS):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = np.logaddexp(out[n, :n], np.log(n - discount * t) + out[n, 1 : n + 1])
        out[n + 1, n + 1] = 0.0
    return out


def _log_stirling_beyond(n: int, t: np.ndarray, discount: float) -> np.ndarray:
    """Log of S(n, t), but for a constant, where n is above ROWS.

    With B(n, t) = S(n, t) t! discount^t / Gamma(n) the rule above says that B(n + 1, t) is the mean of B(n, .) after one
    of t has left with chance discount t / n. From n down to ROWS each of t stays with chance `stay`, so
    B(n, t) is the mean of B(ROWS, .) over a binomial number.
    """
    stay = math.exp(math.lgamma(n - discount) + math.lgamma(ROWS) - math.lgamma(n) - math.lgamma(ROWS - discount))
    most = int(t[-1])
    factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, max(most, ROWS) + 1)))))
    j = np.arange(1, min(most, ROWS, int(most * stay + 10 * math.sqrt(most * stay) + 20)) + 1)
    below = _log_stirling(discount)[ROWS, j] + factorial[j] + j * math.log(discount)
    rest = t[:, None] - j
    chosen = factorial[t][:, None] - factorial[j] - factorial[np.maximum(rest, 0)]
    terms = np.where(rest >= 0, chosen + j * math.log(stay) + rest * math.log1p(-stay) + below, -np.inf)
    top = terms.max(axis=1, keepdims=True)
    return top[:, 0] + np.log(np.exp(terms - top).sum(axis=1)) - factorial[t] - t * math.log(discount)


def seat(
    customers: np.ndarray, tables: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng, first: bool = True
) -> np.ndarray:
    """A Gibbs draw of the tables of each (restaurant, dish): from their distribution given all other seats.

    others: tables of the same restaurant with other dishes; parent: the parent's probability of the dish.
    t tables of n customers have the weight S(n, t) parent^t (strength + discount others) (strength + discount (others +
    1)) ... over t factors. Up to FULL customers t is drawn from 1 to n, above from the BLOCK
    numbers around the present one, whose bounds are moved at random in each call; `first`: such dishes begin with
    seats taken one by one and not with `tables`.
    """
    out = np.minimum(customers, 1)
    largest = np.nonzero(customers > FULL)[0]
    if first and len(largest):
        tables = tables.copy()
        tables[largest] = _first_tables(customers[largest], others[largest], parent[largest], discount, rng)
    stirling, low = _log_stirling(discount), 2
    for width in (2, 3, 4, 6, 8, 12, 16, 32, FULL):
        own = np.nonzero((customers >= low) & (customers <= width))[0]
        low = width + 1
        for i in range(0, len(own), 1 << 16):
            at = own[i : i + (1 << 16)]
            weights = stirling[customers[at], 1 : width + 1]
            out[at] = 1 + _drawn(weights, np.zeros(len(at)), others[at], parent[at], discount, rng)
    shift = int(rng.integers(BLOCK))
    begins = np.maximum(1, (tables[largest] + shift) // BLOCK * BLOCK - shift)
    inside = customers[largest] <= ROWS
    for i in range(0, int(inside.sum()), 4096):
        at, begin = largest[inside][i : i + 4096], begins[inside][i : i + 4096]
        t = begin[:, None] + np.arange(BLOCK)
        end = ((tables[at] + shift) // BLOCK + 1) * BLOCK - shift  # the first block is cut at 1
        weights = np.where(t < end[:, None], stirling[customers[at][:, None], np.minimum(t, ROWS)], -np.inf)
        weights[t > customers[at][:, None]] = -np.inf
        out[at] = begin + _drawn(weights, begin - 1, others[at], parent[at], discount, rng)
    for at, begin in zip(largest[~inside].tolist(), begins[~inside].tolist()):
        end = min(((int(tables[at]) + shift) // BLOCK + 1) * BLOCK - shift, int(customers[at]) + 1)
        weights = _log_stirling_beyond(int(customers[at]), np.arange(begin, end), discount)[None]
        out[at] = begin + _drawn(weights, np.array([begin - 1]), others[at : at + 1], parent[at : at + 1], discount, rng)[0]
    return out


def _drawn(weights: np.ndarray, opened: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng) -> np.ndarray:
    """Column drawn in each row; column k stands for k + 1 tables more than those opened, weights are logs of S."""
    more = np.log((STRENGTH + discount * (others + opened))[:, None] + discount * np.arange(weights.shape[1]))
    more += np.log(parent)[:, None]
    weights = weights + np.cumsum(more, axis=1)
    weights -= weights.max(axis=1, keepdims=True)
    upto = np.cumsum(np.exp(weights, out=weights), axis=1)
    return (upto <= (rng.random(len(upto)) * upto[:, -1])[:, None]).sum(axis=1)


def _without(own, customers, tables, all_customers, all_tables, base, discount: float) -> np.ndarray:
    """A parent's probability of a dish once `own` of the dish's customers have left it."""
    left = customers - own
    return (left - discount * np.minimum(tables, left) + (STRENGTH + discount * all_tables) * base) / (STRENGTH + all_customers - own)


class _Seating:
    """The restaurants of one bucket's words at every level, seen from its (word, context) pairs.

    above: the parent of each context, below 65,536; without it the last byte of the context's number.
    """

    def __init__(self, words: int, word: np.ndarray, context: np.ndarray, count: np.ndarray, above: np.ndarray | None = None):
        self.words, self.context, self.customers = words, context.astype(np.int64), count
        self.contexts = int(self.context.max(initial=-1)) + 1 if above is None else len(above)
        parent = self.context & 0xFF if above is None else above[self.context]
        key, self.up = np.unique(word.astype(np.int64) << 16 | parent, return_inverse=True)
        self.word1, self.context1 = key >> 16, key & 0xFFFF
        self.word = word
        self.tables = np.minimum(count, 1)
        self._lift()
        self.tables1 = np.minimum(self.customers1, 1)
        self.customers0 = np.bincount(self.word1, self.tables1, words).astype(np.int64)
        self.tables0 = np.minimum(self.customers0, 1)

    def resume(self, tables: np.ndarray, tables1: np.ndarray, tables0: np.ndarray) -> None:
        """Take over the tables of an earlier sweep."""
        self.tables = tables
        self._lift()
        self.tables1, self.tables0 = tables1, tables0
        self.customers0 = np.bincount(self.word1, tables1, self.words).astype(np.int64)

    def _lift(self) -> None:
        self.customers1 = np.bincount(self.up, self.tables, len(self.word1)).astype(np.int64)

    def probabilities(self, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word at the root, of each word by parent context, of each pair."""
        d0, d1, d2 = totals.discounts
        base = 1.0 / (totals.vocabulary + 1)
        c0, t0 = totals.customers[0][0], totals.tables[0][0]
        root = (self.customers0 - d0 * self.tables0 + (STRENGTH + d0 * t0) * base) / (STRENGTH + c0)
        c1, t1 = totals.customers[1][self.context1], totals.tables[1][self.context1]
        middle = (self.customers1 - d1 * self.tables1 + (STRENGTH + d1 * t1) * root[self.word1]) / (STRENGTH + c1)
        c2, t2 = totals.customers[2][self.context], totals.tables[2][self.context]
        pairs = (self.customers - d2 * self.tables + (STRENGTH + d2 * t2) * middle[self.up]) / (STRENGTH + c2)
        return root, middle, pairs

    def sweep(self, totals: Totals, rng, first: bool = True) -> None:
        """Draw the tables of all dishes, level by level; those of other dishes and buckets are as the last sweep left them."""
        d0, d1, d2 = totals.discounts
        root, _, _ = self.probabilities(totals)
        others = totals.tables[2][self.context] - self.tables
        c1, t1 = totals.customers[1][self.context1], totals.tables[1][self.context1]
        up = self.up
        parent = _without(self.tables, self.customers1[up], self.tables1[up], c1[up], t1[up], root[self.word1][up], d1)
        self.tables = seat(self.customers, self.tables, others, parent, d2, rng, first)
        self._lift()
        base = np.full(self.words, 1.0 / (totals.vocabulary + 1))
        others, at = np.maximum(t1 - self.tables1, 0), self.word1
        parent = _without(
            self.tables1, self.customers0[at], self.tables0[at], totals.customers[0][0], totals.tables[0][0], base[at], d0
        )
        self.tables1 = seat(self.customers1, self.tables1, others, parent, d1, rng, first)
        self.customers0 = np.bincount(self.word1, self.tables1, self.words).astype(np.int64)
        others = np.maximum(totals.tables[0][0] - self.tables0, 0)
        self.tables0 = seat(self.customers0, self.tables0, others, base, d0, rng, first)

    def totals(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(customers, tables) of each restaurant, level by level."""
        levels = (
            (np.zeros(self.words, np.int64), self.customers0, self.tables0, 1),
            (self.context1, self.customers1, self.tables1, 65_536),
            (self.context, self.customers, self.tables, self.contexts),
        )
        return [(np.bincount(at, c, n), np.bincount(at, t, n)) for at, c, t, n in levels]


class Totals:
    """Customers and tables of each restaurant over all buckets, and the discounts; level 2 in the order of one bucket's contexts."""

    def __init__(self, vocabulary: int, customers: list[np.ndarray], tables: list[np.ndarray], discounts: tuple):
        self.vocabulary, self.customers, self.tables, self.discounts = vocabulary, customers, tables, discounts


def _seating(row: dict) -> _Seating:
    words, contexts = len(_values(row["words"], "<u8")), _values(row["contexts"], "<u8", True)
    pairs = _values(row["pair_word"], "<u4", True), _values(row["pair_context"], "<u4"), _values(row["pair_count"], "<i8")
    return _Seating(words, *pairs, (contexts & np.uint64(0xFFFF)).astype(np.int64))


def _resumed(row: dict, state: dict) -> _Seating:
    seating = _seating(row)
    seating.resume(*(_values(state[c], "<i8") for c in ("tables", "tables1", "tables0")))
    return seating


def _by_target(row: dict, targets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a bucket, their order by target, and where each target ends in that order."""
    contexts = _values(row["contexts"], "<u8", True)
    target = (contexts >> np.uint64(24)) % np.uint64(targets)
    order = np.argsort(target, kind="stable")
    return contexts, order, np.searchsorted(target[order], np.arange(targets + 1))


_SEATS = (
    "bucket long, round int, target long, tables binary, tables1 binary, tables0 binary, sums binary, "
    "keys binary, customers binary, opened binary"
)
_INDEX = "target long, bucket long, at binary"
_LEAVES = "bucket long, round int, target long, customers binary, opened binary"
_SUMS = "level int, context long, customers double, tables double"


def _seats(row: dict, seating: _Seating, number: int, targets: int) -> pa.RecordBatch:
    """A bucket's tables after a sweep, its sums for the driver, and for each target the totals of its restaurants of words."""
    schema = arrow_schema(_SEATS)
    (c0, t0), (c1, t1), (c2, t2) = seating.totals()
    levels = seating.customers0, seating.customers1, seating.customers
    head = [c0[0], t0[0], c2.sum(), (seating.customers0 > 0).sum(), *((c == k).sum() for k in (1, 2) for c in levels)]
    at = np.nonzero(c1)[0]
    rows = [{
        "tables": _blob(seating.tables, "<i8"), "tables1": _blob(seating.tables1, "<i8"), "tables0": _blob(seating.tables0, "<i8"),
        "sums": _blob(np.concatenate((head, at, c1[at], t1[at])), "<f8"),
    }]
    contexts, order, ends = _by_target(row, targets)
    for target in np.nonzero(np.diff(ends))[0].tolist():
        own = order[ends[target] : ends[target + 1]]
        rows.append({"target": target, "opened": _blob(t2[own], "<i8")})
        if number == 0:  # later rounds keep the order, and the customers
            rows[-1] |= {"keys": _blob(contexts[own], "<u8", True), "customers": _blob(c2[own], "<i8")}
    rows = [r | {"bucket": row["bucket"], "round": number} for r in rows]
    return to_batch({c: [r.get(c) for r in rows] for c in schema.names}, schema)


def _number(table: pa.Table) -> pa.Table:
    """A number for each context of a target, listed for each bucket in the order in which it sends them."""
    rows = table.to_pylist()
    keys = [_values(r["keys"], "<u8", True) for r in rows]
    at = np.split(np.unique(np.concatenate(keys), return_inverse=True)[1], np.cumsum([len(k) for k in keys])[:-1])
    columns = {"target": [r["target"] for r in rows], "bucket": [r["bucket"] for r in rows], "at": [_blob(a, "<u4") for a in at]}
    return pa.Table.from_batches([to_batch(columns, arrow_schema(_INDEX))])


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of the contexts of a target over all buckets, for each bucket in its own order."""
    schema, rows = arrow_schema(_LEAVES), table.to_pylist()
    places = {r["bucket"]: _values(r["at"], "<u4") for r in rows if r["at"] is not None}
    sent = [r for r in rows if r["opened"] is not None]
    out = {c: [r[c] for r in sent] for c in ("bucket", "round", "target")} | {"customers": [None] * len(sent)}
    for name in ("customers", "opened"):
        if sent and sent[0][name] is not None:
            total = np.zeros(1 + max(int(a.max()) for a in places.values()), np.int64)
            for r in sent:
                total[places[r["bucket"]]] += _values(r[name], "<i8")
            out[name] = [_blob(total[places[r["bucket"]]], "<i8") for r in sent]
    return pa.Table.from_batches([to_batch(out, schema)])


def _gathered(row: dict, leaves: list[dict], name: str, targets: int) -> np.ndarray:
    """Totals of all contexts of a bucket from what the targets sent."""
    contexts, order, ends = _by_target(row, targets)
    out = np.zeros(len(contexts), np.int64)
    for r in leaves:
        out[order[ends[r["target"]] : ends[r["target"] + 1]]] = _values(r[name], "<i8")
    return out


def _measure(seats: DataFrame, first: Totals | None) -> tuple[Totals, int]:
    """Totals of the upper levels, with the discounts of the first round, and the number of customers of all words.

    Rows: restaurants (level 0 and 1), customers of level 2 in all, words learnt (level 3), and dishes with one and
    with two customers at each level (levels 4 to 6), from which the discounts come as n1 / (n1 + 2 n2).
    """
    target = arrow_schema(_SUMS)

    def run(batches):
        head, middle = np.zeros(10), np.zeros((2, 65_536))
        for batch in batches:
            for blob in batch.column("sums").to_pylist():
                values = _values(blob, "<f8")
                head += values[:10]
                at, customers, tables = values[10:].reshape(3, -1)
                middle[0][at.astype(np.int64)] += customers
                middle[1][at.astype(np.int64)] += tables
        at = np.nonzero(middle[0])[0]
        yield to_batch({"level": np.full(len(at), 1, np.int32), "context": at, "customers": middle[0][at], "tables": middle[1][at]}, target)
        more = {"level": [0, 2, 3, 4, 5, 6], "context": [0] * 6, "customers": [head[0], *head[2:7]], "tables": [head[1], 0.0, 0.0, *head[7:]]}
        yield to_batch(more, target)

    needed = seats.filter("sums IS NOT NULL").select("sums")
    found = needed.mapInArrow(run, _SUMS).groupBy("level", "context").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables"))
    customers, tables = ([np.zeros(n) for n in (1, 65_536)] for _ in range(2))
    vocabulary, trained, discounts = 0, 0, [0.5] * LEVELS
    for level, context, c, t in found.collect():  # a row for each restaurant of two bytes, 65,543 rows at most
        if level < 2:
            customers[level][context], tables[level][context] = c, t
        elif level == 2:
            trained = int(c)
        elif level == 3:
            vocabulary = int(c)
        elif c:
            discounts[level - 4] = min(0.95, max(0.05, c / (c + 2 * t)))
    return Totals(vocabulary, customers, tables, first.discounts if first else tuple(discounts)), trained


def _completed(totals: Totals, customers: np.ndarray, tables: np.ndarray) -> Totals:
    return Totals(totals.vocabulary, [*totals.customers, customers], [*totals.tables, tables], totals.discounts)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of the store written by bucket, so that what is grouped by bucket later is read in place and not shuffled."""
    spark, name = rows.sparkSession, f"pitman_yor_{uuid.uuid4().hex}"
    files = rows.write.bucketBy(buckets, "bucket").sortBy("bucket").option("path", scratch_path(spark, "pitman-yor"))
    files.saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the frame has their list
    return stored


def score_documents(docs: DataFrame, learn, sweeps: int = 3, samples: int = 2, seed: int = 7) -> DataFrame:
    """Learn from the rows where the column `learn` holds and score all.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): tokens are the words with A-Z in
    lower case and one end; score is the log10 probability of the text under the model, base_score under
    smoothed word counts. Words that were not learnt share one unknown word. A null text is empty and
    has the end only. A null doc_id stays null. Repeated rows count and are scored one by one, other columns
    are left behind, an empty table gives an empty one. With nothing to learn from, all words are unknown.
    """
    spark = docs.sparkSession
    buckets = buckets_for(docs)
    rows = id_and_text(docs, F.coalesce(learn, F.lit(False)).alias("learn"))
    parcels = rows.mapInArrow(lambda batches: _send(batches, buckets), _PARCEL)
    store = _bucketed(parcels.groupBy("target").applyInArrow(_collect, _STORE), buckets)
    targets = 8 * math.isqrt(buckets)  # a bucket sends a row to each

    def written(df: DataFrame, name: str, schema: str) -> DataFrame:
        path = scratch_path(spark, f"pitman-yor-{name}")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    def first_seats(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _seats(row, _seating(row), 0, targets)

    pairs = store.filter("kind = 2").select("bucket", "words", "contexts", "pair_word", "pair_context", "pair_count")
    seats = [written(pairs.mapInArrow(first_seats, _SEATS), "seats", _SEATS)]
    keyed = seats[0].filter("keys IS NOT NULL").select("target", "bucket", "keys")
    index = written(keyed.groupBy("target").applyInArrow(_number, _INDEX), "index", _INDEX)

    def added_up(round_: DataFrame) -> DataFrame:
        sent = round_.filter("opened IS NOT NULL").select("bucket", "round", "target", "customers", "opened")
        both = index.unionByName(sent, allowMissingColumns=True)
        return written(both.groupBy("target").applyInArrow(_add_up, _LEAVES), "leaves", _LEAVES)

    def state_of(round_: DataFrame) -> DataFrame:
        return round_.filter("sums IS NOT NULL").select("bucket", "round", "tables", "tables1", "tables0")

    def sweep_after(number: int, totals: Totals):
        def sweep(stored: pa.Table, sent: pa.Table) -> pa.Table:
            pa.default_memory_pool().release_unused()
            (row,), rows = stored.to_pylist(), sent.to_pylist()
            seating = _resumed(row, next(r for r in rows if r["tables"] is not None))
            opened = _gathered(row, [r for r in rows if r["opened"] is not None], "opened", targets)
            # Seating needs the tables of restaurants of words and not their customers.
            complete = _completed(totals, np.zeros(len(opened)), opened)
            seating.sweep(complete, np.random.Generator(np.random.PCG64([seed, number, row["bucket"]])), number == 0)
            return pa.Table.from_batches([_seats(row, seating, number + 1, targets)])

        return sweep

    totals, trained = _measure(seats[0], None)
    history, leaves = [totals], [added_up(seats[0])]
    for number in range(sweeps):
        given = state_of(seats[-1]).unionByName(leaves[-1].select("bucket", "target", "opened"), allowMissingColumns=True)
        swept = pairs.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(sweep_after(number, totals), _SEATS)
        seats.append(written(swept, "seats", _SEATS))
        totals, _ = _measure(seats[-1], history[0])
        history.append(totals)
        leaves.append(added_up(seats[-1]))
    vocabulary = history[0].vocabulary
    partial_schema, result_schema = arrow_schema(_PARTIAL), arrow_schema(_RESULT)

    def answer(stored: pa.Table, sent: pa.Table) -> pa.Table:
        def rows_of(block, found):
            docs_ = np.nonzero(found[3])[0]
            return {"block": block, "kind": 2, "docs": _blob(docs_, "<u2"), "known": _blob(found[0][docs_], "<u4"),
                    "base": _blob(found[1][docs_], "<f8"), "score": _blob(found[2][docs_], "<f8")}

        def batch_of(rows):
            return to_batch({c: [r.get(c) for r in rows] for c in partial_schema.names}, partial_schema)

        pa.default_memory_pool().release_unused()
        (row,), rows = stored.to_pylist(), sent.to_pylist()
        sent = [r for r in rows if r["target"] is not None]
        customers, chances, out = _gathered(row, [r for r in sent if r["customers"] is not None], "customers", targets), [], []
        for state in sorted((r for r in rows if r["tables"] is not None), key=lambda r: r["round"]):
            own = [r for r in sent if r["round"] == state["round"] and r["opened"] is not None]
            complete = _completed(history[state["round"]], customers, _gathered(row, own, "opened", targets))
            chances.append(_resumed(row, state).probabilities(complete)[2])
        log = np.log10(np.mean(chances, axis=0))
        word, context = _values(row["pair_word"], "<u4", True), _values(row["pair_context"], "<u4")
        hashes, contexts = _values(row["words"], "<u8", True), _values(row["contexts"], "<u8", True)
        c = np.bincount(word, _values(row["pair_count"], "<i8"), len(hashes))[word]
        base, known = np.log10(c + 0.5), (c > 0).astype(float)
        pair, doc = _values(row["entry_pair"], "<u4", True), _values(row["entry_doc"], "<u2")
        count, at = _values(row["entry_count"], "<u4"), 0
        for block, n in zip(_values(row["entry_block"], "<i8").tolist(), _values(row["entry_size"], "<i8").tolist()):
            p, d, k = pair[at : at + n], doc[at : at + n], count[at : at + n]
            at += n
            asked = d == HOME
            if asked.any():
                q = p[asked]
                out.append({"block": block, "kind": 3, "words": _blob(hashes[word[q]], "<u8", True), "contexts": _blob(contexts[context[q]], "<u8", True),
                            "known": _blob(known[q], "<f8"), "base": _blob(base[q], "<f8"), "score": _blob(log[q], "<f8")})
            p, d, k = p[~asked], d[~asked], k[~asked]
            if len(d):
                out.append(rows_of(block, [np.bincount(d, k * value) for value in (known[p], base[p], log[p], np.ones(len(p)))]))
        return pa.Table.from_batches([batch_of(out)])

    def finish(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        own = next(r for r in parts if r["kind"] == 0)
        ids, train, sizes = _values(own["words"], "<i8"), _values(own["docs"], "u1"), _values(own["known"], "<i8")
        total = np.zeros((3, len(ids)))
        asked = [r for r in parts if r["kind"] == 3]
        for r in parts:
            if r["kind"] == 2:
                at = _values(r["docs"], "<u2")
                for k, (c, kind) in enumerate((("known", "<u4"), ("base", "<f8"), ("score", "<f8"))):
                    np.add.at(total[k], at, _values(r[c], kind))
        if asked:
            key = _key(*(np.concatenate([_values(r[c], "<u8", True) for r in asked]) for c in ("words", "contexts")))
            order = np.argsort(key)
            kept = next(r for r in parts if r["kind"] == 1)
            mine = _key(_values(kept["words"], "<u8", True), _values(kept["contexts"], "<u8", True))
            at = order[np.searchsorted(key[order], mine)][_values(kept["base"], "<u4", True)]
            doc, count = _values(kept["docs"], "<u2"), _values(kept["known"], "<u4")
            for k, c in enumerate(("known", "base", "score")):
                total[k] += np.bincount(doc, count * np.concatenate([_values(r[c], "<f8") for r in asked])[at], len(ids))
        columns = {
            "doc_id": pa.array(ids, mask=ids == -(1 << 63)), "held_out": pa.array(train == 0), "n_tokens": sizes,
            "n_known": np.rint(total[0]).astype(np.int64), "base_sum": total[1], "score": total[2],
        }
        return pa.Table.from_batches([to_batch(columns, result_schema)])

    given = leaves[0].select("bucket", "target", "customers")
    for k in range(max(0 if sweeps == 0 else 1, sweeps + 1 - samples), sweeps + 1):
        given = given.unionByName(state_of(seats[k]), allowMissingColumns=True)
        given = given.unionByName(leaves[k].select("bucket", "round", "target", "opened"), allowMissingColumns=True)
    partial = store.filter("kind = 2").drop("kind").groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(answer, _PARTIAL)
    none = F.lit(None).cast("binary")
    homes = store.filter("kind < 2").select(
        F.col("bucket").alias("block"), "kind", F.col("entry_doc").alias("docs"), "words",
        "contexts", F.col("entry_count").alias("known"), F.col("entry_pair").alias("base"), none.alias("score"),
    )
    found = partial.union(homes).groupBy("block").applyInArrow(finish, _RESULT)
    below = F.lit(float(np.log10(trained + 0.5 * (vocabulary + 1))))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(trained)).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * below).alias("base_score"), "score",
    )


def _key(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """One number for each word and context."""
    return (words ^ (contexts + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) per token."""
    tokens = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"),
    )


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_documents(spark, sf_dir), id_remainder(5) != 1)


QUERIES = {"op1_pitman_yor": op1_pitman_yor}
ORACLE: dict[str, str] = {}
