"""Merging Burrows-Wheeler transforms of string collections by interleave refinement."""

from __future__ import annotations

import numpy as np

# Characters, of 9 bits each, that the first sorting looks at.
PACKED = 7


class Shard:
    """Suffixes of some strings in order, and the character before each: the transform.

    Every string ends with a sentinel of its own, which sorts before all bytes. Suffixes are ordered by
    `depth` characters or more, by doubling the sorted length where neighbours are still equal, which is all
    that refining to that depth can see. Characters are 1 to 256, 0 is the sentinel. `back` gives the row of
    the suffix that is one character longer.
    """

    def __init__(self, strings: list[bytes], depth: int):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.n = int(lengths.sum()) + len(strings)
        text = np.zeros(self.n, np.int64)
        ends = np.cumsum(lengths + 1)
        inside = np.ones(self.n, bool)
        inside[ends - 1] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        # Nothing is read past a sentinel: two suffixes that reach theirs are equal up to there.
        left = np.repeat(ends, lengths + 1) - np.arange(self.n) - 1
        key = text
        for k in range(1, PACKED):
            ahead = np.minimum(np.arange(k, self.n + k), self.n - 1)
            key = (key << 9) | np.where(left >= k, text[ahead], 0)
        order, open_ = np.arange(self.n), np.arange(self.n)
        rank, width = np.empty(self.n, np.int64), PACKED
        while True:
            sorting = np.argsort(key)
            position, key = order[open_][sorting], key[sorting]
            order[open_] = position
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            at = np.nonzero(first)[0]
            rank[position] = np.repeat(open_[at], np.diff(np.append(at, len(key))))
            if width >= depth:
                break
            alone = first & np.append(first[1:], True)
            open_ = open_[~alone]
            position = order[open_]
            ahead = np.where(left[position] >= width, rank[np.minimum(position + width, self.n - 1)] + 1, 0)
            key = rank[position] * (self.n + 1) + ahead
            width *= 2
        self.suffixes = order
        self.transform = np.where(order > 0, text[order - 1], 0).astype(np.uint16)
        rank[order] = np.arange(self.n)
        self.back = rank[order - 1]


def merge(shards: list[Shard], depth: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, interval of each): the merged suffixes whose interval holds different values, in their order.

    Rows count through the shards, `values` has one for each; intervals are equal `depth`-character prefixes.
    The interleave begins with the shards one after the other and is right for prefixes of no characters.
    Putting every suffix's left neighbour behind the others of its first character makes it right for
    one character more; no suffix is compared or sorted again. A common prefix ends where neighbours come
    from different intervals of the round before, so the intervals fall out of the same pass. An interval
    of one value is settled: what stands to the left of its suffixes has that value as well, so no later
    round needs them. Shorter suffixes have their sentinel within the prefix and are alone in their interval.
    """
    begins = np.cumsum([0] + [s.n for s in shards[:-1]])
    transforms = np.concatenate([s.transform for s in shards])
    back = np.concatenate([s.back + begin for s, begin in zip(shards, begins)])
    row, interval = np.arange(len(transforms)), np.zeros(len(transforms), np.int64)
    for _ in range(depth):
        letters = transforms[row]
        order = np.argsort(letters, kind="stable")
        order = order[np.count_nonzero(letters == 0) :]
        if not len(order):
            return row[:0], interval[:0]
        letters, came, row = letters[order], interval[order], back[row[order]]
        cut = np.ones(len(row), bool)
        cut[1:] = (letters[1:] != letters[:-1]) | (came[1:] != came[:-1])
        first, own = np.nonzero(cut)[0], values[row]
        mixed = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
        interval = np.cumsum(cut) - 1
        keep = mixed[interval]
        row, interval = row[keep], interval[keep]
    return row, interval


def window_minimum(strings: list[bytes], values: np.ndarray, depth: int, shards: int = 4) -> list[np.ndarray]:
    """For each string, the least value among strings that have each of its windows of `depth` bytes."""
    cut = np.array_split(np.arange(len(strings)), max(1, min(shards, len(strings))))
    built = [Shard([strings[i] for i in part], depth) for part in cut]
    owners, places = [], []
    for part, shard in zip(cut, built):
        lengths = np.array([len(strings[i]) + 1 for i in part], np.int64)
        starts = np.cumsum(lengths) - lengths
        string = np.repeat(np.arange(len(part)), lengths)[shard.suffixes]
        owners.append(part[string])
        places.append(shard.suffixes - starts[string])
    owner, place = np.concatenate(owners), np.concatenate(places)
    row, interval = merge(built, depth, values[owner])
    out = [np.full(max(0, len(s) - depth + 1), v, np.int64) for s, v in zip(strings, values)]
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    ends = np.cumsum([len(o) for o in out])
    if len(row):
        begins = np.concatenate(([True], interval[1:] != interval[:-1]))
        least = np.minimum.reduceat(values[owner[row]], np.nonzero(begins)[0])[np.cumsum(begins) - 1]
        offset = np.concatenate(([0], ends))[:-1]
        flat[offset[owner[row]] + place[row]] = least
    return np.split(flat, ends[:-1])
