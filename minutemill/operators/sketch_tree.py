"""Merged sketches of 2, 4, 8, ... days, and the few of them that make up a range of days.

A node of level k holds the users of 2^k days and begins at a day whose number since 1970 is a multiple of
2^k. Any range of n days is at most 2 log2(n) nodes and single days, so a year to date reads about a dozen
sketches a name. A node says up to which generation of the tables it holds everything; daily sketches that
came later are read beside it, so that a range is whole at any time. Union is idempotent: a user that is
read twice counts once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to 1,024 days in one node.
LEVELS = 10
_EPOCH = date(1970, 1, 1)


class Stored(Protocol):
    """What is asked of a stored part: its first day, its level (nodes only) and what it is up to date with."""

    day: date
    level: int | None
    since: int


def start_of(day: Column, level: int) -> Column:
    """First day of the node of a level that a day belongs to."""
    number = F.unix_date(day)
    return F.date_from_unix_date(number - F.pmod(number, F.lit(1 << level)))


def end(start: date, level: int) -> date:
    return start + timedelta(days=(1 << level) - 1)


def starts(level: int, first: date, last: date) -> list[date]:
    """Nodes of a level that lie within first..last as a whole."""
    days = 1 << level
    number = -(-(first - _EPOCH).days // days) * days
    found = []
    while (start := _EPOCH + timedelta(days=number)) <= last and end(start, level) <= last:
        found.append(start)
        number += days
    return found


def cover(first: date, last: date, nodes: Sequence[Stored], days: Sequence[Stored]) -> tuple[list, list]:
    """Nodes and daily parts whose union is the range, largest nodes first from the left."""
    largest: dict[date, list] = {}
    for node in sorted(nodes, key=lambda n: -n.level):
        largest.setdefault(node.day, []).append(node)
    chosen, holder, at = [], {}, first
    while at <= last:
        node = next((n for n in largest.get(at, []) if end(at, n.level) <= last), None)
        following = at + timedelta(days=1)
        if node is not None:
            chosen.append(node)
            following = end(at, node.level) + timedelta(days=1)
            holder.update({at + timedelta(days=k): node for k in range((following - at).days)})
        at = following
    inside = [d for d in days if first <= d.day <= last]
    daily = [d for d in inside if d.day not in holder or d.since > holder[d.day].since]
    return chosen, daily


def due(level: int, first: date, last: date, nodes: Sequence[Stored], days: Sequence[Stored]) -> tuple[list, list[date]]:
    """Nodes of a level that are out of date, and first days of those to be made (again)."""
    there = {n.day: n for n in nodes if n.level == level}
    newest: dict[date, int] = {}
    for part in days:
        number = (part.day - _EPOCH).days
        start = _EPOCH + timedelta(days=number - number % (1 << level))
        newest[start] = max(newest.get(start, -1), part.since)
    wanted = [s for s in starts(level, first, last) if s in newest and (s not in there or newest[s] > there[s].since)]
    return [there[s] for s in wanted if s in there], wanted
