"""Which files of the stored tables are live: one small change set for every commit, in Parquet.

Layout: `<root>/manifest/base=<b>/generation=<n>/*.parquet`. A generation lists the parts that a commit added
and removed, and has one row about the commit itself; writing it is what makes the commit visible, in all
tables at once. A part is a folder of files of one table and one place, such as `day=2024-01-15`; it is
written once and never changed, so a reader that holds a generation goes on reading the same rows. Every
CHECKPOINT_EVERY generations the whole list is written down as the first generation of a new base, so a
reader lists the bases by name and reads the files of one.

Readers bring only the entries of their table, days and buckets to the driver. One writer per root, as two
at a time could both replace the same batch.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_EVERY = 25

_ENTRY = "table string, place string, part string, day date, bucket int, level int, batch_id string, since long, live boolean"
# The row about a commit has no table; it carries the health of a batch, if it stored one.
_COMMIT = "full boolean, batch_size long, inserted long, duplicates long, took_seconds double, error string, ts timestamp, parts long"
_PRINTS = "received_print array<bigint>, stored_print array<bigint>"
_CHANGE = f"{_ENTRY}, at timestamp, {_COMMIT}, {_PRINTS}"
_NAMES = [field.split()[0] for field in _CHANGE.split(", ")]


@dataclass(frozen=True)
class Part:
    """A folder of files. `since` is the generation up to which it holds all rows that were there before."""

    table: str
    place: str
    part: str
    day: date | None = None
    bucket: int | None = None
    level: int | None = None
    batch_id: str | None = None
    since: int | None = None

    @property
    def path(self) -> str:
        return f"{self.table}/{self.place}/part={self.part}"


@dataclass(frozen=True)
class View:
    """What one look at the manifest has found: live parts that fulfil a condition, and all commits since the base."""

    base: int
    generation: int
    parts: list[Part]
    commits: list


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self.path = f"{root}/manifest"

    def create(self) -> None:
        if not self._bases():
            self._rows([self._row(full=True, at=datetime.now(timezone.utc))]).write.parquet(self._folder(0, 0))

    def _folder(self, base: int, generation: int) -> str:
        return f"{self.path}/base={base}/generation={generation}"

    def _names(self, path: str) -> list[str]:
        where, files = self._files(path)
        return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []

    def _files(self, path: str) -> tuple:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _bases(self) -> list[int]:
        return sorted(int(name[5:]) for name in self._names(self.path) if name.startswith("base="))

    # -- reading ----------------------------------------------------------------------------

    def _under(self, base: int) -> DataFrame:
        return self.spark.read.schema(f"{_CHANGE}, generation long").parquet(f"{self.path}/base={base}")

    def look(self, condition: Column, generation: int | None = None) -> View:
        """Live parts that fulfil a condition on their entry, in the given generation or the newest."""
        fields = ["generation", "full", "parts", "error", *[f.split()[0] for f in _ENTRY.split(", ")]]
        for base in reversed([b for b in self._bases() if generation is None or b <= generation]):
            # A removal that the base already holds takes nothing off its list.
            wanted = condition & (F.col("live") | (F.col("generation") > base))
            found = self._under(base).filter(F.col("table").isNull() | wanted).select(fields).collect()
            commits = [r for r in found if r.table is None and (generation is None or r.generation <= generation)]
            known = {r.generation for r in commits}
            if base in known:  # else its checkpoint was cut off, and the base before it is still the newest
                break
        else:
            raise ValueError(f"generation {generation} is not, or no longer, in {self.path}")
        newest = max(known) if generation is None else generation
        if newest not in known:
            raise ValueError(f"generation {generation} is not in {self.path}")
        parts: dict[tuple, Part] = {}
        for row in sorted((r for r in found if r.table and r.generation <= newest), key=lambda r: r.generation):
            key = (row.table, row.place, row.part)
            if row.live:
                since = row.generation if row.since is None else row.since
                parts[key] = Part(row.table, row.place, row.part, row.day, row.bucket, row.level, row.batch_id, since)
            else:
                parts.pop(key, None)
        return View(base, newest, list(parts.values()), commits)

    def live(self, condition: Column, generation: int | None = None) -> list[Part]:
        return self.look(condition, generation).parts

    def changes(self) -> DataFrame:
        """All rows since the newest base."""
        return self._under(self.look(F.lit(False)).base)

    def newest(self, generation: int | None = None) -> int:
        """The newest generation; or the given one, if it is there."""
        return self.look(F.lit(False), generation).generation

    def batches(self) -> DataFrame:
        """(generation, batch_id, health fields) of commits of batches since the base."""
        return self.changes().filter(F.col("table").isNull() & F.col("batch_id").isNotNull())

    # -- writing ----------------------------------------------------------------------------

    def _row(self, **values) -> tuple:
        return tuple(values.get(name) for name in _NAMES)

    def _rows(self, rows: Iterable[tuple]) -> DataFrame:
        schema = to_arrow_schema(T.StructType.fromDDL(_CHANGE))
        columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
        return self.spark.createDataFrame(pa.table(columns, schema=schema)).coalesce(1)

    def commit(self, added: Iterable[Part], removed: Iterable[Part] = (), replaces: str | None = None, **health) -> bool:
        """Write the next generation; returns whether a checkpoint is due.

        The parts that batch `replaces` has are removed as well. Parts to be removed must still be live:
        if they aren't, another commit has replaced them meanwhile and nothing is written.
        """
        names = {p.part for p in removed}
        condition = F.col("part").isin(list(names)) if names else F.lit(False)
        if replaces is not None:
            condition |= F.col("batch_id") == F.lit(replaces)
        view = self.look(condition)
        still, following = view.parts, view.generation + 1
        if gone := names - {p.part for p in still}:
            raise ValueError(f"parts {sorted(gone)} were replaced by another commit")
        now = datetime.now(timezone.utc)
        added = list(added)
        rows = [self._row(full=False, at=now, parts=len(added), **health)]
        outgoing = {(p.table, p.place, p.part) for p in removed}
        outgoing |= {(p.table, p.place, p.part) for p in still if replaces is not None and p.batch_id == replaces}
        for live, parts in ((True, added), (False, [p for p in still if (p.table, p.place, p.part) in outgoing])):
            rows += [
                self._row(table=p.table, place=p.place, part=p.part, day=p.day, bucket=p.bucket, level=p.level,
                          batch_id=p.batch_id, since=p.since, live=live, at=now) for p in parts
            ]
        self._rows(rows).write.mode("append").parquet(self._folder(view.base, following))
        return following - view.base >= CHECKPOINT_EVERY

    def entries(self) -> DataFrame:
        """The last change of every part that is live or whose files are still there."""
        fields = F.struct("day", "bucket", "level", "batch_id", F.coalesce("since", "generation").alias("since"), "live", "at")
        rows = self.changes().filter(F.col("table").isNotNull())
        last = rows.groupBy("table", "place", "part").agg(F.max_by(fields, "generation").alias("_e"))
        return last.select("table", "place", "part", "_e.*")

    def checkpoint(self, added: Iterable[Part] = (), forgotten: DataFrame | None = None) -> None:
        """Write the whole list as a new base; `forgotten` (table, place, part) are left out."""
        newest = self.newest()
        entries = self.entries()
        if forgotten is not None:
            entries = entries.join(forgotten, ["table", "place", "part"], "left_anti")
        now = datetime.now(timezone.utc)
        more = [self._row(full=True, at=now)] + [
            self._row(table=p.table, place=p.place, part=p.part, day=p.day, since=newest + 1, live=True, at=now) for p in added
        ]
        kept = entries.select(*[F.col(n) if n in entries.columns else F.lit(None).alias(n) for n in _NAMES])
        kept.unionAll(self._rows(more)).coalesce(4).write.mode("append").parquet(self._folder(newest + 1, newest + 1))

    # -- removal ----------------------------------------------------------------------------

    def _delete(self, path: str) -> None:
        where, files = self._files(path)
        files.delete(where, True)

    def remove_dead(self, tables: Iterable[str], grace: timedelta) -> int:
        """Delete files that left the tables, or never became part of them, more than `grace` ago; returns
        the number of folders. Readers of a generation older than that find its files gone.

        Files are listed by Spark; the names of folders to delete, which is what compaction and failed
        attempts have left since the last call, come to the driver.
        """
        before = datetime.now(timezone.utc) - grace
        entries = self.entries()
        dead = entries.filter(~F.col("live") & (F.col("at") <= F.lit(before))).select("table", "place", "part")
        files = None
        for table in (t for t in tables if self._names(f"{self.root}/{t}")):
            listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{table}")
            where = rf"/{table}/([^/]+)/part=([^/]+)/[^/]+$"
            rows = listed.select(
                F.lit(table).alias("table"), F.regexp_extract("path", where, 1).alias("place"),
                F.regexp_extract("path", where, 2).alias("part"), "modificationTime",
            )
            files = rows if files is None else files.unionAll(rows)
        folders = dead
        if files is not None:
            there = files.filter("part <> ''").groupBy("table", "place", "part").agg(F.max("modificationTime").alias("_changed"))
            stray = there.filter(F.col("_changed") <= F.lit(before)).join(entries, ["table", "place", "part"], "left_anti")
            folders = dead.unionAll(stray.select("table", "place", "part"))
        rows = folders.collect()
        for row in rows:
            self._delete(f"{self.root}/{row.table}/{row.place}/part={row.part}")
        if rows:
            self.checkpoint(forgotten=self.spark.createDataFrame([tuple(r) for r in rows], "table string, place string, part string"))
        bases = self._bases()
        for base, following in zip(bases, bases[1:]):
            made = self._under(following).filter(F.col("full")).agg(F.min("at")).first()[0]
            if made is not None and made.astimezone(timezone.utc) <= before:
                self._delete(f"{self.path}/base={base}")
        return len(rows)
