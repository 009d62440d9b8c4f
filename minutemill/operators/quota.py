"""Quota audits: which requests of a log a rate limit lets through.

`requests` has (request_id, client, ts); a publish call is one request whatever it carries. Both
audits return the whole log with an `allowed` flag. One client, or one client in one second, may
own a large part of the log, so neither ranks a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutemill.session import scratch_path

MICROS = 1_000_000


def _named(requests: DataFrame) -> DataFrame:
    """Requests without a client share the bucket of "unknown"."""
    return requests.withColumn("client", F.coalesce("client", F.lit("unknown")))


def _mod(value: Column, divisor: int) -> Column:
    return F.pmod(value, F.lit(divisor))


def _floor_to(micros: Column, step: int) -> Column:
    """Start of the step a time lies in, in whole numbers."""
    return micros - _mod(micros, step)


def fixed_window_quota(requests: DataFrame, limit: int, window_seconds: int = 1) -> DataFrame:
    """The first `limit` requests of each client and window are allowed; denied ones still count.

    Only the last allowed request of a full window is looked for: every task keeps at most `limit`
    rows per window before the shuffle. The log is then compared with those few rows, a join that
    Spark broadcasts when they are small and splits where a client is skewed.
    """
    requests = _named(requests)
    if limit <= 0:
        return requests.withColumn("allowed", F.lit(False))
    stamped = requests.withColumn("_w", _floor_to(F.unix_micros("ts"), window_seconds * MICROS))
    order = Window.partitionBy("client", "_w").orderBy("ts", "request_id")
    last_allowed = (
        stamped.select("client", "_w", "ts", "request_id")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == limit)
        .select("client", "_w", F.col("ts").alias("_ts"), F.col("request_id").alias("_id"))
    )
    judged = stamped.join(last_allowed, ["client", "_w"], "left")
    before = (F.col("ts") < F.col("_ts")) | ((F.col("ts") == F.col("_ts")) & (F.col("request_id") <= F.col("_id")))
    allowed = F.col("_id").isNull() | before
    return judged.select(*requests.columns, allowed.alias("allowed"))


class _Bucket:
    """Bucket arithmetic in whole units: exact, and the same on every engine.

    A token is `token` units, a microsecond brings `refill` units and the bucket holds `cap`.
    """

    def __init__(self, rate: int | Fraction, burst: int | None):
        rate = Fraction(rate)
        self.burst = int(2 * rate) if burst is None else burst
        if rate <= 0 or self.burst < 1:
            raise ValueError("rate must be positive and burst at least 1")
        self.token = MICROS * rate.denominator
        self.refill = rate.numerator
        self.cap = self.burst * self.token
        # After this long without a request the bucket is full whatever went before.
        self.refill_micros = -(-self.cap // self.refill)


_WALK_SCHEMA = "client string, chunk long, us long, n long, tokens long, kind string"


def _walk(rows: DataFrame, bucket: _Bucket, ends: bool) -> DataFrame:
    """Run the buckets over rows (client, chunk, us, n, start).

    A row with `start` sets the bucket to that content at `us`; other rows are `n` requests at `us`.
    A chunk without such a row starts with a full bucket. With `ends` the result is the start and
    the end of each chunk, else the instants at which fewer than `n` were let through. Rows pass
    through in order and only one bucket is held at a time.
    """
    token, refill, cap = bucket.token, bucket.refill, bucket.cap
    small = 1 << 62

    def all_pass(us, n, tokens: int, last: int):
        """How many leading instants pass in full, the content after them, and whether it was full.

        As long as everything passes the content is a running minimum over "full at j" and "as it
        was at the start", so a stretch without denials takes a few array operations.
        """
        since = us - last
        cost = n * token
        spent = np.cumsum(cost) - cost
        earned = since * refill
        if_full = cap + np.minimum.accumulate(spent - earned)
        before = np.minimum(tokens, if_full) + earned - spent
        after = before - cost
        short = np.flatnonzero(after < 0)
        passed = int(short[0]) if len(short) else len(us)
        if not passed:
            return 0, tokens, last, False
        return passed, int(after[passed - 1]), int(us[passed - 1]), bool((before[:passed] == cap).any())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["client", "chunk", "us", "n", "tokens", "kind"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        current, tokens, last, begun, full = None, 0, 0, None, False

        def finish(out: list) -> None:
            if ends and current is not None:
                out.append((*current, last, 1 if full else 0, tokens, "end"))
                out.append((*current, last, 0, begun, "start"))

        def pack(out: list) -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=names
            )

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            out: list = []
            clients, chunks, starts = (batch.column(c) for c in ("client", "chunk", "start"))
            times, counts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("us", "n"))
            changed = pc.or_(
                pc.not_equal(clients.slice(1), clients.slice(0, size - 1)),
                pc.not_equal(chunks.slice(1), chunks.slice(0, size - 1)),
            )
            heads = [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), size]
            for a, b in zip(heads, heads[1:]):
                key = (clients[a].as_py(), chunks[a].as_py())
                if current != key:
                    finish(out)
                    current, begun, full = key, None, False
                    start = starts[a].as_py()
                    if start is not None:
                        tokens, last, begun = start, int(times[a]), start
                        a += 1
                    else:
                        tokens, last, begun, full = cap, int(times[a]), cap, True
                if a == b:
                    continue
                us, n = times[a:b], counts[a:b]
                if b - a >= 16 and (int(us[-1]) - last) * refill < small and int(n.sum()) * token < small:
                    passed, tokens, last, was_full = all_pass(us, n, tokens, last)
                    full = full or was_full
                    us, n = us[passed:], n[passed:]
                for time, asked in zip(us.tolist(), n.tolist()):
                    tokens += (time - last) * refill
                    if tokens >= cap:
                        tokens, full = cap, True
                    last = time
                    through = min(asked, tokens // token)
                    tokens -= through * token
                    if through < asked and not ends:
                        out.append((*key, time, asked, through, "short"))
            yield pack(out)
        out = []
        finish(out)
        yield pack(out)

    ordered = rows.repartition("client", "chunk").sortWithinPartitions("client", "chunk", "us")
    return ordered.mapInArrow(walk, _WALK_SCHEMA)


def _first_guess(spans: DataFrame, bucket: _Bucket, chunk_micros: int) -> DataFrame:
    """Where each chunk might start. A busy client is taken to be out of whole tokens, the rest of a
    token following from the time since its bucket was last known full; a quiet one to be full."""
    by_time = Window.partitionBy("client").orderBy("chunk")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    busy = F.col("_total") * F.lit(bucket.token) >= F.lit(chunk_micros * bucket.refill)
    remainder = _mod(F.lit(bucket.cap) + (F.col("us") - F.col("_session")) * F.lit(bucket.refill), bucket.token)
    return (
        spans.withColumn("us", F.lag("last").over(by_time))
        .withColumn("_total", F.lag("total").over(by_time))
        .withColumn("fresh", F.col("us").isNull() | (F.col("first") - F.col("us") >= bucket.refill_micros))
        .withColumn("_session", F.last(F.when(F.col("fresh"), F.col("first")), ignorenulls=True).over(so_far))
        .withColumn("start", F.when(busy, remainder).otherwise(F.lit(bucket.cap)))
        .select("client", "chunk", "fresh", F.when(~F.col("fresh"), F.col("us")).alias("us"), "start")
    )


def _outcomes(walked: DataFrame, guess: DataFrame) -> DataFrame:
    """(client, chunk, fresh, used, end, full, at): how each walked chunk started and ended."""

    def value(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    ends = walked.groupBy("client", "chunk").agg(
        value("start", "tokens").alias("used"),
        value("end", "tokens").alias("end"),
        value("end", "n").alias("full"),
        F.max("us").alias("at"),
    )
    return guess.select("client", "chunk", "fresh").join(ends, ["client", "chunk"])


def _next_guess(outcomes: DataFrame, bucket: _Bucket) -> DataFrame:
    """Starts from the ends of the chunks before; `changed` where another start was used.

    Requests take whole tokens, so between two moments at which the bucket is full the part below
    one token depends on time alone. It is carried forward from the last full moment, which puts
    a whole run of busy chunks right in one round. The earliest chunk of a client whose start is
    not yet the end before it always changes, so no wrong start is left when none changes.
    """
    by_time = Window.partitionBy("client").orderBy("chunk")
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.when((F.col("full") == 1) | F.col("fresh"), F.struct("end", "at"))
    remainder = _mod(
        F.col("_anchor.end") + (F.col("us") - F.col("_anchor.at")) * F.lit(bucket.refill), bucket.token
    )
    whole = F.col("_end") - _mod(F.col("_end"), bucket.token)
    return (
        outcomes.withColumn("_anchor", F.last(anchor, ignorenulls=True).over(before))
        .withColumn("_end", F.lag("end").over(by_time))
        .withColumn("us", F.lag("at").over(by_time))
        .withColumn("start", F.least(whole + remainder, F.lit(bucket.cap)))
        .withColumn("changed", ~F.col("fresh") & (F.col("used") != F.col("start")))
        .select(
            "client", "chunk", "fresh", F.when(~F.col("fresh"), F.col("us")).alias("us"), "start", "changed"
        )
    )


def _settled_starts(busy: DataFrame, bucket: _Bucket, chunk_micros: int, folder: str) -> DataFrame:
    """The true start of every chunk: walk all from a guess, then walk again what was wrong."""
    keys = ["client", "chunk"]
    spans = busy.groupBy(*keys).agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.sum("n").alias("total")
    )
    guess = _saved(_first_guess(spans, bucket, chunk_micros), folder, "guess-0")
    walked = _walk(busy.unionAll(_start_rows(guess)), bucket, ends=True)
    outcomes = _saved(_outcomes(walked, guess), folder, "outcomes-0")
    for number in count(1):
        guess = _saved(_next_guess(outcomes, bucket), folder, f"guess-{number}")
        changed = guess.filter("changed").drop("changed")
        if changed.isEmpty():
            return guess.drop("changed")
        again = busy.join(changed.select(*keys), keys, "left_semi")
        walked = _walk(again.unionAll(_start_rows(changed)), bucket, ends=True)
        kept = outcomes.join(changed.select(*keys), keys, "left_anti")
        outcomes = _saved(kept.unionByName(_outcomes(walked, changed)), folder, f"outcomes-{number}")


def _saved(rows: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _start_rows(guess: DataFrame) -> DataFrame:
    return guess.filter(~F.col("fresh")).select(
        "client", "chunk", "us", F.lit(0).cast("long").alias("n"), "start"
    )


def _instants(requests: DataFrame) -> DataFrame:
    """Requests of a client at the same microsecond stand or fall in order, so they are one row."""
    return requests.groupBy("client", F.unix_micros("ts").alias("us")).agg(F.count("*").alias("n"))


def token_bucket_quota(
    requests: DataFrame,
    rate: int | Fraction,
    burst: int | None = None,
    hot_instants: int = 1_000_000,
    chunk_seconds: int = 60,
) -> DataFrame:
    """Per client a bucket of `burst` tokens (default 2 * rate), refilled at `rate` per second and
    full at first sight. A request takes one token or is denied and takes none.

    The bucket of one client is a chain, but few clients are large. Clients with up to
    `hot_instants` distinct times are walked in one piece each. A larger client is cut into chunks
    of time that are walked in parallel from assumed starts; a chunk whose assumed start is not the
    end of the chunk before is walked again. Every round makes at least the next chunk of each
    client right, usually all of them, and the loop ends when all starts agree with all ends, so
    the result is exact.
    """
    bucket, requests = _Bucket(rate, burst), _named(requests)
    spark = requests.sparkSession
    folder = scratch_path(spark, "quota")
    chunk_micros = chunk_seconds * MICROS
    instants = _saved(_instants(requests), folder, "instants")
    hot = (
        instants.groupBy("client")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > hot_instants)
        .select("client", F.lit(True).alias("_hot"))
    )
    hot = _saved(hot, folder, "hot")
    no_start = F.lit(None).cast("long").alias("start")
    if hot.isEmpty():
        whole = instants.select("client", F.lit(0).cast("long").alias("chunk"), "us", "n", no_start)
        short = _walk(whole, bucket, ends=False)
    else:
        chunk = F.when(F.col("_hot"), _floor_to(F.col("us"), chunk_micros)).otherwise(F.lit(0).cast("long"))
        chunked = instants.join(hot, "client", "left").select(
            "client", chunk.alias("chunk"), "us", "n", no_start, "_hot"
        )
        busy = chunked.filter(F.col("_hot")).drop("_hot")
        guess = _settled_starts(busy, bucket, chunk_micros, folder)
        short = _walk(chunked.drop("_hot").unionAll(_start_rows(guess)), bucket, ends=False)
    short = _saved(short.select("client", "us", F.col("tokens").alias("_passed")), folder, "short")
    return _judge(requests, short, bucket.burst)


def _judge(requests: DataFrame, short: DataFrame, burst: int) -> DataFrame:
    """Flag requests; of those at one short instant, the ones with the smallest ids passed."""
    timed = requests.withColumn("us", F.unix_micros("ts"))
    order = Window.partitionBy("client", "us").orderBy("request_id")
    last_passed = (
        timed.select("client", "us", "request_id")
        .join(short.filter(F.col("_passed") > 0), ["client", "us"], "left_semi")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= burst)  # an instant never passes more than a full bucket
        .join(short, ["client", "us"])
        .filter(F.col("_rank") == F.col("_passed"))
        .select("client", "us", F.col("request_id").alias("_last"))
    )
    limits = short.join(last_passed, ["client", "us"], "left")
    judged = timed.join(limits, ["client", "us"], "left")
    allowed = F.col("_passed").isNull() | F.coalesce(F.col("request_id") <= F.col("_last"), F.lit(False))
    return judged.select(*requests.columns, allowed.alias("allowed"))
