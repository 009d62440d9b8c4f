"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR is the data folder and BENCH_CPUS the number of local threads. Each query runs once to
warm up and is then timed over BENCH_REPEATS runs, of which the fastest counts. Results go to the
"noop" sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from minutemill.operators import uniques
from minutemill.plans import inputs
from minutemill.plans.registry import QUERIES
from minutemill.session import build_session

HEADLINES = (
    "parse_event_json validate_events reject_report explode_event_batches dedupe_batch dedupe_stored batch_outcome "
    "reconcile minute_rollup count_today totals_today minute_series dense_series stats_by_name dashboard_stats "
    "uniques_daily uniques_today_all uniques_range exact_uniques unique_accuracy portable_hash portable_registers "
    "portable_estimate export_portable_sketches import_portable_sketches fixed_window_quota token_bucket_quota "
    "exp_histogram histogram_quantile event_rates latency_percentiles write_events ingest_stream live_rollup"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        runs = []
        for _ in range(1 + repeats):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs[1:] or runs), 3)
    exact_and_estimate = uniques.unique_accuracy(inputs.received(spark, sf_dir))
    worst = exact_and_estimate.agg(F.max("error_pct")).first()[0]
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
                "ingest_events_per_sec": round(events * 1.2 / seconds["ingest_stream"]),
                "worst_unique_error_pct": round(worst, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
