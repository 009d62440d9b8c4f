"""The registered queries as plain SQL over the same tables, for comparison."""

from __future__ import annotations

from minutemill.operators.health import BATCH_SIZE_BUCKETS, FLUSH_SECONDS_BUCKETS, INGEST_SECONDS_BUCKETS
from minutemill.plans.inputs import AS_OF
from minutemill.plans.registry import (
    BUCKET_BURST,
    BUCKET_RATE,
    COMPACTED_DAY,
    NAME,
    RANGE,
    WINDOW_LIMIT,
)

_NOW = f"TIMESTAMP '{AS_OF}'"
_TODAY = f"date_trunc('day', {_NOW})::TIMESTAMP"

_EV = """
src AS (SELECT *, 'user_' || user_id AS usr FROM events),
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS name,
         CASE WHEN event_id % 7 = 0 THEN '' ELSE usr END AS distinct_id,
         props AS properties, ts, event_id AS id
  FROM src)"""

_RECEIVED = f"""{_EV},
copies AS (SELECT *, 0 AS copy FROM ev UNION ALL SELECT *, 1 AS copy FROM ev WHERE id % 5 = 0),
received AS (
  SELECT event_id, name,
         CASE WHEN copy = 1 AND id % 10 = 0 AND distinct_id <> '' THEN distinct_id || '_b'
              ELSE distinct_id END AS distinct_id,
         properties,
         CASE WHEN copy = 1 THEN ts + INTERVAL 36 HOUR ELSE ts END AS ts,
         lpad(CAST(id // 1000 + copy AS VARCHAR), 12, '0') AS batch_id
  FROM copies)"""


def _firsts(source: str, order: str = "ts, name, distinct_id, properties") -> str:
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {order}) AS rn"
        f" FROM {source}) WHERE rn = 1"
    )


_NOW_STATE = f"""{_RECEIVED},
arrived AS (SELECT * FROM received WHERE ts <= {_NOW}),
stored AS ({_firsts('arrived')}),
rollup_now AS (SELECT name, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM stored GROUP BY ALL),
today AS (SELECT * FROM rollup_now WHERE minute >= {_TODAY}),
totals AS (SELECT name, CAST(sum(n) AS BIGINT) AS count FROM today GROUP BY name
           ORDER BY count DESC, name LIMIT 20),
uniques_now AS (SELECT name, count(DISTINCT distinct_id) AS count FROM arrived
                WHERE distinct_id <> '' AND CAST(ts AS DATE) = CAST({_NOW} AS DATE) GROUP BY name),
recent AS (SELECT * FROM rollup_now
           WHERE minute >= date_trunc('minute', {_NOW})::TIMESTAMP - INTERVAL 15 MINUTE)"""

_LINES = """
lines AS (
  SELECT event_id AS line_id, ts, 'user_' || user_id AS client,
    CASE event_id % 11
      WHEN 0 THEN 'not json ' || event_id
      WHEN 1 THEN '{"event_id":"","name":"' || event_type || '","distinct_id":"user_' || user_id || '","properties":' || props || '}'
      WHEN 2 THEN '{"event_id":"' || event_id || '","name":null,"distinct_id":"user_' || user_id || '","properties":' || props || '}'
      WHEN 3 THEN '{"event_id":' || event_id || ',"name":"' || event_type || '","distinct_id":"user_' || user_id || '","properties":' || props || '}'
      WHEN 4 THEN '{"event_id":"' || event_id || '","name":"' || event_type || '","distinct_id":"user_' || user_id || '","properties":null}'
      WHEN 5 THEN '{"event_id":"' || event_id || '","name":"' || event_type || '","distinct_id":"user_' || user_id || '","properties":[1]}'
      WHEN 6 THEN '{"name":"' || event_type || '"}'
      ELSE '{"event_id":"' || event_id || '","name":"' || event_type || '","distinct_id":"user_' || user_id || '","properties":' || props || '}'
    END AS value
  FROM events),
decoded AS (SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM lines),
parsed AS (
  SELECT *, j IS NULL
    OR coalesce(json_type(j, '$.event_id'), 'NULL') NOT IN ('NULL', 'VARCHAR')
    OR coalesce(json_type(j, '$.name'), 'NULL') NOT IN ('NULL', 'VARCHAR')
    OR coalesce(json_type(j, '$.distinct_id'), 'NULL') NOT IN ('NULL', 'VARCHAR')
    OR coalesce(json_type(j, '$.properties'), 'NULL') NOT IN ('NULL', 'OBJECT') AS malformed
  FROM decoded),
fields AS (
  SELECT line_id, ts, client, malformed,
    CASE WHEN NOT malformed THEN coalesce(j->>'$.event_id', '') END AS event_id,
    CASE WHEN NOT malformed THEN coalesce(j->>'$.name', '') END AS name,
    CASE WHEN NOT malformed THEN coalesce(j->>'$.distinct_id', '') END AS distinct_id,
    CASE WHEN NOT malformed AND json_type(j, '$.properties') = 'OBJECT'
         THEN CAST(json_extract(j, '$.properties') AS VARCHAR) END AS properties
  FROM parsed),
judged AS (
  SELECT *, CASE WHEN malformed THEN 'invalid JSON body'
                 WHEN event_id = '' THEN 'event_id is required'
                 WHEN name = '' THEN 'name is required' END AS reason
  FROM fields)"""

_CALLS = f"""{_EV},
envelopes AS (
  SELECT id, event_id AS batch_id, 0 AS index, event_id, name, usr_of AS distinct_id, 1 AS has_map, name AS kind FROM
    (SELECT *, 'user_' || user_id AS usr_of FROM (SELECT e.*, s.user_id FROM ev e JOIN src s ON e.id = s.event_id))
  UNION ALL
  SELECT event_id, CAST(event_id AS VARCHAR), 1, '', event_type, usr, 1, event_type FROM src
  UNION ALL
  SELECT event_id, CAST(event_id AS VARCHAR), 2, event_id || '-x',
         CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END, usr, 0, event_type FROM src
  UNION ALL
  SELECT event_id, CAST(event_id AS VARCHAR), 3, CAST(event_id AS VARCHAR), event_type, usr, 1, event_type FROM src),
checked AS (
  SELECT *, CASE WHEN event_id = '' THEN 'event_id is required'
                 WHEN name = '' THEN 'name is required' END AS reason FROM envelopes)"""

_REQUESTS = """
requests AS (
  SELECT event_id AS request_id, 'user_' || user_id AS client, event_id % 600 AS second FROM events)"""

_WINDOW = f"""{_REQUESTS},
windowed AS (
  SELECT *, row_number() OVER (PARTITION BY client, second ORDER BY request_id) <= {WINDOW_LIMIT} AS allowed
  FROM requests)"""

_TWO64 = "18446744073709551616::UHUGEINT"
# The portable hash of each distinct user: bytes folded one by one, then three mixing steps, all
# in 128-bit numbers reduced to 64 bits. Users here are ASCII, so characters are bytes.
_HASHED = f"""{_RECEIVED},
users AS (SELECT DISTINCT distinct_id FROM received),
fnv AS (
  SELECT distinct_id, list_reduce(
    list_prepend(14695981039346656037::UHUGEINT,
      list_transform(list_filter(string_split(distinct_id, ''), lambda c: c <> ''),
                     lambda c: CAST(ascii(c) AS UHUGEINT))),
    lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_TWO64}) AS x FROM users),
mix1 AS (SELECT distinct_id, (xor(x, x // 1073741824) * 13787848793156543929::UHUGEINT) % {_TWO64} AS x FROM fnv),
mix2 AS (SELECT distinct_id, (xor(x, x // 134217728) * 10723151780598845931::UHUGEINT) % {_TWO64} AS x FROM mix1),
hashed AS (SELECT distinct_id, xor(x, x // 2147483648) AS x FROM mix2),
ranked AS (
  SELECT distinct_id, x, CAST(x // 1125899906842624 AS INTEGER) AS register,
         (x % 1125899906842624) * 16384 AS rest FROM hashed),
placed AS (
  SELECT distinct_id, x, register,
         CAST(CASE WHEN rest = 0 THEN 51
                   ELSE least(51, 65 - length(ltrim(CAST(CAST(rest AS UBIGINT)::BIT AS VARCHAR), '0'))) END
              AS INTEGER) AS rank FROM ranked),
registers AS (
  SELECT r.name, CAST(r.ts AS DATE) AS day, p.register, max(p.rank) AS rank
  FROM received r JOIN placed p USING (distinct_id) WHERE r.distinct_id <> '' GROUP BY ALL)"""


def _estimates(registers: str, keys: str) -> str:
    return f"""
sums AS (SELECT {keys}, count(*) AS filled, sum(power(2.0::DOUBLE, -rank)) AS s FROM {registers} GROUP BY {keys}),
raw AS (SELECT *, 16384 - filled AS zeros,
          (0.7213::DOUBLE / (1 + 1.079::DOUBLE / 16384)) * 16384 * 16384 / (s + 16384 - filled) AS e FROM sums),
estimates AS (
  SELECT {keys}, CAST(floor(CASE WHEN e <= 2.5 * 16384 AND zeros > 0
           THEN 16384 * ln(16384.0::DOUBLE / zeros) ELSE e END + 0.5) AS BIGINT) AS estimate FROM raw)"""


_SKETCH_HEX = f"""{_HASHED},
keys AS (SELECT DISTINCT name, day FROM registers),
cells AS (SELECT k.name, k.day, g.i, coalesce(r.rank, 0) AS rank
  FROM keys k CROSS JOIN range(16384) g(i)
  LEFT JOIN registers r ON r.name = k.name AND r.day = k.day AND r.register = g.i)"""

_HEALTH = f"""{_RECEIVED}, ins AS ({_firsts('received', 'batch_id, ts, name, distinct_id, properties')}),
health AS (
  SELECT batch_id, ts, r AS batch_size, coalesce(i, 0) AS inserted, CAST(batch_id AS BIGINT) % 4 = 3 AS failed
  FROM (SELECT batch_id, count(*) AS r, max(ts) AS ts FROM received GROUP BY batch_id)
  LEFT JOIN (SELECT batch_id, count(*) AS i FROM ins GROUP BY batch_id) USING (batch_id))"""

_TOKEN = 1_000_000 * BUCKET_RATE.denominator
_REFILL = BUCKET_RATE.numerator
_CAP = BUCKET_BURST * _TOKEN

_LATENCIES = "lat AS (SELECT event_id AS request_id, event_type AS name, value / 1000 AS took_seconds FROM events)"


def _histogram_of(rows: str, column: str, bounds: list[float], keys: str = "") -> str:
    values = ", ".join(f"({b!r}::DOUBLE)" for b in bounds)
    return f"""
bounds(le) AS (SELECT CAST(le AS DOUBLE) FROM (VALUES {values}, ('inf'::DOUBLE)) v(le)),
hist AS (
  SELECT {keys} b.le, count(*) FILTER (WHERE l.{column} <= b.le) AS count
  FROM {rows} l CROSS JOIN bounds b GROUP BY ALL)"""


_HISTOGRAM = f"{_LATENCIES}, {_histogram_of('lat', 'took_seconds', INGEST_SECONDS_BUCKETS, 'l.name,')}"
_FLUSH_TIMES = f"{_LATENCIES}, {_histogram_of('lat', 'took_seconds', FLUSH_SECONDS_BUCKETS, 'l.name,')}"


def _quantile(q: str) -> tuple[str, str]:
    """Steps after hist, and the selection, of the quantile q."""
    steps = f"""
placed AS (
  SELECT *, {q}::DOUBLE AS quantile, coalesce(lag(le) OVER w, 0) AS lower_le, coalesce(lag(count) OVER w, 0) AS below,
         {q}::DOUBLE * max(count) OVER (PARTITION BY name) AS target,
         max(CASE WHEN le < 'inf'::DOUBLE THEN le END) OVER (PARTITION BY name) AS largest
  FROM hist WINDOW w AS (PARTITION BY name ORDER BY le)),
holding AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY le) AS rn FROM placed WHERE count >= target)"""
    select = """SELECT name, quantile,
             CASE WHEN le = 'inf'::DOUBLE THEN largest
                  ELSE lower_le + (le - lower_le) * ((target - below) / (count - below)) END AS value
           FROM holding WHERE rn = 1"""
    return steps, select


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select}"


_EVENT = "event_id, name, distinct_id, properties, ts"
_MINUTE = "date_trunc('minute', ts)::TIMESTAMP"
_DAY = "CAST(ts AS DATE)"
_FIRSTS = _firsts("received")
_ORIGINAL_ROLLUP = f"SELECT name, {_MINUTE} AS minute, count(*) AS n FROM ev GROUP BY ALL"

ORACLE: dict[str, str] = {
    # sources and sinks
    "parse_event_json": _with(
        _LINES, "SELECT line_id, malformed, event_id, name, distinct_id, properties FROM fields"
    ),
    "explode_event_batches": _with(
        _CALLS,
        """SELECT batch_id, CAST(index AS INTEGER) AS index, event_id, name, distinct_id,
             CASE WHEN has_map = 1 THEN '{"type":"' || kind || '","source":"sdk"}' ELSE '{}' END AS properties
           FROM envelopes""",
    ),
    "write_event_log": _with(
        _EV,
        """SELECT name AS key, '{"event_id":"' || event_id || '","name":"' || name || '","distinct_id":"' || distinct_id
             || '","properties":' || replace(properties, ' ', '') || ',"ts":"'
             || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}' AS value FROM ev""",
    ),
    "read_event_log": _with(
        _EV, "SELECT event_id, name, distinct_id, replace(properties, ' ', '') AS properties, ts FROM ev"
    ),
    "write_events": _with(
        _RECEIVED,
        f"SELECT {_EVENT}, {_DAY} AS day, 'log-000000000000' AS batch_id FROM ({_FIRSTS})",
    ),
    "write_minute_deltas": _with(
        _EV,
        f"""SELECT name, {_MINUTE} AS minute, count(*) AS n, {_DAY} AS day
            FROM ev GROUP BY name, {_MINUTE}, {_DAY}, distinct_id = ''""",
    ),
    "write_sketch_deltas": _with(
        _EV,
        f"""SELECT name, {_DAY} AS day, count(DISTINCT distinct_id) AS count
            FROM ev WHERE distinct_id <> '' GROUP BY ALL""",
    ),
    "compact_deltas": _with(
        f"""{_EV},
deltas AS (SELECT name, {_MINUTE} AS minute, {_DAY} AS day, distinct_id = '' AS anonymous, count(*) AS n
           FROM ev GROUP BY ALL)""",
        f"""SELECT day, CASE WHEN day = DATE '{COMPACTED_DAY}' THEN count(DISTINCT (name, minute))
                             ELSE count(*) END AS stored_rows, CAST(sum(n) AS BIGINT) AS n
            FROM deltas GROUP BY day""",
    ),
    # projections and filters
    "validate_events": _with(_LINES, "SELECT line_id, coalesce(reason, 'accepted') AS reason FROM judged"),
    "reject_report": _with(
        _CALLS,
        """SELECT batch_id, CAST(count(*) FILTER (WHERE reason IS NULL) AS INTEGER) AS accepted,
             coalesce(string_agg(index || ':' || reason, '; ' ORDER BY index) FILTER (WHERE reason IS NOT NULL), '')
               AS rejected
           FROM checked GROUP BY batch_id""",
    ),
    "reject_counts": _with(
        f"""{_LINES},
timed AS (SELECT *, line_id % 600 AS second FROM judged),
limited AS (
  SELECT *, row_number() OVER (PARTITION BY client, second ORDER BY line_id) > {WINDOW_LIMIT} AS over_limit FROM timed),
classed AS (
  SELECT CASE WHEN over_limit THEN 'rate_limited' WHEN reason IS NOT NULL THEN 'invalid' END AS reason FROM limited)""",
        "SELECT reason, count(*) AS n FROM classed WHERE reason IS NOT NULL GROUP BY reason",
    ),
    "stamp_ingest_time": _with(
        _EV, "SELECT event_id, CASE WHEN id % 3 = 0 THEN ts + INTERVAL 2 SECOND ELSE ts END AS ts FROM ev"
    ),
    "default_properties": _with(
        _EV, "SELECT event_id, CASE WHEN id % 3 = 0 THEN '{}' ELSE properties END AS properties FROM ev"
    ),
    "map_properties": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}'
        ELSE '{"type":"' || event_type || '","user":"' || user_id || '"}' END AS properties FROM events""",
    "filter_name": _with(_EV, f"SELECT {_EVENT} FROM ev WHERE name = '{NAME}'"),
    "filter_today": _with(_NOW_STATE, "SELECT name, minute, n FROM today"),
    "filter_last_minutes": _with(
        _NOW_STATE,
        f"""SELECT name, minute, n FROM rollup_now
            WHERE minute >= date_trunc('minute', {_NOW})::TIMESTAMP - INTERVAL 90 MINUTE""",
    ),
    "filter_has_user": _with(_EV, "SELECT event_id, distinct_id FROM ev WHERE distinct_id <> ''"),
    "client_key": """SELECT event_id AS request_id, CASE event_id % 5
        WHEN 0 THEN 'team-' || user_id WHEN 1 THEN '10.0.0.' || user_id WHEN 2 THEN '2001:db8::' || user_id
        WHEN 3 THEN 'host-' || user_id ELSE 'unknown' END AS client FROM events""",
    # joins and de-duplication
    "new_events_only": _with(_EV, f"SELECT {_EVENT} FROM ev WHERE id % 3 <> 0"),
    "dedupe_batch": _with(_RECEIVED, f"SELECT {_EVENT} FROM ({_FIRSTS})"),
    "dedupe_stored": _with(
        _RECEIVED, f"SELECT {_EVENT} FROM ({_FIRSTS}) WHERE CAST(event_id AS BIGINT) % 3 <> 0"
    ),
    "batch_outcome": _with(
        f"{_RECEIVED}, ins AS ({_firsts('received', 'batch_id, ts, name, distinct_id, properties')})",
        """SELECT batch_id, r AS received, coalesce(i, 0) AS inserted, r - coalesce(i, 0) AS duplicates
           FROM (SELECT batch_id, count(*) AS r FROM received GROUP BY batch_id)
           LEFT JOIN (SELECT batch_id, count(*) AS i FROM ins GROUP BY batch_id) USING (batch_id)""",
    ),
    "dedupe_stream": _with(_EV, "SELECT event_id, name FROM ev"),
    "dedupe_stream_bounded": _with(_EV, "SELECT event_id, name FROM ev"),
    "stats_by_name": _with(
        _NOW_STATE,
        "SELECT t.name, t.count, u.count AS unique_users FROM totals t LEFT JOIN uniques_now u USING (name)",
    ),
    "reconcile": _with(
        f"{_RECEIVED}, stored AS ({_FIRSTS})",
        """SELECT coalesce(a.name, s.name) AS name, coalesce(a.n, 0) AS accepted, coalesce(s.n, 0) AS stored,
             coalesce(a.n, 0) - coalesce(s.n, 0) AS difference
           FROM (SELECT name, count(DISTINCT event_id) AS n FROM received GROUP BY name) a
           FULL OUTER JOIN (SELECT name, count(DISTINCT event_id) AS n FROM stored GROUP BY name) s
             ON a.name = s.name""",
    ),
    # counters
    "minute_rollup": _with(
        f"{_RECEIVED}, stored AS ({_FIRSTS})",
        f"SELECT name, {_MINUTE} AS minute, count(*) AS n FROM stored GROUP BY ALL",
    ),
    "merge_rollups": _with(
        _EV,
        f"""SELECT name, {_MINUTE} AS minute,
              count(*) + count(*) FILTER (WHERE distinct_id <> '') AS n FROM ev GROUP BY ALL""",
    ),
    "count_today": _with(
        _NOW_STATE,
        f"""SELECT '{NAME}' AS event, coalesce(CAST(sum(n) AS BIGINT), 0) AS count_today
            FROM today WHERE name = '{NAME}'""",
    ),
    "totals_today": _with(_NOW_STATE, "SELECT name, count FROM totals"),
    "grand_total_today": _with(
        _NOW_STATE, "SELECT coalesce(CAST(sum(count) AS BIGINT), 0) AS total FROM totals"
    ),
    "top_events": _with(
        _EV, "SELECT name, count(*) AS count FROM ev GROUP BY name ORDER BY count DESC, name LIMIT 20"
    ),
    "share_of_max": _with(
        f"{_EV}, t AS (SELECT name, count(*) AS count FROM ev GROUP BY name ORDER BY count DESC, name LIMIT 20)",
        """SELECT name, count, greatest(2.0::DOUBLE, 100.0::DOUBLE * count
             / CASE WHEN max(count) OVER () = 0 THEN 1 ELSE max(count) OVER () END) AS share FROM t""",
    ),
    "minute_series": _with(_NOW_STATE, "SELECT name, minute, n AS count FROM recent"),
    "dense_series": _with(
        f"""{_NOW_STATE},
spine AS (SELECT unnest(generate_series(date_trunc('minute', {_NOW})::TIMESTAMP - INTERVAL 15 MINUTE,
                                        date_trunc('minute', {_NOW})::TIMESTAMP, INTERVAL 1 MINUTE)) AS minute)""",
        """SELECT minute, coalesce(CAST(sum(n) AS BIGINT), 0) AS count
           FROM spine LEFT JOIN recent USING (minute) GROUP BY minute""",
    ),
    "share_of_peak": _with(
        f"""{_NOW_STATE},
spine AS (SELECT unnest(generate_series(date_trunc('minute', {_NOW})::TIMESTAMP - INTERVAL 15 MINUTE,
                                        date_trunc('minute', {_NOW})::TIMESTAMP, INTERVAL 1 MINUTE)) AS minute),
dense AS (SELECT minute, coalesce(CAST(sum(n) AS BIGINT), 0) AS count
          FROM spine LEFT JOIN recent USING (minute) GROUP BY minute)""",
        """SELECT minute, count,
             greatest(1.0::DOUBLE, 100.0::DOUBLE * count / greatest(max(count) OVER (), 1)) AS share FROM dense""",
    ),
    "dashboard_stats": _with(
        _NOW_STATE,
        """SELECT 'total' AS section, name, CAST(NULL AS TIMESTAMP) AS minute, count FROM totals
           UNION ALL SELECT 'unique', name, NULL, count FROM uniques_now
           UNION ALL SELECT 'series', name, minute, n FROM recent""",
    ),
    # unique users: below about 1,500 users per sketch the estimate is the exact number
    "uniques_daily": _with(
        _RECEIVED,
        f"""SELECT name, {_DAY} AS day, count(DISTINCT distinct_id) AS count
            FROM received WHERE distinct_id <> '' GROUP BY ALL""",
    ),
    "merge_sketches": _with(
        _RECEIVED,
        f"SELECT {_DAY} AS day, count(DISTINCT distinct_id) AS count FROM received WHERE distinct_id <> '' GROUP BY ALL",
    ),
    "uniques_today": _with(
        _NOW_STATE,
        f"""SELECT '{NAME}' AS event, coalesce((SELECT count FROM uniques_now WHERE name = '{NAME}'), 0)
              AS unique_users_today""",
    ),
    "uniques_today_all": _with(_NOW_STATE, "SELECT name, count FROM uniques_now"),
    "uniques_range": _with(
        _RECEIVED,
        f"""SELECT name, count(DISTINCT distinct_id) AS count FROM received
            WHERE distinct_id <> '' AND {_DAY} BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' GROUP BY name""",
    ),
    "exact_uniques": _with(
        _RECEIVED,
        f"""SELECT name, {_DAY} AS day, count(DISTINCT distinct_id) AS exact
            FROM received WHERE distinct_id <> '' GROUP BY ALL""",
    ),
    "unique_accuracy": _with(
        _RECEIVED,
        f"""SELECT name, {_DAY} AS day, count(DISTINCT distinct_id) AS exact, true AS within_5pct
            FROM received WHERE distinct_id <> '' GROUP BY ALL""",
    ),
    # portable sketches
    "portable_hash": _with(
        _HASHED,
        f"""SELECT event_id, CAST(CASE WHEN x >= 9223372036854775808::UHUGEINT
                 THEN CAST(x AS HUGEINT) - CAST({_TWO64} AS HUGEINT) ELSE CAST(x AS HUGEINT) END AS BIGINT) AS hash
            FROM ev JOIN placed USING (distinct_id)""",
    ),
    "portable_registers": _with(_HASHED, "SELECT name, day, register, rank FROM registers"),
    "portable_merge": _with(
        _HASHED, "SELECT name, register, max(rank) AS rank FROM registers GROUP BY name, register"
    ),
    "portable_estimate": _with(
        f"{_HASHED}, {_estimates('registers', 'name, day')}", "SELECT name, day, estimate FROM estimates"
    ),
    "portable_uniques_range": _with(
        f"""{_HASHED},
week AS (SELECT name, register, max(rank) AS rank FROM registers
         WHERE day BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' GROUP BY name, register),
{_estimates('week', 'name')}""",
        "SELECT name, estimate AS count FROM estimates",
    ),
    "export_portable_sketches": _with(
        _SKETCH_HEX,
        """SELECT name, day, md5('010E' || string_agg(printf('%02X', rank), '' ORDER BY i)) AS digest
           FROM cells GROUP BY name, day""",
    ),
    "import_portable_sketches": _with(
        _HASHED,
        """SELECT name, day, CASE WHEN name = 'error' THEN 0 ELSE count(*) END AS registers,
             CAST(CASE WHEN name = 'error' THEN 0 ELSE sum(rank) END AS BIGINT) AS rank_sum
           FROM registers GROUP BY name, day""",
    ),
    # streaming
    "ingest_stream": _with(
        _EV, f"SELECT name, {_MINUTE} AS minute, {_DAY} AS day, count(*) AS n FROM ev GROUP BY ALL"
    ),
    "ingest_stream_with_state": _with(
        f"""{_HASHED},
original AS (
  SELECT e.name, CAST(e.ts AS DATE) AS day, p.register, max(p.rank) AS rank
  FROM ev e JOIN placed p USING (distinct_id) WHERE e.distinct_id <> '' GROUP BY ALL),
{_estimates('original', 'name, day')}""",
        f"""SELECT name, day, n, estimate
            FROM (SELECT name, {_DAY} AS day, count(*) AS n FROM ev GROUP BY ALL) JOIN estimates USING (name, day)""",
    ),
    "live_rollup": _with(_EV, _ORIGINAL_ROLLUP),
    # quotas and health
    "fixed_window_quota": _with(_WINDOW, "SELECT request_id, client, allowed FROM windowed"),
    "token_bucket_quota": _with(
        f"""{_REQUESTS},
numbered AS (
  SELECT request_id, client, second * 1000000 AS us,
         row_number() OVER (PARTITION BY client ORDER BY second, request_id) AS k FROM requests),
walk AS (
  SELECT request_id, client, us, k, {_CAP - _TOKEN}::BIGINT AS tokens, true AS allowed FROM numbered WHERE k = 1
  UNION ALL
  SELECT request_id, client, us, k, CASE WHEN t >= {_TOKEN} THEN t - {_TOKEN} ELSE t END, t >= {_TOKEN}
  FROM (SELECT n.*, least({_CAP}, w.tokens + (n.us - w.us) * {_REFILL})::BIGINT AS t
        FROM walk w JOIN numbered n ON n.client = w.client AND n.k = w.k + 1))""",
        "SELECT request_id, client, allowed FROM walk",
        recursive=True,
    ),
    "flush_health": _with(
        _HEALTH,
        """SELECT count(*) AS flushes, CAST(sum(batch_size) AS BIGINT) AS events,
             CAST(coalesce(sum(inserted) FILTER (WHERE NOT failed), 0) AS BIGINT) AS inserted,
             CAST(coalesce(sum(batch_size - inserted) FILTER (WHERE NOT failed), 0) AS BIGINT) AS duplicates,
             CAST(coalesce(sum(batch_size) FILTER (WHERE failed), 0) AS BIGINT) AS dropped FROM health""",
    ),
    "exp_histogram": _with(_HISTOGRAM, "SELECT name, le, count FROM hist"),
    "histogram_quantile": _with(f"{_HISTOGRAM}, {_quantile('0.99')[0]}", _quantile("0.99")[1]),
    "batch_size_histogram": _with(
        f"{_HEALTH}, {_histogram_of('health', 'batch_size', BATCH_SIZE_BUCKETS)}", "SELECT le, count FROM hist"
    ),
    "flush_time_quantiles": "\nUNION ALL\n".join(
        f"({_with(f'{_FLUSH_TIMES}, {_quantile(q)[0]}', _quantile(q)[1])})" for q in ("0.5", "0.99")
    ),
    "event_rates": _with(
        f"""{_HEALTH},
outcomes AS (
  SELECT ts, 'accepted' AS outcome, 1 AS n FROM received
  UNION ALL SELECT ts, 'inserted', inserted FROM health WHERE NOT failed
  UNION ALL SELECT ts, 'duplicate', batch_size - inserted FROM health WHERE NOT failed
  UNION ALL SELECT ts, 'dropped', batch_size FROM health WHERE failed)""",
        f"""SELECT {_MINUTE} AS minute, outcome, CAST(sum(n) AS DOUBLE) / 60 AS per_second
            FROM outcomes GROUP BY ALL""",
    ),
    "rejected_rate_by_reason": _with(
        _LINES,
        f"""SELECT {_MINUTE} AS minute, 'invalid' AS reason, count(*) / 60.0::DOUBLE AS per_second
            FROM judged WHERE reason IS NOT NULL GROUP BY ALL""",
    ),
    "latency_percentiles": """WITH sorted AS (
          SELECT value / 1000 AS v, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events),
        probs(prob) AS (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE))
        SELECT prob, v AS value FROM sorted JOIN probs ON place = CAST(floor(prob * (n - 1)) AS BIGINT)""",
}

ORACLE["reconcile_tables"] = ORACLE["reconcile"]

_WITH_DAY = (
    "write_events write_minute_deltas write_sketch_deltas compact_deltas uniques_daily merge_sketches exact_uniques "
    "unique_accuracy portable_registers portable_estimate export_portable_sketches import_portable_sketches "
    "ingest_stream ingest_stream_with_state"
).split()
for _name in _WITH_DAY:
    ORACLE[_name] = f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM (\n{ORACLE[_name]}\n)"
