"""Shared inputs of the registered queries, and the same inputs as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinproof.operators.reconcile import TableSpec
from twinproof.session import prepare
from twinproof.registry import derived
from twinproof.sources import feed, logs
from twinproof.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

ANCHOR = "2024-01-31 00:00:00"
TODAY = "2024-01-30"

BY_ID = TableSpec("public.events", ["event_id"], ["event_id"], "ts", ["props"])
BY_TENANT = TableSpec("public.events", ["event_id"], ["user_id", "ts", "event_id"], "ts", ["props"])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(prepare(spark), folder, name)


def stream_path(folder: str, name: str) -> str:
    """A pattern, so that a stream accepts a table stored as one file as well as a folder of files."""
    return f"{folder.rstrip('/')}/{name}.parque[t]"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def source(spark: SparkSession, folder: str, mode: str = feed.FULL) -> DataFrame:
    return feed.events_after_changes(events(spark, folder), mode)


def log(spark: SparkSession, folder: str, mode: str = feed.FULL) -> DataFrame:
    return feed.event_log(events(spark, folder), mode)


def checks(spark: SparkSession, folder: str) -> DataFrame:
    return derived.checks(events(spark, folder))


def faults(spark: SparkSession, folder: str) -> DataFrame:
    return logs.parse_faults(derived.fault_lines(events(spark, folder)))


def server_events(spark: SparkSession, folder: str) -> DataFrame:
    return logs.parse_server_log(derived.server_lines(events(spark, folder)))


# --- the same inputs as SQL ---------------------------------------------------------------------------------------

def feed_sql(mode: str = feed.FULL, name: str = "feed") -> str:
    """The version log as a common table expression."""
    props = "''" if mode == feed.EMPTY_TEXT else "props"
    ts, user = ("TIMESTAMP '1970-01-01 00:00:00'", "CAST(0 AS BIGINT)") if mode == feed.DELETE_MARKER else ("ts", "user_id")
    moved = (
        " UNION ALL SELECT event_id, ts, user_id + 1, event_type, value + 1, props, 1, false FROM events WHERE event_id % 50 = 3"
        if mode == feed.KEY_MOVE
        else ""
    )
    return f"""{name} AS (
      SELECT event_id, ts, user_id, event_type, value, props, 0 AS _version, false AS _is_deleted FROM events
      UNION ALL SELECT event_id, ts, user_id, event_type, value + 1, {props}, 1, false FROM events WHERE event_id % 5 = 0
      UNION ALL SELECT event_id, {ts}, {user}, event_type, value, props, 2, true FROM events WHERE event_id % 20 = 7{moved})"""


def live_sql(key: str = "event_id", source_name: str = "feed", name: str = "live") -> str:
    return f"""{name} AS (
      SELECT event_id, ts, user_id, event_type, value, props FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY _version DESC) AS rn FROM {source_name})
      WHERE rn = 1 AND NOT _is_deleted)"""


def source_sql(mode: str = feed.FULL, name: str = "source") -> str:
    moved = "event_id % 50 = 3" if mode == feed.KEY_MOVE else "false"
    return f"""{name} AS (
      SELECT event_id, ts, CASE WHEN {moved} THEN user_id + 1 ELSE user_id END AS user_id, event_type,
             CASE WHEN event_id % 5 = 0 OR {moved} THEN value + 1 ELSE value END AS value, props
      FROM events WHERE event_id % 20 <> 7)"""


EPOCH = "CAST(floor(epoch_us(ts) / 1000000.0) AS HUGEINT)"
SUMS = (
    f"concat_ws('|', count(*), sum(event_id), sum({EPOCH}), sum(user_id), sum(strlen(event_type)), "
    r"sum(strlen(regexp_replace(props, '\s', '', 'g'))))"
)

RUN_TIME = "(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id * 30))"


def run_time_sql(shift: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id * 30 + ({shift})))"


CHECKS = f"""checks AS (
  SELECT {RUN_TIME} AS ts, CAST(event_id // 20 AS INTEGER) AS cycle,
    CASE user_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'sharded' ELSE 'local' END AS variant,
    'r' || (event_id % 2 + 1) AS replica,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'events' ELSE 'sessions' END AS tab,
    concat(event_id * 10, '|', user_id, '|', strlen(props)) AS pg,
    CASE WHEN event_id % 97 = 0 THEN ''
         WHEN event_id % 61 = 5 THEN concat(event_id * 10 - 1, '|', user_id, '|', strlen(props))
         ELSE concat(event_id * 10, '|', user_id, '|', strlen(props)) END AS ch,
    event_id % 97 <> 0 AND event_id % 61 <> 5 AS match,
    CAST(CAST(floor(value) AS BIGINT) % 300 AS INTEGER) AS waited_s,
    CASE WHEN event_id % 97 = 0 AND event_id % 2 = 0 THEN 'code: 241, MEMORY_LIMIT_EXCEEDED'
         WHEN event_id % 97 = 0 THEN 'dial tcp: no such host' END AS err
  FROM events)"""

FAULTS = f"""faults AS (
  SELECT {RUN_TIME} AS ts, CASE WHEN event_type IN ('error', 'purchase') THEN 'stop' ELSE 'restart' END AS action,
         'node-' || (user_id % 7) AS service FROM events WHERE value >= 150 AND event_type IN ('error', 'purchase', 'signup', 'click')
  UNION ALL
  SELECT {run_time_sql('180 + user_id % 240')}, 'start', 'node-' || (user_id % 7) FROM events
  WHERE value >= 150 AND event_type IN ('error', 'purchase'))"""

NEXT_START = """linked AS (
  SELECT f.*, (SELECT min(s.ts) FROM faults s WHERE s.action = 'start' AND s.service = f.service AND s.ts > f.ts) AS next_start
  FROM faults f)"""

WINDOWS = """windows AS (
  SELECT ts AS w_beg, CASE WHEN action = 'stop' THEN coalesce(next_start, ts + INTERVAL 600 SECONDS) ELSE ts END
         + INTERVAL 120 SECONDS AS w_end,
         CASE WHEN action = 'stop' THEN 'outage ' ELSE 'restart ' END || service AS label
  FROM linked WHERE action IN ('stop', 'restart'))"""

SPANS = """ends AS (SELECT cycle, min(ts) AS first_seen, max(ts) AS fin FROM checks GROUP BY cycle),
spans AS (
  SELECT cycle, coalesce(lag(fin) OVER (ORDER BY first_seen, cycle), fin - INTERVAL 900 SECONDS) AS beg, fin FROM ends)"""

GRADED = """graded AS (
  SELECT s.cycle, s.beg, s.fin, count(w.label) = 0 AS clean
  FROM spans s LEFT JOIN windows w ON w.w_beg < s.fin AND w.w_end > s.beg GROUP BY ALL)"""


def nearest_rank(alias: str, column: str, index: str, rows: str, by: str = "") -> str:
    """SQL of an order statistic: the value at the zero-based ``index``, an expression over ``n``."""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    keep = f"{by}, " if by else ""
    return f"""{alias} AS (SELECT {keep}max(v) AS {alias} FROM (
      SELECT {keep}{column} AS v, row_number() OVER ({part}ORDER BY {column}) - 1 AS i, count(*) OVER ({part}) AS n FROM {rows})
      WHERE i = {index} {group})"""
