"""The streaming forms, over tables that arrive in slices with a restart between them, and the drill-down."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinproof.functions.names import DELETED, VERSION
from twinproof.functions.terms import comparable_terms
from twinproof.operators import intervals, reconcile
from twinproof.operators.drilldown import drill_down
from twinproof.session import scratch
from twinproof.sources import feed
from twinproof.streaming import checksums, freshness, ingest, joins, late, progress, upserts, windows
from twinproof.verdicts import soak

from .base import (
    BY_ID, BY_TENANT, CHECKS, FAULTS, NEXT_START, SPANS, SUMS, TODAY, WINDOWS, Query, checks, events, faults, feed_sql, live_sql, log,
    server_events, source, source_sql,
)
from .replication import SQL as _SCANNED, _BOUNDS, _BUCKET
from .runs import _ATTEMPTS, _SERVER, _VERIFIED, attempts

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SLICES = 3


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def arrive(tables: dict[str, tuple], run) -> None:
    """Let tables arrive in slices and call ``run(paths)`` before the last slice and after it, as a restart would.

    ``tables`` maps a name to (rows, slice number from 0); each slice is written after the one before it.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    paths = {name: scratch(spark, f"arriving-{name}") for name in tables}
    for k in range(SLICES):
        for name, (rows, number) in tables.items():
            rows.where(number == k).write.mode("append").parquet(paths[name])
        if k >= SLICES - 2:
            run(paths)


def _by_time(column: str = "ts"):
    """Slices of the derived logs by time: events a third of the table apart."""
    def of(spark, d, rows):
        first, last = rows.agg(F.min(column), F.max(column)).first()
        if first is None:
            return F.lit(0)
        step = (last - first) / SLICES
        return F.when(F.col(column) < F.lit(first + step), 0).when(F.col(column) < F.lit(first + 2 * step), 1).otherwise(2)

    return of


def _stored(spark, path: str, schema: str):
    return spark.read.schema(schema).parquet(path)


def _append(stream, path: str, checkpoint: str) -> None:
    windows.write_settled(stream, path, checkpoint).awaitTermination()


# --- state --------------------------------------------------------------------------------------------------------

def _upserted(spark, rows, key, large=()):
    out, state = scratch(spark, "accepted"), scratch(spark, "upserts")

    def run(paths):
        stream = ingest.read_changes(spark, paths["log"], rows.schema, files_per_trigger=4)
        upserts.run_upserts(upserts.upsert_state_stream(stream, key, large), out, state).awaitTermination()

    # Versions of one key fall into any slice, in any order.
    arrive({"log": (rows, F.pmod(F.xxhash64("event_id", VERSION), F.lit(SLICES)))}, run)
    return upserts.read_state(spark, state, rows, key)


@query("upsert_state_stream", f"WITH {feed_sql()}, {live_sql('user_id, ts, event_id')} SELECT * FROM live")
def upsert_state_stream(spark, d):
    return _upserted(spark, log(spark, d), ["user_id", "ts", "event_id"])


@query("carried_state_stream", """SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END AS props FROM events WHERE event_id % 20 <> 7""")
def carried_state_stream(spark, d):
    """Updates that did not carry ``props`` find it in another micro-batch, before or after their own."""
    update = F.col(VERSION) == 1
    blank = log(spark, d).withColumn("props", F.when(update, F.lit(None)).otherwise(F.col("props"))).withColumn(
        "_unchanged", F.when(update & (F.col("event_id") % 10 != 0), F.array(F.lit("props"))).otherwise(F.array().cast("array<string>")))
    return _upserted(spark, blank, ["event_id"], ["props"])


# An hour before the newest attempt: whatever a wait needs has come by then.
@query("freshness_wait_stream", f"""WITH {_ATTEMPTS},
h AS (SELECT cycle, replica, min(waited) AS waited FROM w WHERE equal AND waited <= 300 GROUP BY ALL),
o AS (SELECT cycle, replica, min(waited) AS waited FROM w WHERE waited > 300 GROUP BY ALL),
l AS (SELECT cycle, replica, max(waited) AS waited FROM w WHERE started <= (SELECT max(moment) FROM w) - INTERVAL 1 HOUR GROUP BY ALL),
p AS (SELECT l.cycle, l.replica, coalesce(h.waited, o.waited, l.waited) AS waited FROM l LEFT JOIN h USING (cycle, replica) LEFT JOIN o USING (cycle, replica))
SELECT p.cycle, p.replica, w.moment AS ts, w.equal AS match, CAST(p.waited AS INTEGER) AS waited_s, CASE WHEN w.failed THEN 'query failed' END AS err
FROM p JOIN w ON w.cycle = p.cycle AND w.replica = p.replica AND w.waited = p.waited""")
def freshness_wait_stream(spark, d):
    rows = attempts(spark, d)
    out, state = scratch(spark, "waits"), scratch(spark, "waits-state")

    def run(paths):
        stream = ingest.read_changes(spark, paths["attempts"], rows.schema, files_per_trigger=100)
        _append(freshness.freshness_wait_stream(stream, ["cycle", "replica"]), out, state)

    arrive({"attempts": (rows, _by_time("at")(spark, d, rows))}, run)
    found = _stored(spark, out, "cycle int, replica string, ts timestamp, match boolean, waited_s int, err string")
    newest = rows.agg(F.max("at")).first()[0]
    settled = F.col("ts").cast("timestamp_ntz") - F.make_dt_interval(secs=F.col("waited_s")) <= F.lit(newest) - F.expr("INTERVAL 1 HOUR")
    return found.where(settled).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- stream-stream joins ------------------------------------------------------------------------------------------

_SETTLED = "(SELECT least(max(f.ts), (SELECT max(ts) FROM server)) - INTERVAL 1 HOUR FROM faults f)"


@query("fault_verified_stream", f"WITH {FAULTS}, {_SERVER} SELECT DISTINCT ts, action, service, {_VERIFIED} AS verified FROM faults f WHERE f.ts <= {_SETTLED}")
def fault_verified_stream(spark, d):
    """Fault actions and server logs as two streams; actions an hour behind both are compared."""
    acts, logged = faults(spark, d).select("ts", "action", "service"), server_events(spark, d).select("service", "ts", "kind")
    out, state = scratch(spark, "verified"), scratch(spark, "verified-state")

    def run(paths):
        left = ingest.read_changes(spark, paths["faults"], acts.schema)
        right = ingest.read_changes(spark, paths["server"], logged.schema)
        action = F.col("action")
        want = left.withColumn("want", F.when(action == "stop", "stop").otherwise("up"))
        _append(joins.exists_within_stream(
            want, right, ["service"], "ts", "ts", F.when(action == "restart", 0).otherwise(-5), F.when(action == "stop", 60).otherwise(180),
            "want", "kind", before=5, after=180), out, state)

    by = _by_time()
    arrive({"faults": (acts, by(spark, d, acts)), "server": (logged, by(spark, d, logged))}, run)
    last = F.lit(min(acts.agg(F.max("ts")).first()[0], logged.agg(F.max("ts")).first()[0])) - F.expr("INTERVAL 1 HOUR")
    found = _stored(spark, out, "ts timestamp_ntz, action string, service string, verified boolean")
    return found.where(F.col("ts") <= last)


@query("outage_end_stream", f"""WITH {FAULTS}, {NEXT_START} SELECT DISTINCT ts, service, CASE WHEN next_start <= ts + INTERVAL 1 HOUR THEN next_start END AS next_start
FROM linked WHERE action = 'stop' AND ts <= least((SELECT max(ts) FROM faults WHERE action = 'stop'), (SELECT max(ts) FROM faults WHERE action = 'start')) - INTERVAL 2 HOURS""")
def outage_end_stream(spark, d):
    """Stops meet the starts of the hour after them; stops two hours behind both streams are compared."""
    rows = faults(spark, d).select("ts", "action", "service")
    stops, starts = rows.where("action = 'stop'").select("ts", "service"), rows.where("action = 'start'").select("ts", "service")
    out, state = scratch(spark, "outages"), scratch(spark, "outages-state")

    def run(paths):
        left, right = (ingest.read_changes(spark, paths[n], stops.schema) for n in ("stops", "starts"))
        _append(joins.next_after_stream(left, right, ["service"], "ts", "ts", "next_start", horizon=3600), out, state)

    by = _by_time()
    arrive({"stops": (stops, by(spark, d, stops)), "starts": (starts, by(spark, d, starts))}, run)
    last = F.lit(min(stops.agg(F.max("ts")).first()[0], starts.agg(F.max("ts")).first()[0])) - F.expr("INTERVAL 2 HOURS")
    return _stored(spark, out, "ts timestamp_ntz, service string, next_start timestamp_ntz").where(F.col("ts") <= last)


@query("fault_overlap_stream", f"""WITH {CHECKS}, {FAULTS}, {NEXT_START}, {WINDOWS}, {SPANS}
SELECT s.cycle, s.beg, s.fin, coalesce((SELECT string_agg(label, ', ' ORDER BY label) FROM (
  SELECT DISTINCT label FROM windows w WHERE w.w_beg < s.fin AND w.w_end > s.beg)), '') AS labels
FROM spans s WHERE s.fin <= least((SELECT max(fin) FROM spans), (SELECT max(w_beg) FROM windows)) - INTERVAL 6 HOURS""")
def fault_overlap_stream(spark, d):
    """Closed cycles and fault windows as two streams; cycles six hours behind both are compared."""
    spans = intervals.cycle_intervals(checks(spark, d)).select("cycle", "beg", "end")
    struck = soak.fault_windows(faults(spark, d)).select("w_beg", "w_end", "label")
    out, state = scratch(spark, "overlaps"), scratch(spark, "overlaps-state")

    def run(paths):
        left = ingest.read_changes(spark, paths["spans"], spans.schema)
        right = ingest.read_changes(spark, paths["windows"], struck.schema)
        _append(joins.overlap_labels_stream(left, right, ["cycle"]), out, state)

    arrive({"spans": (spans, _by_time("end")(spark, d, spans)), "windows": (struck, _by_time("w_beg")(spark, d, struck))}, run)
    found = _stored(spark, out, "cycle int, beg timestamp_ntz, `end` timestamp_ntz, labels array<string>")
    last = F.lit(min(spans.agg(F.max("end")).first()[0], struck.agg(F.max("w_beg")).first()[0])) - F.expr("INTERVAL 6 HOURS")
    return found.where(F.col("end") <= last).select("cycle", "beg", F.col("end").alias("fin"), F.array_join("labels", ", ").alias("labels"))


# --- positions ----------------------------------------------------------------------------------------------------

def _ingested(spark, rows):
    """A log ingested in slices with totals kept beside it: its folder and theirs."""
    path, totals, state = scratch(spark, "ingested"), scratch(spark, "totals"), scratch(spark, "ingest-state")

    def run(paths):
        stream = ingest.read_changes(spark, paths["log"], rows.schema, files_per_trigger=4)
        ingest.ingest(stream, path, state, progress=totals).awaitTermination()

    arrive({"log": (rows, F.pmod(F.xxhash64("event_id", VERSION), F.lit(SLICES)))}, run)
    return path, progress.read_totals(spark, totals)


@query("status_of_totals", _SCANNED["replication_status"])
def status_of_totals(spark, d):
    """Positions and lag as the ingests counted them; equal to a scan of the logs."""
    full = log(spark, d)
    _, whole = _ingested(spark, full)
    _, behind = _ingested(spark, full.where(F.col(VERSION) < 2))
    return progress.status_of_totals(whole, {"a": whole, "b": behind}, "public.events").drop("table")


@query("cutover_gate_of_totals", _SCANNED["cutover_gate"])
def cutover_gate_of_totals(spark, d):
    """The gate over an ingested log, its position from the totals."""
    path, totals = _ingested(spark, log(spark, d))
    held = {"r": ingest.read_ingested(spark, path).drop(ingest.BATCH)}
    gates = [reconcile.cutover_gate(source(spark, d), held, BY_ID, w, TODAY, positions={"r": totals}) for w in (2, 3)]
    return gates[0].unionByName(gates[1]).drop("table")


# --- counts and checksums -----------------------------------------------------------------------------------------

@query("incremental_checksums", f"""WITH {source_sql()}, {_BOUNDS}, {feed_sql()}, {live_sql()}
SELECT {_BUCKET} AS bucket, {SUMS} AS sums FROM live, bounds GROUP BY 1""")
def incremental_checksums(spark, d):
    """Changes with both images arrive in any order; the sums after the last batch equal a scan of the live rows."""
    rows, live = log(spark, d), source(spark, d)
    lo, hi = reconcile.key_bounds(live, "event_id").first()
    width = reconcile.bucket_width(lo, hi)
    terms = comparable_terms(live.schema, ["props"])
    changes = checksums.changes_of(rows, ["event_id"], VERSION, DELETED)
    path, state = scratch(spark, "checksums"), scratch(spark, "checksums-state")

    def run(paths):
        stream = ingest.read_changes(spark, paths["changes"], changes.schema, files_per_trigger=4)
        checksums.keep_checksums(stream, path, state, "event_id", terms, lo, width).awaitTermination()

    arrive({"changes": (changes, F.pmod(F.xxhash64("event_id", VERSION), F.lit(SLICES)))}, run)
    return checksums.read_checksums(spark, path, terms)


# Every eleventh event comes a slice later than its time says, so that its day has mostly been reported.
_DAYS = """SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
  WHERE CAST(ts AS DATE) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY 1"""


@query("late_days", _DAYS)
def late_days(spark, d):
    """Reports of settled days plus the corrections by late rows: nothing is lost."""
    rows = events(spark, d)
    path, state = scratch(spark, "late"), scratch(spark, "late-state")
    on_time = _by_time()(spark, d, rows)

    def run(paths):
        stream = ingest.read_changes(spark, paths["events"], rows.schema, files_per_trigger=1)
        late.count_days(stream, "ts", path, state).awaitTermination()

    arrive({"events": (rows, F.when(F.col("event_id") % 11 == 0, F.least(on_time + 1, F.lit(SLICES - 1))).otherwise(on_time))}, run)
    added = late.corrections(spark, path).groupBy("day").agg(F.sum("added").alias("added"))
    return late.reports(spark, path).join(added, "day", "left").select("day", (F.col("n") + F.coalesce("added", F.lit(0))).alias("n"))


# --- drill-down ---------------------------------------------------------------------------------------------------

def _rows_sql(mode: str, key: str) -> str:
    src = feed.KEY_MOVE if mode == feed.KEY_MOVE else feed.FULL
    return f"""WITH {source_sql(src)}, {feed_sql(mode)}, {live_sql(key)},
s AS (SELECT event_id, {SUMS} AS sums FROM source GROUP BY 1), r AS (SELECT event_id, {SUMS} AS sums FROM live GROUP BY 1)
SELECT event_id AS key, 'r' AS replica, coalesce(s.sums, '') AS source_sums, coalesce(r.sums, '') AS replica_sums
FROM s FULL JOIN r USING (event_id) WHERE s.sums IS DISTINCT FROM r.sums"""


def _rows_of(mode: str, spec):
    def run(spark, d):
        src = source(spark, d, feed.KEY_MOVE if mode == feed.KEY_MOVE else feed.FULL)
        return drill_down(src, {"r": log(spark, d, mode)}, spec)

    return run


for _name, _mode, _spec, _key in (
    ("clean_rows", feed.FULL, BY_TENANT, "user_id, ts, event_id"),
    ("delete_marker_rows", feed.DELETE_MARKER, BY_TENANT, "user_id, ts, event_id"),
    ("empty_text_rows", feed.EMPTY_TEXT, BY_ID, "event_id"),
    ("tenant_move_rows", feed.KEY_MOVE, BY_TENANT, "user_id, ts, event_id"),
):
    query(_name, _rows_sql(_mode, _key))(_rows_of(_mode, _spec))
