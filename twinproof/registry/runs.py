"""Run logs and verdicts: checks, faults, cycles, recovery, tallies, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinproof.functions.names import FAULT_EVERY_SECONDS
from twinproof.operators import intervals
from twinproof.operators.onerow import side_by_side
from twinproof.session import pinned, scratch
from twinproof.registry import derived
from twinproof.sources import logs, tables
from twinproof.verdicts import audit, benchtable, claims as claiming, cycles, soak

from .analytics import _row_counts, _samples
from .base import (
    CHECKS, FAULTS, GRADED, NEXT_START, RUN_TIME, SPANS, WINDOWS, Query, checks, events, faults, nearest_rank,
    run_time_sql, server_events,
)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_ALL = f"WITH {CHECKS}, {FAULTS}, {NEXT_START}, {WINDOWS}, {SPANS}, {GRADED}"
_P99 = "CAST(floor(CAST(0.99 AS DOUBLE) * (n - 1)) AS BIGINT)"
_KIND = """CASE WHEN match THEN NULL WHEN coalesce(ch, '') = '' AND regexp_matches(coalesce(err, ''), '241|MEMORY_LIMIT') THEN 'memory'
  WHEN coalesce(ch, '') = '' THEN 'error' ELSE 'lag' END"""

# An excluded hour and a contended stretch, early enough to fall inside every test run.
RUN = soak.Windows(
    excluded=[("2024-01-01 06:00:00", "2024-01-01 06:41:07")], contention=[("2024-01-01 10:09:00", "2024-01-01 11:20:00")]
)
_WINDOW = """CASE WHEN ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-01 06:41:07' THEN 'excluded'
  WHEN ts >= TIMESTAMP '2024-01-01 10:09:00' AND ts < TIMESTAMP '2024-01-01 11:20:00' THEN 'contention' ELSE 'valid' END"""


# --- log sources -------------------------------------------------------------------------------------------------------

@query("checks_read", f"WITH {CHECKS} SELECT ts, cycle, variant, replica, tab, pg, ch, match, waited_s, err FROM checks")
def checks_read(spark, d):
    """Write the check log as JSON lines, broken ones among them, and read it back."""
    path = scratch(spark, "checks")
    derived.check_lines(events(spark, d)).write.text(path)
    return logs.read_checks(spark, path).withColumnRenamed("table", "tab").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("checks_appended", f"WITH {CHECKS} SELECT ts, cycle, variant, replica, tab, pg, ch, match, waited_s, err FROM checks")
def checks_appended(spark, d):
    """Cycles append their records to one log: even cycles first, odd ones after them."""
    path, rows = scratch(spark, "check-log"), checks(spark, d)
    for odd in (0, 1):
        logs.append_checks(rows.where(F.col("cycle") % 2 == odd), path)
    return logs.read_checks(spark, path).withColumnRenamed("table", "tab").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("results_tab_separated", """SELECT concat('user ', user_id) AS key, count(*) AS n, min(event_id) AS first_id, sum(event_id) / 4.0 AS quarter
  FROM events GROUP BY user_id""")
def results_tab_separated(spark, d):
    """Answers as lines of a key and its values, written and read back; other lines are skipped."""
    path, key = scratch(spark, "results"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("key")
    answers = events(spark, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), (F.sum("event_id") / F.lit(4.0)).alias("quarter"))
    tables.write_tab_separated(answers.select(key, "n", "first_id", "quarter"), path)
    answers.select(F.concat(F.lit("no answer for "), key).alias("value")).write.mode("append").text(path)
    return tables.read_tab_separated(spark, path, "key string, n bigint, first_id bigint, quarter double")


@query("fault_log_parse", f"WITH {FAULTS} SELECT ts, action, service FROM faults")
def fault_log_parse(spark, d):
    return faults(spark, d)


@query("skipped_faults", f"""SELECT {RUN_TIME} AS ts, concat(strftime({RUN_TIME}, '%Y-%m-%dT%H:%M:%SZ'), ' skip fault ', event_id, ': paused by guard') AS line
FROM events WHERE value >= 150 AND event_type = 'view'""")
def skipped_faults(spark, d):
    return logs.parse_skips(derived.fault_lines(events(spark, d)))


@query("server_log_parse", f"""SELECT 'node-' || (user_id % 7) AS service, {run_time_sql('user_id % 70')} AS ts, 'stop' AS kind FROM events WHERE value >= 150 AND event_type IN ('error', 'purchase')
UNION ALL SELECT 'node-' || (user_id % 7), {run_time_sql('180 + user_id % 240 + 20')}, 'up' FROM events WHERE value >= 150 AND event_type IN ('error', 'purchase')
UNION ALL SELECT 'node-' || (user_id % 7), {run_time_sql('user_id % 90 * 3')}, 'up' FROM events WHERE value >= 150 AND event_type IN ('signup', 'click')""")
def server_log_parse(spark, d):
    return server_events(spark, d)


@query("claims_read", r"""SELECT concat('user ', user_id, ' did ', event_id) AS claim, event_type || '.log' AS log, concat('^event ', event_id, ' ;user ', user_id) AS patterns
FROM events WHERE event_type NOT IN ('error', 'view')""")
def claims_read(spark, d):
    """Claim lines with comments and blanks between them."""
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("# "), "props"))
        .when(F.col("event_type") == "view", F.lit("  "))
        .otherwise(F.concat(
            F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_id").cast("string"), F.lit("\t"),
            "event_type", F.lit(".log\t^event "), F.col("event_id").cast("string"), F.lit(" && user "), F.col("user_id").cast("string"),
        ))
    )
    parsed = logs.parse_claims(events(spark, d).select(line.alias("value")))
    return parsed.withColumn("patterns", F.array_join("patterns", " ;"))


# --- checks --------------------------------------------------------------------------------------------------------------

@query("miss_classes", f"WITH {CHECKS} SELECT variant, {_KIND} AS kind, count(*) AS n FROM checks WHERE NOT match GROUP BY 1, 2")
def miss_classes(spark, d):
    kinds = checks(spark, d).select("variant", cycles.miss_class().alias("kind"))
    return kinds.where("kind is not null").groupBy("variant", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("variant_summary", f"""WITH {CHECKS}, o AS (SELECT *, row_number() OVER (PARTITION BY variant, match ORDER BY ts, cycle, replica, tab) AS i FROM checks)
SELECT variant, count(*) AS checks, count(*) FILTER (WHERE NOT match) AS mismatches, max(pg) FILTER (WHERE NOT match AND i = 1) AS first_pg,
  max(cycle) FILTER (WHERE NOT match AND i = 1) AS first_cycle, arg_max(cycle, ts) AS last_cycle FROM o GROUP BY variant""")
def variant_summary(spark, d):
    first = F.col("first_mismatch")
    return cycles.summarise(checks(spark, d)).select(
        "variant", "checks", "mismatches", first["pg"].alias("first_pg"), first["cycle"].alias("first_cycle"), "last_cycle"
    )


@query("summary_file", SQL["variant_summary"])
def summary_file(spark, d):
    """The totals per variant as the summary file holds them once it has been rewritten."""
    path, rows = scratch(spark, "summary"), checks(spark, d)
    for seen in (rows.where("cycle < 3"), rows):
        cycles.write_summary(seen, path)
    held = spark.read.schema("variant string, checks bigint, mismatches bigint, first_mismatch struct<pg string, cycle int>, last_cycle int").json(path)
    first = F.col("first_mismatch")
    return held.select("variant", "checks", "mismatches", first["pg"].alias("first_pg"), first["cycle"].alias("first_cycle"), "last_cycle")


@query("wait_percentiles", f"""WITH {CHECKS}, m AS (SELECT * FROM checks WHERE match), {nearest_rank('p50', 'waited_s', 'n // 2', 'm', 'variant')},
{nearest_rank('p99', 'waited_s', _P99, 'm', 'variant')}, {nearest_rank('top', 'waited_s', 'n - 1', 'm', 'variant')}
SELECT variant, p50, p99, top AS max FROM p50 JOIN p99 USING (variant) JOIN top USING (variant)""")
def wait_percentiles(spark, d):
    return soak.wait_statistics(checks(spark, d).where("match"), ["variant"]).drop("n")


@query("miss_recovery", f"""WITH {CHECKS}, c AS (SELECT cycle, bool_and(match) AS exact FROM checks GROUP BY cycle)
SELECT c.cycle, n.exact AS recovered FROM c LEFT JOIN c n ON n.cycle = c.cycle + 1 WHERE NOT c.exact""")
def miss_recovery(spark, d):
    return cycles.miss_recovery(checks(spark, d))


@query("insert_rate", f"""WITH {CHECKS}, s AS (SELECT variant, ts, CAST(split_part(pg, '|', 1) AS BIGINT) AS k FROM checks WHERE tab = 'events')
SELECT variant, max(k) - min(k) AS rows, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS seconds,
  round((arg_max(k, ts) - arg_min(k, ts)) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 9) AS rate FROM s GROUP BY variant""")
def insert_rate(spark, d):
    rates = cycles.insert_rate(checks(spark, d).where(F.col("table") == "events"), "variant")
    return rates.withColumn("rate", F.round("rate", 9))


_ATTEMPTS = f"""a AS (SELECT CAST(event_id // 20 AS INTEGER) AS cycle, 'r' || (event_id % 2 + 1) AS replica, {RUN_TIME} AS moment,
  (TIMESTAMP '2024-01-01 00:00:00' + to_seconds((event_id // 20) * 600)) AS started,
  value < 20 AND event_id % 97 <> 0 AS equal, event_id % 97 = 0 AS failed FROM events),
w AS (SELECT *, CAST(epoch(moment) - epoch(started) AS BIGINT) AS waited FROM a)"""


def attempts(spark, d):
    """Every event is one comparison attempt of its cycle; small values mean the two sides agreed."""
    failed = F.col("event_id") % 97 == 0
    start = F.timestamp_seconds(F.unix_timestamp(F.lit(derived.START)) + F.expr("event_id div 20") * 600).cast("timestamp_ntz")
    return events(spark, d).select(
        F.expr("cast(event_id div 20 as int)").alias("cycle"),
        F.concat(F.lit("r"), (F.col("event_id") % 2 + 1).cast("string")).alias("replica"),
        start.alias("started"),
        derived.run_time().alias("at"),
        F.lit("x").alias("pg"),
        F.when(F.col("value") < 20, "x").otherwise("y").alias("ch"),
        F.when(failed, "query failed").alias("err"),
    )


@query("freshness_wait", f"""WITH {_ATTEMPTS},
h AS (SELECT cycle, replica, min(waited) AS waited FROM w WHERE equal AND waited <= 300 GROUP BY ALL),
o AS (SELECT cycle, replica, min(waited) AS waited FROM w WHERE waited > 300 GROUP BY ALL),
l AS (SELECT cycle, replica, max(waited) AS waited FROM w GROUP BY ALL),
p AS (SELECT l.cycle, l.replica, coalesce(h.waited, o.waited, l.waited) AS waited FROM l LEFT JOIN h USING (cycle, replica) LEFT JOIN o USING (cycle, replica))
SELECT p.cycle, p.replica, w.moment AS ts, w.equal AS match, CAST(p.waited AS INTEGER) AS waited_s, CASE WHEN w.failed THEN 'query failed' END AS err
FROM p JOIN w ON w.cycle = p.cycle AND w.replica = p.replica AND w.waited = p.waited""")
def freshness_wait(spark, d):
    return cycles.freshness_waits(attempts(spark, d), ["cycle", "replica"]).select("cycle", "replica", "ts", "match", "waited_s", "err")


# --- intervals -------------------------------------------------------------------------------------------------------------

@query("cycle_intervals", f"WITH {CHECKS}, {SPANS} SELECT cycle, beg, fin AS \"end\" FROM spans")
def cycle_intervals(spark, d):
    return intervals.cycle_intervals(checks(spark, d))


@query("outage_end_asof", f"""WITH {FAULTS}, {NEXT_START} SELECT ts, service, next_start, coalesce(next_start, ts + INTERVAL 600 SECONDS) AS until_ FROM linked WHERE action = 'stop'""")
def outage_end_asof(spark, d):
    linked = soak.outage_ends(faults(spark, d)).where(F.col("action") == "stop")
    return linked.select(
        "ts", "service", "next_start", F.coalesce("next_start", F.col("ts") + F.expr("INTERVAL 600 SECONDS")).alias("until_")
    )


@query("outage_ties", """WITH f AS (SELECT event_id, (event_id // 40) * 60 AS t, CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'stop' END AS action,
  concat('node-', user_id % 3) AS service FROM events)
SELECT event_id, (SELECT min(s.t) FROM f s WHERE s.action = 'start' AND s.service = f.service AND s.t > f.t) AS next_start FROM f""")
def outage_ties(spark, d):
    """Forty actions a minute, all at the same second: a stop never takes a start of its own second for its end."""
    at = F.timestamp_seconds(F.expr("(event_id div 40) * 60")).cast("timestamp_ntz")
    rows = events(spark, d).select(
        "event_id", at.alias("ts"), F.when(F.col("event_id") % 3 == 0, "start").otherwise("stop").alias("action"),
        F.concat(F.lit("node-"), (F.col("user_id") % 3).cast("string")).alias("service"))
    return soak.outage_ends(rows).select("event_id", F.unix_timestamp(F.col("next_start").cast("timestamp")).alias("next_start"))


@query("fault_overlap", f"""WITH {CHECKS}, {FAULTS}, {NEXT_START}, {WINDOWS}, {SPANS}
SELECT s.cycle, s.beg, s.fin, coalesce((SELECT string_agg(label, ', ' ORDER BY label) FROM (
  SELECT DISTINCT label FROM windows w WHERE w.w_beg < s.fin AND w.w_end > s.beg)), '') AS labels FROM spans s""")
def fault_overlap(spark, d):
    spans = intervals.cycle_intervals(checks(spark, d))
    hit = intervals.overlap_labels(spans, soak.fault_windows(faults(spark, d)), ["cycle"])
    return hit.select("cycle", "beg", F.col("end").alias("fin"), F.array_join("labels", ", ").alias("labels"))


_SERVER = f"""server AS (SELECT 'node-' || (user_id % 7) AS service, {run_time_sql('user_id % 70')} AS ts, 'stop' AS kind FROM events WHERE value >= 150 AND event_type IN ('error', 'purchase')
UNION ALL SELECT 'node-' || (user_id % 7), {run_time_sql('180 + user_id % 240 + 20')}, 'up' FROM events WHERE value >= 150 AND event_type IN ('error', 'purchase')
UNION ALL SELECT 'node-' || (user_id % 7), {run_time_sql('user_id % 90 * 3')}, 'up' FROM events WHERE value >= 150 AND event_type IN ('signup', 'click'))"""
_VERIFIED = """EXISTS (SELECT 1 FROM server s WHERE s.service = f.service AND s.kind = CASE WHEN f.action = 'stop' THEN 'stop' ELSE 'up' END
  AND s.ts >= f.ts - to_seconds(CASE WHEN f.action = 'restart' THEN 0 ELSE 5 END)
  AND s.ts <= f.ts + to_seconds(CASE WHEN f.action = 'stop' THEN 60 ELSE 180 END))"""


@query("fault_verified", f"WITH {FAULTS}, {_SERVER} SELECT ts, action, service, {_VERIFIED} AS verified FROM faults f")
def fault_verified(spark, d):
    return audit.verify_actions(faults(spark, d), server_events(spark, d)).select("ts", "action", "service", "verified")


def _gaps(spark, d):
    linked = soak.outage_ends(faults(spark, d)).where(F.col("action") != "start")
    seconds = lambda c: c.cast("timestamp").cast("bigint")
    done = F.when(F.col("action") == "stop", F.coalesce("next_start", "ts")).otherwise(F.col("ts"))
    struck = linked.select(seconds(F.col("ts")).alias("t"), seconds(done).alias("done"))
    start, last = checks(spark, d).agg(seconds(F.min("ts")), seconds(F.max("ts"))).first()
    return intervals.schedule_gaps(struck, F.lit(start), F.lit(last), every=FAULT_EVERY_SECONDS)


# The due ticks of a gap are those at or before the last check and more than 120 s before the fault that closes it.
_GAPS = f"""WITH {CHECKS}, {FAULTS}, {NEXT_START}, b AS (SELECT CAST(epoch(min(ts)) AS BIGINT) AS start, CAST(epoch(max(ts)) AS BIGINT) AS last FROM checks),
f AS (SELECT CAST(epoch(ts) AS BIGINT) AS t, CAST(epoch(CASE WHEN action = 'stop' THEN coalesce(next_start, ts) ELSE ts END) AS BIGINT) AS done FROM linked WHERE action <> 'start'),
g AS (SELECT coalesce(lag(done) OVER (ORDER BY t, done), start) AS begin_, t FROM f, b
  UNION ALL SELECT (SELECT arg_max(done, struct_pack(t := t, done := done)) FROM f), NULL),
k AS (SELECT begin_, t, begin_ + unnest(generate_series(1, greatest((last - begin_) // 2400, 0))) * 2400 AS due FROM g, b)"""


@query("missing_ticks", f"{_GAPS} SELECT due FROM k WHERE t IS NULL OR t - due > 120")
def missing_ticks(spark, d):
    return intervals.missing_ticks(_gaps(spark, d))


# --- verdicts ---------------------------------------------------------------------------------------------------------------

@query("graded_cycles", f"{_ALL} SELECT cycle, beg, fin, clean, (SELECT bool_or(NOT match) FROM checks c WHERE c.cycle = g.cycle) AS missed FROM graded g")
def graded_cycles(spark, d):
    return soak.graded_cycles(checks(spark, d), faults(spark, d)).select("cycle", "beg", F.col("end").alias("fin"), "clean", "missed")


_STATS = f"""{_ALL}, k AS (SELECT *, {_KIND} AS kind FROM checks),
x AS (SELECT cycle, bool_and(match) AS exact, max(ts) AS fin FROM checks GROUP BY cycle),
rec AS (SELECT x.cycle, n.exact AS recovered FROM x LEFT JOIN x n ON n.cycle = x.cycle + 1 WHERE NOT x.exact),
cw AS (SELECT waited_s FROM checks JOIN graded USING (cycle) WHERE match AND clean),
{nearest_rank('p50', 'waited_s', 'n // 2', 'cw')}, {nearest_rank('p99', 'waited_s', _P99, 'cw')},
s AS (SELECT count(*) AS checks, count(*) FILTER (WHERE match) AS exact, count(*) FILTER (WHERE kind = 'lag') AS lag_misses,
  count(*) FILTER (WHERE kind IN ('error', 'memory')) AS query_errors, count(*) FILTER (WHERE kind = 'memory') AS memory_errors,
  round((epoch(max(ts)) - epoch(min(ts))) / 3600.0, 6) AS hours FROM k),
y AS (SELECT count(*) AS cycles, count(*) FILTER (WHERE clean) AS clean, count(*) FILTER (WHERE NOT clean) AS affected,
  count(*) FILTER (WHERE clean AND NOT exact) AS clean_misses, arg_max(exact, g.fin) AS final_exact FROM graded g JOIN x USING (cycle)),
z AS (SELECT count(*) FILTER (WHERE recovered IS NULL) AS pending, count(*) FILTER (WHERE NOT recovered) AS unrecovered FROM rec)"""


@query("soak_stats", f"{_STATS} SELECT s.*, y.*, z.*, p50, p99, (SELECT max(waited_s) FROM cw) AS \"max\" FROM s, y, z, p50, p99")
def soak_stats(spark, d):
    stats = soak.soak_verdict(checks(spark, d), faults(spark, d)).stats
    return stats.drop("first", "last", "audit_ok").withColumn("hours", F.round("hours", 6))


@query("soak_verdict", f"""{_STATS}, c AS (
  SELECT 1 AS no, true AS ok UNION ALL SELECT 2, false UNION ALL SELECT 3, hours >= 5.5 FROM s
  UNION ALL SELECT 4, pending = 0 AND unrecovered = 0 FROM z UNION ALL SELECT 5, final_exact FROM y
  UNION ALL SELECT 6, clean_misses = 0 FROM y UNION ALL SELECT 7, p99 <= 150 FROM p99 UNION ALL SELECT 8, memory_errors = 0 FROM s)
SELECT no, ok FROM c UNION ALL SELECT 99, bool_and(ok) FROM c""")
def soak_verdict(spark, d):
    summary = _audit(spark, d).summary
    return soak.soak_verdict(checks(spark, d), faults(spark, d), audit_ok=summary).criteria.select("no", "ok")


def _audit(spark, d):
    lines = derived.fault_lines(events(spark, d))
    bounds = checks(spark, d).agg(F.min("ts").alias("start"), F.max("ts").alias("until"))
    return audit.fault_audit(faults(spark, d), bounds, logs.parse_skips(lines), server_events(spark, d), checks(spark, d))


@query("fault_audit", f"""{_GAPS}, {_SERVER}, m AS (SELECT begin_, t, count(due) FILTER (WHERE t IS NULL OR t - due > 120) AS missing FROM g LEFT JOIN k USING (begin_, t) GROUP BY ALL),
missing AS (SELECT count(*) AS n FROM k WHERE t IS NULL OR t - due > 120),
per AS (SELECT g.begin_, g.t, (SELECT count(*) FROM k WHERE k.begin_ = g.begin_ AND k.t IS NOT DISTINCT FROM g.t AND (k.t IS NULL OR k.t - k.due > 120)) AS missing FROM g),
due AS (SELECT count(*) AS n FROM per, b WHERE t IS NOT NULL AND begin_ + (missing + 1) * 2400 <= last),
v AS (SELECT action, ts, {_VERIFIED} AS verified FROM faults f),
a AS (SELECT count(*) FILTER (WHERE action <> 'start' AND CAST(epoch(ts) AS BIGINT) <= (SELECT last FROM b)) AS applied, count(*) AS logged,
  count(*) FILTER (WHERE verified) AS verified FROM v),
sk AS (SELECT count(*) AS n FROM events WHERE value >= 150 AND event_type = 'view')
SELECT missing.n + due.n AS scheduled, missing.n AS missing, applied, logged, verified, sk.n AS skipped,
  applied = missing.n + due.n AND missing.n = 0 AND sk.n = 0 AND verified = logged AS ok FROM missing, due, a, sk""")
def fault_audit(spark, d):
    return _audit(spark, d).summary


# --- tallies ------------------------------------------------------------------------------------------------------------------

@query("tally_by_window", f"""WITH {CHECKS}, k AS (SELECT *, {_KIND} AS kind, {_WINDOW} AS window_ FROM checks),
t AS (SELECT window_, variant, 'checks' AS counter FROM k UNION ALL SELECT window_, variant, CASE WHEN kind = 'lag' THEN 'lag_miss' ELSE 'query_error' END FROM k WHERE kind IS NOT NULL
  UNION ALL SELECT window_, variant, 'miss_cycles_' || cycle FROM k WHERE NOT match)
SELECT window_ AS "window", variant, counter, count(*) AS n FROM t GROUP BY ALL""")
def tally_by_window(spark, d):
    return soak.tally_by_window(checks(spark, d), RUN)


@query("contention_cycles", f"""WITH {CHECKS} SELECT cycle, min(ts) AS first, count(*) AS checks, count(*) FILTER (WHERE NOT match) AS misses, max(waited_s) AS max_wait
FROM checks WHERE {_WINDOW} = 'contention' GROUP BY cycle""")
def contention_cycles(spark, d):
    return soak.contention_cycles(checks(spark, d), RUN)


@query("valid_hours", f"""WITH {CHECKS}, e AS (SELECT epoch(max(ts)) AS fin FROM checks), d AS (SELECT epoch(TIMESTAMP '2024-01-01') AS z)
SELECT round((fin - z - greatest(least(fin, z + 24067) - (z + 21600), 0)) / 3600.0, 6) AS valid_hours,
  round(greatest(least(fin, z + 40800) - (z + 36540), 0) / 3600.0, 6) AS contention_hours FROM e, d""")
def valid_hours(spark, d):
    hours = soak.valid_hours(checks(spark, d), derived.START, RUN)
    return hours.select(F.round("valid_hours", 6).alias("valid_hours"), F.round("contention_hours", 6).alias("contention_hours"))


@query("fault_counts", f"""WITH {FAULTS} SELECT action || ' ' || service AS act, count(*) AS n FROM faults WHERE {_WINDOW} <> 'excluded' GROUP BY 1""")
def fault_counts(spark, d):
    acts = logs.parse_fault_counts(derived.fault_lines(events(spark, d)))
    return soak.fault_counts(acts, RUN)


_BUSY = f"""u AS (SELECT {RUN_TIME} AS ts, (CAST(floor(value) AS BIGINT) % 101 + user_id % 101) / 2.0 AS busy FROM events),
uv AS (SELECT busy FROM u WHERE {_WINDOW} = 'valid')"""


@query("busy_p90", f"""WITH {_BUSY}, {nearest_rank('p90', 'busy', 'CAST(floor(CAST(0.9 AS DOUBLE) * n) AS BIGINT)', 'uv')}
SELECT (SELECT count(*) FROM uv) AS n, (SELECT round(avg(busy), 6) FROM uv) AS mean, p90 FROM p90""")
def busy_p90(spark, d):
    use = logs.parse_core_use(derived.core_lines(events(spark, d)))
    return soak.busy_cores(use, RUN).withColumn("mean", F.round("mean", 6))


@query("host_throttle", f"""WITH t AS (SELECT {RUN_TIME} AS ts, event_id * 1500 AS usec, round(value, 2) AS load, user_id % 100 + 0.5 AS pressure FROM events),
b AS (SELECT min({RUN_TIME}) AS a, max({RUN_TIME}) AS z FROM events),
i AS (SELECT t.* FROM t, b WHERE ts >= a - INTERVAL 900 SECONDS AND ts <= z),
{nearest_rank('load_p50', 'load', 'n // 2', 'i')}, {nearest_rank('pressure_p50', 'pressure', 'n // 2', 'i')}
SELECT (SELECT load_p50 FROM load_p50) AS load_p50, (SELECT pressure_p50 FROM pressure_p50) AS pressure_p50, count(*) AS ticks, (max(usec) - min(usec)) / 1000000.0 AS throttled_s, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS span_s,
  max(load) AS load_max, max(pressure) AS pressure_max, coalesce(round((max(usec) - min(usec)) / 1000000.0 / (epoch(max(ts)) - epoch(min(ts))), 9), 0) AS share FROM i""")
def host_throttle(spark, d):
    """From the run's first check to its last."""
    ticks = logs.parse_ticks(derived.tick_lines(events(spark, d)))
    first, last = checks(spark, d).agg(F.min("ts"), F.max("ts")).first()
    out = soak.host_throttle(ticks, F.lit(first), F.lit(last))
    return out.withColumn("share", F.round("share", 9))


@query("soak_layouts", f"""WITH {CHECKS}, k AS (SELECT *, {_KIND} AS kind FROM checks WHERE {_WINDOW} <> 'excluded')
SELECT variant, count(*) AS checks, count(*) FILTER (WHERE match) AS exact, count(*) FILTER (WHERE kind = 'lag') AS lag_misses,
  count(*) FILTER (WHERE kind IN ('error', 'memory')) AS query_errors FROM k GROUP BY variant""")
def soak_layouts(spark, d):
    return _tally(spark, d).layouts


@query("soak_tally", f"""WITH {CHECKS}, v AS (SELECT * FROM checks WHERE {_WINDOW} <> 'excluded'),
x AS (SELECT cycle, bool_and(match) AS exact FROM checks GROUP BY cycle),
rec AS (SELECT m.cycle, n.exact AS recovered FROM (SELECT DISTINCT cycle FROM v WHERE NOT match) m LEFT JOIN x n ON n.cycle = m.cycle + 1),
c AS (SELECT cycle, bool_or(NOT match) AS missed FROM v WHERE variant = 'plain' GROUP BY cycle), w AS (SELECT waited_s FROM v WHERE variant = 'plain' AND match),
{nearest_rank('p50', 'waited_s', 'n // 2', 'w')}, {nearest_rank('p99', 'waited_s', _P99, 'w')}
SELECT p50, p99, (SELECT max(waited_s) FROM w) AS max, (SELECT count(*) FROM c) AS cycles, (SELECT count(*) FROM c WHERE missed) AS missed,
  CASE WHEN (SELECT count(*) FROM rec WHERE NOT recovered) > 0 THEN 'FAIL' WHEN (SELECT count(*) FROM rec WHERE recovered IS NULL) > 0 THEN 'PENDING' ELSE 'PASS' END AS integrity
FROM p50, p99""")
def soak_tally(spark, d):
    t = _tally(spark, d)
    return side_by_side(t.waits.drop("n"), t.cycles, t.integrity.select("integrity"))


def _tally(spark, d):
    use = logs.parse_core_use(derived.core_lines(events(spark, d)))
    acts = logs.parse_fault_counts(derived.fault_lines(events(spark, d)))
    return soak.soak_tally(checks(spark, d), acts, use, derived.START, RUN, "plain")


@query("confirm_tally", f"""WITH {CHECKS}, k AS (SELECT *, {_KIND} AS kind FROM checks), x AS (SELECT cycle, bool_and(match) AS exact FROM checks GROUP BY cycle),
rec AS (SELECT x.cycle, n.exact AS recovered FROM x LEFT JOIN x n ON n.cycle = x.cycle + 1 WHERE NOT x.exact),
m AS (SELECT waited_s FROM checks WHERE match), {nearest_rank('p99', 'waited_s', _P99, 'm')},
s AS (SELECT CASE WHEN (SELECT count(*) FROM rec WHERE NOT recovered) > 0 THEN 'FAIL' WHEN (SELECT count(*) FROM rec WHERE recovered IS NULL) > 0 THEN 'PENDING' ELSE 'PASS' END AS integrity,
  round((epoch(max(ts)) - epoch(min(ts))) / 3600.0, 1) AS hours, count(*) FILTER (WHERE kind = 'lag') AS lag, count(*) FILTER (WHERE kind IN ('error', 'memory')) AS errors FROM k),
c AS (SELECT 1 AS no, integrity = 'PASS' AS ok FROM s UNION ALL SELECT 2, hours >= 5.5 FROM s UNION ALL SELECT 3, lag = 0 FROM s
  UNION ALL SELECT 4, p99 <= 150 FROM p99 UNION ALL SELECT 5, errors = 0 FROM s)
SELECT no, ok FROM c UNION ALL SELECT 99, bool_and(ok) FROM c""")
def confirm_tally(spark, d):
    acts = logs.parse_fault_counts(derived.fault_lines(events(spark, d)))
    return soak.confirm_tally(checks(spark, d), acts).criteria.select("no", "ok")


@query("verify_claims")
def verify_claims(spark, d):
    """A document written from the evidence, with one figure left out and one claim nobody logged."""
    samples, counts = pinned(_samples(spark, d)), _row_counts(spark, d)
    stores, middle = ["a", "b", "c"], benchtable.medians(samples)
    rows = claiming.bench_rows(middle, stores).where(F.col("query") != "view").select("value")
    said = events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("The log "), "event_type", F.lit(" holds "), F.format_number("n", 0), F.lit(" lines")).alias("value"), "event_type"
    )
    document = rows.unionByName(claiming.range_texts(middle, "a").select("value")).unionByName(said.select("value"))
    claims = said.select(
        F.col("value").alias("claim"), F.concat("event_type", F.lit(".log")).alias("log"),
        F.array(F.when(F.col("event_type") == "click", "^no such line").otherwise("^event ")).alias("patterns"),
    )
    return claiming.verify_claims(document, claims, derived.event_lines(events(spark, d)), samples, stores, "a", counts)
