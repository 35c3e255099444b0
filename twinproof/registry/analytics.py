"""The four questions, percentile definitions, comparisons and series: the analysis side."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinproof.operators import actives, compare as comparing, ordered, questions, series
from twinproof.operators.fold import fold
from twinproof.registry import derived
from twinproof.session import scratch
from twinproof.verdicts import benchtable, claims as claiming

from .base import (
    ANCHOR, RUN_TIME, Query, events, feed_sql, live_sql, log, nearest_rank, source, source_sql, table,
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


def live(spark, d, *columns):
    return fold(log(spark, d), ["event_id"], ["event_id", "ts", *columns])


_LIVE = f"WITH {feed_sql()}, {live_sql()}"
_SINCE_30 = f"ts > TIMESTAMP '{ANCHOR}' - INTERVAL 30 DAYS"
_SINCE_7 = f"ts > TIMESTAMP '{ANCHOR}' - INTERVAL 7 DAYS"


# --- the four questions ---------------------------------------------------------------------------------------------

@query("dau_30d", f"{_LIVE} SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM live WHERE {_SINCE_30} GROUP BY 1")
def dau_30d(spark, d):
    return questions.daily_actives(questions.since(live(spark, d, "user_id"), "ts", ANCHOR, 30), "ts", "user_id")


@query("dau_settled", f"""{_LIVE} SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM live
  WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 30 DAYS AND ts < TIMESTAMP '2024-01-30' GROUP BY 1""")
def dau_settled(spark, d):
    rows = questions.settled(live(spark, d, "user_id"), "ts", "2024-01-30 13:00:00", 30)
    return questions.daily_actives(rows, "ts", "user_id")


_ROLLING = """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
  l AS (SELECT max(day) AS last FROM d), s AS (SELECT unnest([1, 7, 30]) AS span),
  a AS (SELECT span, CAST(unnest(range(0, span)) AS INTEGER) AS ahead FROM s), r AS (SELECT user_id, span, day + ahead AS to_day FROM d, a)
  SELECT to_day AS day, span, count(DISTINCT user_id) AS users FROM r, l WHERE to_day <= last GROUP BY 1, 2"""


@query("rolling_actives", _ROLLING)
def rolling_actives(spark, d):
    """From stored day states: two batches that share days and users, the second written twice."""
    rows, path = events(spark, d), scratch(spark, "actives")
    early = F.hour("ts") < 18
    actives.save_states(actives.day_bitmaps(rows.where(early), "ts", "user_id"), path, 0)
    for _ in range(2):
        actives.save_states(actives.day_bitmaps(rows.where(F.hour("ts") >= 12), "ts", "user_id"), path, 1)
    return actives.rolling_actives(actives.read_states(spark, path))


@query("rolling_actives_estimated", f"SELECT day, span, true AS close FROM ({_ROLLING})")
def rolling_actives_estimated(spark, d):
    """Sketches a day, merged: within 8 per cent of the exact counts, five times their error."""
    rows = events(spark, d)
    exact = actives.rolling_actives(actives.day_bitmaps(rows, "ts", "user_id")).withColumnRenamed("users", "exact")
    about = actives.rolling_actives(actives.day_sketches(rows, "ts", "user_id"))
    return about.join(exact, ["day", "span"]).select("day", "span", (F.abs(F.col("users") - F.col("exact")) <= 0.08 * F.col("exact")).alias("close"))


@query("dau_30d_plain", f"SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM events WHERE {_SINCE_30} GROUP BY 1")
def dau_30d_plain(spark, d):
    return questions.daily_actives(questions.since(events(spark, d), "ts", ANCHOR, 30), "ts", "user_id")


@query("kind_per_week", f"""{_LIVE} SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS kind, count(*) AS events
  FROM live GROUP BY 1, 2""")
def kind_per_week(spark, d):
    return questions.kinds_per_week(live(spark, d, "event_type"), "ts", "event_type")


@query("kind_per_week_sunday", f"""{_LIVE} SELECT CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE) AS week, event_type AS kind,
  count(*) AS events FROM live GROUP BY 1, 2""")
def kind_per_week_sunday(spark, d):
    return questions.kinds_per_week(live(spark, d, "event_type"), "ts", "event_type", weeks="sunday")


@query("top10_accounts", f"""{_LIVE} SELECT user_id, count(*) AS events FROM live WHERE {_SINCE_7}
  GROUP BY user_id ORDER BY events DESC, user_id LIMIT 10""")
def top10_accounts(spark, d):
    return questions.top_accounts(questions.since(live(spark, d, "user_id"), "ts", ANCHOR, 7), "user_id")


@query("p95_cont", f"""{_LIVE} SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM live WHERE {_SINCE_30} GROUP BY event_type""")
def p95_cont(spark, d):
    rows = questions.since(live(spark, d, "event_type", "value"), "ts", ANCHOR, 30)
    # Split points need no fold: the log's own values place the chunks just as well.
    splits = ordered.split_points(log(spark, d), "value")
    return questions.p95_continuous(rows, "event_type", "value", splits=splits).withColumn("p95", F.round("p95", 6))


@query("p95_exact", f"""{_LIVE}, ranked AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM live WHERE {_SINCE_30})
SELECT event_type, value AS p95 FROM ranked WHERE i = CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT)""")
def p95_exact(spark, d):
    rows = questions.since(live(spark, d, "event_type", "value"), "ts", ANCHOR, 30)
    return questions.p95_exact(rows, "event_type", "value", splits=ordered.split_points(log(spark, d), "value"))


# --- order statistics and bench documents -----------------------------------------------------------------------------

@query("event_percentiles", f"""WITH {nearest_rank('p50', 'value', 'n // 2', 'events', 'user_id')},
{nearest_rank('p99', 'value', 'CAST(floor(CAST(0.99 AS DOUBLE) * (n - 1)) AS BIGINT)', 'events', 'user_id')},
{nearest_rank('top', 'value', 'n - 1', 'events', 'user_id')}
SELECT user_id, p50, p99, top FROM p50 JOIN p99 USING (user_id) JOIN top USING (user_id)""")
def event_percentiles(spark, d):
    ranks = {"p50": ordered.rank_upper_median(), "p99": ordered.rank_below(0.99), "top": ordered.rank_last()}
    return ordered.order_statistics(events(spark, d), ["user_id"], "value", ranks).drop("n")


_COUNTS = "c AS (SELECT CAST(ts AS DATE) AS day, event_type AS query, count(*) AS n FROM events GROUP BY 1, 2)"
_SAMPLES = f"""{_COUNTS}, samples AS (SELECT query, store, run, CAST(n * factor + extra AS DOUBLE) AS ms
  FROM c, (VALUES ('a', 20), ('b', 5), ('c', 2)) AS s(store, factor), (VALUES (0, 12), (1, 0), (2, 6), (3, 3), (4, 9)) AS r(run, extra))"""


def _results(spark, d):
    from twinproof.sources import logs

    return logs.parse_bench_documents(derived.bench_documents(events(spark, d)))


def _samples(spark, d):
    from twinproof.sources import logs

    return logs.bench_samples(_results(spark, d))


def _row_counts(spark, d):
    return _results(spark, d).select("query", F.explode("result_rows").alias("store", "n"))


@query("bench_doc_explode", f"WITH {_SAMPLES} SELECT query, store, run, ms FROM samples")
def bench_doc_explode(spark, d):
    return _samples(spark, d)


@query("bench_median", f"WITH {_SAMPLES} SELECT query, store, count(*) AS runs, quantile_cont(ms, 0.5) AS median_ms FROM samples GROUP BY 1, 2")
def bench_median(spark, d):
    return benchtable.medians(_samples(spark, d))


@query("bench_upper_median", f"""WITH {_SAMPLES}, r AS (SELECT query, store, ms, row_number() OVER (PARTITION BY query, store ORDER BY ms) - 1 AS i,
  count(*) OVER (PARTITION BY query, store) AS n FROM samples) SELECT query, store, ms AS median_ms FROM r WHERE i = n // 2""")
def bench_upper_median(spark, d):
    ranks = {"median_ms": ordered.rank_upper_median()}
    return ordered.order_statistics(_samples(spark, d), ["query", "store"], "ms", ranks).drop("n")


@query("speedup_range", f"""WITH {_SAMPLES}, m AS (SELECT query, store, quantile_cont(ms, 0.5) AS v FROM samples GROUP BY 1, 2)
SELECT m.store, round(min(a.v / m.v), 9) AS low, round(max(a.v / m.v), 9) AS high FROM m JOIN m a ON a.query = m.query AND a.store = 'a'
WHERE m.store <> 'a' GROUP BY m.store""")
def speedup_range(spark, d):
    return benchtable.speedups(_samples(spark, d), "a").select("store", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("bench_table", f"""WITH {_SAMPLES}, m AS (SELECT query, store, quantile_cont(ms, 0.5) AS v FROM samples GROUP BY 1, 2),
w AS (SELECT query, max(v) FILTER (WHERE store = 'a') AS a, max(v) FILTER (WHERE store = 'b') AS b, max(v) FILTER (WHERE store = 'c') AS c FROM m GROUP BY query)
SELECT query, a, b, c, round(a / b, 9) AS b_speedup, round(a / c, 9) AS c_speedup FROM w""")
def bench_table(spark, d):
    t = benchtable.bench_table(_samples(spark, d), ["a", "b", "c"], "a")
    return t.withColumns({"b_speedup": F.round("b_speedup", 9), "c_speedup": F.round("c_speedup", 9)})


@query("row_count_agreement", f"""WITH {_COUNTS}, r AS (SELECT query, n FROM c UNION ALL SELECT query, n + CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END FROM c)
SELECT query, count(DISTINCT n) = 1 AS agree, min(n) AS fewest, max(n) AS most FROM r GROUP BY query""")
def row_count_agreement(spark, d):
    return benchtable.row_count_agreement(_row_counts(spark, d))


# --- comparisons -----------------------------------------------------------------------------------------------------

def _pair(spark, d):
    """Revenue-like answers of source and a replica that missed the tenant moves: they differ in some rows."""
    answer = lambda rows: rows.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.max("value").alias("top")
    )
    return answer(source(spark, d)), answer(events(spark, d))


_NORM = r"""concat_ws(chr(31), printf('%.8e', CAST(user_id AS DOUBLE)), event_type, printf('%.8e', CAST(n AS DOUBLE)),
  strftime(last_ts, '%Y-%m-%dT%H:%M:%S.%fZ'), printf('%.8e', top))"""
_ANSWER = "SELECT user_id, event_type, count(*) AS n, max(ts) AS last_ts, max(value) AS top FROM {} GROUP BY 1, 2"
_PAIR = f"""{source_sql()}, l AS (SELECT {_NORM} AS t, user_id, event_type FROM ({_ANSWER.format('source')})),
r AS (SELECT {_NORM} AS t, user_id, event_type FROM ({_ANSWER.format('events')}))"""


def _mismatch_sql(order: str) -> str:
    return f"""WITH {_PAIR}, lp AS (SELECT t, row_number() OVER (ORDER BY {order}) - 1 AS p FROM l),
rp AS (SELECT t, row_number() OVER (ORDER BY {order}) - 1 AS p FROM r),
f AS (SELECT lp.p, lp.t AS lt, rp.t AS rt FROM lp JOIN rp ON lp.p = rp.p WHERE lp.t <> rp.t ORDER BY lp.p LIMIT 1)
SELECT 'activity' AS query, (SELECT count(*) FROM f) = 0 AND (SELECT count(*) FROM l) = (SELECT count(*) FROM r) AS match,
  (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows, coalesce((SELECT p FROM f), -1) AS first_different_row,
  (SELECT concat('left [', replace(lt, chr(31), ', '), '] vs right [', replace(rt, chr(31), ', '), ']') FROM f) AS detail"""


@query("compare_unordered", _mismatch_sql("t"))
def compare_unordered(spark, d):
    return comparing.compare("activity", *_pair(spark, d))


@query("compare_ordered", _mismatch_sql("event_type DESC, user_id"))
def compare_ordered(spark, d):
    return comparing.compare("activity", *_pair(spark, d), order=[F.desc("event_type"), "user_id"])


@query("compare_equal", f"""WITH {feed_sql()}, {live_sql('user_id, ts, event_id')}
SELECT 'live' AS query, true AS match, count(*) AS left_rows, count(*) AS right_rows, CAST(-1 AS BIGINT) AS first_different_row, '' AS detail FROM live""")
def compare_equal(spark, d):
    return comparing.compare("live", source(spark, d), fold(log(spark, d), ["user_id", "ts", "event_id"]))


@query("bag_difference", f"""WITH {_PAIR}, lc AS (SELECT t, count(*) AS n FROM l GROUP BY t), rc AS (SELECT t, count(*) AS n FROM r GROUP BY t)
SELECT replace(coalesce(lc.t, rc.t), chr(31), ', ') AS "row", coalesce(lc.n, 0) AS left_count, coalesce(rc.n, 0) AS right_count
FROM lc FULL JOIN rc ON lc.t = rc.t WHERE coalesce(lc.n, 0) <> coalesce(rc.n, 0)""")
def bag_difference(spark, d):
    return comparing.bag_difference(*_pair(spark, d))


@query("ordered_difference", f"""WITH {_PAIR}, lp AS (SELECT t, row_number() OVER (ORDER BY event_type DESC, user_id) - 1 AS p FROM l),
rp AS (SELECT t, row_number() OVER (ORDER BY event_type DESC, user_id) - 1 AS p FROM r)
SELECT coalesce(lp.p, rp.p) AS position, replace(lp.t, chr(31), ', ') AS left_row, replace(rp.t, chr(31), ', ') AS right_row
FROM lp FULL JOIN rp ON lp.p = rp.p WHERE lp.t IS DISTINCT FROM rp.t""")
def ordered_difference(spark, d):
    from twinproof.functions.normalise import readable

    diff = comparing.ordered_difference(*_pair(spark, d), order=[F.desc("event_type"), "user_id"])
    return diff.select("position", readable(F.col("left_row")).alias("left_row"), readable(F.col("right_row")).alias("right_row"))


@query("sample_hash", """SELECT event_type, count(*) AS n FROM events
WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 50000 GROUP BY event_type""")
def sample_hash(spark, d):
    return comparing.sampled(events(spark, d), "event_id", 0.05).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("shadow_stats", """SELECT event_type AS query, count(*) AS shadowed, count(*) FILTER (WHERE event_id % 13 <> 0 AND event_id % 7 <> 0) AS matches,
  count(*) FILTER (WHERE event_id % 13 <> 0 AND event_id % 7 = 0) AS mismatches, count(*) FILTER (WHERE event_id % 13 = 0) AS errors,
  CAST(coalesce(sum(user_id) FILTER (WHERE event_id % 13 <> 0), 0) AS BIGINT) AS left_ms,
  CAST(coalesce(sum(user_id * 2) FILTER (WHERE event_id % 13 <> 0), 0) AS BIGINT) AS right_ms FROM events GROUP BY event_type""")
def shadow_stats(spark, d):
    """Recorded comparisons, one per event."""
    failed = F.col("event_id") % 13 == 0
    rows = events(spark, d).select(
        F.col("event_type").alias("query"),
        F.when(~failed, F.col("event_id") % 7 != 0).alias("match"),
        F.when(failed, "right side down").alias("error"),
        F.col("user_id").cast("double").alias("left_ms"),
        (F.col("user_id") * 2).cast("double").alias("right_ms"),
    )
    stats = comparing.shadow_stats(rows, "query")
    return stats.withColumns({"left_ms": F.col("left_ms").cast("bigint"), "right_ms": F.col("right_ms").cast("bigint")})


# --- series ----------------------------------------------------------------------------------------------------------

@query("running_since", """WITH p AS (SELECT event_id, user_id, ts, event_type <> 'error' AS running FROM events),
b AS (SELECT *, sum(CASE WHEN running THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM p),
s AS (SELECT *, CASE WHEN running THEN min(CASE WHEN running THEN ts END) OVER (PARTITION BY user_id, island) END AS running_since FROM b)
SELECT event_id, user_id, running_since, coalesce(ts - running_since >= INTERVAL 2 MINUTES, false) AS ready FROM s""")
def running_since(spark, d):
    polls = events(spark, d).select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("running"))
    return series.running_since(polls, ["user_id"], ["ts", "event_id"], F.col("running")).select(
        "event_id", "user_id", "running_since", "ready"
    )


@query("streak_k", """WITH p AS (SELECT event_id, user_id, ts, event_type <> 'error' AS good FROM events),
b AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM p)
SELECT event_id, CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak,
  sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) >= 5 AS resumed FROM b""")
def streak_k(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "ts", "event_type")
    out = series.streak(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")
    return out.select("event_id", "streak", (F.col("streak") >= 5).alias("resumed"))


_STEPS = f"""s AS (SELECT event_id, user_id % 5 AS mirror, {RUN_TIME} AS moment, (event_id * 7 + user_id) % 4000 AS counter FROM events),
t AS (SELECT *, epoch(moment)::BIGINT AS e, lag(counter) OVER w AS before FROM s WINDOW w AS (PARTITION BY mirror ORDER BY moment, event_id)),
u AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN counter < before THEN counter ELSE counter - before END AS step FROM t)"""


@query("counter_rate_5m", f"""WITH {_STEPS},
r AS (SELECT event_id, mirror, e, sum(step) OVER w - first_value(step) OVER w AS rise, e - min(e) OVER w AS span FROM u
      WINDOW w AS (PARTITION BY mirror ORDER BY e RANGE BETWEEN 300 PRECEDING AND CURRENT ROW))
SELECT event_id, mirror, round(CASE WHEN span > 0 THEN rise / span END, 9) AS rate FROM r""")
def counter_rate_5m(spark, d):
    samples = events(spark, d).select(
        "event_id", (F.col("user_id") % 5).alias("mirror"), derived.run_time().alias("at"),
        ((F.col("event_id") * 7 + F.col("user_id")) % 4000).alias("counter"),
    )
    rates = series.counter_rate(samples, ["mirror"], ["at", "event_id"], "counter")
    return rates.select("event_id", "mirror", F.round("rate", 9).alias("rate"))


@query("positions", "SELECT event_id, row_number() OVER (ORDER BY event_type DESC, value, event_id) - 1 AS position FROM events")
def positions(spark, d):
    rows = events(spark, d).select("event_id", "event_type", "value")
    return ordered.with_position(rows, [F.desc("event_type"), "value", "event_id"]).select("event_id", "position")


# --- claims ------------------------------------------------------------------------------------------------------------

def _claims(spark, d):
    """One claim per event type and property value: some user of a tens group has it in that type's log."""
    seen = events(spark, d).groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return seen.select(
        F.concat(F.lit("k "), "k", F.lit(" is seen by user 7x")).alias("claim"),
        F.concat("event_type", F.lit(".log")).alias("log"),
        F.array(
            F.concat(F.lit(' user 7\\d? props .*"k": '), "k", F.lit("\\}")),
            F.concat(F.lit("^event \\d+ user \\d+ props \\{\"k\": "), "k", F.lit("\\}$")),
        ).alias("patterns"),
    )


_CLAIMS_SQL = r"""WITH lines AS (SELECT event_type || '.log' AS log, concat('event ', event_id, ' user ', user_id, ' props ', props) AS line FROM events),
c AS (SELECT DISTINCT event_type || '.log' AS log, json_extract_string(props, '$.k') AS k FROM events),
p AS (SELECT concat('k ', k, ' is seen by user 7x') AS claim, log, concat(' user 7\d? props .*"k": ', k, '\}') AS pattern FROM c
      UNION ALL SELECT concat('k ', k, ' is seen by user 7x'), log, concat('^event \d+ user \d+ props \{"k": ', k, '\}$') FROM c)
SELECT claim, log, pattern FROM p WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.log = p.log AND regexp_matches(l.line, p.pattern))"""


@query("claims_unmatched", _CLAIMS_SQL)
def claims_unmatched(spark, d):
    return claiming.unmatched_claims(_claims(spark, d), derived.event_lines(events(spark, d)))


def _few_claims(spark, d):
    """One claim per event type, short enough for the single pass over literals."""
    kinds = events(spark, d).select("event_type").distinct()
    return kinds.select(
        F.concat("event_type", F.lit(" by user 7x")).alias("claim"),
        F.concat("event_type", F.lit(".log")).alias("log"),
        F.array(F.lit(r' user 7\d? props .*"k": 9\d\}'), F.lit("^event 1 "), F.lit(r"^event [1-3]\d* user 14\d ")).alias("patterns"),
    )


@query("claims_unmatched_literal", r"""WITH lines AS (SELECT event_type || '.log' AS log, concat('event ', event_id, ' user ', user_id, ' props ', props) AS line FROM events),
p AS (SELECT DISTINCT concat(event_type, ' by user 7x') AS claim, event_type || '.log' AS log, pattern FROM events,
  (VALUES (' user 7\d? props .*"k": 9\d\}'), ('^event 1 '), ('^event [1-3]\d* user 14\d ')) AS x(pattern))
SELECT claim, log, pattern FROM p WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.log = p.log AND regexp_matches(l.line, p.pattern))""")
def claims_unmatched_literal(spark, d):
    return claiming.unmatched_claims(_few_claims(spark, d), derived.event_lines(events(spark, d)))


@query("uncovered_numbers", r"""WITH n AS (SELECT DISTINCT replace(unnest(regexp_extract_all(regexp_replace(text, '\d{4}-\d{2}-\d{2}', '', 'g'), '\d{1,3}(?:,\d{3})+|\d{4,}')), ',', '') AS number FROM documents),
k AS (SELECT replace(unnest(regexp_extract_all(text, '\d{1,3}(?:,\d{3})+|\d{4,}')), ',', '') AS number FROM benchmark)
SELECT number FROM n WHERE number NOT IN (SELECT number FROM k) AND number <> '2026'""")
def uncovered_numbers(spark, d):
    document = table(spark, d, "documents").select(F.col("text").alias("value"))
    covered = table(spark, d, "benchmark").select(F.col("text").alias("value"))
    return claiming.uncovered_numbers(document, covered, ignore=["2026"])
