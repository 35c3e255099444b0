"""Sources, sinks, folds, reconciliation, planning, status: the replication side."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinproof.functions.names import DELETED, VERSION
from twinproof.functions.terms import comparable_terms, term_sum
from twinproof.operators import compare, fold as folding, reconcile, status
from twinproof.operators.onerow import side_by_side
from twinproof.plans import catalog, propose
from twinproof.session import pinned, scratch
from twinproof.sources import feed, tables
from twinproof.streaming import ingest, windows
from twinproof.verdicts.cycles import fingerprints

from .base import (
    BY_ID, BY_TENANT, EPOCH, SUMS, TODAY, Query, events, feed_sql, live_sql, log, source, source_sql, stream_path, table,
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


# --- scans and sinks ----------------------------------------------------------------------------------------------

@query("src_scan", "SELECT user_id, count(*) AS events, max(ts) AS last_ts FROM events GROUP BY user_id")
def src_scan(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))


@query("replica_live_scan", f"""WITH {feed_sql()}, {live_sql()}
SELECT event_type, count(*) AS live_rows, CAST(sum(user_id) AS BIGINT) AS users_sum FROM live GROUP BY event_type""")
def replica_live_scan(spark, d):
    live = folding.fold(log(spark, d), ["event_id"], ["event_type", "user_id"])
    return live.groupBy("event_type").agg(F.count(F.lit(1)).alias("live_rows"), F.sum("user_id").alias("users_sum"))


@query("fold_live", f"WITH {feed_sql()}, {live_sql('user_id, ts, event_id')} SELECT * FROM live")
def fold_live(spark, d):
    return folding.fold(log(spark, d), ["user_id", "ts", "event_id"])


@query("fold_by_rank", f"WITH {feed_sql()}, {live_sql()} SELECT * FROM live")
def fold_by_rank(spark, d):
    return folding.fold_by_rank(log(spark, d), ["event_id"])


@query("fold_over_snapshot", f"WITH {feed_sql()}, {live_sql()} SELECT * FROM live")
def fold_over_snapshot(spark, d):
    changes = log(spark, d).where(F.col(VERSION) > 0)
    return folding.fold_over_snapshot(events(spark, d), changes, ["event_id"])


@query("fold_touched", f"WITH {feed_sql()}, {live_sql()} SELECT * FROM live")
def fold_touched(spark, d):
    """The log's own version 0 as snapshot."""
    whole = log(spark, d)
    first = whole.where(F.col(VERSION) == 0).drop(VERSION, "_is_deleted")
    return folding.fold_over_snapshot(first, whole.where(F.col(VERSION) > 0), ["event_id"])


@query("compacted_log", f"""WITH {feed_sql()}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY _version DESC) AS rn FROM feed WHERE _version <= 1),
done AS (SELECT event_id, value, _version, _is_deleted FROM kept WHERE rn = 1
         UNION ALL SELECT event_id, value, _version, _is_deleted FROM feed WHERE _version > 1)
SELECT _version, _is_deleted AS deleted, count(*) AS versions, CAST(sum(event_id) AS BIGINT) AS ids FROM done GROUP BY ALL""")
def compacted_log(spark, d):
    short = folding.compact(log(spark, d).select("event_id", "value", VERSION, DELETED), ["event_id"], 1)
    return short.groupBy(VERSION, F.col(DELETED).alias("deleted")).agg(
        F.count(F.lit(1)).alias("versions"), F.sum("event_id").alias("ids")
    )


@query("snapshot_copy", """SELECT CAST(0 AS BIGINT) AS _version, count(*) AS copied, CAST(sum(event_id) AS BIGINT) AS ids,
  CAST(sum(strlen(props)) AS BIGINT) AS props_bytes FROM events""")
def snapshot_copy(spark, d):
    copy = tables.copy_snapshot(events(spark, d), "event_id", scratch(spark, "snapshot"))
    return copy.groupBy(VERSION).agg(
        F.count(F.lit(1)).alias("copied"), F.sum("event_id").alias("ids"), F.sum(F.octet_length("props")).alias("props_bytes")
    )


@query("snapshot_resumed", """SELECT CAST(0 AS BIGINT) AS _version, count(*) AS copied, CAST(sum(event_id) AS BIGINT) AS ids,
  CAST(sum(strlen(props)) AS BIGINT) AS props_bytes FROM events""")
def snapshot_resumed(spark, d):
    """A copy that breaks off in its third range, run again."""
    path = scratch(spark, "ranges")

    def stop(n):
        if n == 2:
            raise InterruptedError

    try:
        tables.copy_in_ranges(events(spark, d), "event_id", path, ranges=6, before_range=stop)
    except InterruptedError:
        pass
    copy = tables.copy_in_ranges(events(spark, d), "event_id", path, ranges=6)
    return copy.groupBy(VERSION).agg(
        F.count(F.lit(1)).alias("copied"), F.sum("event_id").alias("ids"), F.sum(F.octet_length("props")).alias("props_bytes")
    )


@query("cdc_stream_versions", f"""WITH {feed_sql()}
SELECT CAST(_version AS BIGINT) AS version, _is_deleted AS deleted, count(*) AS versions, CAST(sum(event_id) AS BIGINT) AS ids
FROM feed GROUP BY ALL""")
def cdc_stream_versions(spark, d):
    schema = events(spark, d).schema
    stream = ingest.read_changes(spark, stream_path(d, "events"), schema, files_per_trigger=100)
    path = scratch(spark, "versions")
    ingest.ingest(
        feed.event_log(stream), path, scratch(spark, "ingest"), ["event_id"], time_column="ts"
    ).awaitTermination()
    return ingest.read_ingested(spark, path).groupBy(F.col(VERSION).alias("version"), F.col(DELETED).alias("deleted")).agg(
        F.count(F.lit(1)).alias("versions"), F.sum("event_id").alias("ids")
    )


@query("stream_daily_counts", """SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
  WHERE date_trunc('day', ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY 1""")
def stream_daily_counts(spark, d):
    schema = events(spark, d).schema
    stream = ingest.read_changes(spark, stream_path(d, "events"), schema)
    path = scratch(spark, "daily")
    windows.write_settled(windows.daily_counts(stream, "ts"), path, scratch(spark, "daily-state")).awaitTermination()
    return spark.read.schema("day date, n bigint").parquet(path)


@query("partitioned_sink_roundtrip", f"""WITH {feed_sql()}
SELECT strftime(ts, '%Y%m') AS month, count(*) AS versions, CAST(sum(_version) AS BIGINT) AS version_sum,
       CAST(sum(event_id) AS BIGINT) AS ids FROM feed WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1""")
def partitioned_sink_roundtrip(spark, d):
    path = scratch(spark, "log")
    tables.write_version_log(log(spark, d), path, ["user_id", "ts", "event_id"], "ts")
    back = tables.read_version_log(spark, path, "ts", since="2024-01-10 00:00:00")
    return back.groupBy(F.date_format("ts", "yyyyMM").alias("month")).agg(
        F.count(F.lit(1)).alias("versions"), F.sum(VERSION).alias("version_sum"), F.sum("event_id").alias("ids")
    )


@query("parquet_copy_counts", """SELECT 'events' AS name, count(*) AS copied, count(DISTINCT user_id) AS keys FROM events
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey) FROM orders""")
def parquet_copy_counts(spark, d):
    parts = []
    for name, key in (("events", "user_id"), ("orders", "o_custkey")):
        copy = tables.copy_parquet(table(spark, d, name), scratch(spark, f"copy-{name}"))
        parts.append(copy.agg(F.count(F.lit(1)).alias("copied"), F.count_distinct(key).alias("keys")).withColumn("name", F.lit(name)))
    return parts[0].unionByName(parts[1]).select("name", "copied", "keys")


# --- aggregates ---------------------------------------------------------------------------------------------------

@query("daily_counts", """SELECT 'events' AS name, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'orders', strftime(o_orderdate, '%Y-%m-%d'), count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'documents', 'all', count(*) FROM documents""")
def daily_counts(spark, d):
    parts = [
        reconcile.count_days(table(spark, d, name), time).select(F.lit(name).alias("name"), "day", "n")
        for name, time in (("events", "ts"), ("orders", "o_orderdate"), ("documents", None))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("live_totals", f"""WITH {feed_sql()}, {live_sql()}, {source_sql()}
SELECT 'source' AS side, count(*) AS live_rows FROM source UNION ALL SELECT 'replica', count(*) FROM live""")
def live_totals(spark, d):
    days = reconcile.count_days(source(spark, d), "ts").withColumn("side", F.lit("source"))
    both = days.unionByName(reconcile.replica_days({"replica": log(spark, d)}, BY_ID))
    return both.groupBy("side").agg(F.sum("n").alias("live_rows"))


@query("typed_sums", f"""WITH {feed_sql()}, newest AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY _version DESC) AS rn FROM feed)
SELECT event_type, count(*) AS n, CAST(sum(event_id) AS VARCHAR) AS id_sum, CAST(sum(user_id) AS VARCHAR) AS user_sum,
  CAST(sum({EPOCH}) AS VARCHAR) AS ts_sum, CAST(sum(CAST(_is_deleted AS INT)) AS VARCHAR) AS deleted_sum,
  CAST(sum(strlen(regexp_replace(props, '\\s', '', 'g'))) AS VARCHAR) AS props_sum, count(*) FILTER (WHERE _is_deleted) AS deleted
FROM newest WHERE rn = 1 GROUP BY event_type""")
def typed_sums(spark, d):
    newest = folding.newest(log(spark, d), ["event_id"])
    t = {x.column: x.expr for x in comparable_terms(newest.schema, ["props"])}
    text = lambda c: term_sum(t[c]).cast("string")
    return newest.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        text("event_id").alias("id_sum"),
        text("user_id").alias("user_sum"),
        text("ts").alias("ts_sum"),
        text(DELETED).alias("deleted_sum"),
        text("props").alias("props_sum"),
        F.count_if(DELETED).alias("deleted"),
    )


_COMPARED = {
    "region": {"r_regionkey": "integer", "r_name": "text"},
    "nation": {"n_nationkey": "integer", "n_name": "text", "n_regionkey": "integer"},
    "customer": {"c_custkey": "integer", "c_name": "text", "c_nationkey": "integer", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "integer", "s_name": "text", "s_nationkey": "integer"},
    "part": {"p_partkey": "integer", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "integer"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_orderdate": "time", "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
                 "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"},
    "events": {"event_id": "integer", "ts": "time", "user_id": "integer", "event_type": "text", "props": "json"},
    "documents": {"doc_id": "integer", "text": "text", "lang": "text", "source": "text", "n_chars": "integer"},
    "embeddings": {"vec_id": "integer", "label": "integer"},
    "pages": {"page_id": "integer", "url": "text", "html": "text"},
    "benchmark": {"item_id": "integer", "text": "text"},
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "conversations": {"conv_id": "integer", "turn": "integer", "role": "text", "text": "text"},
}


def _compared_sql() -> str:
    form = {
        "integer": "{c}", "text": "strlen({c})", "json": r"strlen(regexp_replace({c}, '\s', '', 'g'))",
        "time": "CAST(floor(epoch_us({c}) / 1000000.0) AS HUGEINT)",
    }
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tab, '{c}' AS col, '{k}' AS kind, CAST(coalesce(sum({form[k].format(c=c)}), 0) AS VARCHAR) AS total FROM {t}"
        for t, cols in _COMPARED.items()
        for c, k in cols.items()
    )


@query("comparable_columns", _compared_sql())
def comparable_columns(spark, d):
    """Which columns of each table both sides can compare, with their sums."""
    parts = []
    for name in _COMPARED:
        df = table(spark, d, name)
        terms = comparable_terms(df.schema, ["props"])
        sums = df.agg(*[term_sum(t.expr).cast("string").alias(t.alias) for t in terms])
        rows = F.array(*[
            F.struct(F.lit(t.column).alias("col"), F.lit(t.kind).alias("kind"), F.col(t.alias).alias("total")) for t in terms
        ])
        parts.append(sums.select(F.lit(name).alias("tab"), F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("pk_bounds", """SELECT 'events' AS name, min(event_id) AS lo, max(event_id) AS hi, (max(event_id) - min(event_id)) // 64 + 1 AS width FROM events
UNION ALL SELECT 'orders', min(o_orderkey), max(o_orderkey), (max(o_orderkey) - min(o_orderkey)) // 64 + 1 FROM orders""")
def pk_bounds(spark, d):
    parts = [
        reconcile.key_bounds(table(spark, d, n), k).select(
            F.lit(n).alias("name"), "lo", "hi", F.expr("(hi - lo) div 64 + 1").alias("width")
        )
        for n, k in (("events", "event_id"), ("orders", "o_orderkey"))
    ]
    return parts[0].unionByName(parts[1])


_BOUNDS = "bounds AS (SELECT min(event_id) AS lo, (max(event_id) - min(event_id)) // 64 + 1 AS width FROM source)"
_BUCKET = "CAST(floor((event_id - lo) / width) AS BIGINT)"


@query("bucket_checksums", f"""WITH {source_sql()}, {_BOUNDS}
SELECT {_BUCKET} AS bucket, {SUMS} AS sums FROM source, bounds GROUP BY 1""")
def bucket_checksums(spark, d):
    src = source(spark, d)
    lo, hi = reconcile.key_bounds(src, "event_id").first()
    return reconcile.source_buckets(src, BY_ID, lo, reconcile.bucket_width(lo, hi))


@query("fingerprint", f"WITH {feed_sql()}, {live_sql()} SELECT {SUMS} AS fingerprint FROM live")
def fingerprint(spark, d):
    terms = reconcile.terms_for(events(spark, d), BY_ID)
    slim = folding.fold_terms(log(spark, d), ["event_id"], {t.alias: t.expr for t in terms})
    carried = [reconcile.Term(t.column, t.kind, F.col(t.alias)) for t in terms]
    return reconcile.fingerprint(slim, carried)


@query("fingerprint_all", """SELECT 'plain' AS variant, 'r1' AS replica, 'orders' AS name,
  concat_ws('|', count(*), sum(o_orderkey), sum(o_custkey), sum(strlen(o_orderstatus)),
  sum(CAST(floor(epoch_us(o_orderdate) / 1000000.0) AS HUGEINT)), sum(strlen(o_orderpriority))) AS fingerprint FROM orders
UNION ALL SELECT 'plain', 'r1', 'customer', concat_ws('|', count(*), sum(c_custkey), sum(strlen(c_name)), sum(c_nationkey), sum(strlen(c_mktsegment))) FROM customer
UNION ALL SELECT 'plain', 'r2', 'documents', concat_ws('|', count(*), sum(doc_id), sum(strlen(text)), sum(strlen(lang)), sum(strlen(source)), sum(n_chars)) FROM documents""")
def fingerprint_all(spark, d):
    live = {("plain", r, n): table(spark, d, n) for r, n in (("r1", "orders"), ("r1", "customer"), ("r2", "documents"))}
    terms = {k[2]: comparable_terms(df.schema) for k, df in live.items()}
    return fingerprints(live, terms, ["variant", "replica", "name"])


# --- reconciliation -------------------------------------------------------------------------------------------------

_TENANT_KEY = "user_id, ts, event_id"


@query("day_check", f"""WITH {source_sql()}, {feed_sql('full', 'fa')}, {feed_sql('delete_marker', 'fb')},
{live_sql(_TENANT_KEY, 'fa', 'la')}, {live_sql(_TENANT_KEY, 'fb', 'lb')},
c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, 's' AS side FROM source UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'a' FROM la
      UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'b' FROM lb),
g AS (SELECT day, count(*) FILTER (WHERE side = 's') AS source_rows, count(*) FILTER (WHERE side = 'a') AS rows_a,
      count(*) FILTER (WHERE side = 'b') AS rows_b FROM c GROUP BY day)
SELECT day, source_rows, rows_a, rows_b, source_rows = rows_a AND source_rows = rows_b AS same, day < '{TODAY}' AS settled,
  concat(day, ' source=', source_rows, ' a=', rows_a, ' b=', rows_b) AS line FROM g""")
def day_check(spark, d):
    replicas = {"a": log(spark, d), "b": log(spark, d, feed.DELETE_MARKER)}
    days = reconcile.check_days(source(spark, d), replicas, BY_TENANT, TODAY)
    return days.select(
        "day", "source_rows", F.col("replica_rows")["a"].alias("rows_a"), F.col("replica_rows")["b"].alias("rows_b"),
        "same", "settled", "line",
    )


@query("table_check", f"""WITH {source_sql()}, {feed_sql('delete_marker', 'fb')}, {live_sql(_TENANT_KEY, 'fb', 'lb')},
g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 'b') AS b
      FROM (SELECT ts, 's' AS side FROM source UNION ALL SELECT ts, 'b' FROM lb) GROUP BY 1)
SELECT 'public.events' AS tab, CAST(sum(s) AS BIGINT) AS source_rows, CAST(sum(b) AS BIGINT) AS replica_rows,
  count(*) FILTER (WHERE day < '{TODAY}' AND s <> b) AS bad_day_count,
  string_agg(concat(day, ' source=', s, ' b=', b), ';' ORDER BY day) FILTER (WHERE day < '{TODAY}' AND s <> b) AS bad_days,
  string_agg(concat(day, ' source=', s, ' b=', b), ';' ORDER BY day) FILTER (WHERE day >= '{TODAY}' AND s <> b) AS unsettled,
  count(*) FILTER (WHERE day < '{TODAY}' AND s <> b) = 0 AS ok FROM g""")
def table_check(spark, d):
    checked = reconcile.check_tables([(BY_TENANT, source(spark, d), {"b": log(spark, d, feed.DELETE_MARKER)})], TODAY)
    return checked.select(
        F.col("table").alias("tab"), "source_rows", F.col("replica_rows")["b"].alias("replica_rows"), "bad_day_count",
        F.array_join("bad_days", ";").alias("bad_days"), F.array_join(F.map_values("unsettled"), ";").alias("unsettled"), "ok",
    )


@query("bad_days_topk", f"""WITH {source_sql()}, {feed_sql('delete_marker', 'fb')}, {live_sql(_TENANT_KEY, 'fb', 'lb')},
g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 'b') AS b
      FROM (SELECT ts, 's' AS side FROM source UNION ALL SELECT ts, 'b' FROM lb) GROUP BY 1),
bad AS (SELECT day, concat(day, ' source=', s, ' b=', b) AS line, row_number() OVER (ORDER BY day) AS rank, count(*) OVER () AS total
        FROM g WHERE s <> b AND day < '{TODAY}')
SELECT day, line, CAST(rank AS INTEGER) AS rank, greatest(total - 10, 0) AS more FROM bad WHERE rank <= 10""")
def bad_days_topk(spark, d):
    days = reconcile.check_days(source(spark, d), {"b": log(spark, d, feed.DELETE_MARKER)}, BY_TENANT, TODAY)
    return reconcile.show_first(days.where("settled"), "table", "day", 10).drop("table")


@query("bucket_check", f"""WITH {source_sql()}, {_BOUNDS}, {feed_sql('full', 'fa')}, {feed_sql('empty_text', 'fb')},
{live_sql('event_id', 'fa', 'la')}, {live_sql('event_id', 'fb', 'lb')},
s AS (SELECT {_BUCKET} AS bucket, {SUMS} AS sums FROM source, bounds GROUP BY 1),
a AS (SELECT {_BUCKET} AS bucket, {SUMS} AS sums FROM la, bounds GROUP BY 1),
b AS (SELECT {_BUCKET} AS bucket, {SUMS} AS sums FROM lb, bounds GROUP BY 1),
k AS (SELECT bucket FROM s UNION SELECT bucket FROM a UNION SELECT bucket FROM b),
w AS (SELECT k.bucket, coalesce(s.sums, '') AS source_sums, coalesce(a.sums, '') AS sums_a, coalesce(b.sums, '') AS sums_b
      FROM k LEFT JOIN s USING (bucket) LEFT JOIN a USING (bucket) LEFT JOIN b USING (bucket))
SELECT bucket, lo + bucket * width AS low, lo + (bucket + 1) * width - 1 AS high, source_sums, sums_a, sums_b,
  source_sums = sums_a AND source_sums = sums_b AS same FROM w, bounds""")
def bucket_check(spark, d):
    replicas = {"a": log(spark, d), "b": log(spark, d, feed.EMPTY_TEXT)}
    found = reconcile.check_buckets(source(spark, d), replicas, BY_ID)
    return found.select(
        "bucket", "low", "high", "source_sums", F.col("replica_sums")["a"].alias("sums_a"),
        F.col("replica_sums")["b"].alias("sums_b"), "same",
    )


def _defect_sql(mode: str, key: str) -> str:
    src = feed.KEY_MOVE if mode == feed.KEY_MOVE else feed.FULL
    return f"""WITH {source_sql(src)}, {_BOUNDS}, {feed_sql(mode)}, {live_sql(key)},
days AS (SELECT day, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 'r') AS r FROM (
  SELECT CAST(ts AS DATE) AS day, 's' AS side FROM source UNION ALL SELECT CAST(ts AS DATE), 'r' FROM live) GROUP BY day),
s AS (SELECT {_BUCKET} AS bucket, {SUMS} AS sums FROM source, bounds GROUP BY 1),
r AS (SELECT {_BUCKET} AS bucket, {SUMS} AS sums FROM live, bounds GROUP BY 1)
SELECT (SELECT count(*) FROM live) AS live_rows, (SELECT count(*) FROM days WHERE s <> r) AS bad_days,
  (SELECT count(*) FROM s FULL JOIN r USING (bucket) WHERE s.sums IS DISTINCT FROM r.sums) AS bad_buckets"""


def _defect(mode: str, spec):
    def run(spark, d):
        src = source(spark, d, feed.KEY_MOVE if mode == feed.KEY_MOVE else feed.FULL)
        replicas = {"r": log(spark, d, mode)}
        days = reconcile.check_days(src, replicas, spec, "2024-01-31")
        sums = reconcile.check_buckets(src, replicas, spec)
        left = days.agg(F.sum(F.col("replica_rows")["r"]).alias("live_rows"), F.count_if(~F.col("same")).alias("bad_days"))
        right = sums.agg(F.count_if(~F.col("same")).alias("bad_buckets"))
        return side_by_side(left, right)

    return run


for _name, _mode, _spec, _key in (
    ("clean_feed", feed.FULL, BY_TENANT, _TENANT_KEY),
    ("delete_marker_defect", feed.DELETE_MARKER, BY_TENANT, _TENANT_KEY),
    ("empty_text_defect", feed.EMPTY_TEXT, BY_ID, "event_id"),
    ("tenant_move_defect", feed.KEY_MOVE, BY_TENANT, _TENANT_KEY),
    ("tenant_move_by_key", feed.KEY_MOVE, BY_ID, "event_id"),
):
    query(_name, _defect_sql(_mode, _key))(_defect(_mode, _spec))


@query("toast_safe_merge", """SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END AS props FROM events WHERE event_id % 20 <> 7""")
def toast_safe_merge(spark, d):
    """Updates that did not carry ``props`` keep the value before them; those that set it to NULL keep the NULL."""
    changed = log(spark, d)
    update = F.col(VERSION) == 1
    blank = changed.withColumn("props", F.when(update, F.lit(None)).otherwise(F.col("props"))).withColumn(
        "_unchanged", F.when(update & (F.col("event_id") % 10 != 0), F.array(F.lit("props"))).otherwise(F.array().cast("array<string>"))
    )
    return folding.carry_unchanged(blank, ["event_id"], ["props"])


@query("cutover_gate", f"""WITH {source_sql()}, {_BOUNDS}, {feed_sql()}, {live_sql()},
days AS (SELECT day, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 'r') AS r FROM (
  SELECT strftime(ts, '%Y-%m-%d') AS day, 's' AS side FROM source UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'r' FROM live) GROUP BY day),
s AS (SELECT {_BUCKET} AS bucket, {SUMS} AS sums FROM source, bounds GROUP BY 1),
r AS (SELECT {_BUCKET} AS bucket, {SUMS} AS sums FROM live, bounds GROUP BY 1),
v AS (SELECT (SELECT max(_version) FROM feed) AS applied, (SELECT count(*) FROM days WHERE s <> r AND day < '{TODAY}') AS bad_days,
  (SELECT count(*) FROM days WHERE s <> r AND day >= '{TODAY}') AS unsettled_days,
  (SELECT count(*) FROM s FULL JOIN r USING (bucket) WHERE s.sums IS DISTINCT FROM r.sums) AS bad_buckets)
SELECT CAST(w AS BIGINT) AS watermark, CAST(applied AS BIGINT) AS applied, applied >= w AS reached, bad_days, unsettled_days, bad_buckets,
  applied >= w AND bad_days = 0 AND unsettled_days = 0 AND bad_buckets = 0 AS ready FROM v, (VALUES (2), (3)) AS x(w)""")
def cutover_gate(spark, d):
    gate = lambda w: reconcile.cutover_gate(source(spark, d), {"r": log(spark, d)}, BY_ID, w, TODAY)
    return gate(2).unionByName(gate(3)).drop("table")


# --- planning and status ---------------------------------------------------------------------------------------------

def _catalog(spark, d):
    t = lambda n: table(spark, d, n)
    return catalog.profile_tables([
        catalog.TableInput("events", t("events"), ["event_id"], json_columns=["props"]),
        catalog.TableInput("events_changed", t("events"), ["event_id"], log(spark, d), ["props"]),
        catalog.TableInput("orders", t("orders"), ["o_orderkey"]),
        catalog.TableInput("customer", t("customer"), ["c_custkey"]),
        catalog.TableInput("documents", t("documents"), ["doc_id"]),
        catalog.TableInput("lineitem", t("lineitem"), ["l_orderkey", "l_linenumber"]),
    ])


@query("profile_tables", f"""WITH {feed_sql()},
base AS (SELECT 'events' AS name, count(*) AS rows, count(DISTINCT event_id) AS keys, 'event_id' AS k, 6 AS columns FROM events
  UNION ALL SELECT 'events_changed', count(*), count(DISTINCT event_id), 'event_id', 6 FROM events
  UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), 'o_orderkey', 6 FROM orders
  UNION ALL SELECT 'customer', count(*), count(DISTINCT c_custkey), 'c_custkey', 5 FROM customer
  UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id), 'doc_id', 5 FROM documents
  UNION ALL SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)), 'l_orderkey,l_linenumber', 11 FROM lineitem)
SELECT name, rows, CASE WHEN rows = keys THEN k ELSE '' END AS pk, columns,
  CASE WHEN name = 'events_changed' THEN (SELECT count(*) FROM feed WHERE _version = 0) ELSE 0 END AS ins,
  CASE WHEN name = 'events_changed' THEN (SELECT count(*) FROM feed WHERE _version = 1) ELSE 0 END AS upd,
  CASE WHEN name = 'events_changed' THEN (SELECT count(*) FROM feed WHERE _version = 2) ELSE 0 END AS del FROM base""")
def profile_tables(spark, d):
    return _catalog(spark, d).select(
        "name", "rows", F.array_join("pk", ",").alias("pk"), F.size("cols").alias("columns"), "ins", "upd", "del"
    )


_PLAN_SQL = """WITH n AS (SELECT 'public.events' AS source, count(*) AS rows, 'user_id,ts,event_id' AS order_by, 'month(ts)' AS partition_by, 0 AS changes,
    true AS has_time, true AS has_pk, false AS large_need FROM events
  UNION ALL SELECT 'public.events_changed', count(*), 'event_id', NULL,
    count(*) FILTER (WHERE event_id % 5 = 0) + count(*) FILTER (WHERE event_id % 20 = 7), true, true, true FROM events
  UNION ALL SELECT 'public.orders', count(*), 'o_orderdate,o_orderkey', 'month(o_orderdate)', 0, true, true, false FROM orders
  UNION ALL SELECT 'public.customer', count(*), 'c_custkey', NULL, 0, false, true, false FROM customer
  UNION ALL SELECT 'public.documents', count(*), 'doc_id', NULL, 0, false, true, false FROM documents
  UNION ALL SELECT 'public.lineitem', count(*), 'l_shipdate', 'month(l_shipdate)', 0, true, false, false FROM lineitem),
j AS (SELECT mode, n.*, CASE WHEN NOT has_pk THEN 'no primary key' WHEN mode = 'named' THEN NULL WHEN NOT has_time THEN 'no timestamp column'
    WHEN rows < 1000 THEN 'rows' WHEN changes > 0.05 * rows THEN 'entity-like' END AS reason FROM n, (VALUES ('auto'), ('named')) AS m(mode))
SELECT mode, source, reason, order_by, partition_by, changes > 0 AS mutated,
  CASE WHEN NOT has_pk THEN NULL WHEN order_by LIKE '%,%' THEN 'sort key' WHEN large_need THEN 'large values' END AS identity FROM j"""


@query("plan_tables", _PLAN_SQL)
def plan_tables(spark, d):
    found = pinned(_catalog(spark, d))
    names = [f"public.{n}" for n in ("events", "events_changed", "orders", "customer", "documents", "lineitem")]
    parts = []
    for mode, chosen in (("auto", ()), ("named", names)):
        j = propose.judged(found, chosen, min_rows=1000)
        reason = F.col("reason")
        short = (
            F.when(reason.startswith("no primary key"), "no primary key")
            .when(reason.startswith("no timestamp column"), "no timestamp column")
            .when(reason.contains("rows <"), "rows")
            .when(reason.startswith("entity-like"), "entity-like")
            .otherwise(reason)
        )
        need = F.when(F.col("identity_need").contains("sort key"), "sort key").when(
            F.col("identity_need").contains("large-value"), "large values"
        )
        parts.append(j.select(
            F.lit(mode).alias("mode"), "source", short.alias("reason"), F.array_join("order_by", ",").alias("order_by"),
            "partition_by", "mutated", need.alias("identity"),
        ))
    return parts[0].unionByName(parts[1])


@query("plan_roundtrip", """SELECT 'public.events' AS source, count(*) AS rows, 'event_id' AS pk, 'ts' AS time_column,
  'timestamp without time zone' AS time_type, 'user_id,ts,event_id' AS order_by, 'month(ts)' AS partition_by, false AS mutated, 3 AS notes FROM events
UNION ALL SELECT 'public.orders', count(*), 'o_orderkey', 'o_orderdate', 'timestamp without time zone', 'o_orderdate,o_orderkey',
  'month(o_orderdate)', false, 2 FROM orders""")
def plan_roundtrip(spark, d):
    plan = propose.plan_tables(_catalog(spark, d), min_rows=1000)
    path = scratch(spark, "plan")
    propose.save_plan(plan, path)
    back = propose.load_plan(spark, path)
    return back.planned.select(
        "source", "rows", F.array_join("primary_key", ",").alias("pk"), "time_column", "time_type",
        F.array_join("order_by", ",").alias("order_by"), "partition_by", "mutated", F.size("notes").alias("notes"),
    )


@query("fixes_missing", """SELECT 0 AS step, 'ALTER TABLE "public"."orders" REPLICA IDENTITY FULL' AS fix, count(*) > 0 AS any_rows FROM orders
UNION ALL SELECT 1, 'CREATE PUBLICATION events_copy_pub FOR TABLE ' || CASE WHEN (SELECT count(*) FROM orders) >= 0 THEN '2 tables' END, true""")
def fixes_missing(spark, d):
    found = pinned(_catalog(spark, d))
    plan = propose.plan_tables(found, min_rows=1000)
    # The events table already ships full rows; nothing is published yet.
    identities = found.select("schema", "name", F.when(F.col("name") == "events", "f").otherwise("d").alias("repl_ident"))
    publications = found.where(F.col("rows") < 0).select("name")
    left = propose.pending_fixes(plan, identities, publications)
    tables_named = F.size(F.split(F.substring_index("fix", " FOR TABLE ", -1), ", ")).cast("string")
    short = F.concat(F.substring_index("fix", " FOR TABLE ", 1), F.lit(" FOR TABLE "), tables_named, F.lit(" tables"))
    return left.select(
        "step", F.when(F.col("step") == 1, short).otherwise(F.col("fix")).alias("fix"), F.lit(True).alias("any_rows")
    )


@query("catalog_discover", """SELECT * FROM (
  SELECT 'public' AS schema_name, 'events' AS name, count(*) AS rows, 'event_id' AS pk,
    'event_id,ts,user_id,event_type,value,props' AS cols, count(*) AS ins, CAST(0 AS BIGINT) AS upd FROM events
  UNION ALL SELECT 'public', 'orders', count(*), 'o_orderkey', 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority', 0, 0 FROM orders
  UNION ALL SELECT 'public', 'lineitem', count(*), 'l_orderkey,l_linenumber',
    'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate', 0, 0 FROM lineitem)""")
def catalog_discover(spark, d):
    """System tables whose row estimates come from the tables at hand, then the catalog query over them."""
    names = ["events", "orders", "lineitem", "customer", "part"]
    keys = {"events": ["event_id"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
    data = {n: table(spark, d, n) for n in names}
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("rel_id"), "rows") for i, df in enumerate(data.values())]
    estimates = counts[0]
    for c in counts[1:]:
        estimates = estimates.unionByName(c)
    # customer stands for a partition of another table, part lies in a system schema
    shape = spark.createDataFrame(
        [(i, 2 if n == "part" else 1, n, "r", n == "customer", i * 1000, "d") for i, n in enumerate(names)],
        "rel_id int, namespace_id int, name string, kind string, is_partition boolean, size bigint, repl_ident string",
    )
    spaces = spark.createDataFrame([(1, "public"), (2, "_peerdb_internal")], "namespace_id int, schema string")
    stats = estimates.where("rel_id = 0").select(
        "rel_id", F.col("rows").alias("ins"), F.lit(0).cast("bigint").alias("upd"), F.lit(0).cast("bigint").alias("del")
    )
    attributes = spark.createDataFrame(
        [(i, p, c, 1, "text", False) for i, df in enumerate(data.values()) for p, c in enumerate(df.columns, 1)]
        + [(0, 99, "dropped_column", 1, "text", True), (0, -1, "ctid", 1, "text", False)],
        "rel_id int, attnum int, name string, type_id int, typ string, dropped boolean",
    )
    key_columns = spark.createDataFrame(
        [(names.index(n), p, data[n].columns.index(c) + 1) for n, cs in keys.items() for p, c in enumerate(cs)],
        "rel_id int, pos int, attnum int",
    )
    kinds = spark.createDataFrame([(1, "x")], "type_id int, storage string")
    found = catalog.discover(shape.join(estimates, "rel_id"), spaces, stats, key_columns, attributes, kinds)
    return found.select(
        F.col("schema").alias("schema_name"), "name", "rows", F.array_join("pk", ",").alias("pk"),
        F.array_join(F.transform("cols", lambda c: c["name"]), ",").alias("cols"), "ins", "upd",
    )


_NAMES = ["updated_at", "created_at", "last_seen_at", "date_last", "event_time", "update_count_at", "row_updated", "Deleted_At", "logged_at", "modified"]


@query("rewritten_name", f"""WITH t AS (SELECT list_extract({_NAMES!r}, CAST(event_id % 10 + 1 AS INTEGER)) || CASE WHEN user_id % 2 = 0 THEN '' ELSE '_' || event_type END AS name FROM events)
SELECT name, regexp_matches(lower(name), '(^|_)(updated|modified|changed|edited|synced|touched|refreshed|deleted)(_|$)|^last_|_last$') AS is_rewritten, count(*) AS n
FROM t GROUP BY name""")
def rewritten_name(spark, d):
    base = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % 10 + 1).cast("int"))
    name = F.concat(base, F.when(F.col("user_id") % 2 == 0, "").otherwise(F.concat(F.lit("_"), "event_type")))
    return events(spark, d).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(
        "name", propose.rewritten(F.col("name")).alias("is_rewritten"), "n"
    )


def _behind(spark, d):
    """Replicas at different positions: one complete, one that has not applied the deletes."""
    full = log(spark, d)
    return full, {"a": full, "b": full.where(F.col(VERSION) < 2)}


@query("replication_status", f"""WITH {feed_sql()}, r AS (SELECT 'a' AS replica, _version FROM feed UNION ALL SELECT 'b', _version FROM feed WHERE _version < 2)
SELECT replica, CAST((SELECT max(_version) FROM feed) AS BIGINT) AS source_position, CAST(max(_version) AS BIGINT) AS applied_position,
  CAST((SELECT max(_version) FROM feed) - max(_version) AS BIGINT) AS lag, (SELECT count(*) FROM feed) - count(*) AS unapplied,
  count(*) FILTER (WHERE _version > 0) AS rows_synced, count(*) AS physical_rows,
  (SELECT count(*) FROM feed WHERE _version = 0) AS source_estimate FROM r GROUP BY replica""")
def replication_status(spark, d):
    full, replicas = _behind(spark, d)
    return status.replication_status(full, replicas, "public.events").drop("table")


@query("metrics_rows", f"""WITH {feed_sql()}, c AS (SELECT count(*) AS all_rows, count(*) FILTER (WHERE _version > 0) AS synced,
  count(*) FILTER (WHERE _version = 2) AS gone, count(*) FILTER (WHERE _version = 0) AS base FROM feed)
SELECT name, rank, line FROM (
  SELECT 'mirror_up' AS name, 2 AS rank, 'mirror_up{{mirror="m"}} 1' AS line
  UNION ALL SELECT 'retained_changes', 2, concat('retained_changes{{mirror="m"}} ', gone) FROM c
  UNION ALL SELECT 'rows_synced', 2, concat('rows_synced{{mirror="m"}} ', synced) FROM c
  UNION ALL SELECT 'table_rows', 2, concat('table_rows{{store="source",table="public.events"}} ', base) FROM c
  UNION ALL SELECT 'table_rows', 2, concat('table_rows{{store="a",table="public.events"}} ', all_rows) FROM c
  UNION ALL SELECT 'table_rows', 2, concat('table_rows{{store="b",table="public.events"}} ', all_rows - gone) FROM c
  UNION ALL SELECT n, 0, concat('# HELP ', n, ' ', h) FROM (VALUES ('mirror_up', '{status.HELP["mirror_up"]}'),
    ('retained_changes', '{status.HELP["retained_changes"]}'), ('rows_synced', '{status.HELP["rows_synced"]}'),
    ('table_rows', '{status.HELP["table_rows"]}')) AS x(n, h)
  UNION ALL SELECT n, 1, concat('# TYPE ', n, ' gauge') FROM (VALUES ('mirror_up'), ('retained_changes'), ('rows_synced'), ('table_rows')) AS y(n))""")
def metrics_rows(spark, d):
    full, replicas = _behind(spark, d)
    return status.exposition(status.status_metrics(status.replication_status(full, replicas, "public.events"), "m", "RUNNING"))


# --- rows that once went wrong ----------------------------------------------------------------------------------------

@query("null_time_check", f"""WITH {feed_sql()}, s AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS ts FROM feed WHERE _version = 0),
d AS (SELECT coalesce(strftime(ts, '%Y-%m-%d'), '<null>') AS day, event_id FROM s)
SELECT day, count(*) AS source_rows, count(*) FILTER (WHERE event_id % 9 <> 0) AS replica_rows,
  count(*) = count(*) FILTER (WHERE event_id % 9 <> 0) AS same, day = '<null>' OR day < '{TODAY}' AS settled FROM d GROUP BY day""")
def null_time_check(spark, d):
    """Days of events of which a third has no time; the replica lacks some of these."""
    rows = events(spark, d).withColumn("ts", F.when(F.col("event_id") % 3 != 0, F.col("ts")))
    replica = tables.snapshot(rows.where(F.col("event_id") % 9 != 0))
    days = reconcile.check_days(rows, {"r": replica}, BY_ID, TODAY)
    return days.select("day", "source_rows", F.element_at("replica_rows", "r").alias("replica_rows"), "same", "settled")


@query("tables_with_failure", """SELECT 'public.bad' AS "table", false AS ok, true AS failed, CAST(NULL AS BIGINT) AS source_rows
UNION ALL SELECT 'public.events', true, false, count(*) FROM events""")
def tables_with_failure(spark, d):
    """A table whose values cannot be evaluated stands beside one that can."""
    rows = events(spark, d)
    bad = rows.withColumn("ts", F.col("event_type").cast("int").cast("timestamp"))
    spec = reconcile.TableSpec("public.bad", ["event_id"], ["event_id"], "ts")
    out = reconcile.check_tables([(spec, bad, {"r": tables.snapshot(bad)}), (BY_ID, rows, {"r": tables.snapshot(rows)})], TODAY)
    return out.select("table", "ok", F.col("error").isNotNull().alias("failed"), "source_rows")


_SHADOW_LINES = [
    ("reads_total", '{mode="shadow"}', "n"), ("shadow_errors_total", '{reader="shadow"}', "bad"), ("shadow_mismatch_total", '{reader="shadow"}', "off"),
    ("shadow_reads_total", '{reader="shadow"}', "n"), ("shadow_latency_seconds_count", '{store="left"}', "n - bad"), ("shadow_latency_seconds_count", '{store="right"}', "n - bad"),
    ("shadow_latency_seconds_sum", '{store="left"}', "l"), ("shadow_latency_seconds_sum", '{store="right"}', "2 * l"),
]


@query("shadow_metrics_rows", f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 13 = 0) AS bad,
  count(*) FILTER (WHERE event_id % 13 <> 0 AND event_id % 7 = 0) AS off, CAST(sum(user_id) FILTER (WHERE event_id % 13 <> 0) AS BIGINT) AS l FROM events)
SELECT * FROM ({" UNION ALL ".join(f"SELECT '{n}' AS name, 2 AS rank, concat('{n}{label} ', {v}) AS line FROM c" for n, label, v in _SHADOW_LINES)}
  {" ".join(f"UNION ALL SELECT '{n}', 0, '# HELP {n} {status.HELP[n]}' UNION ALL SELECT '{n}', 1, '# TYPE {n} counter'" for n in dict.fromkeys(x[0] for x in _SHADOW_LINES))})""")
def shadow_metrics_rows(spark, d):
    failed = F.col("event_id") % 13 == 0
    rows = events(spark, d).select(
        F.when(~failed, F.col("event_id") % 7 != 0).alias("match"), F.when(failed, "down").alias("error"),
        (F.col("user_id") * 1000).cast("double").alias("left_ms"), (F.col("user_id") * 2000).cast("double").alias("right_ms"))
    reads = rows.count()
    return status.exposition(status.shadow_metrics(compare.shadow_stats(rows), {"shadow": reads}))
