import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from twinproof.functions import clock
from twinproof.functions.names import DELETED, SKIP_NOT_SINGLE_KEY, VERSION
from twinproof.functions.terms import comparable_terms
from twinproof.operators import reconcile, status
from twinproof.operators.reconcile import TableSpec
from twinproof.sources import feed
from twinproof.streaming import ingest

BY_ID = TableSpec("public.events", ["event_id"], ["event_id"], "ts", ["props"])
BY_TENANT = TableSpec("public.events", ["event_id"], ["user_id", "ts", "event_id"], "ts", ["props"])
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "mode, spec, live, bad_days, bad_buckets",
    [
        # Known results of the planted defects at sf0.01 (source: 9,500 live rows, 30 days, 64 buckets).
        (feed.FULL, BY_TENANT, 9500, 0, 0),
        (feed.DELETE_MARKER, BY_TENANT, 10_000, 30, 64),
        (feed.DELETE_MARKER, BY_ID, 9500, 0, 0),
        (feed.EMPTY_TEXT, BY_ID, 9500, 0, 64),
        (feed.KEY_MOVE, BY_TENANT, 9700, 30, 64),
        (feed.KEY_MOVE, BY_ID, 9500, 0, 0),
    ],
)
def test_each_planted_defect_is_found(spark, mode, spec, live, bad_days, bad_buckets):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source = feed.events_after_changes(events, feed.KEY_MOVE if mode == feed.KEY_MOVE else feed.FULL)
    replicas = {"r": feed.event_log(events, mode)}
    days = reconcile.summarise_days(reconcile.check_days(source, replicas, spec, "2024-01-31")).first()
    buckets = reconcile.check_buckets(source, replicas, spec)
    assert days["replica_rows"]["r"] == live
    assert len(days["bad_days"]) == bad_days and days["ok"] == (bad_days == 0)
    assert buckets.where("not same").count() == bad_buckets


def test_unsettled_days_are_reported_not_judged(spark, events):
    replicas = {"r": feed.event_log(events, feed.DELETE_MARKER)}
    source = feed.events_after_changes(events)
    first = reconcile.summarise_days(reconcile.check_days(source, replicas, BY_TENANT, "1970-01-01")).first()
    assert first["ok"] and not first["bad_days"] and len(first["unsettled"]) == 30
    # but the cutover gate stops on them
    gate = reconcile.cutover_gate(source, replicas, BY_TENANT, 2, "1970-01-01").first()
    assert gate["unsettled_days"] == 30 and not gate["ready"]


def test_gate_waits_for_every_replica(spark, events):
    log = feed.event_log(events)
    source = feed.events_after_changes(events)
    ready = reconcile.cutover_gate(source, {"a": log, "b": log}, BY_ID, 2, "2024-01-31").first()
    assert ready["ready"] and ready["reached"]
    behind = reconcile.cutover_gate(source, {"a": log, "b": log.where(F.col(VERSION) < 2)}, BY_ID, 2, "2024-01-31").first()
    assert not behind["reached"] and not behind["ready"]


def test_table_without_time_is_judged_under_one_key(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    log = spark.createDataFrame([(1, "a", 0, False)], f"id long, x string, {VERSION} long, {DELETED} boolean")
    spec = TableSpec("t", ["id"], ["id"])
    row = reconcile.check_days(source, {"r": log}, spec, "2024-01-31").first()
    assert (row["day"], row["source_rows"], row["replica_rows"], row["settled"], row["same"]) == ("all", 2, {"r": 1}, True, False)
    assert row["line"] == "all source=2 r=1"


def test_null_times_get_their_own_day(spark):
    df = spark.sql("select 1 id, cast(null as timestamp_ntz) ts union all select 2, timestamp_ntz'2024-01-05 23:59:59'")
    got = {r["day"]: r["n"] for r in reconcile.count_days(df, "ts").collect()}
    assert got == {"<null>": 1, "2024-01-05": 1}


def test_rows_outside_the_source_range_get_buckets(spark):
    source = spark.range(100, 228).select(F.col("id"))
    log = spark.createDataFrame(
        [(i, 0, False) for i in [*range(100, 228), 5, -7, 4000]], f"id long, {VERSION} long, {DELETED} boolean"
    )
    bad = reconcile.check_buckets(source, {"r": log}, TableSpec("t", ["id"], ["id"])).where("not same")
    got = {r["bucket"]: (r["low"], r["high"], r["line"]) for r in bad.collect()}
    assert got[-48] == (4, 5, "id 4..5: source=[] r=[1|5]")
    assert set(got) == {-48, -54, 1950}


@pytest.mark.parametrize("lo, width", [(-9_223_372_036_854_775_808, 288_230_376_151_711_744), (0, 157), (-5, 3)])
def test_bucket_is_a_floor_division(spark, lo, width):
    keys = [-9_223_372_036_854_775_808, -9, -6, -5, -1, 0, 1, 156, 157, 9_223_372_036_854_775_807]
    df = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("b", reconcile.bucket_of("k", lo, width))
    assert {r["k"]: r["b"] for r in df.collect()} == {k: (k - lo) // width for k in keys}


def test_keys_that_cannot_be_bucketed_are_skipped_with_a_reason(spark):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    for key in (["a"], ["a", "b"]):
        row = reconcile.check_buckets(df, {"r": df}, TableSpec("t", key, key, folded=False)).first()
        assert row["line"] == SKIP_NOT_SINGLE_KEY and row["same"]


def test_same_length_edit_needs_the_strict_check(spark):
    source = spark.createDataFrame([(1, "abc")], "id long, x string")
    copy = spark.createDataFrame([(1, "abd")], "id long, x string")
    spec = TableSpec("t", ["id"], ["id"], folded=False)
    assert reconcile.check_buckets(source, {"r": copy}, spec).where("not same").count() == 0
    assert reconcile.check_buckets(source, {"r": copy}, spec, strict=True).where("not same").count() == 1


def test_comparable_types(spark):
    schema = spark.sql(
        "select 1L a, true b, current_timestamp() c, current_date() d, 'x' e, '{}' f, 1.0D g, 1.0F h, 1.00BD i, X'00' j, array(1) k, 1S l"
    ).schema
    got = {t.column: t.kind for t in comparable_terms(schema, ["f"])}
    assert got == {"a": "integer", "b": "boolean", "c": "time", "d": "time", "e": "text", "f": "json", "l": "integer"}


def test_sums_are_exact_beyond_bigint_and_count_bytes(spark):
    df = spark.createDataFrame(
        [(9_223_372_036_854_775_807, "ä €"), (9_223_372_036_854_775_807, None)], "id long, x string"
    )
    terms = comparable_terms(df.schema)
    assert reconcile.fingerprint(df, terms).first()[0] == "2|18446744073709551614|6"
    assert reconcile.fingerprint(df.limit(0), terms).first()[0] == "0|0|0"


def test_times_before_1970_round_down(spark):
    df = spark.sql("select timestamp_ntz'1969-12-31 23:59:58.5' t")
    assert df.select(clock.epoch_seconds("t")).first()[0] == -2


def test_weeks(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-14')) d")
    for r in df.select("d", clock.week_monday("d").alias("m"), clock.week_sunday("d").alias("s"), clock.month_key("d").alias("k")).collect():
        assert r["m"].weekday() == 0 and 0 <= (r["d"] - r["m"]).days < 7
        assert r["s"].weekday() == 6 and 0 <= (r["d"] - r["s"]).days < 7
        assert r["k"] == "202401"


def test_failing_table_does_not_stop_the_others(spark, events):
    log = feed.event_log(events)
    broken = TableSpec("public.broken", ["event_id"], ["event_id"], "no_such_column")
    out = reconcile.check_tables(
        [(BY_ID, feed.events_after_changes(events), {"r": log}), (broken, events, {"r": log})], "2024-01-31"
    )
    got = {r["table"]: (r["ok"], r["error"] is None) for r in out.collect()}
    assert got == {"public.events": (True, True), "public.broken": (False, False)}


def test_exposition_names_help_once(spark, events):
    log = feed.event_log(events)
    s = status.replication_status(log, {"a": log, "b": log}, "public.events")
    summary = reconcile.summarise_days(reconcile.check_days(feed.events_after_changes(events), {"a": log}, BY_ID, "2024-01-31"))
    metrics = status.status_metrics(s, "m", "PAUSED").unionByName(status.check_metrics(summary, "m", 12.5))
    lines = [r["line"] for r in status.exposition(metrics).collect()]
    names = [x.split(" ")[2] for x in lines if x.startswith("# HELP")]
    assert names == sorted(set(names)) and len(names) == 7
    assert 'mirror_up{mirror="m"} 0' in lines and 'check_age_seconds{mirror="m"} 12.5' in lines
    assert lines.count('reconcile_mismatch_days{table="public.events"} 0') == 1


def test_ingested_stream_is_restartable_and_equals_the_batch(spark, events, tmp_path):
    source, path, state = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "state")
    log = feed.event_log(events)
    log.repartition(3).write.parquet(source)

    def run():
        stream = ingest.read_changes(spark, source, log.schema, files_per_trigger=1)
        ingest.ingest(stream, path, state, ["event_id"], "ts").awaitTermination()
        return ingest.read_ingested(spark, path)

    first = run()
    assert first.count() == log.count() and first.select("batch").distinct().count() == 3
    assert run().count() == log.count()  # nothing new: a restart adds nothing
    log.limit(10).write.mode("append").parquet(source)
    assert run().count() == log.count() + 10
    live = reconcile.fold(run().drop("batch"), ["event_id"])
    assert live.count() == feed.events_after_changes(events).count()


def test_questions_run_on_both_stores(spark, events):
    from twinproof.operators import questions
    from twinproof.operators.fold import fold

    stores = {"source": feed.events_after_changes(events), "replica": fold(feed.event_log(events), ["event_id"])}
    asked = questions.event_questions("2024-01-31 00:00:00")
    samples = questions.run_questions(stores, asked, runs=1)
    assert samples.count() == len(asked) * 2
    assert questions.summarise_samples(samples).where("runs = 1 and median_ms > 0").count() == len(asked) * 2
    for ask in asked.values():
        left, right = ask(stores["source"]), ask(stores["replica"])
        assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_snapshot_copies_with_and_without_clustering(spark, events, tmp_path):
    from twinproof.sources import tables

    plain = tables.copy_snapshot(events, "event_id", str(tmp_path / "a"))
    ranged = tables.copy_snapshot(events, "event_id", str(tmp_path / "b"), partition_rows=300, cluster=True)
    assert plain.exceptAll(ranged).count() == 0 and plain.count() == ranged.count() == events.count()
    assert len(ranged.inputFiles()) == 4


def test_shadow_metrics(spark):
    row = spark.createDataFrame([(5, 3, 1, 1, 1500.0, 20.0)], "shadowed long, matches long, mismatches long, errors long, left_ms double, right_ms double")
    got = {(r["name"], *r["labels"].values()): r["value"] for r in status.shadow_metrics(row, {"left_only": 7}).collect()}
    assert got == {
        ("shadow_reads_total", "shadow"): 5.0, ("shadow_mismatch_total", "shadow"): 1.0, ("shadow_errors_total", "shadow"): 1.0,
        ("shadow_latency_seconds_sum", "left"): 1.5, ("shadow_latency_seconds_count", "left"): 4.0,
        ("shadow_latency_seconds_sum", "right"): 0.02, ("shadow_latency_seconds_count", "right"): 4.0, ("reads_total", "left_only"): 7.0}
    lines = [r["line"] for r in status.exposition(status.shadow_metrics(row)).collect()]
    assert "# TYPE shadow_reads_total counter" in lines and 'shadow_latency_seconds_sum{store="left"} 1.5' in lines


def test_label_values_are_escaped(spark):
    row = spark.createDataFrame([("m", {"a": 'x"y\\z\n'}, 1.0)], "name string, labels map<string,string>, value double")
    assert status.exposition(row).collect()[2]["line"] == 'm{a="x\\"y\\\\z\\n"} 1'


def test_metrics_read_each_log_once(spark, events, tmp_path):
    feed.event_log(events).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    page = status.exposition(status.status_metrics(status.replication_status(log, {"a": log, "b": log}, "t"), "m", "RUNNING"))
    assert plan_of(page).count("FileScan") <= 3


def test_rows_without_a_time_are_judged(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "event_id long, ts timestamp, x string")
    spec = TableSpec("t", ["event_id"], ["event_id"], "ts")
    one = reconcile.summarise_days(reconcile.check_days(rows, {"r": feed_of(rows.limit(1))}, spec, "2024-01-31")).first()
    assert not one["ok"] and one["bad_days"] == ["<null> source=2 r=1"]


def feed_of(rows):
    return rows.withColumns({"_version": F.lit(0).cast("bigint"), "_is_deleted": F.lit(False)})


def test_keys_at_both_ends_of_the_range(spark):
    rows = spark.createDataFrame([(1, "a"), (2**63 - 1, "b")], "event_id long, x string")
    got = reconcile.check_buckets(rows, {"r": feed_of(rows)}, TableSpec("t", ["event_id"], ["event_id"])).collect()
    assert len(got) == 2 and all(r["same"] for r in got)


def test_a_table_that_fails_while_running_stops_no_other(spark):
    good = spark.createDataFrame([(1, "a")], "event_id long, x string")
    bad = good.withColumn("ts", F.col("x").cast("int").cast("timestamp"))
    out = reconcile.check_tables([
        (TableSpec("bad", ["event_id"], ["event_id"], "ts"), bad, {"r": feed_of(bad)}), (TableSpec("good", ["event_id"], ["event_id"]), good, {"r": feed_of(good)})], "2024-01-31")
    got = {r["table"]: (r["ok"], r["error"] is None) for r in out.collect()}
    assert got == {"bad": (False, False), "good": (True, True)}
