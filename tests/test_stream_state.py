"""Streams with state, timers, joins and sums: restarts, replays, disorder, late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from twinproof.functions.terms import comparable_terms
from twinproof.operators import drilldown, reconcile, status
from twinproof.operators.reconcile import TableSpec
from twinproof.sources import feed
from twinproof.streaming import checksums, freshness, ingest, joins, late, progress, upserts, windows

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


LOG = "k string, text string, n int, _version long, _is_deleted boolean, _unchanged array<string>"


def test_upserts_ignore_old_versions_keep_tombstones_and_carry_values(spark, folder):
    batches = [
        [("a", "long", 1, 1, False, []), ("b", "x", 1, 5, False, []), ("c", None, 3, 3, False, ["text"]), (None, "null key", 0, 1, False, [])],
        [("a", None, 2, 4, False, ["text"]), ("b", "old", 0, 2, False, []), ("c", "before", 1, 1, False, []), ("d", "z", 1, 2, True, [])],
        [("d", "revived?", 1, 1, False, []), ("a", None, 3, 6, False, []), ("b", "x", 9, 7, True, []), ("e", "q", 1, 1, False, None)],
        [("b", "again", 2, 8, False, []), ("a", "late", 0, 5, False, ["text"])],
    ]
    changes, out, state = folder("in"), folder("out"), folder("state")
    for batch in batches:
        land(spark, batch, LOG, changes)
        like = spark.read.parquet(changes)
        stream = ingest.read_changes(spark, changes, like.schema)
        upserts.run_upserts(upserts.upsert_state_stream(stream, ["k"], ["text"]), out, state).awaitTermination()  # a restart each time
    got = {r["k"]: (r["text"], r["n"]) for r in upserts.read_state(spark, state, like, ["k"]).collect()}
    assert got == {"a": (None, 3), "b": ("again", 2), "c": ("before", 3), None: ("null key", 0), "e": ("q", 1)}
    accepted = {(r["k"], r["_version"], r["_is_deleted"]) for r in spark.read.parquet(out).collect()}
    assert ("b", 7, True) in accepted and ("b", 2, False) not in accepted and ("d", 1, False) not in accepted


def test_upserts_keep_many_keys_in_few_state_entries(spark, folder):
    """One entry and one call per key took milliseconds each: 600,000 keys did not end within twenty minutes."""
    big = 2**60 + 1
    schema = "k long, n long, x double, at timestamp_ntz, _version long, _is_deleted boolean"
    first = [(i, big + i if i % 3 else None, float("nan") if i % 5 == 0 else None, at(i), 1, False) for i in range(500)]
    then = [(i, -i, 0.5, None, 2, i % 2 == 0) for i in range(0, 500, 4)] + [(i, 0, 0.0, at(0), 0, False) for i in range(1, 500, 4)]
    changes, out, state = folder("in"), folder("out"), folder("state")
    for batch in (first, then):
        land(spark, batch, schema, changes)
        like = spark.read.parquet(changes)
        stream = upserts.upsert_state_stream(ingest.read_changes(spark, changes, like.schema), ["k"], buckets=4)
        upserts.run_upserts(stream, out, state).awaitTermination()
    kept = spark.read.format("statestore").option("stateVarName", upserts.LIVE).load(state)
    assert 1 <= kept.count() <= 4
    got = {r["k"]: (r["n"], str(r["x"]), r["at"]) for r in upserts.read_state(spark, state, like, ["k"]).collect()}
    assert got == {k: (n, str(x), t) for k, n, x, t, *_ in first if k % 4}
    land(spark, [(7, 7, 7.0, None, 9, False)], schema, changes)
    stream = upserts.upsert_state_stream(ingest.read_changes(spark, changes, like.schema), ["k"], buckets=1)
    with pytest.raises(Exception, match="the checkpoint was begun with"):
        upserts.run_upserts(stream, out, state).awaitTermination()


def test_waits_end_by_timers(spark, folder):
    rows = lambda key, began, *tries: [(key, at(began), at(began + w), "x", ch, err) for w, ch, err in tries]
    schema = "key string, started timestamp_ntz, at timestamp_ntz, pg string, ch string, err string"
    first = rows("met", 0, (50, "y", None), (20, "y", None), (70, "x", None), (60, "x", None)) + rows("lost", 0, (10, "y", None)) + rows("error", 0, (40, "x", "failed"))
    then = rows("error", 0, (150, "x", None), (130, None, "again")) + rows("open", 400, (5, "y", None)) + rows("met", 0, (200, "x", None))
    last = rows("tick", 2000, (0, "x", None))
    source, out, state = folder("in"), folder("out"), folder("state")
    for batch in (first, then, last):
        land(spark, batch, schema, source)
        stream = ingest.read_changes(spark, source, spark.read.parquet(source).schema)
        windows.write_settled(freshness.freshness_wait_stream(stream, ["key"], timeout=100, late="300 seconds", grace=100), out, state).awaitTermination()
    got = {r["key"]: (r["waited_s"], r["match"], r["ch"], r["err"]) for r in spark.read.parquet(out).collect()}
    assert got == {"met": (60, True, "x", None), "lost": (10, False, "y", None), "error": (130, False, "", "again"), "open": (5, False, "y", None)}
    assert spark.read.parquet(out).count() == 4


def test_waits_of_many_keys_lie_in_few_state_entries(spark, folder):
    """One call, one entry and one timer per key took milliseconds each."""
    schema = "key long, started timestamp_ntz, at timestamp_ntz, pg string, ch string, err string"
    rows = [(k, at(k), at(k + w), "x", "x" if w > k % 60 else "y", None) for k in range(300) for w in (10, 30, 50, 120)]
    land(spark, rows, schema, folder("in"))
    for last in (None, (10**6, at(9000), at(9000), "x", "x", None)):
        if last:
            land(spark, [last], schema, folder("in"))
        stream = ingest.read_changes(spark, folder("in"), spark.read.parquet(folder("in")).schema)
        found = freshness.freshness_wait_stream(stream, ["key"], timeout=100, late="10 seconds", grace=100, buckets=4)
        windows.write_settled(found, folder("out"), folder("state")).awaitTermination()
        assert 1 <= spark.read.format("statestore").option("stateVarName", "waits").load(folder("state")).count() <= 4
    got = {r["key"]: (r["waited_s"], r["match"]) for r in spark.read.parquet(folder("out")).collect()}
    first = lambda k: next(((w, True) for w in (10, 30, 50) if w > k % 60), (120, True))
    assert got == {k: first(k) for k in range(300)}


def test_stream_joins_keep_rows_without_partners(spark, folder):
    acts, logged = "ts timestamp_ntz, service string, want string", "ts timestamp_ntz, service string, kind string"
    land(spark, [(at(100), "s", "up"), (at(200), "s", "up"), (at(300), "t", "down")], acts, folder("a"))
    land(spark, [(at(110), "s", "up"), (at(120), "s", "up"), (at(299), "t", "up"), (at(259), "s", "up")], logged, folder("b"))
    out, state = folder("out"), folder("state")

    def run():
        left, right = (ingest.read_changes(spark, folder(n), spark.read.parquet(folder(n)).schema) for n in "ab")
        found = joins.exists_within_stream(left, right, ["service"], "ts", "ts", F.lit(-5), F.lit(60), "want", "kind", before=5, after=60, late="10 seconds")
        windows.write_settled(found, out, state).awaitTermination()

    run()
    land(spark, [(at(9000), "u", "up")], acts, folder("a"))
    land(spark, [(at(9000), "v", "up")], logged, folder("b"))
    run()
    got = sorted((r["ts"], r["service"], r["verified"]) for r in spark.read.parquet(out).collect())
    assert got == [(at(100), "s", True), (at(200), "s", True), (at(300), "t", False)]


def test_existence_meets_on_time_cells(spark, folder):
    """A service with a long history was one task that compared all its actions with all its events."""
    land(spark, [(at(t), "s", "up") for t in range(0, 3700, 37)], "ts timestamp_ntz, service string, want string", folder("a"))
    land(spark, [(at(t), "s", "up") for t in range(2, 3700, 101)], "ts timestamp_ntz, service string, kind string", folder("b"))

    def found():
        left, right = (ingest.read_changes(spark, folder(n), spark.read.parquet(folder(n)).schema) for n in "ab")
        return joins.exists_within_stream(left, right, ["service"], "ts", "ts", F.lit(-5), F.lit(30), "want", "kind", before=5, after=30, late="10 seconds")

    query = windows.write_settled(found(), folder("out"), folder("state"))
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "_cell" in plan.split("StreamingSymmetricHashJoin")[1].split("\n")[0]
    land(spark, [(at(9000), "u", "up")], "ts timestamp_ntz, service string, want string", folder("a"))
    land(spark, [(at(9000), "v", "up")], "ts timestamp_ntz, service string, kind string", folder("b"))
    windows.write_settled(found(), folder("out"), folder("state")).awaitTermination()
    got = sorted((r["ts"], r["verified"]) for r in spark.read.parquet(folder("out")).collect())
    assert got == [(at(t), any(-5 <= u - t <= 30 for u in range(2, 3700, 101))) for t in range(0, 3700, 37)]


def test_windows_longer_than_vouched_for_fail_the_query(spark, folder):
    land(spark, [(1, at(0), at(50))], "cycle int, beg timestamp_ntz, end timestamp_ntz", folder("a"))
    land(spark, [(at(0), at(90000), "w")], "w_beg timestamp_ntz, w_end timestamp_ntz, label string", folder("b"))
    left, right = (ingest.read_changes(spark, folder(n), spark.read.parquet(folder(n)).schema) for n in "ab")
    query = windows.write_settled(joins.overlap_labels_stream(left, right, ["cycle"]), folder("out"), folder("state"))
    with pytest.raises(Exception, match="lasts longer"):
        query.awaitTermination()


def test_checksums_equal_a_scan_after_every_batch_and_replay(spark, events, folder, monkeypatch):
    log = feed.event_log(events)
    terms = comparable_terms(events.schema, ["props"])
    changes = checksums.changes_of(log, ["event_id"], "_version", "_is_deleted")
    path, state = folder("sums"), folder("state")
    for k in range(3):
        changes.where(F.col("_version") == k).coalesce(2).write.mode("append").parquet(folder("in"))
        stream = ingest.read_changes(spark, folder("in"), changes.schema, files_per_trigger=1)
        checksums.keep_checksums(stream, path, state, "event_id", terms, 0, 17).awaitTermination()
        live = log.where(F.col("_version") <= k)
        from twinproof.operators.fold import fold

        want = reconcile.source_buckets(fold(live, ["event_id"]), TableSpec("t", ["event_id"], ["event_id"], "ts", ["props"]), 0, 17)
        got = checksums.read_checksums(spark, path, terms)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    before = sorted(map(tuple, got.collect()))
    # A failure after a batch has been written: the batch comes again and overwrites its own folder.
    import os

    commits = os.path.join(state, "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    stream = ingest.read_changes(spark, folder("in"), changes.schema, files_per_trigger=1)
    checksums.keep_checksums(stream, path, state, "event_id", terms, 0, 17).awaitTermination()
    assert sorted(map(tuple, checksums.read_checksums(spark, path, terms).collect())) == before
    monkeypatch.setattr(checksums, "scratch", lambda spark, label: folder("folded"))
    assert sorted(map(tuple, checksums.read_checksums(spark, checksums.fold_checksums(spark, path, terms), terms).collect())) == before


def test_late_rows_are_kept_and_restate_their_day(spark, folder):
    day = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    schema = "id int, ts timestamp_ntz"
    batches = [[(1, day(0)), (2, day(0, 5)), (3, day(1))], [(4, day(3)), (5, day(0, 7))], [(6, day(0, 9)), (7, day(1, 1)), (8, None)], [(9, day(0, 1)), (10, day(9))]]
    for batch in batches:
        land(spark, batch, schema, folder("in"))
        stream = ingest.read_changes(spark, folder("in"), spark.read.parquet(folder("in")).schema, files_per_trigger=1)
        late.count_days(stream, "ts", folder("days"), folder("state")).awaitTermination()
    first = {(r["day"] - T0.date()).days: r["n"] for r in late.reports(spark, folder("days")).collect()}
    assert first == {0: 3, 1: 1, 3: 1}  # row 5 came in the batch that settled its day
    fixed = [((r["day"] - T0.date()).days, r["batch"], r["added"], r["restated"]) for r in late.corrections(spark, folder("days")).orderBy("day", "batch").collect()]
    assert fixed == [(0, 2, 1, 4), (0, 3, 1, 5), (1, 2, 1, 2)]
    kept = late.late_rows(spark, folder("days"), spark.read.parquet(folder("in")))
    assert sorted(r["id"] for r in kept.collect()) == [6, 7, 9]


def spec_of(order_by):
    return TableSpec("t", ["id"], order_by)


def test_drill_down_names_rows_and_reads_only_their_ranges(spark, folder, monkeypatch):
    n = 5000
    source = spark.range(n).select("id", (F.col("id") * 3).alias("v"), F.lit("abc").alias("text"))
    log = source.withColumns({"_version": F.lit(0).cast("long"), "_is_deleted": F.lit(False)})
    odd = spark.createDataFrame([(70, 1, "abc", 1, False), (4999, 5, "abcd", 1, False), (123, 369, "abc", 1, True), (10**12, 1, "extra", 0, False), (-5, 1, "below", 0, False)],
                                "id long, v long, text string, _version long, _is_deleted boolean")
    log.unionByName(odd).write.parquet(folder("log"))
    replica, clean = spark.read.parquet(folder("log")), log
    monkeypatch.setattr(drilldown, "AS_FILTER", 8)
    got = drilldown.drill_down(source, {"a": replica, "b": clean}, spec_of(["id"]), fan=8)
    assert {(r["key"], r["replica"]) for r in got.collect()} == {(70, "a"), (4999, "a"), (123, "a"), (10**12, "a"), (-5, "a")}
    gone = {r["key"]: (r["source_sums"], r["replica_sums"]) for r in got.collect()}
    assert gone[123][1] == "" and gone[10**12][0] == "" and gone[70] == ("1|70|210|3", "1|70|1|3")
    # More ranges than filters: they meet the rows by a join.
    many = log.withColumn("v", F.when(F.col("id") % 50 == 0, 0).otherwise(F.col("v")))
    found = drilldown.drill_down(source, {"a": many}, spec_of(["id"]), fan=8)
    assert {r["key"] for r in found.collect()} == set(range(50, n, 50))
    assert drilldown.drill_down(source, {"a": clean}, spec_of(["id"])).isEmpty()
    assert drilldown.drill_down(source.limit(0), {"a": log.limit(0)}, spec_of(["id"])).isEmpty()
    with pytest.raises(ValueError):
        drilldown.drill_down(source, {"a": log}, TableSpec("t", ["text"], ["text"]))


def test_ranges_become_filters_at_the_scan(spark, folder):
    spark.range(100).write.parquet(folder("t"))
    where = drilldown._inside("id", drilldown._merged([(5, 7), (8, 9), (40, 40)]))
    plan = spark.read.parquet(folder("t")).where(where)._jdf.queryExecution().executedPlan().toString()
    assert drilldown._merged([(8, 9), (5, 7), (40, 40)]) == [(5, 9), (40, 40)] and "PushedFilters: [Or(And(GreaterThanOrEqual(id,5)" in plan


def test_totals_equal_a_scan_after_each_batch_and_a_replay(spark, folder):
    schema = "k string, position int, changes int, _version long, _is_deleted boolean"
    batches = [[("a", 1, 1, 0, False), ("b", 1, 1, 0, False)], [("a", 9, 9, 3, False)], [("b", 0, 0, 2, True), ("c", 0, 0, None, False)]]
    source, path, totals, state = (folder(n) for n in ("in", "log", "totals", "state"))
    assert progress.read_totals(spark, totals).count() == 0
    for batch in batches:
        land(spark, batch, schema, source)
        stream = ingest.read_changes(spark, source, spark.read.parquet(source).schema)
        ingest.ingest(stream, path, state, ["k"], progress=totals).awaitTermination()
        log = ingest.read_ingested(spark, path)
        seen = progress.read_totals(spark, totals)
        scanned = status.replication_status(log, {"r": log}, "t").collect()
        quick = progress.status_of_totals(seen, {"r": seen}, "t")
        assert quick.collect() == scanned
    assert path not in plan_of(quick) and "totals" in plan_of(quick)
    again = {"position": 2, "changes": 2, "snapshot": 0, "synced": 1}
    progress.record(spark, totals, 2, again)  # the last batch once more, as after a failure
    assert progress.read_totals(spark, totals).first()[:] == (2, 3, 5, 2, 2)
    with pytest.raises(RuntimeError):
        progress.record(spark, totals, 7, again)


def test_totals_begin_with_the_stream_and_old_ones_go(spark, folder):
    totals = folder("totals")
    for n in range(progress.KEPT + 3):
        progress.record(spark, totals, n, {"position": None if n == 0 else n, "changes": 1, "snapshot": int(n == 0), "synced": int(n > 0)})
    assert progress.read_totals(spark, totals).first()[:] == (12, 12, 13, 1, 12)
    assert spark.read.parquet(totals).count() == progress.KEPT


def test_gate_from_totals_reads_no_log_for_the_position(spark, events, folder):
    rows, spec = feed.event_log(events), TableSpec("public.events", ["event_id"], ["event_id"], "ts", ["props"])
    done = lambda v, n: spark.createDataFrame([(1, v, n, 0, n)], progress._TOTALS)
    live = feed.events_after_changes(events)
    gate = lambda w, **at: reconcile.cutover_gate(live, {"r": rows}, spec, w, "2024-01-31", positions=at).first()
    assert gate(2, r=done(2, 5))["ready"] and not gate(3, r=done(2, 5))["reached"] and not gate(2, r=done(None, 0))["ready"]
