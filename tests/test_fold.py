import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from twinproof.functions.names import DELETED, VERSION
from twinproof.operators import fold as folding
from twinproof.sources import feed, tables

KEY = ["event_id"]


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("mode", [feed.FULL, feed.DELETE_MARKER, feed.EMPTY_TEXT, feed.KEY_MOVE])
def test_all_folds_agree(spark, events, mode):
    log = feed.event_log(events, mode)
    want = rows(folding.fold(log, KEY))
    assert rows(folding.fold_by_rank(log, KEY)) == want
    assert rows(folding.fold_over_snapshot(events, log.where(F.col(VERSION) > 0), KEY)) == want
    numbers = ["event_id", "user_id", "value"]
    assert rows(folding.fold(log, KEY, numbers)) == rows(folding.fold_by_rank(log, KEY).select(*numbers))


def test_fold_then_delete_never_the_other_way_round(spark):
    log = spark.createDataFrame(
        [(1, "a", 0, False), (1, "b", 1, True), (2, "a", 0, True), (2, "b", 1, False)],
        f"id int, x string, {VERSION} long, {DELETED} boolean",
    )
    # Filtering first would revive row 1 with its old value.
    assert rows(folding.fold(log, ["id"])) == [(2, "b")]


def test_live_filter_stays_above_the_fold(spark, events):
    plan = plan_of(folding.fold_by_rank(feed.event_log(events), KEY))
    assert plan.index("NOT _is_deleted") < plan.index("WindowGroupLimit")


def test_key_filter_moves_below_the_fold(spark, events, tmp_path):
    path = str(tmp_path / "log")
    feed.event_log(events).write.parquet(path)
    log = spark.read.parquet(path)
    live = folding.fold(log, ["user_id", "ts", "event_id"], ["user_id", "ts", "event_id"])
    plan = plan_of(live.where("ts > timestamp_ntz'2024-01-20 00:00:00'"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts,2024-01-20T00:00)]" in plan.replace("...", "")
    # Hash aggregation, and nothing but the key and the two marker columns is read.
    assert "SortAggregate" not in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,_version:bigint,_is_deleted:boolean>" in plan


def test_bucketed_log_folds_without_shuffle(spark, events, tmp_path):
    tables.save_bucketed_log(feed.event_log(events), "bucketed_log", str(tmp_path / "b"), KEY, 4)
    log = spark.table("bucketed_log")
    assert "Exchange" not in plan_of(folding.fold(log, KEY, ["event_id", "ts"]))
    assert rows(folding.fold(log, KEY)) == rows(folding.fold(feed.event_log(events), KEY))


def test_compaction_keeps_the_live_view(spark, events):
    log = feed.event_log(events)
    for up_to in (0, 1, 2):
        short = folding.compact(log, KEY, up_to)
        assert rows(folding.fold(short, KEY)) == rows(folding.fold(log, KEY))
    assert folding.compact(log, KEY, 2).count() == events.count()


def test_unchanged_values_are_carried_and_real_nulls_kept(spark):
    log = spark.createDataFrame(
        [
            (1, "long", 0, False, []), (1, None, 1, False, ["body"]), (1, None, 2, False, ["body"]),
            (2, "long", 0, False, []), (2, None, 1, False, []),
            (3, "long", 0, False, []), (3, "new", 1, False, []), (3, None, 2, False, ["body"]),
        ],
        f"id int, body string, {VERSION} long, {DELETED} boolean, _unchanged array<string>",
    )
    assert rows(folding.carry_unchanged(log, ["id"], ["body"])) == [("long", 1), ("new", 3), (None, 2)]


def test_default_identity_reproduces_both_failures(spark, events):
    log = feed.event_log(events)
    poor = feed.apply_identity(log, "default", ["event_id"], ["props"])
    assert poor.where(F.col(DELETED)).agg(F.max("ts").cast("string")).first()[0] == "1970-01-01 00:00:00"
    assert poor.where((F.col(VERSION) == 1) & (F.col("props") != "")).count() == 0
    assert feed.apply_identity(log, "full", ["event_id"]) is log
    with pytest.raises(ValueError):
        feed.apply_identity(log, "other", ["event_id"])


def test_feed_reads_its_table_once_and_only_needed_columns(events):
    plan = plan_of(feed.event_log(events).select("event_id", VERSION))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<event_id:bigint>" in plan


def test_equal_versions_never_mix_rows(spark):
    log = spark.createDataFrame([(1, f"x{i}", f"y{i}", 3, False) for i in range(20)], f"id int, x string, y string, {VERSION} long, {DELETED} boolean").repartition(5)
    for live in (folding.newest(log, ["id"]), folding.fold(log, ["id"]), folding.fold_by_rank(log, ["id"])):
        row = live.first()
        assert row["x"][1:] == row["y"][1:]


def test_a_copied_snapshot_is_not_copied_again(spark, events, tmp_path):
    tables.copy_snapshot(events, "event_id", str(tmp_path / "copy"))
    with pytest.raises(Exception, match="(?i)exist"):
        tables.copy_snapshot(events, "event_id", str(tmp_path / "copy"))
