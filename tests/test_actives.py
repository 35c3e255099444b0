"""Day states of distinct users, and copies that go on after they broke off."""

import datetime

import pytest
from pyspark.sql import functions as F

from twinproof.operators import actives
from twinproof.sources import tables


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def rows_of(spark):
    seen = [(0, 1), (0, 1), (0, -1), (0, 32768), (0, 40000), (2, 1), (2, 7), (2, None), (None, 5), (9, 0), (9, -32768), (9, 2**40)]
    rows = [(None if d is None else datetime.datetime.combine(day(d), datetime.time(h)), u) for d, u in seen for h in (1, 23)]
    return seen, spark.createDataFrame(rows, "ts timestamp_ntz, u bigint").withColumn("users", F.lit("clash"))


def expected(seen, spans):
    known = [(d, u) for d, u in seen if d is not None and u is not None]
    out = {}
    for span in spans:
        for to in range(10):
            users = {u for d, u in known if to - span < d <= to}
            if users:
                out[day(to), span] = len(users)
    return out


@pytest.mark.parametrize("make", [actives.day_bitmaps, actives.day_sketches])
def test_rolling_actives_equal_sets(spark, tmp_path, make):
    seen, df = rows_of(spark)
    want = expected(seen, (1, 3, 30))
    states = make(df, "ts", "u")
    found = lambda s: {(r["day"], r["span"]): r["users"] for r in actives.rolling_actives(s, (1, 3, 30)).collect()}
    assert found(states) == want
    # Batches that share users, one of them replayed, and a compacted copy.
    path = str(tmp_path / "states")
    for batch, part in ((0, df.where("u > 0")), (1, df.where("u <= 1")), (1, df.where("u <= 1"))):
        actives.save_states(make(part, "ts", "u"), path, batch)
    stored = actives.read_states(spark, path)
    assert found(stored) == want and found(actives.compacted(stored)) == want
    assert found(make(df.limit(0), "ts", "u")) == {}


def test_bitmaps_need_whole_numbers(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "a")], "ts timestamp_ntz, u string")
    with pytest.raises(TypeError):
        actives.day_bitmaps(df, "ts", "u")
    assert actives.rolling_actives(actives.day_sketches(df, "ts", "u"), [1]).first()["users"] == 1


def test_sketches_of_many_users_are_close(spark):
    df = spark.range(50_000).select(F.lit(datetime.datetime(2024, 1, 1)).alias("ts"), F.col("id").alias("u"))
    assert actives.rolling_actives(actives.day_bitmaps(df, "ts", "u"), [1]).first()["users"] == 50_000
    assert abs(actives.rolling_actives(actives.day_sketches(df, "ts", "u"), [1]).first()["users"] - 50_000) < 4_000


@pytest.mark.parametrize("kind", ["bigint", "decimal(20,2)", "double"])
def test_a_copy_goes_on_where_it_broke_off(spark, tmp_path, kind):
    df = spark.range(1000).select(F.when(F.col("id") % 50 != 7, F.col("id")).cast(kind).alias("k"), F.lit("x").alias("v"), F.lit(1).alias("range"))
    path, copied = str(tmp_path / "log"), []

    def stop(n):
        copied.append(n)
        if n == 3 and copied.count(3) == 1:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        tables.copy_in_ranges(df, "k", path, partition_rows=50, ranges=5, before_range=stop)
    log = tables.copy_in_ranges(df, "k", path, partition_rows=50, ranges=5, before_range=stop)
    assert copied == [-1, 0, 1, 2, 3, 3, 4]
    assert sorted(log.select("k", "v", "range").collect(), key=str) == sorted(df.collect(), key=str)
    assert log.columns == [*df.columns, "_version", "_is_deleted"] and log.where("_version <> 0 OR _is_deleted").isEmpty()
    # A third run copies nothing.
    tables.copy_in_ranges(df, "k", path, before_range=stop)
    assert len(copied) == 7


def test_a_copy_of_nothing(spark, tmp_path):
    empty = spark.range(0).select(F.col("id").alias("k"))
    assert tables.copy_in_ranges(empty, "k", str(tmp_path / "a"), ranges=3).isEmpty()
    assert tables.copy_in_ranges(spark.range(5), "id", str(tmp_path / "b"), ranges=1).count() == 5
