import random

import pytest
from pyspark.sql import functions as F

from twinproof.operators import ordered, series

SCHEMA = "g string, t long, id long, v double"


def make(spark, n, seed, hot=0.4):
    """Random series in which one key holds a large share of the rows."""
    r = random.Random(seed)
    rows = [
        ("hot" if r.random() < hot else r.choice("abc") if r.random() < 0.9 else None, r.randrange(n // 2), i,
         None if r.random() < 0.4 else float(r.randrange(20)))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return {k: sorted(v, key=lambda x: (x[1], x[2])) for k, v in groups.items()}


@pytest.mark.parametrize("chunks", [2, 7, 200])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("forward", [True, False])
def test_carry_equals_a_loop(spark, chunks, inclusive, forward):
    rows, df = make(spark, 400, 1)
    want = {}
    for group in by_key(rows).values():
        last = None
        for row in group if forward else reversed(group):
            if not inclusive:
                want[row[2]] = last
            last = row[3] if row[3] is not None else last
            if inclusive:
                want[row[2]] = last
    got = ordered.carry(df, ["g"], ["t", "id"], {"c": F.col("v")}, inclusive, forward, chunks=chunks)
    assert {r["id"]: r["c"] for r in got.collect()} == want


def test_previous_and_running_equal_a_loop(spark):
    rows, df = make(spark, 300, 2)
    prev, total, top = {}, {}, {}
    for group in by_key(rows).values():
        last, s, m = None, 0.0, None
        for row in group:
            prev[row[2]], last = last, row[3]
            s += row[3] or 0
            top[row[2]] = m
            m = row[3] if m is None else m if row[3] is None else max(m, row[3])
            total[row[2]] = s
    got = ordered.previous(df, ["g"], ["t", "id"], {"p": "v"}, chunks=6)
    assert {r["id"]: r["p"] for r in got.collect()} == prev
    got = ordered.running(df, ["g"], ["t", "id"], "s", F.coalesce("v", F.lit(0.0)), chunks=6)
    assert {r["id"]: r["s"] for r in got.collect()} == total
    got = ordered.running(df, ["g"], ["t", "id"], "m", F.col("v"), "max", inclusive=False, chunks=6)
    assert {r["id"]: r["m"] for r in got.collect()} == top


def test_streak_equals_a_loop(spark):
    rows, df = make(spark, 300, 3)
    want = {}
    for group in by_key(rows).values():
        n = 0
        for row in group:
            n = n + 1 if row[3] is not None else 0
            want[row[2]] = n
    got = series.streak(df, ["g"], ["t", "id"], F.col("v").isNotNull(), chunks=5)
    assert {r["id"]: r["streak"] for r in got.collect()} == want


@pytest.mark.parametrize("chunks", [None, 2, 9, 300])
@pytest.mark.parametrize("n", [1, 2, 19, 20, 400])
def test_order_statistics_equal_sorting(spark, chunks, n):
    rows, df = make(spark, max(n, 4), 4)
    rows = rows[:n]
    df = spark.createDataFrame(rows, SCHEMA)
    ranks = {
        "exact": ordered.rank_floor(0.95), "p99": ordered.rank_below(0.99), "mid": ordered.rank_upper_median(), "top": ordered.rank_last(),
    }
    want = {}
    for key, group in by_key(rows).items():
        s = sorted(r[3] for r in group if r[3] is not None)
        if s:
            want[key] = (len(s), s[min(int(0.95 * len(s)), len(s) - 1)], s[int(0.99 * (len(s) - 1))], s[len(s) // 2], s[-1])
    got = ordered.order_statistics(df, ["g"], "v", ranks, chunks=chunks)
    assert {r["g"]: (r["n"], r["exact"], r["p99"], r["mid"], r["top"]) for r in got.collect()} == want


def test_percentile_definitions_differ_where_they_should(spark):
    df = spark.range(1, 21).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    ranks = {"nearest": ordered.rank_floor(0.95)}
    assert ordered.order_statistics(df, ["g"], "v", ranks).first()["nearest"] == 20.0  # not the 19th, as ceil(p n) would be
    cont = ordered.interpolated_percentile(df, ["g"], "v", 0.95, "p").first()["p"]
    assert cont == pytest.approx(df.agg(F.percentile("v", 0.95)).first()[0])


def test_weighted_statistics(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (9, 4)], "v int, n long")
    got = ordered.order_statistics(df, [], "v", {"mid": ordered.rank_upper_median(), "top": ordered.rank_last()}, weight="n").first()
    assert (got["n"], got["mid"], got["top"]) == (10, 2, 9)


def test_positions_of_a_total_order_with_many_equal_rows(spark):
    r = random.Random(5)
    rows = [(r.choice("xyz"), r.randrange(3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a string, b int").repartition(6)
    got = ordered.with_position(df, [F.desc("a"), "b"]).orderBy("position").collect()
    assert [x["position"] for x in got] == list(range(500))
    assert [(x["a"], x["b"]) for x in got] == sorted(rows, key=lambda x: (-ord(x[0]), x[1]))


@pytest.mark.parametrize("count", [0, 1, 5, 64, 65, 200, 1000])
def test_chunk_of_counts_split_points_below(spark, count):
    splits = [10 * i for i in range(count)]
    df = spark.range(-20, 10 * count + 20, 3).withColumn("k", ordered.chunk_of("id", splits))
    bad = df.where(F.col("k") != F.least(F.greatest(F.floor(F.col("id") / 10) + 1, F.lit(0)), F.lit(count)))
    assert bad.count() == 0


def test_split_points_cut_a_hot_key_evenly(spark):
    df = spark.range(20_000).select(F.col("id").alias("t"))
    splits = ordered.split_points(df, "t", 8)
    sizes = [r["count"] for r in df.withColumn("c", ordered.chunk_of("t", splits)).groupBy("c").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_counter_rate_with_a_restart(spark):
    rows = [("m", i * 60, i, c) for i, c in enumerate([0, 60, 120, 180, 240, 300, 30, 90])]
    df = spark.createDataFrame(rows, "m string, s long, id long, c long").withColumn("at", F.timestamp_seconds("s"))
    got = [r["rate"] for r in series.counter_rate(df, ["m"], ["at", "id"], "c").orderBy("id").collect()]
    assert got[0] is None and got[5] == 1.0
    assert got[6] == pytest.approx((60 * 4 + 30) / 300)


def test_counter_rate_does_not_depend_on_cells(spark):
    r = random.Random(7)
    rows = [("m", t, i, t * 2) for i, t in enumerate(sorted(r.sample(range(20_000), 300)))]
    df = spark.createDataFrame(rows, "m string, s long, id long, c long").withColumn("at", F.timestamp_seconds("s"))
    got = {x["id"]: x["rate"] for x in series.counter_rate(df, ["m"], ["at", "id"], "c").collect()}
    for _, t, i, c in rows:
        first = min(x for x in rows if t - 300 <= x[1] <= t)
        assert got[i] == (None if first[1] == t else pytest.approx(2.0))


def test_equal_bits_for_one_chunk_and_many(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 3, rng.random() * 100) for i in range(2000)], "g int, v double")
    one = {r["g"]: r["p"] for r in ordered.interpolated_percentile(df, ["g"], "v", 0.95, "p", splits=[]).collect()}
    many = {r["g"]: r["p"] for r in ordered.interpolated_percentile(df, ["g"], "v", 0.95, "p", chunks=50).collect()}
    assert one == many and all(v is not None for v in one.values())


def test_strict_carry_ignores_rows_of_the_same_time(spark):
    rows = [("a", 10, "stop"), ("a", 10, "start"), ("a", 12, "start"), ("a", 12, "start"), ("a", 15, "stop"), ("b", 11, "start")]
    for chunks in (1, 4):
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, "s string, t int, action string")
            got = ordered.carry(df, ["s"], ["t"], {"n": F.when(F.col("action") == "start", F.col("t"))}, forward=False, strict=True, chunks=chunks)
            assert {(r["s"], r["t"], r["n"]) for r in got.collect()} == {("a", 10, 12), ("a", 12, None), ("a", 15, None), ("b", 11, None)}


def test_order_statistics_compute_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def watched(x):
        seen.add(1)
        return x

    df = spark.range(500).select(F.lit(1).alias("g"), watched("id").alias("v"))
    got = ordered.order_statistics(df, ["g"], "v", {"top": ordered.rank_last()}, chunks=4).collect()
    assert [tuple(r) for r in got] == [(1, 500, 499)] and seen.value <= 1000  # the filter and the grouping may each ask once
