import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from twinproof.operators import compare as comparing
from twinproof.operators.compare import QueryPair, ShadowReader


def one(spark, left, right, **kw):
    return comparing.compare("q", left, right, **kw).first()


def text(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def test_equal_answers_of_different_types_compare_equal(spark):
    left = spark.sql(
        "select timestamp'2026-10-01 05:30:00.123456+05:30' t, cast('12.50' as binary) b, 7L i, 0.1D + 0.2D f, cast(null as int) n, true z"
    )
    right = spark.sql("select timestamp_ntz'2026-10-01 00:00:00.123456' t, 12.5D b, 7 i, 0.3D f, cast(null as string) n, 1S z")
    assert one(spark, left, right)["match"]


def test_bags_and_orders(spark):
    xy, yx, x = text(spark, "x", "y"), text(spark, "y", "x"), text(spark, "x")
    assert one(spark, xy, yx)["match"]
    left = spark.createDataFrame([("x", 1), ("y", 2)], "x string, k int")
    right = spark.createDataFrame([("x", 2), ("y", 1)], "x string, k int")
    by_k = comparing.compare("q", left.select("x", "k"), right.select("x", "k"), order=["k"]).first()
    assert not by_k["match"] and by_k["first_different_row"] == 0
    short = one(spark, xy, x)
    assert (short["match"], short["left_rows"], short["right_rows"], short["first_different_row"]) == (False, 2, 1, -1)
    assert short["detail"] == "row counts differ: left 2, right 1"
    short = one(spark, xy, x, order=["x"])
    assert (short["match"], short["left_rows"], short["right_rows"], short["first_different_row"]) == (False, 2, 1, -1)
    assert not one(spark, text(spark, "x", "x", "y"), text(spark, "x", "y", "y"))["match"]


def test_first_difference(spark):
    left = spark.createDataFrame([(1, "a")], "n long, x string")
    right = spark.createDataFrame([(2, "a")], "n int, x string")
    got = one(spark, left, right)
    assert got["first_different_row"] == 0 and got["detail"].startswith("left [1.00000000e+00, a] vs right [2.0")


def test_null_is_not_the_text_null(spark):
    assert not one(spark, text(spark, None), text(spark, "NULL"))["match"]
    assert one(spark, text(spark, None), spark.createDataFrame([(None,)], "x int"))["match"]


def test_numbers(spark):
    same = lambda a, b, **kw: one(spark, spark.sql(f"select {a} v"), spark.sql(f"select {b} v"), **kw)["match"]
    assert same("'1.2.3'", "'1.2.3'") and not same("'1.2.3'", "1.2D")
    assert same("'1e3'", "1000") and not same("'1d'", "1") and not same("''", "0")
    assert same("0.0D", "-0.0D") and same("double('NaN')", "float('NaN')")
    assert same("12345678901L", "12345678902L") and not same("12345678901L", "12345678902L", digits=None)
    assert same("12.50BD", "12.5D")


@pytest.mark.parametrize("seed", range(3))
def test_shuffled_rows_match_and_a_dropped_row_never_does(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(5), r.choice(["a", "b", None])) for _ in range(40)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    dropped = shuffled[:-1]
    make = lambda x: spark.createDataFrame(x, "n int, x string")
    assert one(spark, make(rows), make(shuffled))["match"]
    assert not one(spark, make(rows), make(dropped))["match"]
    assert comparing.bag_difference(make(rows), make(dropped)).count() == 1


def test_bag_comparison_reports_what_sorting_would(spark):
    r = random.Random(9)
    for _ in range(6):
        a = sorted(r.choice("abcde") for _ in range(r.randrange(1, 9)))
        b = sorted(r.choice("abcde") for _ in range(r.randrange(1, 9)))
        first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), -1)
        got = one(spark, text(spark, *a), text(spark, *b))
        assert (got["match"], got["first_different_row"]) == (a == b, first)


def test_modes_route_reads(spark):
    pair = QueryPair("q", lambda s: text(s, "left"), lambda s: text(s, "right"))
    for mode, want in (("left_only", "left"), ("right_only", "right"), ("shadow_read", "left")):
        reader = ShadowReader(spark, mode, rate=-1)
        assert reader.read(pair).first()["x"] == want
        assert reader.comparisons().count() == 0 and reader.reads == 1


def test_shadow_never_changes_the_answer(spark):
    seen = []
    reader = ShadowReader(spark, "shadow_read", rate=1, on_mismatch=seen.append)
    differs = QueryPair("dau", lambda s: s.sql("select 1L n, 'a' x"), lambda s: s.sql("select 2 n, 'a' x"))
    same = QueryPair("same", lambda s: text(s, "x"), lambda s: text(s, "x"))

    def down(s):
        raise RuntimeError("right side down")

    fails = QueryPair("down", lambda s: text(s, "x"), down)
    assert reader.read(differs).first()["n"] == 1
    assert reader.read(same).count() == 1 and reader.read(fails).count() == 1
    stats = comparing.shadow_stats(reader.comparisons()).first()
    assert (stats["shadowed"], stats["matches"], stats["mismatches"], stats["errors"]) == (3, 1, 1, 1)
    assert [(m.query, m.first_different_row) for m in seen] == [("dau", 0)]


def test_slow_right_side_is_cut_off_and_counted(spark):
    def slow(s):
        @F.udf("long")
        def wait(x):
            time.sleep(0.05)
            return x

        return s.range(0, 4000, 1, 4).select(wait("id").alias("id"))

    reader = ShadowReader(spark, "shadow_read", rate=1, timeout=3)
    t0 = time.time()
    reader.read(QueryPair("slow", lambda s: s.range(1), slow))
    row = reader.comparisons().first()
    assert row["error"] and row["match"] is None and time.time() - t0 < 40


def test_sample_is_repeatable(spark):
    df = spark.range(20_000)
    a = comparing.sampled(df, "id", 0).count()
    assert 800 < a < 1200 and a == comparing.sampled(df, "id", 0.05).count()
    assert comparing.sampled(df, "id", -1).count() == 0 and comparing.sampled(df, "id", 1).count() == 20_000


def test_decimal_text(spark):
    left = spark.createDataFrame([(Decimal("3.140000000"),)], "v decimal(20,9)")
    assert one(spark, left, text(spark, "3.14"))["match"]


def test_marks_inside_texts_never_look_like_borders_or_nulls(spark):
    pair = lambda rows: spark.createDataFrame(rows, "a string, b string")
    for left, right in (([("a\x1fb", "c")], [("a", "b\x1fc")]), ([(None, "x")], [("\x00", "x")]), ([("\x10s", "x")], [("\x1f", "x")])):
        assert comparing.compare("q", pair(left), pair(right)).first()["match"] is False
        assert comparing.compare("q", pair(left), pair(left)).first()["match"] is True
