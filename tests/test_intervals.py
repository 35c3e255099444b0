import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from twinproof.operators import intervals
from twinproof.verdicts import audit, soak

T0 = datetime(2026, 10, 5, 12)


def at(s):
    return T0 + timedelta(seconds=s)


def test_overlaps_equal_brute_force(spark):
    r = random.Random(1)
    spans = [(i, at(a), at(a + r.randrange(1, 4000))) for i, a in enumerate(r.randrange(50_000) for _ in range(120))]
    wins = [(at(a), at(a + r.randrange(1, 900)), r.choice("abc")) for a in (r.randrange(50_000) for _ in range(200))]
    # edges: a window that ends where a span begins, or begins where it ends, does not overlap
    spans += [(500, at(100_000), at(100_100))]
    wins += [(at(99_000), at(100_000), "before"), (at(100_100), at(100_200), "after"), (at(100_050), at(100_060), "in")]
    s = spark.createDataFrame(spans, "id int, beg timestamp_ntz, `end` timestamp_ntz")
    w = spark.createDataFrame(wins, "w_beg timestamp_ntz, w_end timestamp_ntz, label string")
    want = {i: sorted({n for a, b, n in wins if a < e and b > g}) for i, g, e in spans}
    for chunks in (None, 5):
        got = intervals.overlap_labels(s, w, ["id"], chunks=chunks)
        assert {x["id"]: x["labels"] for x in got.collect()} == want
    assert want[500] == ["in"]


def test_touching_windows_stay_apart_when_merged(spark):
    w = spark.createDataFrame(
        [(at(0), at(10), "a"), (at(5), at(20), "a"), (at(20), at(30), "a"), (at(6), at(7), "b")],
        "w_beg timestamp_ntz, w_end timestamp_ntz, label string",
    )
    got = intervals.merge_windows(w, "label", "w_beg", "w_end", chunks=3).collect()
    assert sorted((x["label"], x["w_beg"], x["w_end"]) for x in got) == [
        ("a", at(0), at(20)), ("a", at(20), at(30)), ("b", at(6), at(7))
    ]


def test_outages_end_with_the_next_start_of_their_service(spark):
    acts = [(at(0), "stop", "x"), (at(5), "start", "y"), (at(9), "start", "x"), (at(20), "stop", "x"), (at(30), "restart", "y")]
    df = spark.createDataFrame(acts, "ts timestamp_ntz, action string, service string")
    got = {(x["w_beg"], x["w_end"], x["label"]) for x in soak.fault_windows(df, chunks=3).collect()}
    assert got == {
        (at(0), at(9 + 120), "outage x"), (at(20), at(20 + 600 + 120), "outage x"), (at(30), at(30 + 120), "restart y")
    }


def test_existence_bounds_are_inclusive(spark):
    log = spark.createDataFrame([(at(0), "up", "x"), (at(60), "stop", "x")], "ts timestamp_ntz, kind string, service string")
    acts = [
        (at(-180), "restart", "x"), (at(0), "restart", "x"), (at(1), "restart", "x"), (at(5), "start", "x"), (at(6), "start", "x"),
        (at(0), "stop", "x"), (at(65), "stop", "x"), (at(66), "stop", "x"), (at(-1), "stop", "x"), (at(0), "stop", "y"),
    ]
    df = spark.createDataFrame(acts, "ts timestamp_ntz, action string, service string")
    got = {(x["ts"], x["action"], x["service"]) for x in audit.verify_actions(df, log).where("verified").collect()}
    assert got == {
        (at(-180), "restart", "x"), (at(0), "restart", "x"), (at(5), "start", "x"), (at(0), "stop", "x"), (at(65), "stop", "x")
    }


def schedule_by_loop(faults, start, last, every, tolerance):
    """The schedule as a person would walk it: one due time after the other."""
    scheduled, missing, due = 0, [], start + every
    for t, done in faults:
        while due <= last and t - due > tolerance:
            missing.append(due)
            scheduled += 1
            due += every
        if due > last:
            break
        scheduled += 1
        due = done + every
    while due <= last:
        missing.append(due)
        scheduled += 1
        due += every
    return scheduled, missing


def test_missing_ticks_equal_walking_the_schedule(spark):
    r = random.Random(3)
    for _ in range(12):
        t, faults = 0, []
        for _ in range(r.randrange(0, 9)):
            t += r.choice([2300, 2400, 2450, 2521, 5000, 7300, 100])
            done = t + r.choice([0, 0, 600])
            faults.append((t, done))
            t = done
        last = r.randrange(0, 30_000)
        df = spark.createDataFrame(faults, "t long, done long")
        gaps = intervals.schedule_gaps(df, F.lit(0), F.lit(last), chunks=3)
        want = schedule_by_loop(faults, 0, last, 2400, 120)
        got = gaps.agg(F.sum("missing") + F.count_if("closing_fault_due")).first()[0]
        assert got == want[0]
        assert sorted(x["due"] for x in intervals.missing_ticks(gaps).collect()) == want[1]
