import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from twinproof.functions.names import DELETED, VERSION
from twinproof.functions.terms import comparable_terms
from twinproof.registry import derived
from twinproof.sources import logs, tables
from tests.conftest import plan_of
from twinproof.verdicts import audit, benchtable, claims as claiming, cycles, soak

# Known run: per cycle the time of its last check and the seconds waited; both tables of a cycle agree unless noted.
RUN = """
17:41:09 5, 17:51:15 5, 18:01:20 5, 18:11:26 5, 18:21:33 5, 18:31:39 5, 18:41:46 5, 18:51:53 5, 19:01:59 5, 19:12:10 10,
19:22:17 5, 19:37:19 300, 19:47:29 10, 19:57:36 5, 20:07:42 5, 20:17:48 5, 20:28:00 10, 20:38:06 5, 20:48:13 5, 20:58:19 5,
21:08:30 10, 21:18:38 5, 21:28:44 5, 21:38:50 5, 21:48:57 5, 22:00:05 67, 22:10:11 5, 22:20:20 5, 22:35:25 303, 22:45:37 10,
22:55:50 10, 23:05:57 5, 23:20:17 256, 23:30:25 5, 23:40:31 5
"""
FAULT_LOG = """
2026-10-05T17:32:09Z chaos start, until epoch 1791243035
2026-10-05T18:12:09Z restart ch1 (a)
2026-10-05T18:52:16Z restart flow-worker (b)
2026-10-05T19:32:27Z stop ch1 (a)
2026-10-05T19:42:35Z start ch1 (a)
2026-10-05T20:22:35Z restart source (c)
2026-10-05T21:02:45Z restart ch1 (a)
2026-10-05T21:42:51Z restart flow-worker (b)
2026-10-05T22:23:03Z stop ch1 (a)
2026-10-05T22:33:10Z start ch1 (a)
2026-10-05T23:13:11Z restart source (c)
"""


@pytest.fixture(scope="module")
def checks(spark):
    rows = []
    for n, part in enumerate(RUN.replace("\n", " ").strip().split(", "), 1):
        clock, waited = part.split()
        ts = datetime.fromisoformat(f"2026-10-05 {clock}")
        error, lag = n == 12, n == 29
        for table in ("events", "sessions"):
            count = f"{n * 1000}|1"
            ch = "" if error else "9|1" if lag else count
            err = "no such host" if error else None
            rows.append((ts, n, "single", "r1", table, count, ch, not (error or lag), int(waited), err))
    return spark.createDataFrame(rows, logs.CHECKS)


@pytest.fixture(scope="module")
def fault_text(spark):
    return spark.createDataFrame([(x,) for x in FAULT_LOG.strip().split("\n")], "value string")


@pytest.mark.parametrize("chunks", [None, 4])
def test_known_run_gives_the_known_verdict(checks, fault_text, chunks):
    v = soak.soak_verdict(checks, logs.parse_faults(fault_text), chunks=chunks)
    s = v.stats.first()
    assert (s["cycles"], s["checks"], s["exact"], s["lag_misses"], s["query_errors"], s["memory_errors"]) == (35, 70, 66, 2, 2, 0)
    assert (s["clean"], s["affected"], s["clean_misses"], s["final_exact"]) == (26, 9, 0, True)
    assert (s["p50"], s["p99"], s["max"]) == (5, 67, 67) and round(s["hours"], 1) == 6.0
    assert {r["cycle"]: r["recovered"] for r in v.recovery.collect()} == {12: True, 29: True}
    labels = {r["cycle"]: r["labels"] for r in v.cycles.where("missed").collect()}
    assert labels == {12: ["outage ch1"], 29: ["outage ch1"]}
    assert [(r["no"], r["ok"]) for r in v.criteria.collect()] == [(i, True) for i in (*range(1, 9), 99)]


def test_verdict_can_fail(checks, fault_text):
    faults = logs.parse_faults(fault_text)
    # Without its faults the run's misses happen in clean cycles.
    v = soak.soak_verdict(checks, faults.limit(0), audit_ok=False, chunks=4)
    failed = [r["no"] for r in v.criteria.where("not ok").collect()]
    assert failed == [2, 6, 7, 99]
    # A miss in the last cycle has no next cycle: a failure here, pending in the tally.
    cut = checks.where("cycle <= 29")
    assert 4 in [r["no"] for r in soak.soak_verdict(cut, faults).criteria.where("not ok").collect()]
    assert 4 not in [r["no"] for r in soak.soak_verdict(cut, faults, pending_fails=False).criteria.where("not ok").collect()]
    assert soak.integrity(cycles.miss_recovery(cut)).first()["integrity"] == "PENDING"


def test_known_run_audit(spark, checks, fault_text):
    faults = logs.parse_faults(fault_text)
    lines = [
        ("ch1", "2026.10.05 18:12:17.781068 [ 7 ] Application: Starting server 1"), ("flow-worker", '2026-10-05T18:52:20Z "Started Worker"'),
        ("ch1", "2026.10.05 19:32:27.864703 [ 76 ] Application: Received termination signal (Terminated)"),
        ("ch1", "2026.10.05 19:42:40 Starting server 1"), ("source", "2026-10-05 20:22:40 database system is ready to accept connections"),
        ("ch1", "2026.10.05 21:02:50 Starting server 1"), ("flow-worker", '2026-10-05T21:42:55Z "Started Worker"'),
        ("ch1", "2026.10.05 22:23:03 Received termination signal"), ("ch1", "2026.10.05 22:33:20 Starting server 1"),
        ("source", "2026-10-05 23:13:15 database system is ready to accept connections"), ("source", "no time here, Starting server"),
    ]
    server = logs.parse_server_log(spark.createDataFrame(lines, "service string, value string"))
    none = logs.parse_skips(fault_text)
    a = audit.fault_audit(faults, logs.parse_run_bounds(fault_text), none, server, checks)
    s = a.summary.first()
    assert (s["scheduled"], s["applied"], s["logged"], s["verified"], s["skipped"], s["missing"], s["ok"]) == (8, 8, 10, 10, 0, 0, True)
    # One fault taken out of the log was due and is missing; one server line taken out leaves an action unverified.
    gone = faults.where("not (ts = timestamp_ntz'2026-10-05 20:22:35')")
    b = audit.fault_audit(gone, logs.parse_run_bounds(fault_text), none, server, checks)
    assert b.missing.count() == 1 and not b.summary.first()["ok"]
    c = audit.fault_audit(faults, logs.parse_run_bounds(fault_text), none, server.where("kind = 'up'"), checks)
    assert c.summary.first()["verified"] == 8 and not c.summary.first()["ok"]


def test_confirm_criteria(checks, fault_text):
    t = soak.confirm_tally(checks, logs.parse_fault_counts(fault_text))
    assert {r["no"]: r["ok"] for r in t.criteria.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 99: False}
    assert {r["act"]: r["n"] for r in t.faults.collect()}["stop ch1"] == 2
    assert t.stats.first()["rate"] == pytest.approx(34_000 / 21_562)


def test_tally_labels_windows(checks):
    w = soak.Windows(excluded=[("2026-10-05 19:30:00", "2026-10-05 19:40:00")], contention=[("2026-10-05 22:30:00", "2026-10-05 22:40:00")])
    got = {(r["window"], r["counter"]): r["n"] for r in soak.tally_by_window(checks, w).collect()}
    assert got[("excluded", "query_error")] == 2 and got[("contention", "lag_miss")] == 2 and got[("contention", "miss_cycles_29")] == 2
    assert got[("valid", "checks")] == 66 and ("valid", "lag_miss") not in got
    hours = soak.valid_hours(checks, "2026-10-05 17:40:31", w).first()
    assert hours["valid_hours"] == pytest.approx(6 - 1 / 6) and hours["contention_hours"] == pytest.approx(1 / 6)


def test_logs_survive_noise(spark, tmp_path):
    path = str(tmp_path / "checks")
    good = '{"ts":"2026-10-05T17:41:09Z","cycle":1,"variant":"s","replica":"r","table":"t","pg":"1","ch":"1","match":true,"waited_s":5}'
    spark.createDataFrame([(good,), ("{broken",), (good.replace('"cycle":1', '"cycle":2'),)], "value string").write.text(path)
    got = logs.read_checks(spark, path).orderBy("cycle").collect()
    assert [r["cycle"] for r in got] == [1, 2] and got[0]["err"] is None
    logs.append_checks(logs.read_checks(spark, path), str(tmp_path / "again"))
    logs.append_checks(logs.read_checks(spark, path), str(tmp_path / "again"))
    assert logs.read_checks(spark, str(tmp_path / "again")).count() == 4
    cycles.write_summary(logs.read_checks(spark, path), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first()["checks"] == 2
    ticks = spark.createDataFrame(
        [("2026-10-05 20:00:00 CEST tick load=1.5 x=1 agent_cpu_psi_avg10=7.00 nr_throttled=3 throttled_usec=99",), ("other",)], "value string")
    row = logs.parse_ticks(ticks).first()
    assert (str(row["ts"]), row["load"], row["throttled_usec"]) == ("2026-10-05 18:00:00", 1.5, 99)


def test_tab_separated_results(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([("2024-01-01", 3), ("2024-01-02", 4)], "d string, n long")
    tables.write_tab_separated(df, path)
    spark.createDataFrame([("no tab here",)], "value string").write.mode("append").text(path)
    assert tables.read_tab_separated(spark, path, "d string, n long").count() == 2
    spark.createDataFrame([("2024-01-03\tmany",)], "value string").write.mode("append").text(path)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_tab_separated(spark, path, "d string, n long").collect()


def test_verify_cycle_waits_for_equality_and_records_errors(spark):
    schema = f"id long, {VERSION} long, {DELETED} boolean"
    good = spark.createDataFrame([(1, 0, False)], schema)
    terms = {"events": comparable_terms(good.schema)}
    calls, now = [], [0.0]

    def targets():
        calls.append(1)
        late = good if len(calls) > 2 else good.limit(0)
        broken = good.select("id", VERSION, F.assert_true(F.lit(False)).cast("boolean").alias(DELETED))
        return {("v", "r1", "events"): good, ("v", "r2", "events"): late, ("v", "r3", "events"): broken}

    def sleep(s):
        now[0] += s

    got = {
        r["replica"]: r
        for r in cycles.verify_cycle(7, lambda: {"events": good}, targets, terms, timeout=20, poll=5, clock=lambda: now[0], sleep=sleep).collect()
    }
    assert got["r1"]["match"] and got["r1"]["waited_s"] == 0
    assert got["r2"]["match"] and got["r2"]["waited_s"] in (5, 10)
    assert not got["r3"]["match"] and got["r3"]["ch"] == "" and got["r3"]["err"] and got["r3"]["waited_s"] == 25


def test_medians_speedups_and_stale_medians(spark):
    r = random.Random(1)
    rows = [(q, s, i, float(r.randrange(1, 1000))) for q in ("x", "y") for s in ("a", "b") for i in range(5)]
    samples = spark.createDataFrame(rows, "query string, store string, run int, ms double")
    med = {(q, s): sorted(x[3] for x in rows if x[:2] == (q, s))[2] for q in ("x", "y") for s in ("a", "b")}
    assert {(x["query"], x["store"]): x["median_ms"] for x in benchtable.medians(samples).collect()} == med
    up = benchtable.speedups(samples, "a").first()
    ratios = [med[(q, "a")] / med[(q, "b")] for q in ("x", "y")]
    assert (up["low"], up["high"]) == (pytest.approx(min(ratios)), pytest.approx(max(ratios)))
    stored = spark.createDataFrame([(q, s, v + (q == "x" and s == "b")) for (q, s), v in med.items()], "query string, store string, median_ms double")
    assert [(x["query"], x["store"]) for x in benchtable.stale_medians(samples, stored).collect()] == [("x", "b")]


def test_a_document_equal_to_its_evidence_has_no_problem(spark):
    samples = spark.createDataFrame(
        [("daily", s, i, v) for s, v in (("pg", 5388.0), ("ch", 107.0)) for i in range(3)], "query string, store string, run int, ms double")
    counts = spark.createDataFrame([("daily", "pg", 30), ("daily", "ch", 30)], "query string, store string, n long")
    doc = ["Copied **14,000,000 rows** on 2026-10-03.", "| Daily | 5,388 | 107 |", "Speed-up 50.4× to 50.4× in 2026."]
    claim_lines = ["# comment", "", "14,000,000 rows\trun.log\tnode-a \\d+000000 && done$"]
    lines = spark.createDataFrame([("run.log", "node-a 14000000"), ("run.log", "all done")], "log string, value string")

    def problems(document=doc, evidence=lines, sizes=counts):
        text = lambda x: spark.createDataFrame([(v,) for v in x], "value string")
        out = claiming.verify_claims(
            text(document), logs.parse_claims(text(claim_lines)), evidence, samples, ["pg", "ch"], "pg", sizes, ignore=["2026"])
        return sorted({r["check"] for r in out.collect()})

    assert problems() == []
    assert problems(document=[*doc, "and 1,234 more"]) == ["figure not covered"]
    assert problems(document=doc[:2]) == ["bench figure missing or different"]
    assert problems(document=doc[1:]) == ["claim not in document"]
    assert problems(evidence=lines.limit(1)) == ["no line matches"]
    assert problems(sizes=counts.withColumn("n", F.when(F.col("store") == "ch", 31).otherwise(30))) == ["row counts differ"]


def test_pattern_lists_of_any_length(spark):
    lines = spark.createDataFrame([("l1", f"row {i} of a") for i in range(50)] + [("l2", "row 1 of b")], "log string, value string")
    patterns = spark.createDataFrame(
        [(log, f"^row {i} of {x}$") for log in ("l1", "l2", "l3") for i in range(0, 90, 3) for x in "ab"], "log string, pattern string")
    key = lambda df: sorted(map(tuple, df.select("log", "pattern").collect()))
    some = patterns.where("pattern like '%of a$'").limit(60)
    assert key(claiming.matched_patterns(lines, some)) == key(claiming.matched_patterns(lines, some, per_row=1))
    assert len(key(claiming.matched_patterns(lines, patterns))) == 17


def test_blocks_of_lines_take_one_pattern_after_the_other(spark):
    """Every line compiled every pattern anew; a block compiles each once and leaves it at the first match."""
    lines = spark.createDataFrame([("l", f"row {i % 40}") for i in range(400)] + [("l", None), (None, "row 1"), ("empty", None)], "log string, value string")
    patterns = spark.createDataFrame([(log, p) for log in ("l", "empty", "none") for p in ("^row 3$", "^row 39", "^row 40", "", "w 1.$")] + [("l", None)], "log string, pattern string")
    for size in (1, 7, 1000):
        got = claiming.matched_patterns(lines, patterns, per_block=size)
        assert sorted(map(tuple, got.collect())) == [("l", ""), ("l", "^row 3$"), ("l", "^row 39"), ("l", "w 1.$")]
    assert "exists(values" in plan_of(got) and "RLIKE" not in plan_of(got).upper()


def test_derived_checks_grow_with_their_table(events):
    assert derived.checks(events).count() == events.count()


def test_malformed_checks_are_dropped_whatever_is_read(spark, tmp_path):
    good = '{"ts":"2026-01-01T00:00:00Z","cycle":1,"variant":"v","replica":"r","table":"t","pg":"1","ch":"1","match":true,"waited_s":5}'
    (tmp_path / "c.json").write_text(good + "\n" + good.replace(":5}", ':"abc"}') + "\nnot json\n")
    checks = logs.read_checks(spark, str(tmp_path / "c.json"))
    assert checks.count() == checks.select("cycle").count() == len(checks.collect()) == 1
    assert logs.parse_checks(spark.read.text(str(tmp_path / "c.json"))).count() == 1
