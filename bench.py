"""Headline timings: one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the repeats."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from twinproof.operators import compare, fold, questions, reconcile  # noqa: E402
from twinproof.registry.base import ANCHOR, BY_TENANT  # noqa: E402
from twinproof.session import scratch, session  # noqa: E402
from twinproof.sources import feed, tables  # noqa: E402
from twinproof.streaming import ingest  # noqa: E402
from twinproof.verdicts import cycles, soak  # noqa: E402
from twinproof.registry import base  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    events = tables.read_table(spark, folder, "events")

    # The replica as it lies on storage: month folders, sorted by its sort key.
    path = scratch(spark, "bench-log")
    tables.write_version_log(feed.event_log(events), path, BY_TENANT.order_by, "ts")
    log = tables.read_version_log(spark, path)
    source = feed.events_after_changes(events)

    def asked(rows, name):
        if name == "dau_30d":
            return questions.daily_actives(questions.since(rows, "ts", ANCHOR, 30), "ts", "user_id")
        if name == "kind_per_week":
            return questions.kinds_per_week(rows, "ts", "event_type")
        if name == "top10_accounts":
            return questions.top_accounts(questions.since(rows, "ts", ANCHOR, 7), "user_id")
        return questions.p95_continuous(questions.since(rows, "ts", ANCHOR, 30), "event_type", "value")

    def live(name):
        carried = {"kind_per_week": ["event_type"], "p95_cont": ["event_type", "value"]}.get(name, [])
        return fold.fold(log, BY_TENANT.order_by, [*BY_TENANT.order_by, *carried])

    def finish(df):
        df.write.format("noop").mode("overwrite").save()

    def ingest_stream():
        stream = ingest.read_changes(spark, base.stream_path(folder, "events"), events.schema)
        target = scratch(spark, "bench-stream")
        ingest.ingest(feed.event_log(stream), target, scratch(spark, "bench-state"), ["event_id"]).awaitTermination()

    jobs = {}
    for name in ("dau_30d", "kind_per_week", "top10_accounts", "p95_cont"):
        jobs[f"{name}_final"] = lambda n=name: finish(asked(live(n), n))
        jobs[f"{name}_plain"] = lambda n=name: finish(asked(events, n))
    jobs["day_check"] = lambda: finish(reconcile.check_days(source, {"a": log, "b": log}, BY_TENANT, "2024-01-31"))
    jobs["bucket_checksums"] = lambda: finish(reconcile.check_buckets(source, {"a": log, "b": log}, BY_TENANT))
    jobs["snapshot_copy"] = lambda: tables.copy_snapshot(events, "event_id", scratch(spark, "bench-snapshot"))
    jobs["cdc_stream"] = ingest_stream
    jobs["compare_unordered"] = lambda: finish(
        compare.compare("live", source, fold.fold(log, BY_TENANT.order_by).select(*source.columns))
    )
    jobs["soak_verdict"] = lambda: finish(soak.soak_verdict(base.checks(spark, folder), base.faults(spark, folder)).criteria)
    jobs["variant_summary"] = lambda: finish(cycles.summarise(base.checks(spark, folder)))

    results = {}
    for name, job in jobs.items():
        samples = []
        for _ in range(runs + 1):  # the first run warms up
            t0 = time.perf_counter()
            job()
            samples.append(time.perf_counter() - t0)
        results[name] = round(median(samples[1:]), 4)
    print(json.dumps({
        "metric": "total of median seconds per query",
        "value": round(sum(results.values()), 4),
        "unit": "sec",
        "queries": results,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
