from datetime import datetime, timedelta

from pyspark.sql import functions as F

from twinproof.operators import fold, reconcile, series
from twinproof.session import pinned, scratch, shared_dir
from twinproof.sources import feed
from twinproof.streaming import gate, ingest, windows


def finish(query):
    query.awaitTermination()


def test_state_keeps_the_newest_version_per_key(spark, events, tmp_path):
    log = feed.event_log(events).select("event_id", "value", "_version", "_is_deleted")
    source = str(tmp_path / "in")
    log.repartition(4).write.parquet(source)
    stream = ingest.read_changes(spark, source, log.schema, files_per_trigger=1)
    finish(ingest.upsert_into_memory(stream, ["event_id"], "state_now", str(tmp_path / "cp")))
    got = ingest.live(spark.table("state_now"))
    want = fold.fold(log, ["event_id"])
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_settled_windows_equal_the_batch(spark, events, tmp_path):
    source = str(tmp_path / "in")
    events.repartitionByRange(3, "ts").write.parquet(source)
    stream = ingest.read_changes(spark, source, events.schema)
    out = str(tmp_path / "days")
    finish(windows.write_settled(windows.daily_counts(stream, "ts"), out, str(tmp_path / "cp")))
    got = {(str(r["day"]), r["n"]) for r in spark.read.parquet(out).collect()}
    batch = {(r["day"], r["n"]) for r in reconcile.count_days(events, "ts").collect()}
    assert got < batch and len(batch) - len(got) == 2  # the two latest days may still change

    weeks = str(tmp_path / "weeks")
    finish(windows.write_settled(windows.weekly_counts(stream, "ts", "event_type"), weeks, str(tmp_path / "cpw")))
    assert {str(r["week"]) for r in spark.read.parquet(weeks).collect()} == {"2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"}


def test_sliding_windows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=m),) for m in (0, 1, 2, 40)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.parquet(source)
    stream = ingest.read_changes(spark, source, spark.read.parquet(source).schema)
    finish(windows.write_settled(windows.sliding_counts(stream, "ts"), out, str(tmp_path / "cp")))
    got = {r["until"]: r["n"] for r in spark.read.parquet(out).collect()}
    assert got[t0 + timedelta(minutes=3)] == 3 and got[t0 + timedelta(minutes=6)] == 2 and got[t0 + timedelta(minutes=1)] == 1


def test_streamed_gate_equals_the_batch_operator(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    polls = [("m", t0 + timedelta(seconds=30 * i), s == "R") for i, s in enumerate("RRPRRRRRRPRRRR")]
    polls += [("n", t0 + timedelta(seconds=30 * i), True) for i in range(14)]
    df = spark.createDataFrame(polls, "mirror string, at timestamp, running boolean")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cut = t0 + timedelta(seconds=30 * 6)
    df.where(F.col("at") < F.lit(cut)).coalesce(1).write.parquet(source)
    gate.use_state_store(spark)

    def run():
        stream = ingest.read_changes(spark, source, df.schema)
        finish(
            gate.running_since_stream(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )

    run()
    df.where(F.col("at") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(source)
    run()  # state survives between the two runs
    key = lambda d: sorted((r["mirror"], r["at"], str(r["running_since"]), r["ready"]) for r in d.collect())
    want = series.running_since(df, ["mirror"], ["at"], F.col("running"), chunks=3)
    assert key(spark.read.parquet(out)) == key(want)


def test_the_shared_folder_comes_from_the_session(spark):
    folder = shared_dir(spark)
    assert scratch(spark, "x").startswith(folder) and scratch(spark, "x") != scratch(spark, "x")
    kept = pinned(spark.range(10).withColumn("r", F.rand()))
    assert kept.collect() == kept.collect()
