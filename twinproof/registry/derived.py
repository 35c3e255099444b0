"""Run logs derived from an event table: the same shapes a long replication run leaves behind, one line per event.

They let every log operator run over data of any size. Event *i* stands for second ``30 * i`` of the run, so longer
tables mean longer runs at the same density of checks and faults. Text logs are rendered as text and parsed back by
the readers in ``logs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STEP_SECONDS = 30
CHECKS_PER_CYCLE = 20
START = "2024-01-01 00:00:00"


def run_time(shift: str = "0") -> Column:
    """Time of an event in the run, plus whole seconds."""
    seconds = F.expr(f"event_id * {STEP_SECONDS} + ({shift})")
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + seconds).cast("timestamp_ntz")


def _stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def checks(events: DataFrame) -> DataFrame:
    """Check records: 20 per cycle over three variants and two replicas, with lag misses, query errors, memory errors."""
    error, lag = F.col("event_id") % 97 == 0, F.col("event_id") % 61 == 5
    source = F.format_string("%d|%d|%d", F.col("event_id") * 10, F.col("user_id"), F.octet_length("props"))
    stale = F.format_string("%d|%d|%d", F.col("event_id") * 10 - 1, F.col("user_id"), F.octet_length("props"))
    return events.select(
        run_time().alias("ts"),
        F.expr(f"cast(event_id div {CHECKS_PER_CYCLE} as int)").alias("cycle"),
        F.element_at(F.array(F.lit("plain"), F.lit("sharded"), F.lit("local")), (F.col("user_id") % 3 + 1).cast("int")).alias("variant"),
        F.concat(F.lit("r"), (F.col("event_id") % 2 + 1).cast("string")).alias("replica"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "events").otherwise("sessions").alias("table"),
        source.alias("pg"),
        F.when(error, "").when(lag, stale).otherwise(source).alias("ch"),
        (~error & ~lag).alias("match"),
        (F.floor(F.col("value")) % 300).cast("int").alias("waited_s"),
        F.when(error & (F.col("event_id") % 2 == 0), "code: 241, MEMORY_LIMIT_EXCEEDED")
        .when(error, "dial tcp: no such host").alias("err"),
    )


def check_lines(events: DataFrame) -> DataFrame:
    """The check records as JSON lines, with one broken line for every event of type ``error``."""
    c = checks(events)
    stamped = c.withColumn("ts", _stamp(F.col("ts")))
    good = stamped.select(F.to_json(F.struct(*stamped.columns)).alias("value"))
    broken = events.where(F.col("event_type") == "error").select(F.concat(F.lit('{"ts": "'), F.col("event_id").cast("string")).alias("value"))
    return good.unionByName(broken)


def service() -> Column:
    return F.concat(F.lit("node-"), (F.col("user_id") % 7).cast("string"))


def fault_lines(events: DataFrame) -> DataFrame:
    """The fault injector's log: restarts, outages with their later start, skipped faults, and chatter."""
    t0 = _stamp(run_time())
    back = _stamp(run_time("180 + user_id % 240"))
    big = F.col("value") >= 150
    tail = F.concat(service(), F.lit(" ("), F.lower(F.hex("event_id")), F.lit(")"))
    stop = F.array(F.concat(t0, F.lit(" stop "), tail), F.concat(back, F.lit(" start "), tail))
    restart = F.array(F.concat(t0, F.lit(" restart "), tail))
    skipped = F.array(F.concat(t0, F.lit(" skip fault "), F.col("event_id").cast("string"), F.lit(": paused by guard")))
    chatter = F.array(F.concat(t0, F.lit(" chaos heartbeat "), F.col("event_id").cast("string")))
    line = (
        F.when(big & F.col("event_type").isin("error", "purchase"), stop)
        .when(big & F.col("event_type").isin("signup", "click"), restart)
        .when(big, skipped)
        .otherwise(chatter)
    )
    return events.select(F.explode(line).alias("value"))


def server_lines(events: DataFrame) -> DataFrame:
    """Server logs ``(service, value)``: what the faulted servers wrote, some of it too late to count."""
    late = "user_id % 90 * 3"
    dotted = lambda t: F.date_format(t, "yyyy.MM.dd HH:mm:ss'.000000'")
    down = F.concat(dotted(run_time("user_id % 70")), F.lit(" [ 7 ] Application: Received termination signal."))
    boot = F.concat(dotted(run_time(late)), F.lit(" [ 7 ] Application: Starting server 1.0"))
    again = F.concat(dotted(run_time("180 + user_id % 240 + 20")), F.lit(" [ 7 ] Application: Starting server 1.0"))
    other = F.concat(dotted(run_time()), F.lit(" [ 9 ] Query ok"))
    big = F.col("value") >= 150
    line = (
        F.when(big & F.col("event_type").isin("error", "purchase"), F.array(down, again))
        .when(big & F.col("event_type").isin("signup", "click"), F.array(boot))
        .otherwise(F.array(other))
    )
    return events.select(service().alias("service"), F.explode(line).alias("value"))


def tick_lines(events: DataFrame) -> DataFrame:
    """Host monitor lines in local summer time with a growing throttle counter."""
    local = F.date_format(run_time("7200"), "yyyy-MM-dd HH:mm:ss")
    return events.select(
        F.concat(
            local, F.lit(" CEST tick load="), F.round("value", 2).cast("string"),
            F.lit(" procs=3 agent_cpu_psi_avg10="), (F.col("user_id") % 100).cast("string"), F.lit(".5"),
            F.lit(" nr_throttled="), F.col("event_id").cast("string"),
            F.lit(" throttled_usec="), (F.col("event_id") * 1500).cast("string"),
        ).alias("value")
    )


def core_lines(events: DataFrame) -> DataFrame:
    """Core-use lines."""
    return events.select(
        F.concat(
            _stamp(run_time()), F.lit(" load1="), F.round("value", 2).cast("string"), F.lit(" mem_avail_gb=8.1"),
            F.lit(" cpu6="), (F.floor("value") % 101).cast("string"), F.lit("% cpu7="), (F.col("user_id") % 101).cast("string"), F.lit("%"),
        ).alias("value")
    )


def event_lines(events: DataFrame) -> DataFrame:
    """A readable log per event type: ``(log, value)``."""
    text = F.concat(
        F.lit("event "), F.col("event_id").cast("string"), F.lit(" user "), F.col("user_id").cast("string"),
        F.lit(" props "), F.col("props"),
    )
    return events.select(F.concat("event_type", F.lit(".log")).alias("log"), text.alias("value"))


def bench_documents(events: DataFrame) -> DataFrame:
    """Bench documents, one JSON line per day: per event type five timings on three stores and their row counts."""
    day = F.to_date("ts")
    runs = lambda factor: F.concat(
        F.lit("["), F.concat_ws(",", *[(F.col("n") * factor + i * 3).cast("string") for i in (4, 0, 2, 1, 3)]), F.lit("]")
    )
    counts = events.groupBy(day.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    result = F.concat(
        F.lit('{"query":"'), "event_type", F.lit('","runs":{"a":'), runs(20), F.lit(',"b":'), runs(5), F.lit(',"c":'), runs(2),
        F.lit('},"result_rows":{"a":'), F.col("n").cast("string"), F.lit(',"b":'),
        (F.col("n") + F.when(F.col("n") % 10 == 0, 1).otherwise(0)).cast("string"), F.lit("}}"),
    )
    # A day's document holds one entry per event type.
    docs = counts.select("day", result.alias("r")).groupBy("day").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return docs.select("day", F.concat(F.lit('{"results":['), F.array_join("rs", ","), F.lit("]}")).alias("value"))
