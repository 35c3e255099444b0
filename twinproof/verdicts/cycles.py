"""Repeated verification: one check record per cycle, variant, replica and table, and what follows from them."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from twinproof.functions.names import MATCH_TIMEOUT_SECONDS
from twinproof.functions.terms import Term
from twinproof.operators.reconcile import fingerprint
from twinproof.sources.logs import CHECKS


def fingerprints(live: Mapping[tuple[str, ...], DataFrame], terms: Mapping[str, Sequence[Term]], names: Sequence[str]) -> DataFrame:
    """Fingerprints of many live tables as rows; keys of ``live`` are tuples named by ``names``, the last being the table."""
    parts = []
    for key, df in live.items():
        one = fingerprint(df, terms[key[-1]])
        parts.append(one.select(*[F.lit(v).alias(n) for n, v in zip(names, key)], "fingerprint"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def verify_cycle(
    cycle: int,
    source: Callable[[], Mapping[str, DataFrame]],
    targets: Callable[[], Mapping[tuple[str, str, str], DataFrame]],
    terms: Mapping[str, Sequence[Term]],
    timeout: float = MATCH_TIMEOUT_SECONDS,
    poll: float = 5.0,
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Compare the source's fingerprints with every target until all agree or the time is up; one record each.

    ``source`` and ``targets`` give the live tables anew on every attempt (targets keyed by variant, replica, table).
    Each attempt is one Spark job over all targets that do not agree yet; only fingerprints reach the driver. A target
    that fails is recorded with its error and an empty fingerprint.
    """
    began = clock()
    live = source()
    spark = next(iter(live.values())).sparkSession
    rows = fingerprints({(t,): df for t, df in live.items()}, terms, ["table"]).collect()  # one row per table
    want = {r["table"]: r["fingerprint"] for r in rows}
    open_ = set(targets())
    done: dict[tuple[str, str, str], tuple] = {}
    while open_:
        now = targets()
        got: dict[tuple[str, str, str], str] = {}
        errors: dict[tuple[str, str, str], str] = {}
        try:
            found = fingerprints({k: now[k] for k in sorted(open_)}, terms, ["variant", "replica", "table"]).collect()
            got = {(r["variant"], r["replica"], r["table"]): r["fingerprint"] for r in found}
        except Exception:  # noqa: BLE001 - find the failing target, keep the others
            for k in sorted(open_):
                try:
                    got[k] = fingerprints({k: now[k]}, terms, ["variant", "replica", "table"]).first()["fingerprint"]
                except Exception as e:  # noqa: BLE001
                    errors[k] = str(e).split("\n")[0]
        waited = clock() - began
        late = waited > timeout
        for k in list(open_):
            match = k not in errors and got.get(k) == want.get(k[2])
            if match or late:
                stamp = datetime.now(timezone.utc).replace(microsecond=0)
                done[k] = (stamp, cycle, *k, want.get(k[2]), got.get(k, ""), match, int(waited), errors.get(k))
                open_.discard(k)
        if open_:
            sleep(poll)
    return spark.createDataFrame([done[k] for k in sorted(done)], CHECKS)


def freshness_waits(attempts: DataFrame, keys: Sequence[str], timeout: int = MATCH_TIMEOUT_SECONDS) -> DataFrame:
    """From all comparison attempts of a cycle to its check record.

    ``attempts`` holds ``keys``, ``started`` and ``at`` (times), ``pg``, ``ch``, ``err``. The first equal attempt
    within the timeout counts; without one, the first attempt past it (or the last there is) is the recorded miss.
    Aggregates only.
    """
    waited = F.col("at").cast("timestamp").cast("bigint") - F.col("started").cast("timestamp").cast("bigint")
    equal = F.col("err").isNull() & (F.col("pg") == F.col("ch"))
    rows = attempts.withColumns({"_w": waited, "_equal": F.coalesce(equal, F.lit(False))})
    rows = rows.withColumn("_on_time", F.col("_w") <= timeout)
    record = F.struct(
        F.col("at").alias("ts"), "pg", F.when(F.col("err").isNull(), F.col("ch")).otherwise("").alias("ch"),
        F.col("_equal").alias("match"), F.col("_w").cast("int").alias("waited_s"), "err",
    )
    place = F.struct("_w", "at")
    best = rows.groupBy(*keys).agg(
        F.min_by(record, F.when(F.col("_equal") & F.col("_on_time"), place)).alias("hit"),
        F.min_by(record, F.when(~F.col("_on_time"), place)).alias("over"),
        F.max_by(record, place).alias("last"),
    )
    return best.select(*keys, F.coalesce("hit", "over", "last").alias("r")).select(*keys, "r.*")


def miss_class() -> Column:
    """``lag`` (a differing value), ``error`` (no value), ``memory`` (a memory-limit error) or NULL for a match."""
    failed = ~F.col("match") & (F.coalesce(F.col("ch"), F.lit("")) == "")
    memory = F.coalesce(F.col("err"), F.lit("")).rlike("241|MEMORY_LIMIT")
    return F.when(F.col("match"), None).when(failed & memory, "memory").when(failed, "error").otherwise("lag")


def summarise(checks: DataFrame) -> DataFrame:
    """Per variant: checks, mismatches, the first mismatch as a record, the last cycle."""
    place = F.struct("ts", "cycle", "replica", "table")
    return checks.groupBy("variant").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("match")).alias("mismatches"),
        F.min_by(F.struct(*checks.columns), F.when(~F.col("match"), place)).alias("first_mismatch"),
        F.max_by("cycle", place).alias("last_cycle"),
    )


def write_summary(checks: DataFrame, path: str) -> None:
    """Totals per variant as one small JSON file, rewritten after each cycle."""
    summarise(checks).coalesce(1).write.mode("overwrite").json(path)


def per_cycle(checks: DataFrame) -> DataFrame:
    """One row per cycle: first and last check, number of checks, exact ones, misses by kind. Everything a verdict
    needs besides waits follows from these rows, so the check log is aggregated once."""
    kind = miss_class()
    return checks.groupBy("cycle").agg(
        F.min("ts").cast("timestamp_ntz").alias("first_seen"),
        F.max("ts").cast("timestamp_ntz").alias("end"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if("match").alias("exact"),
        F.count_if(kind == "lag").alias("lag_misses"),
        F.count_if(kind.isin("error", "memory")).alias("query_errors"),
        F.count_if(kind == "memory").alias("memory_errors"),
        F.some(~F.col("match")).alias("missed"),
    )


def recovery_of(cycles: DataFrame) -> DataFrame:
    """Every cycle with a miss and whether the next cycle was exact; NULL while that cycle has not been checked.

    The next cycle is the next number: a missing number stays pending.
    """
    following = cycles.select((F.col("cycle") - 1).alias("cycle"), (~F.col("missed")).alias("recovered"))
    return cycles.where("missed").join(following, "cycle", "left").select("cycle", "recovered")


def miss_recovery(checks: DataFrame) -> DataFrame:
    return recovery_of(per_cycle(checks))


def insert_rate(checks: DataFrame, *by: str) -> DataFrame:
    """Source rows per second between the first and the last check; the row count leads each fingerprint."""
    rows = F.split("pg", r"\|")[0].cast("bigint")
    seen = checks.withColumns({"_rows": rows, "_s": F.col("ts").cast("timestamp").cast("bigint")})
    place = F.struct("ts", "cycle", "_rows")
    out = seen.groupBy(*by).agg(
        (F.max_by("_rows", place) - F.min_by("_rows", place)).alias("rows"),
        (F.max("_s") - F.min("_s")).alias("seconds"),
    )
    return out.withColumn("rate", F.col("rows") / F.greatest("seconds", F.lit(1)))
