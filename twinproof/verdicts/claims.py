"""Check a document's figures against the logs and samples they come from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinproof.session import pinned

from .benchtable import medians, ratios

_NUMBER = r"\d{1,3}(?:,\d{3})+|\d{4,}"


def numbers_in(c: Column) -> Column:
    """Large numbers of a text (four digits or more, thousands separators removed)."""
    return F.transform(F.regexp_extract_all(c, F.lit(_NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))


def matched_patterns(lines: DataFrame, patterns: DataFrame, per_row: int = 50, per_block: int = 500) -> DataFrame:
    """The distinct ``(log, pattern)`` pairs for which some line of that log matches.

    ``lines(log, value)`` may be of any size; ``patterns(log, pattern)`` is a list people write and review. Patterns lie in
    arrays of about ``per_row``, each repeated for every salt. A log's lines are dealt into blocks of about ``per_block``, which meet the
    patterns on log and salt: a log that owns most lines is spread over all partitions. A block takes one pattern after the other, so a
    pattern is compiled once a block instead of once a line, and leaves it at the first line that matches. Matches only are emitted, never all pairs.
    """
    salts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = patterns.select("log", "pattern").distinct()
    size = F.greatest(F.ceil(F.count(F.lit(1)).over(Window.partitionBy("log")) / F.lit(per_row)), F.lit(1))
    packed = (
        wanted.withColumn("parts", size)
        .groupBy("log", F.pmod(F.xxhash64("pattern"), F.col("parts")).alias("part"))
        .agg(F.collect_list("pattern").alias("patterns"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    )
    # A row per log that patterns ask for, so lines of other logs go no further.
    blocks = lines.groupBy("log").agg(F.ceil(F.count("value") / F.lit(per_block)).alias("blocks"))
    blocks = blocks.join(wanted.select("log").distinct(), "log", "left_semi")
    # Equal lines match the same patterns; one of them is enough, so a line that repeats without end makes no large block.
    dealt = lines.select("log", "value").distinct().join(blocks, "log").where("blocks > 0")
    dealt = dealt.groupBy("log", F.pmod(F.xxhash64("value"), F.col("blocks")).alias("block")).agg(F.collect_list("value").alias("values"))
    # Unlike ``rlike``, ``regexp_instr`` keeps a pattern that is not a literal from one call to the next.
    some = lambda p: F.exists("values", lambda v: F.regexp_instr(v, p) > 0)
    hits = dealt.withColumn("salt", F.pmod(F.col("block"), F.lit(salts))).join(packed, ["log", "salt"]).select(
        "log", F.explode(F.filter("patterns", some)).alias("pattern")
    )
    return hits.distinct()


def unmatched_claims(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """``(claim, log, pattern)`` for every pattern that no line of its log matches."""
    asked = claims.select("claim", "log", F.explode("patterns").alias("pattern"))
    return asked.join(matched_patterns(lines, asked), ["log", "pattern"], "left_anti").select("claim", "log", "pattern")


def absent_claims(claims: DataFrame, document: DataFrame) -> DataFrame:
    """Claims whose text no line of the document holds verbatim."""
    asked = claims.select("claim", F.lit("doc").alias("log"), F.concat(F.lit(r"\Q"), F.replace("claim", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")).alias("pattern"))
    found = matched_patterns(document.select(F.lit("doc").alias("log"), "value"), asked)
    return asked.join(found, ["log", "pattern"], "left_anti").select("claim")


def uncovered_numbers(document: DataFrame, covered: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Large numbers of the document's lines (dates left out) that no covering text holds: ``EXCEPT`` over sets."""
    dates = r"\d{4}-\d{2}-\d{2}"
    said = document.select(F.explode(numbers_in(F.regexp_replace("value", dates, ""))).alias("number"))
    known = covered.select(F.explode(numbers_in(F.col("value"))).alias("number"))
    left = said.subtract(known)
    return left.where(~F.col("number").isin(list(ignore))) if ignore else left


def _grouped(c: Column) -> Column:
    return F.format_number(F.bround(c, 0), 0)


def bench_rows(middle: DataFrame, stores: Sequence[str]) -> DataFrame:
    """The table rows the medians ``(query, store, median_ms)`` give: ``| query | 5,388 | 266 | 107 |``."""
    m = middle.groupBy("query").pivot("store", list(stores)).agg(F.first("median_ms"))
    cells = [_grouped(F.col(s)) for s in stores]
    name = F.concat(F.upper(F.substring("query", 1, 1)), F.expr("substring(query, 2)"))
    return m.select("query", F.concat(F.lit("| "), name, F.lit(" | "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def range_texts(middle: DataFrame, base: str, digits: int = 1) -> DataFrame:
    """Speed-up ranges as the document writes them: ``10.6× to 62.0×``."""
    number = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    return ratios(middle, base).select(
        "store", F.concat(number("low"), F.lit("× to "), number("high"), F.lit("×")).alias("value")
    )


def verify_claims(
    document: DataFrame,
    claims: DataFrame,
    lines: DataFrame,
    samples: DataFrame,
    stores: Sequence[str],
    base: str,
    row_counts: DataFrame,
    digits: int = 1,
    ignore: Sequence[str] = (),
) -> DataFrame:
    """Every problem of a document as a row ``(check, detail)``; no rows means the document equals its evidence.

    ``document(value)`` holds its lines, ``claims`` the reviewed list, ``lines(log, value)`` the logs, ``samples(query,
    store, run, ms)`` the bench runs, ``row_counts(query, store, n)`` the result sizes per store.
    """
    middle = pinned(medians(samples))  # a row per query and store
    rows = bench_rows(middle, stores)
    ranges = range_texts(middle, base, digits)
    required = rows.select("value").unionByName(ranges.select("value"))
    missing = absent_claims(required.select(F.col("value").alias("claim")), document)
    disagree = row_counts.groupBy("query").agg(F.count_distinct("n").alias("k")).where("k <> 1")
    covered = claims.select(F.col("claim").alias("value")).unionByName(rows.select("value"))
    part = lambda df, check, detail: df.select(F.lit(check).alias("check"), detail.alias("detail"))
    parts = [
        part(absent_claims(claims, document), "claim not in document", F.col("claim")),
        part(unmatched_claims(claims, lines), "no line matches", F.concat_ws(" ", "log", "pattern", "claim")),
        part(missing, "bench figure missing or different", F.col("claim")),
        part(disagree, "row counts differ", F.col("query")),
        part(uncovered_numbers(document, covered, ignore), "figure not covered", F.col("number")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
