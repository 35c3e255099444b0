"""Quality rules with risk-controlled thresholds (operator 7), in DataFrame functions only.

Fixed base rules come first. Four further measures have a cutoff per stratum, chosen on labelled documents: a cutoff is
certified if the number of good labelled documents that it rejects would be improbable, by the exact binomial
distribution, were its true rate of false rejection above its share of ``risk``. Rates are tested at
``doubt / (strata x measures)``; within a measure, cutoffs are tested from lenient to strict and the false rejections only grow
on the way, so the sequence needs no further correction. Of the certified cutoffs, the one that rejects most bad
labelled documents is taken, and the most lenient of equals; a measure without one, or of no use, rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.llm.base import stored, words

RISK, DOUBT = 0.04, 0.05
WINDOW = 8
#: Measure (per cent, or tenths of a character) and its cutoffs from lenient to strict; a document above one fails.
CUTOFFS: dict[str, list[int]] = {
    "symbols": [60, 40, 30, 20, 15, 10, 7, 5, 3],
    "dup_lines": [90, 80, 70, 60, 50, 40, 30, 20, 10],
    "repeats": [25, 20, 15, 10],
    "word_length": [400, 300, 250, 200, 150, 120],
}


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) to the columns of ``docs``.

    A NULL text counts as an empty one. Everything is computed within the row: no shuffle, no cut of long texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn("_w", words(F.col(text_col))).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    step = step.withColumn("_g", F.when(
        F.size("_h") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(F.slice("_h", i + 1, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a repeated window go on to find where its copies lie.
    step = step.withColumn("_at", F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    ))
    step = step.withColumn("_at", F.when(F.col("_at").isNotNull(), F.sort_array(F.transform(
        F.filter("_at", lambda x, i: (x["g"] == F.get("_at", i - 1)["g"]) | (x["g"] == F.get("_at", i + 1)["g"])),
        lambda x: x["i"]))))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"])
    return step.select(
        *[docs[c] for c in docs.columns],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _values() -> dict[str, Column]:
    part = lambda a, b: F.coalesce(F.floor(F.try_divide(100 * F.col(a), F.col(b))), F.lit(0))
    return {
        "symbols": part("n_symbols", "word_chars"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "word_length": F.coalesce(F.floor(F.try_divide(10 * F.col("word_chars"), F.col("n_words"))), F.lit(0)),
    }


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of the binomial distribution of ``n`` trials, summed exactly term by term in logarithms; 1 for k > n p."""
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("i"))
    odds = F.log(F.lit(p / (1 - p)))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k), start,
        lambda a, i: F.struct(
            (a["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double")) + odds).alias("term"),
            (a["sum"] + F.exp(a["term"])).alias("sum"), i.alias("i")),
        lambda a: a["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def certified_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id",
                      risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """A row per stratum: ``stratum`` and a cutoff per measure (NULL: none). All labelled documents are the holdout.

    A document is good if all its labels say quality 1, bad if one says 0; NULL labels say nothing.
    """
    judged = labels.filter("quality IS NOT NULL").groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("good"))
    held = measured.filter(~base_failed()).join(judged, F.col(id_col) == F.col("_id"))
    values = _values()
    rows = held.groupBy(F.col(stratum).alias("stratum"), "good", *[v.alias(k) for k, v in values.items()]).agg(F.count(F.lit(1)).alias("n"))
    each = rows.select("stratum", "good", "n", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.lit(c).alias("cutoff"), F.lit(i).alias("step"), (F.col(m) > c).alias("fails"))
        for m, cs in CUTOFFS.items() for i, c in enumerate(cs)])))
    good = F.col("good") == 1
    counted = each.groupBy("stratum", "measure", "cutoff", "step").agg(
        F.sum(F.when(good, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(good & F.col("fails"), F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.when(~good & F.col("fails"), F.col("n")).otherwise(0)).alias("caught"))
    strata = counted.agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("null"))).alias("strata"))
    tested = counted.crossJoin(F.broadcast(strata)).withColumn(
        "ok", at_most(F.col("k"), F.col("n"), risk / len(CUTOFFS)) <= doubt / (len(CUTOFFS) * F.col("strata")))
    best = tested.filter(F.col("ok") & (F.col("caught") > 0)).groupBy("stratum", "measure").agg(
        F.max_by("cutoff", F.struct("caught", -F.col("step"))).alias("cutoff"))
    return best.groupBy("stratum").pivot("measure", list(CUTOFFS)).agg(F.first("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang",
          risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """Measures of every document, base_failed and kept: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    NULL and empty texts have no words and fail the base rules. A NULL stratum is a stratum. Repeated rows are judged
    each; without labels nothing is certified and the base rules alone decide; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum).alias("lang"))
    measured = stored(measures(slim).drop("text"), "measures")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").alias("quality"))
    cut = stored(certified_cutoffs(measured, marks, "lang", "doc_id", risk, doubt), "cutoffs")
    values = _values()
    fails = F.lit(False)
    for m in CUTOFFS:
        fails = fails | F.coalesce(values[m] > F.col(f"_cut_{m}"), F.lit(False))
    named = cut.select(F.col("stratum").alias("_stratum"), *[F.col(m).alias(f"_cut_{m}") for m in CUTOFFS])
    # Strata with labels: as many rows as languages; Spark chooses the join by its size.
    return (
        measured.join(named, F.col("lang").eqNullSafe(F.col("_stratum")), "left")
        .withColumn("base_failed", base_failed())
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                (~F.col("base_failed") & ~fails).alias("kept"))
    )


def _list(cs: list[int]) -> str:
    return "[" + ", ".join(map(str, cs)) + "]"


#: The same in SQL, over the views documents and labels.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, list_slice(ws, i, i + 7) AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT rid, i, unnest(range(0, 8)) AS j FROM dup) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    coalesce(100 * n_symbols // nullif(word_chars, 0), 0) AS symbols, coalesce(100 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_lines,
    coalesce(100 * n_repeat_words // nullif(n_words, 0), 0) AS repeats, coalesce(10 * word_chars // nullif(n_words, 0), 0) AS word_length
  FROM m),
j AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
e AS (
  {" UNION ALL ".join(f"SELECT lang, good, '{k}' AS measure, {k} AS v, unnest({_list(c)}) AS cutoff FROM v JOIN j USING (doc_id) WHERE NOT base_failed" for k, c in CUTOFFS.items())}),
c AS (
  SELECT lang, measure, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND v > cutoff) AS k,
         count(*) FILTER (good <> 1 AND v > cutoff) AS caught FROM e GROUP BY ALL),
t AS (
  SELECT *, (SELECT count(DISTINCT coalesce('=' || lang, 'null')) FROM c) AS strata,
    CASE WHEN k > n * {RISK / 4} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(
      lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({RISK / 4}) + (n - i) * ln(1 - {RISK / 4})))) END AS p FROM c),
best AS (
  SELECT lang, measure, cutoff FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, measure ORDER BY caught DESC, cutoff DESC) AS rn
    FROM t WHERE p <= {DOUBT} / (4 * strata) AND caught > 0) WHERE rn = 1),
cut AS (SELECT lang, {", ".join(f"max(cutoff) FILTER (measure = '{k}') AS c_{k}" for k in CUTOFFS)} FROM best GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"coalesce({k} > c_{k}, false)" for k in CUTOFFS)}) AS kept
FROM v LEFT JOIN cut ON v.lang IS NOT DISTINCT FROM cut.lang
"""
