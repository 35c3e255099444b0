"""Mixing sources to target weights by subset sums (operator 5).

Each source gets a budget in words. Whole rounds of the source are taken as often as they fit; the rest of the budget is a
bounded knapsack over counts of documents by exact size: every size gets its share, rounded down, and dynamic programming
over reachable sums closes what is left, mostly to the word. How many documents of a size are taken is thus known from
counts alone; which ones, a seeded hash says: all below a boundary bucket of hashes, and within that bucket by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.base import stored

WEIGHTS = (1, 2, 3)
MOST = 3
BUCKETS = 1024
#: Sums that dynamic programming ranges over, in words, at first and at most; more than that is first filled by large documents. Choices that
#: are listed one by one for each half of a source.
REACH, WIDE, LISTED = 1 << 16, 1 << 24, 1 << 18


def subset_counts(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many items of each size (at most ``counts``) to take, so that their sizes sum to ``budget`` or as near below it as found.

    What the first, narrow try misses is searched for anew: among all choices where they are few, else over sums up to ``WIDE``, which is the
    whole budget or what is left of it once shares and large items are fixed. The result is the nearest there is if the budget is at most ``WIDE`` or
    the choices are few; in any case it misses less than the smallest item left out.
    """
    total = sum(k * c for k, c in counts.items())
    if total <= budget:
        return dict(counts)
    sizes = sorted((k for k, c in counts.items() if k and c), reverse=True)
    taken, missed = _filled(counts, sizes, budget, budget, total, REACH)
    if missed == budget % math.gcd(*sizes):  # no sum of these sizes is nearer
        return taken
    if (halves := _halves(counts, sizes, budget)) is not None:
        return dict.fromkeys(counts, 0) | ({0: counts[0]} if 0 in counts else {}) | _listed(halves, budget)
    wide, still = _filled(counts, sizes, budget, max(0, budget - WIDE), total, WIDE)
    if budget <= WIDE and 0 in counts:
        wide[0] = counts[0]
    return wide if still < missed else taken


def _filled(counts: dict[int, int], sizes: list[int], budget: int, shared: int, total: int, reach: int) -> tuple[dict[int, int], int]:
    """Shares of ``shared`` words, then large items until ``reach`` is left, then the nearest sum; what is missing from ``budget`` then."""
    taken = {k: c * shared // total for k, c in counts.items()}
    rest = budget - sum(k * t for k, t in taken.items())
    for k in sizes:
        if rest > reach and k <= rest and taken[k] < counts[k]:
            n = min(counts[k] - taken[k], (rest - reach + k - 1) // k, rest // k)
            taken[k] += n
            rest -= n * k
    return taken, _close(taken, counts, sizes, rest)


def _close(taken: dict[int, int], counts: dict[int, int], sizes: list[int], rest: int) -> int:
    """Add to ``taken`` what brings its sum up by ``rest``, or as near below it as can be; what is missing then."""
    fit = [k for k in sizes if k <= rest and taken[k] < counts[k]]
    if (every := sum(k * (counts[k] - taken[k]) for k in fit)) <= rest:
        taken.update({k: counts[k] for k in fit})
        return rest - every
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    made = np.zeros(rest + 1, dtype=np.int32)  # the step that made a sum first
    for k in fit:
        free, part = min(counts[k] - taken[k], rest // k), 1
        while free > 0 and not reach >> rest & 1:
            n = min(part, free)
            new = (reach << n * k) & mask & ~reach
            if new:
                reach |= new
                made[_ones(new)] = len(steps)
                steps.append((k, n))
            free, part = free - n, part * 2
    at = reach.bit_length() - 1
    missed = rest - at
    while at:  # a sum that a step made first came from one that earlier steps made
        k, n = steps[made[at]]
        taken[k] += n
        at -= n * k
    return missed


def _ones(bits: int) -> np.ndarray:
    """Places of the ones of a number."""
    low = (bits & -bits).bit_length() - 1 & ~7
    data = np.frombuffer((bits >> low).to_bytes((bits.bit_length() - low + 7) // 8, "little"), dtype=np.uint8)
    at = np.flatnonzero(data)
    row, place = np.nonzero(np.unpackbits(data[at, None], axis=1, bitorder="little"))
    return low + at[row] * 8 + place


def _halves(counts: dict[int, int], sizes: list[int], budget: int) -> list[list[tuple[int, int]]] | None:
    """Sizes with their numbers, in two halves of at most ``LISTED`` choices each; None if there are more."""
    halves, ways = [[], []], [1, 1]
    for n, k in sorted(((min(counts[k], budget // k), k) for k in sizes if k <= budget), reverse=True):
        i = int(ways[1] < ways[0])
        halves[i].append((k, n))
        ways[i] *= n + 1
        if ways[i] > LISTED:
            return None
    return halves


def _listed(halves: list[list[tuple[int, int]]], budget: int) -> dict[int, int]:
    """The nearest sum of all choices: each choice of one half meets the largest one of the other that still fits."""
    sums = []
    for half in halves:
        s = np.zeros(1, dtype=np.int64)
        for k, n in half:
            s = (s[None, :] + k * np.arange(n + 1, dtype=np.int64)[:, None]).ravel()
        sums.append(s)
    order = np.argsort(sums[1], kind="stable")
    ranked = sums[1][order]
    room = budget - sums[0]
    at = np.searchsorted(ranked, room, side="right") - 1
    best = int(np.argmax(np.where(room >= 0, sums[0] + ranked[at], -1)))
    taken = {}
    for half, s, place in zip(halves, sums, (best, int(order[at[best]]))):
        width = len(s)
        for k, n in reversed(half):  # the last size varies slowest
            width //= n + 1
            taken[k], place = divmod(place, width)
    return taken


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of sources (source, source_size): the sum of all sizes shared by weight, none above ``most`` times its source.

    Sources take weights in turn in the order of their code points, NULL last. Ordered by the ratio of ceiling to weight, the sources
    that stop at their ceiling come first, and running sums tell where they end: one row per source, no rounds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    no = F.row_number().over(order) - 1
    weighed = sizes.select("source", "source_size", no.alias("no"), F.element_at(
        F.array(*[F.lit(w).cast("long") for w in weights]), (no % len(weights) + 1).cast("int")).alias("w"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "no")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    wide = weighed.select(
        "*", (F.lit(most) * F.col("source_size")).alias("ceiling"), F.sum("source_size").over(every).alias("total"), F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0)).alias("gone"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("gone_w"))
    dec = lambda c: F.col(c).cast("decimal(30,0)")
    stops = (dec("total") - dec("gone")) * dec("w") > dec("ceiling") * (dec("all_w") - dec("gone_w"))
    marked = wide.withColumn("stops", stops).withColumn(
        "left", F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("ceiling"))).over(every), F.lit(0))).withColumn(
        "left_w", F.col("all_w") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("w"))).over(every), F.lit(0)))
    return marked.select("source", "source_size", "no", F.when(F.col("stops"), F.col("ceiling").cast("double")).otherwise(
        F.try_divide(F.col("left").cast("double") * F.col("w"), F.col("left_w"))).alias("target"))


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    target, total = float(frame["target"].iloc[0]), int(frame["source_size"].iloc[0])
    whole = min(int(target // total), MOST) if total else 0
    budget = max(0, int(target + 0.5) - whole * total) if whole < MOST else 0
    counts = dict(zip(frame["size"].astype(int), frame["n"].astype(int)))
    taken = subset_counts(counts, budget)
    return pd.DataFrame({"no": frame["no"], "size": frame["size"], "whole": whole, "quota": [taken[int(k)] for k in frame["size"]]})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
        weights: tuple[int, ...] = WEIGHTS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: the mix takes ``copies`` of a document, ``taken`` words in all.

    Sizes are words; a NULL text has none. Texts without words take no words, and as many copies as their source has whole
    rounds. Repeated rows are documents of their own; NULL sources are one source. An empty table gives an empty result.
    ``keep``: further columns of ``docs`` to carry along.
    """
    keep = keep or []
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    hashed = F.xxhash64(F.lit(seed), F.col(id_col))
    slim = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), hashed.alias("h"),
        F.pmod(F.shiftrightunsigned(hashed, 20), F.lit(BUCKETS)).cast("int").alias("bucket"), *[F.col(c).alias(f"_k_{c}") for c in keep]), "sizes")
    counts = stored(slim.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sized = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = stored(targets(sized, weights), "targets")
    aim = aims.withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    fitted = by_size.join(aim, same).select("no", "size", "n", "source_size", "target").groupBy("no").applyInPandas(
        _fit, "no int, size long, whole int, quota long")
    # The bucket of hashes in which the quota of a size ends, and what is still to take there.
    numbered = counts.join(aim.select("_s", "no"), same).select("no", "size", "bucket", "n")
    behind = Window.partitionBy("no", "size").orderBy("bucket")
    ends = numbered.withColumn("upto", F.sum("n").over(behind)).join(fitted, ["no", "size"]).groupBy("no", "size", "whole", "quota").agg(
        F.min(F.when(F.col("upto") > F.col("quota"), F.struct("bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("rest")))).alias("end"))
    ends = stored(ends.select(F.col("no").alias("_no"), F.col("size").alias("_size"), "whole", F.coalesce("end.bucket", F.lit(BUCKETS)).alias("edge"),
                              F.coalesce("end.rest", F.lit(0)).alias("rest")), "quotas")
    placed = slim.join(aim, same).join(ends, (F.col("no") == F.col("_no")) & (F.col("size") == F.col("_size")))
    chosen = F.col("bucket") < F.col("edge")
    rank = F.row_number().over(Window.partitionBy("no", "size").orderBy("h", "doc_id"))
    at_edge = (F.col("bucket") == F.col("edge")) & (F.col("rest") > 0)
    out = placed.filter(~at_edge).withColumn("more", chosen.cast("int")).unionByName(
        placed.filter(at_edge).withColumn("more", (rank <= F.col("rest")).cast("int")))
    copies = F.col("whole") + F.col("more")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"),
                      *[F.col(f"_k_{c}").alias(c) for c in keep])
