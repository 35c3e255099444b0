"""Quality rules and mixtures against plain Python, and their odd inputs."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, plan_of
from twinproof.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    wins = collections.defaultdict(list)
    for i in range(len(w) - 7):
        wins[tuple(w[i: i + 8])].append(i)
    covered = {i + j for at in wins.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_and_base_rules(spark):
    rows = [(1, None), (2, ""), (3, "\n \t"), (4, "a b c d e f g h " * 9), (5, "x\ny\nx\n\nx \n" * 3 + "# * $ % & | < > é"), (6, "w " * 20_000),
            (7, " ".join(f"u{i}" for i in range(30))), (7, " ".join(f"u{i}" for i in range(30))), (8, "q " * 7), (9, "1 2 3 4 5 6 7 8 9 " * 2 + " ".join(map(str, range(60))))]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], DOCS).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels)
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) for r in out.collect())
    want = sorted((i, *(p := plain(t)), not (p[0] < 20 or 100 * p[4] > 30 * p[0])) for i, t in rows)
    assert got == want
    assert not any(x in plan_of(quality.measures(docs)) for x in ("Python", "Pandas", "Arrow", "Exchange"))


def test_binomial_tail_is_exact(spark):
    cases = [(0, 0), (0, 50), (1, 50), (3, 200), (30, 4000), (300, 40_000), (5, 5)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality.at_most(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        k, n = r["k"], r["n"]
        want = 1.0 if k > n * 0.01 else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_certified_cutoffs_reject_junk_and_spare_good(spark):
    rnd = random.Random(1)
    text = lambda mark: "".join(f"{rnd.randrange(10**6)}{mark} " for _ in range(30))
    rows = [(i, text("###" if i % 5 == 0 else ""), "en" if i % 2 else None, "s", 0) for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 3000)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    out = quality.judge(spark.createDataFrame(rows, DOCS), labels)
    assert out.filter("kept <> (doc_id % 5 > 0)").isEmpty()
    few = quality.judge(spark.createDataFrame(rows, DOCS), labels.filter("doc_id < 100"))
    assert few.filter("not kept").isEmpty()  # a hundred labels certify nothing


def test_quality_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality.judge(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).isEmpty()


def test_subset_counts_reach_the_budget():
    rnd = random.Random(0)
    for _ in range(300):
        counts = {rnd.randrange(0, 40): rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 8))}
        total = sum(k * c for k, c in counts.items())
        budget = rnd.randrange(0, total + 2)
        taken = mixing.subset_counts(counts, budget)
        assert all(0 <= taken[k] <= counts[k] for k in counts)
        assert sum(k * t for k, t in taken.items()) <= max(budget, 0) or total <= budget
    even = {1: 3, 2: 50, 7: 20, 400: 9}
    reach = {0}
    for k, n in even.items():
        reach = {r + k * i for r in reach for i in range(n + 1)}
    for b in range(0, 3000, 37):
        assert sum(k * t for k, t in mixing.subset_counts(even, b).items()) == max(r for r in reach if r <= b)


def test_subset_counts_of_long_documents():
    total = lambda taken: sum(k * t for k, t in taken.items())
    assert mixing.subset_counts({66_000: 1, 65_500: 1, 65_499: 1}, 130_999) == {66_000: 0, 65_500: 1, 65_499: 1}
    assert total(mixing.subset_counts({66_000: 1, 40_000: 1, 39_000: 1}, 79_000)) == 79_000
    rnd = random.Random(5)
    for _ in range(40):
        counts = {rnd.choice([1, 10**4, 10**9]) * rnd.randrange(50_000, 200_000): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 6))} | {0: 2}
        reach = {0}
        for k, n in counts.items():
            reach = {r + k * i for r in reach for i in range(n + 1)}
        budget = rnd.randrange(0, max(reach) + 2)
        taken = mixing.subset_counts(counts, budget)
        assert all(0 <= taken[k] <= counts[k] for k in counts) and total(taken) == max(r for r in reach if r <= budget)
    # Too many to list: the whole budget by sums, and beyond that a wide rest.
    counts = {70_000 + 97 * i: 1 for i in range(60)}
    picked = [k for i, k in enumerate(counts) if i % 7 == 3]
    assert total(mixing.subset_counts(counts, sum(picked))) == sum(picked)
    counts = {700_000 + 97 * i * i: 1 for i in range(60)}
    picked = [k for i, k in enumerate(counts) if i % 2]
    assert total(mixing.subset_counts(counts, sum(picked))) == sum(picked) > mixing.WIDE
    multiples = mixing.subset_counts({k * 7: 3 for k in range(10_000, 10_100)}, 7 * 1_004_950 + 5)
    assert total(multiples) == 7 * 1_004_950


def test_sums_are_the_nearest(monkeypatch):
    monkeypatch.setattr(mixing, "REACH", 16)
    rnd = random.Random(6)
    for listed, wide in ((1 << 18, 64), (0, 1 << 12), (0, 64)):
        monkeypatch.setattr(mixing, "LISTED", listed)
        monkeypatch.setattr(mixing, "WIDE", wide)
        for _ in range(200):
            counts = {rnd.randrange(1, 90): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 8))}
            reach = {0}
            for k, n in counts.items():
                reach = {r + k * i for r in reach for i in range(n + 1)}
            budget = rnd.randrange(0, max(reach) + 1)
            taken = mixing.subset_counts(counts, budget)
            assert all(0 <= taken[k] <= counts[k] for k in counts)
            missed = budget - sum(k * t for k, t in taken.items())
            assert 0 <= missed and (missed == 0 or budget >= max(reach) or missed < min(k for k in counts if taken[k] < counts[k]))
            if listed or budget <= wide:
                assert budget - missed == max(r for r in reach if r <= budget)


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing until none is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in out]
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] > most * sizes[s] * total]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]


def test_targets(spark):
    rnd = random.Random(4)
    for _ in range(6):
        sizes = {f"s{i}": rnd.choice([0, 1, 5, 1000, 20_000]) for i in range(rnd.randrange(1, 9))} | {None: rnd.choice([0, 3, 900]), "é": 8}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(filled(sizes))


def test_mixture_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, "a b", None), (-1, None, None), (-2, "", "src1"), (-3, "one", "src1"), (-3, "one", "src1")], "doc_id long, text string, source string")
    docs = docs.unionByName(odd).withColumn("size", F.lit("clash")).withColumn("no", F.lit(1))
    answer = mixing.mix(docs)
    got = answer.toPandas()
    assert len(got) == docs.count() and (got["taken"] == got["size"] * got["copies"]).all() and got["copies"].between(0, 3).all()
    for _, g in got.groupby(["source_size", "target"]):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(1, 0.05 * g["target"].iloc[0])
    again = mixing.mix(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mix(docs.limit(0)).isEmpty()
