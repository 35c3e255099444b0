"""Repeated passages against counting all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from twinproof.llm import substrings


def flags(texts, n):
    seen = collections.Counter(t[i: i + n] for t in texts for i in range(len(t) - n + 1))
    return [[seen[t[i: i + n]] > 1 for i in range(len(t) - n + 1)] for t in texts]


def brute(texts, n=200):
    out = []
    for t, f in zip(texts, flags(texts, n)):
        gone = np.zeros(len(t) + 1, bool)
        for i, hit in enumerate(f):
            if hit:
                gone[i: i + n] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [3, 50, 100])
@pytest.mark.parametrize("shards", [1, 4, 8])
def test_merged_transforms_find_all_repeats(n, shards):
    rnd = random.Random(n)
    letters = lambda k: bytes(rnd.randrange(97, 100) for _ in range(k))
    base = letters(400)
    texts = [letters(rnd.randrange(200)) + base[rnd.randrange(200):][: rnd.randrange(250)] + letters(rnd.randrange(60)) for _ in range(40)]
    texts += [b"", b"a" * 300]
    assert [list(map(bool, x)) for x in substrings.repeated_windows(texts, n, shards)] == flags(texts, n)


def check(df, rows):
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())
    assert got == sorted(brute([(t or "").encode() for _, t in rows]))


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check(substrings.cut_passages(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_texts(spark):
    rnd = random.Random(2)
    passage = " ".join(f"p{rnd.randrange(10**6)}" for _ in range(60))
    word = lambda k: " ".join(f"é{rnd.randrange(10**9)}" for _ in range(k))
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, "a" * 1000), (6, passage[:199]), (7, word(20) + passage + word(30)),
            (8, passage + word(9)), (9, word(40)), (9, word(40)), (10, word(5) + passage + word(3) + passage), (None, word(50)), (11, word(20_000))]
    twin = word(60)
    rows += [(12, twin), (12, twin), (13, twin)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("z", F.lit(1))
    check(substrings.cut_passages(docs), rows)
    kept = {r["doc_id"]: r for r in substrings.cut_passages(docs, texts=True, keep=["z"]).collect()}
    assert kept[12]["text"] == "" and kept[3]["text"] == "short" and kept[8]["z"] == 1
    assert passage[5:100] not in kept[7]["text"] and len(kept[11]["text"]) > 100_000


def test_empty_table(spark):
    assert substrings.cut_passages(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_crowded_anchors_are_split_without_loss(spark):
    rnd = random.Random(7)
    letters = lambda k: "".join(chr(rnd.randrange(97, 123)) for _ in range(k))
    passage = letters(260)
    rows = [(i, letters(rnd.randrange(150)) + passage[rnd.randrange(40): 260 - rnd.randrange(40)] + letters(rnd.randrange(150))) for i in range(60)]
    rows += [(100 + i, letters(90) + passage[:100] + letters(90)) for i in range(30)] + [(200, rows[0][1]), (201, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(substrings.cut_passages(docs, crowd=3), rows)
    check(substrings.cut_passages(docs), rows)


@pytest.mark.parametrize("how", ["left_semi", "left_anti", "inner"])
def test_common_keys_are_dealt_over_tasks(spark, how):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.col("id") % 7000).alias("k"), "id")
    right = spark.range(0, 7000, 2).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
    counts = left.groupBy("k").agg(F.count("*").alias("times"))
    got = substrings.joined_by_share(left, right, ["k"], counts, how, shares=64)
    want = left.join(right, "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_of_a_common_passage_meet_in_many_tasks(spark):
    rows = spark.range(6000).select(F.lit(1).alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count("*").alias("times"))
    dealt = substrings.joined_by_share(rows, counts.select("k"), ["k"], counts, "left_semi")
    salted = dealt._jdf.queryExecution().analyzed().toString()
    assert "_salt" in salted and dealt.count() == 6000
