"""Near-duplicates against brute force, and the cases that a text can be."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from twinproof.llm import neardup
from twinproof.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent):
    """Ids to (set size, component) by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append((i, {tuple(w[k: k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if n and 100 * n >= percent * (len(a) + len(b) - n):
                r, q = find(i), find(j)
                root[max(r, q)] = min(r, q)
    return {i: (len(s), find(i)) for i, s in sets}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, width, percent):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    answer = neardup.near_duplicates(docs, width, percent)
    assert got(answer) == brute(rows, width, percent)
    assert answer.filter("kept <> (doc_id = component_id)").isEmpty()


def test_group_of_near_copies_and_odd_texts(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "two one"), (1006, "É x"), (1007, "é x")]
    for i in range(150):  # copies of a base text with more and more words changed
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 8)), replace=False):
            w[k] = f"x{rng.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    rows += [(2000, " ".join(base)), (2001, " ".join(base).upper()), (2001, " ".join(base).upper()), (3000, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("same", F.lit("clash")).withColumn("component", F.lit(1))
    answer = neardup.near_duplicates(docs, 3, 85)
    assert answer.count() == len(rows)
    assert got(answer) == brute(list(dict(rows).items()), 3, 85)


def test_ids_with_several_texts_lose_no_link(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (5, a + " more"), (9, b + " more"), (7, c), (12, c + " more"), (12, a + " else")]
    for order in (rows, rows[::-1], rows[2:] + rows[:2], [rows[k] for k in (3, 1, 6, 0, 5, 2, 4)]):
        answer = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 3, 85)
        # 12 carries texts near those of 1 and of 7.
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in answer.collect()) == sorted((i, 1, i == 1) for i, _ in rows)
    apart = neardup.near_duplicates(spark.createDataFrame(rows[:5], "doc_id long, text string"), 3, 85)
    assert {(r["doc_id"], r["component_id"]) for r in apart.collect()} == {(1, 1), (5, 1), (9, 1), (7, 7)}


def test_empty_table_and_null_ids(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    rows = neardup.near_duplicates(spark.createDataFrame([(None, "a b c"), (7, "a b c")], "doc_id long, text string")).collect()
    assert len(rows) == 2


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(2))
    shared = rng.integers(0, 1 << 63, 1600).astype(np.uint64)
    a, b = np.concatenate((x, shared)), np.concatenate((y, shared))
    sa, sb, both = neardup.sketches([a, b, np.union1d(a, b)])
    assert (neardup.merge(sa, sb) == both).all()
    grid = np.linspace(0, 1, 101)
    ll = neardup.log_likelihoods(np.array([(sa > sb).sum()]), np.array([(sa < sb).sum()]), np.array([2000]), np.array([2000]), grid)
    assert abs(grid[ll.argmax()] - 1600 / 2400) < 0.12
    one = np.array([2000])
    assert neardup.may_reach(sa[None], sa[None], one, one, 0.85)[0]
    assert not neardup.may_reach(sa[None], sb[None], one, one, 0.95)[0]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2), (500, 499)]
    got_ = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {499: 499, 500: 499}
    assert got_ == want
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
