"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from twinproof.llm import vectors


def brute(rows, least=0.95):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    x = {k: np.array(v, float) / np.linalg.norm(np.array(v, float)) for k, (_, v) in enumerate(rows) if ok[k]}
    n, root = [0] * len(rows), list(range(len(rows)))
    best = list(ids)
    for a in x:
        for b in x:
            if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= least:
                n[a] += 1
                n[b] += 1
                ra, rb = root[a], root[b]
                root = [ra if r == rb else r for r in root]
    for r in set(root):
        low = min(ids[k] for k in range(len(rows)) if root[k] == r)
        for k in range(len(rows)):
            if root[k] == r:
                best[k] = low
    return sorted(zip(ids, n, best))


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 48))
    near = np.repeat(x[:60], 5, axis=0) + rng.normal(size=(300, 48)) * 0.21
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, near)))]
    want = brute(rows)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    links, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert links > 500 and 0.97 * links <= found <= links
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_odd_vectors_and_one_hot_vector(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).tolist()) for i in range(700)]  # more than a block
    rows += [(1000 + i, base.tolist()) for i in range(300)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] + [1.0] * 15), (2005, [None] + [1.0] * 15),
             (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, (base * 1e300).tolist()), (2009, (base * 1e-300).tolist()), (2010, (-base).tolist()), (2010, (-base).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("clash")).withColumn("dim", F.lit(0))
    got = {}
    for r in vectors.near_vectors(df).collect():
        got.setdefault(r["vec_id"], (r["n_links"], r["component_id"]))
    assert all(got[i] == (1001, 0) for i in range(700)) and all(got[1000 + i] == (1001, 0) for i in range(300))
    assert all(got[i] == (0, i) for i in range(2000, 2006))
    assert got[2006] == (1, 2006) and got[2007] == (1, 2006) and got[2008] == (1001, 0) and got[2010] == (1, 2010)


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    one = vectors.near_vectors(spark.createDataFrame([(5, [1.0]), (6, None)], "vec_id long, embedding array<float>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in one.collect()) == [(5, 0, 5, True), (6, 0, 6, True)]


@pytest.mark.parametrize("shared", [0.0, 0.5, 0.8])
@pytest.mark.parametrize("n", [10**4, 10**6, 10**9])
def test_recall_at_the_threshold_does_not_fall_with_size(n, shared):
    """The index as it is designed for n vectors, on vectors with a common mean of some length, and pairs it was not designed on."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x = shared * np.eye(64)[7] + np.sqrt(1 - shared**2) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.design(x[:3000], n, recall=0.995)
    assert index.recall >= 0.995
    for least in (0.95, 0.955, 0.97):
        y = vectors.pairs_at(x[3000:], least, seed=11)
        assert index.meet(index.codes(x[3000:]), index.codes(y)).mean() >= 0.99


def test_every_meeting_pair_counts_once():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.design(x, 10**6)
    a, b = index.codes(x), index.codes(vectors.pairs_at(x, 0.95, seed=2))
    flips = np.concatenate(([0], 1 << np.arange(index.stretch))).astype(np.uint64)
    counted = np.zeros(len(x), int)
    for t in range(len(index.tables)):
        for i in range(len(x)):
            for key in set((index.stretches(a, t)[i] ^ flips).tolist()) & set((index.stretches(b, t)[i] ^ flips).tolist()):
                counted[i] += vectors._counts_here(a[i: i + 1], b[i: i + 1], np.array([t]), np.array([key], np.uint64).view(np.int64), index)[0]
    assert (counted == index.meet(a, b)).all()


def test_rotation_balances_codes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 24)) * np.linspace(3, 1, 24) + 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, p = vectors.learn_rotation(x, 24)
    assert np.allclose(p.T @ p, np.eye(24)) and abs(((x - mean) @ p >= 0).mean(0) - 0.5).max() < 0.2


def test_table_of_the_test_data(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()) == brute(rows)
