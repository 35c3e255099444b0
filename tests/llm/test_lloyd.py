"""Centroid clustering against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from twinproof.llm import lloyd


def plain(rows, k=8, rounds=10, dimension=64):
    ok = [(i, [lloyd.whole(x) for x in v]) for i, v in rows
          if v is not None and len(v) == dimension and all(x is not None and abs(x) < float("inf") for x in v)]
    order = sorted(range(len(ok)), key=lambda r: (hashlib.sha256(f"3:{'' if ok[r][0] is None else ok[r][0]}".encode()).hexdigest(), ok[r][1]))
    centroids = [list(ok[r][1]) for r in order[:k]]

    def nearest():
        out = []
        for _, v in ok:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        mine = nearest()
        for c in range(len(centroids)):
            members = [v for (_, v), (m, _) in zip(ok, mine) if m == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    last = nearest()
    fits = lambda x: x if x < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, fits(d), fits(sum(e for m, e in last if m == c)), fits(sum(e for _, e in last)), sha[c])
                   for (i, _), (c, d) in zip(ok, last)], key=str)


def got(df, **kw):
    return sorted([tuple(r) for r in lloyd.centroid_clusters(df, **kw).collect()], key=str)


def test_equals_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "ROWS", 7)  # many blocks
    rnd = random.Random(1)
    centre = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [c + rnd.gauss(0, 0.3) for c in centre[i % 9 if i % 3 else 0]]) for i in range(150)]
    rows += [rows[3], rows[3], (3, rows[4][1]), (None, rows[5][1]), (500, None), (501, [1.0] * 63), (502, [1.0] * 65), (503, [None] + [1.0] * 63),
             (504, [float("nan")] * 64), (505, [float("inf")] + [1.0] * 63), (506, [0.0] * 64), (507, [-0.0] * 64), (508, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("clash")).withColumn("cluster", F.lit(7))
    assert got(df.repartition(5)) == plain(rows)


def test_ties_equal_vectors_and_empty_clusters(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]  # two places, eight centroids: six stay empty
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(df, rounds=3) == plain(rows, rounds=3)
    few = rows[:3]
    assert got(spark.createDataFrame(few, df.schema), rounds=2) == plain(few, rounds=2)


def test_components_beyond_64_bits_stay_exact(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([1e300, -1e300, 3.0, 2e9, 1e17]) for _ in range(64)]) for i in range(30)]
    rows += [(100 + i, [rnd.gauss(0, 1) for _ in range(64)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain(rows, rounds=3)
    assert got(df, rounds=3) == want and any(r[2] is None for r in want) and any(r[2] is not None for r in want)


def test_other_shapes_and_no_vectors(spark):
    rows = [(f"v{i}", [float(i), -float(i * i), 0.5]) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, v array<double>")
    assert got(df, k=3, rounds=4, dimension=3, id_col="name", vector_col="v") == plain(rows, 3, 4, 3)
    assert lloyd.centroid_clusters(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).isEmpty()


def test_cells_are_not_moved_again(spark):
    df = spark.createDataFrame([(i, [float(i)] * 64) for i in range(50)], "vec_id long, embedding array<double>")
    cells = lloyd._laid_out(df.mapInArrow(lloyd._cells(64, 1024, 8, 32), "block long, shard int, n int, large boolean, data binary, ids array<long>"))
    other = spark.range(8).withColumnRenamed("id", "block").repartition(3)
    plan = cells.join(other.hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1
