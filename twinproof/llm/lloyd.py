"""Centroid clustering by dimension-sharded Lloyd rounds over integer components (operator 11).

Vectors are laid out once as cells: a block of rows times a shard of columns. A round has two shuffles. A task per cell computes
exact partial squared distances of its rows to its slice of the centroids; these are added up by block, and the smallest
sum is a row's cluster. Assignments, not vectors, then travel back to the cells, whose partitioning by block is kept; every
task adds up its columns by cluster, and each shard replaces its own slice of the centroids by the floored means. The
driver sees k x dimension integers a round, whatever the number of vectors.

All sums are exact: cells whose components are small enough work in 64-bit integers, others in Python's unbounded ones.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.base import slices, stored
from twinproof.session import pinned

K, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
#: Rows of a block and columns of a shard.
ROWS, COLUMNS = 2048, 32
_LONG = (1 << 63) - 1


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), also where the product leaves the range in which doubles are exact."""
    return math.floor(scale * x) if abs(x) < 2.0**52 else int(x) * scale


def _limit(dimension: int) -> int:
    """Components below this leave a whole squared distance below 2^62."""
    return math.isqrt((1 << 62) // dimension) // 2


def _cells(dimension: int, scale: int, rows: int, columns: int):
    """Rows (id, vector) as cells; ``data`` holds the components as 32-bit integers, or the vector's doubles if ``large``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        starts = range(0, dimension, columns)
        for batch in slices(batches, rows):
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dimension)
            with np.errstate(over="ignore"):
                v = np.floor(scale * x)
            large = not np.abs(v).max() < min(_limit(dimension), 1 << 31)
            data = [(x if large else v.astype(np.int32))[:, s: s + columns].tobytes() for s in starts]
            # Only the first shard carries the ids.
            ids = pa.ListArray.from_arrays(pa.array([0] + [n] * len(data), pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32()), pa.array([n] * len(data), pa.int32()),
                pa.array([large] * len(data)), pa.array(data, pa.binary()), ids], names=["block", "shard", "n", "large", "data", "ids"])
            block += 1

    return run


def _components(data: bytes, n: int, large: bool, scale: int) -> np.ndarray:
    """A cell's components: int64, or Python integers."""
    if not large:
        return np.frombuffer(data, np.int32).reshape(n, -1).astype(np.int64)
    x = np.frombuffer(data, np.float64)
    return np.array([whole(c, scale) for c in x.tolist()], object).reshape(n, -1)


def _partials(centroids: list[list[int]], scale: int, columns: int):
    """Of each cell, its share of every distance: int64s of rows x centroids, or decimal texts where those are too small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dimension = len(centroids[0])
        table = np.array(centroids, object)
        far = max(abs(c) for row in centroids for c in row) >= _limit(dimension)
        for batch in batches:
            for row in batch.to_pylist():
                own = table[:, row["shard"] * columns: (row["shard"] + 1) * columns]
                v = _components(row["data"], row["n"], row["large"], scale)
                exact = far or row["large"]
                v, own = (v.astype(object), own) if exact else (v, own.astype(np.int64))
                part = np.stack([((v - c) ** 2).sum(1) for c in own], axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]]), pa.array([row["n"]], pa.int32()),
                    pa.array([None if exact else part.tobytes()], pa.binary()),
                    pa.array([[str(d) for d in part.ravel()] if exact else None], pa.list_(pa.string()))],
                    names=["block", "n", "near", "wide"])

    return run


_ASSIGNED = "block long, cluster array<int>, distance array<long>"


def _nearest(group: pa.Table) -> pa.Table:
    """The shards' shares of one block added up; the nearest centroid of each row, the first of equals."""
    rows, total = group.to_pylist(), 0
    n = rows[0]["n"]
    exact = any(r["near"] is None for r in rows)
    for r in rows:
        part = np.array([int(d) for d in r["wide"]], object) if r["near"] is None else np.frombuffer(r["near"], np.int64)
        total = total + (part.astype(object) if exact else part)
    total = total.reshape(n, -1)
    best = np.array([min(range(len(t)), key=t.__getitem__) for t in total]) if exact else total.argmin(1)
    distance = total[np.arange(n), best].tolist()
    return pa.table({
        "block": pa.array([rows[0]["block"]]), "cluster": pa.array([best.tolist()], pa.list_(pa.int32())),
        "distance": pa.array([[d if d <= _LONG else None for d in distance]], pa.list_(pa.int64()))})


def _sums(scale: int):
    """Sums of a task's cells by shard and cluster, as decimal texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                v = _components(row["data"], row["n"], row["large"], scale)
                cluster = np.array(row["cluster"])
                order = np.argsort(cluster, kind="stable")
                names, begins = np.unique(cluster[order], return_index=True)
                added = np.add.reduceat(v[order], begins, axis=0)
                for c, count, sums in zip(names.tolist(), np.diff(np.append(begins, len(order))).tolist(), added.tolist()):
                    have = held.setdefault((row["shard"], c), [0, [0] * len(sums)])
                    have[0] += count
                    have[1] = [a + b for a, b in zip(have[1], sums)]
        if held:
            yield pa.RecordBatch.from_arrays([
                pa.array([s for s, _ in held], pa.int32()), pa.array([c for _, c in held], pa.int32()),
                pa.array([n for n, _ in held.values()], pa.int64()), pa.array([[str(x) for x in v] for _, v in held.values()])],
                names=["shard", "cluster", "n", "sums"])

    return run


def _update(group: pa.Table) -> pa.Table:
    """A shard's new slice: the floored mean of each cluster that has vectors."""
    total: dict[int, list] = {}
    for r in group.to_pylist():
        have = total.setdefault(r["cluster"], [0, [0] * len(r["sums"])])
        have[0] += r["n"]
        have[1] = [a + int(b) for a, b in zip(have[1], r["sums"])]
    return pa.table({
        "shard": pa.array([group["shard"][0].as_py()] * len(total), pa.int32()), "cluster": pa.array(list(total), pa.int32()),
        "slice": pa.array([[str(s // n) for s in sums] for n, sums in total.values()], pa.list_(pa.string()))})


def _laid_out(cells: DataFrame) -> DataFrame:
    """Cells checkpointed in partitions by block, as no later join has to move them again.

    A checkpoint keeps a plan's partitioning only if adaptive execution does not wrap the plan; the setting is put back at once.
    """
    conf = cells.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return pinned(cells.repartition(int(conf.get("spark.sql.shuffle.partitions")), "block"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED,
                      id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with exactly ``dimension``
    components, none of them NULL or non-finite; other vectors have no row.

    Components are floor(scale * x). Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:id`` (a NULL id
    counts as empty text; repeated ids go by their components), or all vectors if there are fewer; an empty cluster keeps its
    centroid. Repeated rows are vectors of their own. Distances and inertias beyond 64 bits are NULL, the clusters still exact.
    An empty table gives an empty result. The driver holds k centroids, the tasks k per row of a block.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kept = raw.filter((F.size("embedding") == dimension) & F.forall(
        "embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    label = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(label, "embedding").limit(k).select("embedding").collect()
    id_type = raw.schema["vec_id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [[whole(c, scale) for c in r["embedding"]] for r in first]

    cells = _laid_out(kept.mapInArrow(
        _cells(dimension, scale, ROWS, COLUMNS), f"block long, shard int, n int, large boolean, data binary, ids array<{id_type}>"))

    def assigned():
        shares = cells.select("block", "shard", "n", "large", "data").mapInArrow(
            _partials(centroids, scale, COLUMNS), "block long, n int, near binary, wide array<string>")
        return shares.groupBy("block").applyInArrow(_nearest, _ASSIGNED)

    for _ in range(rounds):
        met = cells.drop("ids").join(assigned().select("block", "cluster").hint("shuffle_hash"), "block")
        moved = met.select("shard", "n", "large", "data", "cluster").mapInArrow(
            _sums(scale), "shard int, cluster int, n long, sums array<string>").groupBy("shard").applyInArrow(
            _update, "shard int, cluster int, slice array<string>")
        for r in moved.collect():
            at = r["shard"] * COLUMNS
            centroids[r["cluster"]][at: at + len(r["slice"])] = map(int, r["slice"])

    ids = cells.filter("shard = 0").select("block", "ids")
    rows = ids.join(assigned().hint("shuffle_hash"), "block").select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("r"))
    rows = stored(rows.select(F.col("r.ids").alias("vec_id"), "r.cluster", "r.distance"), "assigned")
    inertia = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.when(
        F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(19,0)")))).collect()}
    whole_sum = None if None in inertia.values() else sum(inertia.values())
    fits = lambda s: int(s) if s is not None and s <= _LONG else None
    stats = spark.createDataFrame(
        [(c, fits(s), fits(whole_sum), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a cluster: at most k.
    return rows.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT rid, c, sum((v - m) * (v - m)) AS d FROM x JOIN c{i} USING (j) GROUP BY rid, c) GROUP BY rid)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c, j, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (
    SELECT c, j, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM x JOIN a{i} USING (rid) GROUP BY c, j) n USING (c, j))""")
    return f"""
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda q: isfinite(q))) = {DIMENSION}),
x AS MATERIALIZED (
  SELECT rid, unnest(range({DIMENSION})) AS j, CAST(floor({SCALE} * unnest(embedding::DOUBLE[])) AS HUGEINT) AS v FROM e),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT c, j, v AS m FROM s JOIN x USING (rid) WHERE c < {k}),{",".join(steps)},
f AS (SELECT c, sum(d) AS inertia FROM a{rounds} GROUP BY c),
h AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY j)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(f.inertia AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(inertia) FROM f) AS BIGINT) AS inertia, sha AS centroid_sha256
FROM e JOIN a{rounds} USING (rid) JOIN f USING (c) JOIN h USING (c)
"""


#: The same in SQL, over the view embeddings.
SQL = _sql()
