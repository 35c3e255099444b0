"""Near-duplicate vectors by iterative quantisation (operator 4).

On a bounded sample, rotations are learned that make the signs of the leading principal components balanced binary codes.
Every vector gets a code of each rotation, and every code is entered in several tables, one for each stretch of its bits: under the
stretch itself and under all values one bit away. Two vectors meet in a table where their stretches differ in at
most two bits. How many tables there are follows from the recall asked for at the threshold: pairs that lie exactly there are made
from the sample, and tables are added, of further rotations where a code has no bits left, until enough of the pairs meet. The
number of vectors only decides how long a stretch pays, and whether codes with or without the mean are cheaper. Members of a bucket whose whole codes are far apart are dropped by code alone; the others are reranked
with the original vectors in double precision. A pair meets in many buckets and counts in one: the first table where it meets, and there
the smallest common entry. Buckets of any size are worked on in pairs of blocks; a block pair writes partial counts and the links that
connect its members, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.base import slices, stored
from twinproof.llm.components import components

LEAST = 0.95
#: Rows that the rotation is fitted on, at most; every row is indexed.
SAMPLE, ITERATIONS, BITS = 8192, 50, 64
#: Share of the pairs at the threshold that the tables must find, measured on pairs made from the sample.
RECALL = 0.999
#: Share of such pairs that may differ in more bits of a code than are looked at.
BEYOND = 1e-4
#: What an entry costs, in comparisons of two codes.
ENTRY_COST = 50
BLOCK = 512


def _spread_out(x: np.ndarray, near: float = 0.8) -> np.ndarray:
    """Unit vectors without those that lie near an earlier one: one large group of copies must not steer the codes."""
    keep = np.ones(len(x), bool)
    for at in range(0, len(x), 512):
        close = x[at: at + 512] @ x[: at + 512].T >= near
        keep[at: at + 512] = ~np.tril(close, at - 1).any(1)
    return x[keep]


def learn_rotation(x: np.ndarray, bits: int = BITS, iterations: int = ITERATIONS, seed: int = 3, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits) of unit vectors ``x``: principal components, rotated so that signs lose least.

    Vectors near each other count once. Where hardly any are left, the mean is left out: it would lie among the copies.
    """
    x = _spread_out(x)
    mean = x.mean(0) if centred and len(x) >= 2 * x.shape[1] else np.zeros(x.shape[1])
    _, _, vt = np.linalg.svd((x - mean).T @ (x - mean))
    axes = vt[: min(bits, x.shape[1])].T
    v = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(iterations):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return mean, axes @ r


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = ((x - mean) @ projection >= 0).astype(np.uint64)
    return (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def _at_most(k: int, n: int, p: float) -> float:
    """Probability that of ``n`` bits at most ``k`` differ, each with probability ``p``."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))


def pairs_at(x: np.ndarray, least: float, seed: int = 5) -> np.ndarray:
    """For each row of unit vectors ``x`` a vector at cosine ``least``: half in any direction, half in directions between rows."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=x.shape)
    if len(x) > 1:
        u[::2] = (x[rng.permutation(len(x))] - x[rng.permutation(len(x))])[::2]
    u -= (u * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    return np.where(norm > 1e-9, least * x + math.sqrt(max(0.0, 1 - least**2)) * u / np.maximum(norm, 1e-9), x)


@dataclass
class Index:
    """Rotations (mean, projection), the length of a stretch, tables as (rotation, first bit), the bits looked at, recall measured."""

    rotations: list[tuple[np.ndarray, np.ndarray]]
    stretch: int
    tables: list[tuple[int, int]]
    far: int
    recall: float

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([codes_of(x, *r) for r in self.rotations], axis=1)

    def stretches(self, codes: np.ndarray, t: int) -> np.ndarray:
        rotation, begin = self.tables[t]
        return (codes[:, rotation] >> np.uint64(begin)) & np.uint64((1 << self.stretch) - 1)

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows of two arrays of codes meet in a table and are looked at there."""
        near = np.bitwise_count(a ^ b) <= self.far
        out = np.zeros(len(a), bool)
        for t, (rotation, _) in enumerate(self.tables):
            out |= (np.bitwise_count(self.stretches(a, t) ^ self.stretches(b, t)) <= 2) & near[:, rotation]
        return out


def design(x: np.ndarray, n: int, least: float = LEAST, bits: int = BITS, recall: float = RECALL) -> Index:
    """The index for ``n`` vectors like the unit vectors ``x`` that finds ``recall`` of the pairs at cosine ``least``.

    The stretch, and whether the mean is taken off, are what costs least for ``n`` by the binomial distribution of differing bits;
    the tables are as many as the made pairs need. Raises RuntimeError if 64 rotations do not suffice.
    """
    # Rotations suit the vectors they were fitted on better than others, so recall is measured on the other half.
    fit, x = (x[::2], x[1::2]) if len(x) >= 16 * x.shape[1] else (x, x)
    x = np.resize(x, (max(len(x), 4096), x.shape[1]))
    y = pairs_at(x, least)
    far_apart = x[np.random.default_rng(7).permutation(len(x))]
    best = None
    for centred in (True, False):
        rotation = learn_rotation(fit, bits, seed=3, centred=centred)
        length = rotation[1].shape[1]
        a, b, c = codes_of(x, *rotation), codes_of(y, *rotation), codes_of(far_apart, *rotation)
        near_bits, other_bits = np.bitwise_count(a ^ b), np.bitwise_count(a ^ c)
        p, q = near_bits.mean() / length, max(other_bits.mean() / length, 1e-9)
        for stretch in range(min(length, 6), min(length, 48) + 1):
            hit = _at_most(2, stretch, p)
            tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1
            cost = tables * ((stretch + 1) * ENTRY_COST + n * _at_most(2, stretch, q))
            if best is None or cost < best[0]:
                best = cost, centred, stretch, length, int(np.quantile(near_bits, 1 - BEYOND)) + 1
    _, centred, stretch, length, far = best
    index = Index([], stretch, [], min(far, length), 0.0)
    for seed in range(3, 67):
        index.rotations.append(learn_rotation(fit, bits, seed=seed, centred=centred))
        a, b = index.codes(x), index.codes(y)
        index.far = max(index.far, int(np.quantile(np.bitwise_count(a ^ b), 1 - BEYOND)) + 1)
        for begin in range(0, length - stretch + 1, stretch):
            index.tables.append((len(index.rotations) - 1, begin))
            index.recall = float(index.meet(a, b).mean())
            if index.recall >= recall:
                return index
    raise RuntimeError(f"the index finds {index.recall:.3f} of the pairs at the threshold; {recall} were asked for")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors as rows of ``width`` components; shorter ones are padded with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_numpy(zero_copy_only=False)):
        out[i, : min(width, len(v))] = v[:width]
    big = np.abs(out).max(1, keepdims=True)
    out /= np.where(big > 0, big, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _coded(width: int, index: Index):
    """The codes of every vector, of all rotations: computed once, so that a pair is judged by the same bits everywhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            codes = np.ascontiguousarray(index.codes(_matrix(batch.column(1), width)))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, flat.cast(pa.binary())], names=[*batch.schema.names, "codes"])

    return run


def _all_codes(column) -> np.ndarray:
    texts = column.to_pylist()
    return np.frombuffer(b"".join(texts), np.uint64).reshape(len(texts), -1)


def _entries(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate(([0], 1 << np.arange(index.stretch))).astype(np.uint64)
        for batch in slices(batches, 2048):
            codes = _all_codes(batch.column(1))
            rep, dim = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for t, (rotation, _) in enumerate(index.tables):
                key = (index.stretches(codes, t)[:, None] ^ flips).astype(np.int64).ravel()
                many = len(flips)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(dim, many).astype(np.int32)), pa.array(np.full(len(key), t, np.int32)), pa.array(key),
                    pa.array(np.repeat(rep, many)), pa.array(np.repeat(codes[:, rotation], many).view(np.int64))], names=["dim", "t", "key", "rep", "code"])

    return run


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], at_least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Sorted batches, cut anew so that a group never lies in two; a group is bounded by its making."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows >= at_least:
            last = _starts(*[held[c].to_numpy() for c in by])[-1]
            if last:
                yield held.slice(0, last).combine_chunks().to_batches()[0]
                held = held.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


def _near_codes(far: int):
    """Entries of buckets sorted by bucket: those with another member within ``far`` bits (all, in buckets beyond a block)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, ["dim", "t", "key", "slice"]):
            cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            code = cols["code"].view(np.uint64)
            starts = _starts(cols["dim"], cols["t"], cols["key"], cols["slice"])
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
            keep = cols["crowded"].astype(bool).copy()
            lag = 1
            while lag < len(code):
                i = np.flatnonzero(group[lag:] == group[:-lag])
                if not len(i):
                    break
                i = i[~(keep[i] & keep[i + lag])]
                hit = i[np.bitwise_count(code[i] ^ code[i + lag]) <= far]
                keep[hit] = True
                keep[hit + lag] = True
                lag += 1
            yield batch.filter(pa.array(keep)).select(["dim", "t", "key", "rep", "code"])

    return run


def _counts_here(cx: np.ndarray, cy: np.ndarray, t: np.ndarray, key: np.ndarray, index: Index) -> np.ndarray:
    """Whether a pair of rows of codes counts in bucket (t, key): its first table, and the smallest common entry there."""
    near = np.bitwise_count(cx ^ cy) <= index.far
    ok = np.ones(len(cx), bool)
    own = np.zeros(len(cx), np.uint64)
    diff = np.zeros(len(cx), np.uint64)
    for k, (rotation, _) in enumerate(index.tables):
        a = index.stretches(cx, k)
        d = a ^ index.stretches(cy, k)
        # Only where the pair's codes of the rotation are near enough is it certain to have been looked at.
        ok &= ~((np.bitwise_count(d) <= 2) & near[:, rotation] & (k < t))
        own, diff = np.where(k == t, a, own), np.where(k == t, d, diff)
    low = diff & (~diff + np.uint64(1))
    n = np.bitwise_count(diff)
    first = np.where(n == 0, own, np.where(n == 1, np.minimum(own, own ^ diff), np.minimum(own ^ low, own ^ diff ^ low)))
    here = near[np.arange(len(cx)), np.array([r for r, _ in index.tables])[t]]
    return ok & (n <= 2) & here & (first == key.astype(np.uint64))


def _rerank(width: int, index: Index, least: float):
    """Of block pairs, rows (a, b, more): a link that connects a and b, or b NULL and what to add to the count of a."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["dim", "t", "key", "bi", "bj"]
        for batch in _whole_groups(batches, by, 8192):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            num = {n: col[n].to_numpy() for n in by + ["rep", "blk", "copies"]}
            x, codes, rep, copies = _matrix(col["embedding"], width), _all_codes(col["codes"]), num["rep"], num["copies"]
            starts = _starts(*[num[n] for n in by])
            stops = np.append(starts[1:], len(rep))
            left, right = [], []
            for s, e in zip(starts, stops):
                if e - s < 2:
                    continue
                i, j = np.nonzero(x[s:e] @ x[s:e].T >= least)
                ok = i < j
                left.append(i[ok] + s)
                right.append(j[ok] + s)
            if not left:
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            ok = _counts_here(codes[i], codes[j], num["t"][i].astype(np.int64), num["key"][i], index)
            ok &= (num["bi"][i] == num["bj"][i]) | (num["blk"][i] != num["blk"][j])
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            who = np.concatenate((rep[i], rep[j]))
            ids, at = np.unique(who, return_inverse=True)
            total = np.bincount(at, np.concatenate((copies[j], copies[i]))).astype(np.int64)
            a, b = _forest(np.searchsorted(ids, rep[i]), np.searchsorted(ids, rep[j]), len(ids))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((ids, ids[a]))), pa.array(np.concatenate((np.zeros(len(ids), np.int64), ids[b])), mask=np.arange(len(ids) + len(a)) < len(ids)),
                pa.array(np.concatenate((total, np.zeros(len(a), np.int64))))], names=["a", "b", "more"])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (component's smallest, member) that connect what the links i, j connect."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new][root]
        if (new == root).all():
            break
        root = new
    b = np.flatnonzero(root != np.arange(n))
    return root[b], b


def near_vectors(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS,
                 recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked where their cosine in double precision is ``least`` or more.

    Vectors that are NULL, empty, zero, or hold a NULL or non-finite component link with nothing; vectors of different lengths do not
    link. Equal vectors are one entry of the index and link with each other; repeated rows count as vectors. An empty table gives an
    empty result. Links are those that the index finds, at least ``recall`` of the pairs at ``least`` and more of nearer ones; none lies below ``least``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = F.coalesce(F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)) & F.exists("embedding", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(sound, F.transform("embedding", lambda c: c + 0.0)))
    classes = stored(rows.filter("embedding IS NOT NULL").groupBy("embedding").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("embedding")), "vectors")
    n, width = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return plain
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()
    index = design(_matrix(sample.column(0).combine_chunks(), width), n, least, bits, recall)
    classes = stored(classes.select("rep", "embedding", "copies", "dim").mapInArrow(
        _coded(width, index), "rep long, embedding array<double>, copies long, dim int, codes binary"), "codes")

    entries = classes.select("rep", "codes", "dim").mapInArrow(_entries(index), "dim int, t int, key long, rep long, code long")
    sizes = entries.groupBy("dim", "t", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    slices = F.ceil(F.col("size") / 4096).cast("int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = entries.join(sizes, ["dim", "t", "key"]).withColumn("crowded", F.col("size") > 4096).withColumn(
        "slice", F.pmod(F.xxhash64("rep"), slices).cast("int"))
    near = met.select("dim", "t", "key", "slice", "rep", "code", "crowded").repartition(parts, "dim", "t", "key", "slice").sortWithinPartitions(
        "dim", "t", "key", "slice").mapInArrow(_near_codes(index.far), "dim int, t int, key long, rep long, code long")
    near = stored(near, "near-codes")
    blocks = near.groupBy("dim", "t", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = near.join(blocks, ["dim", "t", "key"]).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Block b takes part in the pairs (b, 0) to (b, last), written with the smaller number first.
    paired = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "dim", "t", "key", "rep", "blk", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"))
    ready = paired.join(classes.select("rep", "embedding", "copies", "codes"), "rep").repartition(parts, "dim", "t", "key", "bi", "bj").sortWithinPartitions(
        "dim", "t", "key", "bi", "bj")
    found = stored(ready.mapInArrow(_rerank(width, index, least), "a long, b long, more long"), "vector-links")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("more").alias("links"))
    comp = components(found.filter("b IS NOT NULL").select("a", "b"))
    info = classes.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(info, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))
