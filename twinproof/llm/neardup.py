"""Near-duplicates by SetSketch registers (operator 1).

A document is the set of its word shingles. Register ``i`` of its sketch is ``floor(1 - log_b(x_i / rate))``, clipped, where ``x_i`` is the
smallest of exponential variables that hashing gives the shingles: exponentially spaced truncated minima. Sketches merge by the larger
register and agree where sets are alike. Bands of registers propose candidates; the similarity of two documents is estimated from all
registers and both set sizes by likelihood, and what could still reach the threshold is compared on the full sets.

Work on a group of copies stays linear in what is written. Texts with the same words are one class. Each bucket of a band has one hub,
the member that shares most buckets with others, so that hubs repeat over bands; a bucket's members meet at
their hub. First all members are compared with the hub. Where members then still lie in several components, the ones outside the hub's
are compared with the whole cluster, in blocks of bounded size; blocks write their links, and no more than two for a member and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.base import mix, odd_constants, slices, stored
from twinproof.llm.components import components

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65_534
#: Log-likelihood that a pair may lie below its maximum and still be verified: exceeded by chance about once in 10^8 pairs.
SLACK = 16.0
BLOCK = 512
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Hashes(dict):
    """Word hashes of one batch of rows."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, a text without words none."""
    ws = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    k = min(width, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i: len(h) - k + 1 + i])
        return np.unique(mix(out + np.uint64(len(h) if len(h) < width else width)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, a row for each non-empty set."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.concatenate(sets)
    low = np.empty((len(sets), REGISTERS), np.uint64)
    a, c = odd_constants(REGISTERS, 1), odd_constants(REGISTERS, 2)
    with np.errstate(over="ignore"):
        for j in range(REGISTERS):
            low[:, j] = np.minimum.reduceat(flat * a[j] + c[j], starts)
    uniform = (low >> np.uint64(11)).astype(np.float64) / 2.0**53
    x = -np.log1p(-uniform) / RATE
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(x) / np.log(BASE))
    # Truncated to the range of the register: below, sets of one shingle start well above 0; above, 10^28 shingles.
    return np.clip(k, 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def log_likelihoods(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log-likelihood of each similarity in ``grid`` (columns) given how many registers of one sketch lie above and
    below the other's, and the sizes of both sets."""
    n, m = n[:, None].astype(float), m[:, None].astype(float)
    u, v, j = n / (n + m), m / (n + m), np.minimum(grid[None, :], np.minimum(n, m) / np.maximum(n, m))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    same = np.maximum(1 - more - less, 1e-12)
    above, below = above[:, None], below[:, None]
    return above * np.log(more) + below * np.log(less) + (REGISTERS - above - below) * np.log(same)


def may_reach(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of sketches could be ``least`` similar: by size, and by likelihood."""
    grid = np.linspace(0, 1, 101)
    ll = log_likelihoods((x > y).sum(1), (x < y).sum(1), n, m, grid)
    fits = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9
    return fits & (ll[:, grid >= least - 1e-9].max(1) >= ll.max(1) - SLACK)


def sketched(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, same (two hashes of the word sequence), sketch (bytes; NULL without words)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches):
            if len(known) > 200_000:
                known.clear()
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sets = [shingle_hashes(t, width, known) for t in texts]
            same = [_same(t) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            out: list[bytes | None] = [None] * len(sets)
            # A few documents at a time, so that what is hashed stays in the cache.
            at = 0
            while at < len(full):
                end, size = at, 0
                while end < len(full) and (size < 30_000 or end == at):
                    size += len(sets[full[end]])
                    end += 1
                for i, row in zip(full[at:end], sketches([sets[i] for i in full[at:end]])):
                    out[i] = row.tobytes()
                at = end
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(out, pa.binary())],
                names=["doc_id", "n_shingles", "same", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "doc_id long, n_shingles long, same binary, sketch binary")


def _same(text: str | None) -> bytes:
    """Name of a text's word sequence."""
    return xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())) if text else b""


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text, n, sketch, same) to (doc_id, set, n, sketch): the sorted shingle hashes as bytes, of texts that are ``same``."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches):
            if len(known) > 200_000:
                known.clear()
            # An id may carry several texts; a class has the one it was made of.
            batch = batch.filter(pa.array([_same(t) == s for t, s in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())], pa.bool_()))
            sets = [shingle_hashes(t, width, known).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "set", "n", "sketch"])

    return docs.select("doc_id", "text", "n", "sketch", "same").mapInArrow(make, "doc_id long, set binary, n long, sketch binary")


def linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of ``sets``, of ``others``) with 100 x intersection >= percent x union, by counting shared hashes."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(s) for s in sets])
    left, right = [], []
    for k, other in enumerate(others):
        lo, hi = np.searchsorted(flat, other, "left"), np.searchsorted(flat, other, "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            continue
        take = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        shared = np.bincount(owner[take], minlength=len(sets))
        hit = np.flatnonzero((100 * shared >= percent * (sizes + len(other) - shared)) & (shared > 0))
        left.append(hit)
        right.append(np.full(len(hit), k))
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def _verify(percent: int):
    """Links between the asking and the other rows of a block: each other row's first link into each component of askers."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asking, other = frame[frame["asks"]], frame[~frame["asks"]]
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(asking) or not len(other):
            return none
        x = [np.frombuffer(s, np.uint64) for s in asking["set"]]
        y = [np.frombuffer(s, np.uint64) for s in other["set"]]
        i, k = linked(x, y, percent)
        a, b = asking["doc_id"].to_numpy()[i], other["doc_id"].to_numpy()[k]
        ca, cb = asking["comp"].to_numpy()[i], other["comp"].to_numpy()[k]
        keep = ca != cb
        got = pd.DataFrame({"a": a[keep], "b": b[keep], "ca": ca[keep], "cb": cb[keep]})
        # What joins the same two components is one link; copies of one text link in long chains otherwise.
        return got.drop_duplicates(["ca", "cb"])[["a", "b"]] if len(got) else none

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where 100 x intersection >= ``percent`` x union.

    A document with fewer than ``width`` words is one shingle; one without words, empty or NULL, is linked with nothing.
    Repeated rows (of the same or of different ids) with the same words share a component, and an id that carries several texts
    links what each of them is linked with; ``kept`` holds for the smallest id of a component (for each row that carries it).
    An empty table gives an empty result.
    """
    base = stored(sketched(docs, width, id_col, text_col), "sketches")
    classes = stored(
        base.filter("sketch IS NOT NULL").groupBy("same").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        # Classes have numbers of their own, for the smallest ids of two may be one.
        .withColumn("rep", F.monotonically_increasing_id()), "classes")

    # Buckets: one row per class and band; those of a single class say nothing.
    buckets = classes.select("rep", F.posexplode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(substring(sketch, i * {2 * ROWS} + 1, {2 * ROWS}), i))")).alias("band", "key"))
    sizes = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    crowded = stored(buckets.join(sizes, ["band", "key"]), "buckets")
    degree = crowded.groupBy("rep").agg(F.sum("size").alias("degree"))
    hubs = crowded.join(degree, "rep").groupBy("band", "key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("hub"))
    clusters = stored(crowded.join(hubs, ["band", "key"]).select("hub", "rep").distinct(), "clusters")

    # Full sets of the classes that are in some cluster; computed anew from the texts, which is less than keeping all.
    members = clusters.select(F.col("rep").alias("doc_id")).distinct()
    info = classes.select(F.col("rep").alias("doc_id"), "id", "n", "sketch", "same").join(members, "doc_id", "left_semi")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The members grow with the corpus, so they are never broadcast, and texts need no sort to meet them; all that is needed of a class is joined before the sets are made.
    sets = stored(shingle_sets(texts.join(info.hint("shuffle_hash"), "id").withColumn("_text", F.md5("text")).dropDuplicates(["id", "doc_id", "_text"]), width), "sets")

    # Members against their hub: by likelihood first, then on full sets.
    hub_sketch = sets.select(F.col("doc_id").alias("hub"), F.col("sketch").alias("x"), F.col("n").alias("nx"))
    pairs = clusters.filter("hub <> rep").join(hub_sketch, "hub").join(
        sets.select(F.col("doc_id").alias("rep"), F.col("sketch").alias("y"), F.col("n").alias("ny")), "rep")
    near = stored(pairs.select("hub", "rep", "x", "nx", "y", "ny").mapInArrow(_likely(percent / 100), "hub long, rep long"), "near")
    # The hub's own row is repeated for each block of its members.
    block = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)))
    cut = near.join(near.groupBy("hub").agg(F.count(F.lit(1)).alias("size")), "hub").select("hub", block.alias("block"), "rep")
    asks = cut.select("hub", "block", F.col("rep").alias("doc_id"), F.lit(False).alias("asks")).union(
        cut.select("hub", "block", F.col("hub").alias("doc_id"), F.lit(True).alias("asks")).distinct())
    whole = asks.join(sets.select("doc_id", "set"), "doc_id").withColumn("comp", F.col("doc_id"))
    first = stored(whole.groupBy("hub", "block").applyInPandas(_verify(percent), "a long, b long"), "first-links")
    done = stored(components(first), "components")

    # Clusters that still hold several components: those outside the hub's component against all of the cluster.
    comp = F.coalesce("component", "doc_id").alias("comp")
    placed = clusters.select("hub", F.col("rep").alias("doc_id")).join(done.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("hub", "doc_id", comp)
    main = placed.filter("hub = doc_id").select("hub", F.col("comp").alias("main"))
    placed = placed.join(main, "hub").withColumn("outside", F.col("comp") != F.col("main"))
    count = placed.groupBy("hub").agg(F.sum(F.col("outside").cast("long")).alias("n_out"), F.count(F.lit(1)).alias("n_all")).filter("n_out > 0")
    spread = stored(placed.join(count, "hub").withColumns({
        "rows": F.ceil(F.col("n_out") / BLOCK), "cols": F.ceil(F.col("n_all") / BLOCK)}), "spread")
    at = F.xxhash64("doc_id")
    ask = spread.filter("outside").select("hub", "doc_id", "comp", F.lit(True).alias("asks"), F.pmod(at, F.col("rows")).alias("r"),
                                          F.explode(F.expr("sequence(0L, cols - 1)")).alias("c"))
    other = spread.select("hub", "doc_id", "comp", F.lit(False).alias("asks"), F.explode(F.expr("sequence(0L, rows - 1)")).alias("r"),
                          F.pmod(at, F.col("cols")).alias("c"))
    whole = ask.unionByName(other).join(sets.select("doc_id", "set"), "doc_id")
    second = whole.groupBy("hub", "r", "c").applyInPandas(_verify(percent), "a long, b long")
    # Classes that share an id.
    several = base.filter("sketch IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("same").alias("x"), F.max("same").alias("y")).filter("x <> y")
    shared = base.filter("sketch IS NOT NULL").join(several, "doc_id", "left_semi").select("doc_id", "same").distinct().join(classes.select("same", "rep"), "same")
    by_id = shared.join(shared.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
    final = stored(components(first.union(second).union(by_id)), "components").withColumnRenamed("node", "rep")

    # A component is named by the smallest id of its classes.
    least = final.join(classes.select("rep", "id"), "rep").groupBy("component").agg(F.min("id").alias("least"))
    rep = classes.select("same", "rep", "id").join(final.join(least, "component"), "rep", "left").select(
        "same", F.coalesce("least", "id").alias("component"))
    out = base.select("doc_id", "n_shingles", F.when(F.col("sketch").isNotNull(), F.col("same")).alias("same")).join(rep, "same", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            hub, rep, x, nx, y, ny = (batch.column(i) for i in range(6))
            read = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, REGISTERS)
            ok = pa.array(may_reach(read(x), read(y), nx.to_numpy(), ny.to_numpy(), least))
            yield pa.RecordBatch.from_arrays([hub.filter(ok), rep.filter(ok)], names=["hub", "rep"])

    return run
