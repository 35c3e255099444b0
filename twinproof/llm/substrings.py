"""Removal of repeated passages by merged Burrows-Wheeler transforms (operator 6).

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes, same text included. Three steps:

1. *Where to look.* Of each window of ``length`` bytes, one anchor is chosen by its content (the smallest hash of the
   32-byte grams in it), so equal windows choose equal anchors at equal places. Windows with one anchor form a
   context, a stretch of the text. Only anchors that occur twice matter, and contexts that are equal as a whole are one.
2. *What repeats there.* The different contexts of repeated anchors are dealt out by anchor, crowded anchors split
   by the bytes around them. A task takes them in
   shards. A shard's transform is over symbols of 50 bytes (a suffix is a position and the symbols at every 50th byte from it):
   it is sorted once. The transforms of all shards of a batch are merged by refining their interleave, one symbol a round,
   without sorting suffixes again; the rounds also tell where neighbours first differ, so after ``length / 50`` rounds the blocks that were
   never divided are the repeated strings.
3. *Removal.* Repeated windows go back to every place where their context occurs, and texts are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.base import joined_by_share, mix, slices, stored

LENGTH, GRAM, SYMBOL = 200, 32, 50
#: Bytes of contexts merged at once in a task, and the shards they come in.
BATCH, SHARDS = 3 << 18, 8
#: Different contexts of one anchor beyond which the anchor is split by what stands around it.
CROWD = 20_000
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            x = np.full(max(n, 1 << 20), base, np.uint64)
            x[0] = 1
            have = _powers[name] = np.multiply.accumulate(x)
    return have[:n]


class Prefixes:
    """Hashes of any stretches of a byte array, from running sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_B, len(data), "b"), out=self.sums[1:])
        self.down = _power(_BINV, len(data) + 1, "inv")

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def window_anchors(data: np.ndarray, hashes: Prefixes, length: int) -> np.ndarray:
    """For each window of ``length`` bytes of ``data``, the position of its anchor gram."""
    w = length - GRAM + 1
    h = hashes.grams(GRAM)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(v) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max)
    padded[: len(v)] = v
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - w + 1
    return (np.minimum(behind[:n], ahead[w - 1: w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Contexts of texts: index of the text, first window, number of windows, anchor's hash, hash of the context."""
    long = [(i, t) for i, t in enumerate(texts) if len(t) >= length]
    if not long:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    data = np.frombuffer(b"".join(t for _, t in long), np.uint8)
    sizes = np.array([len(t) for _, t in long])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    hashes = Prefixes(data)
    anchor = window_anchors(data, hashes, length)
    inside = np.ones(len(anchor), bool)
    for e in np.cumsum(sizes)[:-1]:
        inside[e - length + 1: e] = False
    edge = np.ones(len(anchor), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] & ~inside[:-1])
    first = np.flatnonzero(edge & inside)
    # A run ends where the next begins or the text's windows end.
    owner = np.searchsorted(starts, first, "right") - 1
    last = np.concatenate((first[1:], [len(anchor)]))
    last = np.minimum(last, starts[owner] + sizes[owner] - length + 1)
    a = anchor[first]
    with np.errstate(over="ignore"):
        whole = hashes.of(first, last + length - 1) + mix(((a - first) * 100_003 + (last - first)).astype(np.uint64))
    key = hashes.of(a, a + GRAM)
    index = np.array([i for i, _ in long])
    return index[owner], first - starts[owner], last - first, key.view(np.int64), whole.view(np.int64)


def _packed(texts) -> list[bytes]:
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(t) for t in texts]


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text, kept) to (row, doc_id, compressed UTF-8, kept)."""
    for batch in slices(batches):
        z = _packed((t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary()), batch.column(3)], names=["row", "doc_id", "z", "kept"])


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.column(0)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):  # about half a megabyte at a time
                end, size = at, 0
                while end < len(texts) and (size < 1 << 19 or end == at):
                    size += len(texts[end])
                    end += 1
                i, first, n, key, ctx = contexts(texts[at:end], length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ctx), rows.slice(at, end - at).take(pa.array(i)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int16))],
                    names=["key", "ctx", "row", "first", "n"])
                at = end

    return run


# --- Burrows-Wheeler transforms -----------------------------------------------------------------------------------

def _sorted_by(c: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative keys."""
    x = (c.astype(np.uint64) << np.uint64(32)) | np.arange(len(c), dtype=np.uint64)
    x.sort()
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def transform(symbols: np.ndarray, follow: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffixes in order of their first ``depth`` symbols, and the symbol before each (0: none).

    ``symbols``: of each row, 0 being the end row of a string; ``follow``: the row of the next symbol (own row at an end).
    """
    order = np.arange(len(symbols))
    rank = np.empty(len(symbols), np.int64)
    for _ in range(depth):
        rank[order] = np.arange(len(order))
        by_next = np.argsort(rank[follow], kind="stable") if len(order) else order
        order = by_next[_sorted_by(symbols[by_next])]
    before = np.zeros(len(symbols), np.int64)
    inner = symbols > 0
    before[follow[inner]] = symbols[inner]
    return order, before[order]


def interleave(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: the shard of each merged row, and the rows' blocks after ``rounds`` symbols.

    Round by round the interleave is dealt out by the symbol before each row, which orders rows by one symbol more. A
    row starts a block where its symbol or the block it came from differs from its neighbour's, that is, where the common prefix
    ends in this round; ends of strings are blocks of their own.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.int32), [len(t) for t in transforms])
    block = np.zeros(len(shard), np.int64)
    symbols = np.empty(len(shard), np.int64)
    for _ in range(rounds):
        for s, t in enumerate(transforms):
            symbols[shard == s] = t
        order = _sorted_by(symbols)
        shard, c, b = shard[order], symbols[order], block[order]
        new = np.ones(len(shard), bool)
        new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (c[1:] == 0)
        block = np.cumsum(new)
    return shard, block


def repeated_windows(texts: list[bytes], length: int = LENGTH, shards: int = SHARDS) -> list[np.ndarray]:
    """Of each text, whether the window of ``length`` bytes that starts at each place starts anywhere else in the texts."""
    out = [np.zeros(max(0, len(t) - length + 1), bool) for t in texts]
    if not any(len(o) for o in out):
        return out
    step = SYMBOL if length % SYMBOL == 0 else 1
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = np.maximum(sizes - step + 1, 0)  # places with a whole symbol
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    _, names = np.unique(Prefixes(data).grams(step)[starts[text] + place], return_inverse=True)
    names = names + 1
    cuts = np.searchsorted(np.cumsum(n), np.linspace(0, n.sum(), min(shards, len(texts)) + 1)[1:-1])
    bounds = [0, *np.unique(cuts).tolist(), len(texts)]
    parts, orders = [], []
    for lo, hi in zip(bounds, bounds[1:]):
        mine = slice(int(n[:lo].sum()), int(n[:hi].sum()))
        t, p, m = text[mine], place[mine], mine.stop - mine.start
        more = p + step < n[t]
        ends = np.flatnonzero(~more)
        follow = np.arange(m + len(ends))
        follow[:m][more] = np.flatnonzero(more) + step
        follow[ends] = m + np.arange(len(ends))
        order, before = transform(np.concatenate((names[mine], np.zeros(len(ends), np.int64))), follow, length // step)
        parts.append(before)
        orders.append(np.where(order < m, order + mine.start, -1))
    shard, block = interleave(parts, length // step)
    rows = np.empty(len(shard), np.int64)
    for s, o in enumerate(orders):
        rows[shard == s] = o
    again = np.zeros(len(block), bool)
    again[1:] = block[1:] == block[:-1]
    again[:-1] |= again[1:]
    rows = rows[again & (rows >= 0)]
    flags = np.zeros(len(text), bool)
    flags[rows] = True
    for i, o in enumerate(out):
        at = int(n[:i].sum()) if i < 2 else at + int(n[i - 1])
        o[:] = flags[at: at + len(o)]
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _cut_out(length: int):
    """Fetch the contexts that a text stands for: (key, ctx, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            keys, ctxs, parts = [], [], []
            for z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = press.decompress(z)
                for w in wanted:
                    keys.append(w["key"])
                    ctxs.append(w["ctx"])
                    parts.append(t[w["first"]: w["first"] + w["n"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ctxs, pa.int64()), pa.array(parts, pa.binary())],
                                             names=["key", "ctx", "bytes"])

    return run


_PIECE = "g long, key long, ctx long, at int, lo int, hi int, bytes binary, h long"


def _split(length: int, ways: int = 4):
    """Contexts to pieces: windows with the anchor in one of ``ways`` ranges of places in them.

    The windows of a range share a core of bytes around the anchor, so equal windows have equal cores: pieces are
    grouped by core. A range of one place has the window itself for its core.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, ctx, at, lo, hi, data in zip(*(batch.column(n).to_pylist() for n in ("key", "ctx", "at", "lo", "hi", "bytes"))):
                first = np.frombuffer(data[:length], np.uint8)
                anchor = int(window_anchors(first, Prefixes(first), length)[0])
                bounds = sorted({lo + (hi - lo) * k // ways for k in range(ways + 1)})
                for a, b in zip(bounds, bounds[1:]):
                    start, stop = max(0, anchor - b + 1), min(len(data) - length, anchor - a)
                    if start <= stop:
                        core = data[anchor - a: anchor - b + 1 + length]
                        piece = data[start: stop + length]
                        out.append((xxhash.xxh3_64_intdigest(core, key & 0xFFFF ^ a << 20) - (1 << 63), key, ctx, at + start, a, b, piece,
                                    xxhash.xxh3_64_intdigest(piece) - (1 << 63)))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["g", "key", "ctx", "at", "lo", "hi", "bytes", "h"])

    return run


def _spread(parts: DataFrame, length: int, crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """Contexts (key, ctx, bytes) as groups (g, ...) of at most about ``crowd``, and the windows already found to repeat.

    A crowded anchor is split again and again; of equal pieces one stays, and all are repeated. This ends with ranges of one place,
    where all pieces of a group are equal.
    """
    rows = stored(parts.select(F.col("key").alias("g"), "key", "ctx", F.lit(0).alias("at"), F.lit(0).alias("lo"), F.lit(length - GRAM + 1).alias("hi"), "bytes",
                               F.lit(0).cast("long").alias("h")), "contexts")
    cool, found = None, None
    while True:
        sizes = stored(rows.groupBy("g").agg(F.count(F.lit(1)).alias("times")), "groups")
        crowded = stored(sizes.filter(F.col("times") > crowd).select("g"), "crowded")
        rest = joined_by_share(rows, crowded, ["g"], sizes, "left_anti")
        cool = rest if cool is None else cool.unionByName(rest)
        if crowded.isEmpty():
            return cool, found
        pieces = stored(joined_by_share(rows, crowded, ["g"], sizes, "left_semi").mapInArrow(_split(length), _PIECE), "pieces")
        equal = stored(pieces.groupBy("g", "h").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "ctx", "at")).alias("one")), "equal")
        windows = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.length("bytes") - length + 1).cast("int").alias("b")))
        again = joined_by_share(pieces, equal.filter("times > 1").select("g", "h"), ["g", "h"], equal, "left_semi").select("key", "ctx", windows.alias("runs"))
        found = again if found is None else found.unionByName(again)
        several = equal.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g")
        kept = equal.select("g", "h", "one.*").join(several, "g", "left_semi")
        rows = stored(pieces.join(kept, ["g", "h", "key", "ctx", "at"], "left_semi").select(*rows.columns), "contexts")


def _merge(length: int):
    """Repeated windows of contexts that come sorted by group: (key, ctx, runs)."""
    def solve(held):
        found = repeated_windows([h[4] for h in held], length)
        rows = []
        for (_, key, ctx, at, _), flags in zip(held, found):
            if flags.any():
                a, b = _runs(flags)
                rows.append((key, ctx, [{"a": int(x) + at, "b": int(y) + at} for x, y in zip(a, b)]))
        return pa.RecordBatch.from_pylist([dict(zip(("key", "ctx", "runs"), r)) for r in rows], schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return run


_RUNS = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _removed(length: int, whole_characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, z, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                t = press.decompress(z)
                marks = np.zeros(len(t) + 1, np.int32)
                for r in runs or ():
                    marks[r["a"]] += 1
                    marks[r["b"] + length - 1] -= 1
                gone = np.cumsum(marks[:-1]) > 0
                n, spans = int(gone.sum()), len(_runs(gone)[0]) if len(gone) else 0
                if n:
                    data = np.frombuffer(t, np.uint8)
                    if whole_characters:  # a character goes if all of its bytes do
                        first = np.flatnonzero((data & 0xC0) != 0x80)
                        gone = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(data))))
                    t = data[~gone].tobytes()
                out.append((doc, len(marks) - 1, n, spans, t))
            ids, size, n, spans, rest = zip(*out) if out else ((),) * 5
            arrays = [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.int64())]
            if whole_characters:
                last = pa.array([x.decode("utf-8", "replace") for x in rest], pa.string())
            else:
                last = pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, last, batch.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "rest", "kept"])

    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                      keep: list[str] | None = None, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Texts (row, doc_id, z: compressed UTF-8, kept: a struct of the columns ``keep``) and, for rows with any, the repeated windows (row, runs of starts a to b).

    Rows are told apart by 128 bits of a hash of id and text, so repeated rows count as copies of each other.
    """
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(name.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.struct(F.lit(0).alias("_"), *keep or []).alias("kept"))
    anchors = stored(rows.select("row", "text").mapInArrow(_anchors(length), "key long, ctx long, row binary, first int, n short"), "anchors")
    twice = stored(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "twice")
    places = stored(joined_by_share(anchors, twice.select("key"), ["key"], twice, "left_semi"), "places")
    kinds = stored(places.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first", "n")).alias("at")), "kinds")
    # One place stands for all that are equal; a text yields its own contexts, as many as it has anchors.
    several = stored(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "several")
    wanted = joined_by_share(kinds, several.select("key"), ["key"], several, "left_semi")
    by_row = wanted.select("key", "ctx", "at.*").groupBy("row").agg(F.collect_list(F.struct("key", "ctx", "first", "n")).alias("wanted"))
    kind = rows.schema["kept"].dataType.simpleString()
    pressed = rows.select("row", "doc_id", "text", "kept").mapInArrow(compressed, f"row binary, doc_id long, z binary, kept {kind}")
    parts = pressed.select("row", "z").join(by_row, "row").select("z", "wanted").mapInArrow(_cut_out(length), "key long, ctx long, bytes binary")
    groups, found = _spread(parts.dropDuplicates(["key", "ctx"]), length, crowd)
    merged = groups.select("g", "key", "ctx", "at", "bytes").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions(
        "g").mapInArrow(_merge(length), "key long, ctx long, runs array<struct<a int, b int>>")
    merged = merged if found is None else merged.unionByName(found)
    all_of = F.array(F.struct(F.lit(0).alias("a"), F.col("at.n").cast("int").alias("b")))
    runs = stored(kinds.filter("times > 1").select("key", "ctx", all_of.alias("runs")).unionByName(
        merged.join(kinds.filter("times > 1").select("key", "ctx"), ["key", "ctx"], "left_anti")), "runs")
    marked = joined_by_share(places, runs, ["key", "ctx"], kinds, "inner").select("row", F.transform("runs", lambda r: F.struct(
        (r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b"))).alias("runs")).distinct()
    return pressed, marked.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def cut_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", texts: bool = False,
                 keep: list[str] | None = None, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what is left; with ``texts`` what is left itself, as ``text``.

    ``text`` keeps characters whole: one goes if all its bytes go. ``keep``: further columns of ``docs`` to carry. A NULL text is empty; texts shorter than ``length`` lose nothing; very long
    texts are worked on whole; repeated rows are copies, and lose everything; an empty table gives an empty result.
    """
    keep = keep or []
    pressed, marked = repeated_passages(docs, length, id_col, text_col, keep, crowd)
    kind = pressed.schema["kept"].dataType.simpleString()
    out = pressed.join(marked, "row", "left").select("doc_id", "z", "runs", "kept").mapInArrow(
        _removed(length, texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, rest string, kept {kind}")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("rest").alias("text" if texts else "kept_sha256"),
                      *[F.col("kept")[c].alias(c) for c in keep])
