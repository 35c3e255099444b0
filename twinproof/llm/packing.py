"""Best-fit packing (operator 10).

Documents become pieces of at most ``size`` tokens. Pieces are counted by length within each partition; a partition is
packed by best-fit decreasing over these counts, and its number of bins is held against a lower bound by dual feasible functions.
A partition that meets it is certified and waits. One with a gap gives the pieces of its bins that are not full back; partitions with gaps
meet in a quarter of their number, where the pieces are packed again. Rounds end when the bins of all partitions are as few as the bound of
all pieces, or when one group is left; then those that waited take part too. ``certificate`` tells the bins of a packing and their bound. What travels between partitions are counts by length (at most ``size`` rows a
partition); pieces take their places by rank within their length afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.base import slices, stored
from twinproof.llm.tokens import END, encoder, vocabulary_path

SIZE = 1024
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = True,
                    vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and (``with_ids``) the ids as bytes.

    A document is its ids and then ``end``; NULL and empty texts are the end alone. A document of more than ``size``
    ids is cut into pieces of ``size``, the first of which is shorter where the length is no multiple.
    """
    path = vocabulary or vocabulary_path()
    stop = np.array([end], dtype="<u4").tobytes()
    names = [n for n in _PIECES.names if with_ids or n != "ids"]
    schema = pa.schema([_PIECES.field(n) for n in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encode(text) + stop
                n = len(data) // 4
                at, take = 0, n % size or size
                for k in range(-(-n // size)):
                    part = data[4 * at: 4 * (at + take)]
                    out.append((i, k, at, take, zlib.crc32(part), part))
                    at, take = at + take, size
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    kinds = {"int64": "long", "int32": "int", "binary": "binary"}
    return rows.mapInArrow(cut, ", ".join(f"{n} {kinds[str(schema.field(n).type)]}" for n in names))


def lower_bound(counts: dict[int, int], size: int = SIZE) -> int:
    """Bins that any packing needs, by the dual feasible functions that round large items up and drop small ones."""
    lengths = np.array(sorted(k for k, c in counts.items() if c), dtype=np.int64)
    if not len(lengths):
        return 0
    c = np.array([counts[int(k)] for k in lengths], dtype=np.int64)
    best = -(-int((lengths * c).sum()) // size)
    # u_e: items over size - e count as a whole bin, items under e as nothing.
    for e in lengths[lengths <= size // 2]:
        big, mid = lengths > size - e, (lengths >= e) & (lengths <= size - e)
        best = max(best, int(c[big].sum()) + -(-int((lengths * c)[mid].sum()) // size))
    # f_k: an item of length x counts as floor((k+1) x / size) k-ths, and exactly x where (k+1) x is a multiple.
    for k in range(1, 40):
        whole = (k + 1) * lengths % size == 0
        value = np.where(whole, lengths * k, (k + 1) * lengths // size * size)
        best = max(best, -(-int((value * c).sum()) // (size * k)))
    return best


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counted lengths: (lengths of a bin, number of such bins).

    All items of one length are placed together: as many as fit go to the bins with the least room that still takes
    them, so the work follows the number of different bins, not of items.
    """
    rooms: dict[int, dict[tuple[int, ...], int]] = {}

    def put(bin_, n):
        room = size - sum(bin_)
        rooms.setdefault(room, {})
        rooms[room][bin_] = rooms[room].get(bin_, 0) + n

    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        left = counts[length]
        for room in sorted(r for r in rooms if r >= length):
            for bin_ in list(rooms[room]):
                if not left:
                    break
                n, fits = rooms[room].pop(bin_), room // length
                full = min(n, left // fits)
                if full:
                    put(bin_ + (length,) * fits, full)
                    left -= full * fits
                    n -= full
                if n and left and left < fits:
                    put(bin_ + (length,) * left, 1)
                    left, n = 0, n - 1
                if n:
                    rooms[room][bin_] = rooms[room].get(bin_, 0) + n
            if not left:
                break
        fits = size // length
        if left // fits:
            put((length,) * fits, left // fits)
        if left % fits:
            put((length,) * (left % fits), 1)
    return [(b, n) for bins in rooms.values() for b, n in bins.items()]


def plan_bins(counts: DataFrame, size: int = SIZE, parts: int = 1) -> DataFrame:
    """Bins for counted lengths (part, length, n): columns bin (array of lengths) and n, the number of such bins.

    Each round packs every part by best fit. A part whose number of bins equals its lower bound by dual feasible functions is certified:
    no packing of its pieces takes fewer, and its bins are held back. Only parts with a gap exchange the pieces of bins that are not full (full ones are done):
    they meet in a quarter of the parts and are packed anew. As soon as all bins together are as few as the bound of all pieces, the
    whole plan is certified and nothing is exchanged any more. If the parts with gaps end in one and bins remain above that bound, the
    bins held back take part once more, for pieces of other parts may fill their room; then only parts that fill their bins, but for one, are done.
    A part holds at most ``size`` rows at any input size, for it is counts that travel; so does the driver.
    """
    def packer(hold: bool):
        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            counted = {int(k): int(c) for k, c in frame.groupby("length")["n"].sum().items()}
            bins = sorted(best_fit(counted, size), key=lambda x: sum(x[0]))
            used = sum(n for _, n in bins)
            filled = used == -(-sum(k * c for k, c in counted.items()) // size)
            rest = ("held" if used == lower_bound(counted, size) else "open") if hold else "done" if filled else "open"
            rows = [("done" if sum(b) == size else rest, list(b), n) for b, n in bins]
            if filled and not hold and rows and sum(bins[0][0]) < size:
                # The emptiest bin may have room left by rounding.
                (_, b, n), *others = rows
                rows = [("open", b, 1), *([("done", b, n - 1)] if n > 1 else []), *others]
            return pd.DataFrame(rows, columns=["state", "bin", "n"]).assign(part=int(frame["part"].iloc[0]))

        return pack

    bound, start, hold, closed = bound_of(counts, size), parts, True, 0
    out, back = [], []
    while True:
        bins = stored(counts.groupBy("part").applyInPandas(packer(hold), "state string, bin array<int>, n long, part int"), "bins")
        n = {r["state"]: r["n"] for r in bins.groupBy("state").agg(F.sum("n").alias("n")).collect()}
        out.append(bins.filter("state = 'done'"))
        back.append(bins.filter("state = 'held'"))
        closed += n.get("done", 0) + n.get("held", 0)
        opened = bins.filter("state = 'open'")
        ended = parts == 1 or not n.get("open")
        if closed + n.get("open", 0) == bound or ended and not hold:
            return reduce(DataFrame.unionByName, [*out, *back, opened]).select("bin", "n")
        if ended:
            held = reduce(DataFrame.unionByName, back)
            closed -= held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            opened, hold, parts, back = opened.unionByName(held), False, start, []
        parts = max(1, parts // 4)
        counts = (
            opened.select((F.col("part") % parts).alias("part"), F.explode("bin").alias("length"), "n")
            .groupBy("part", "length").agg(F.sum("n").alias("n"))
        )


def bound_of(counts: DataFrame, size: int = SIZE) -> int:
    """The lower bound of counted lengths (length, n) over all parts: at most ``size`` sums come to the driver."""
    return lower_bound({int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}, size)


def certificate(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """One row about packed pieces: n_sequences, lower_bound (no packing takes fewer) and certified, whether they are equal."""
    bound = bound_of(packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")), size)
    return packed.agg(F.count_distinct("sequence_id").alias("n_sequences")).select(
        "n_sequences", F.lit(bound).cast("long").alias("lower_bound"), (F.col("n_sequences") == bound).alias("certified"))


def pack_pieces(pieces: DataFrame, size: int = SIZE, parts: int | None = None) -> DataFrame:
    """Give every piece (doc_id, piece, length, ...) its ``sequence_id`` and ``offset``; other columns are kept.

    Pieces of one length are interchangeable: they are numbered within their length, so are the places of that length
    in the planned bins, and equal numbers meet. Sequences are filled without gaps from offset 0. Repeated rows each get
    a place; an empty table gives an empty result. ``parts``: partitions packed apart at first.
    """
    parts = parts or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = pieces.withColumn("_part", F.pmod(F.hash("doc_id", "piece"), F.lit(parts))).withColumn("_len", F.col("length").cast("int"))
    counts = stored(slim.groupBy("_len", "_part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    bins = stored(
        plan_bins(counts.select(F.col("_part").alias("part"), F.col("_len").alias("length"), "n"), size, parts)
        .groupBy("bin").agg(F.sum("n").alias("n"))
        .withColumn("slot", F.pmod(F.hash("bin"), F.lit(64))), "plan")

    # Rows are kinds of bins up to here. Number the bins through: by slot first, within a slot then.
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = bins.groupBy("slot").agg(F.sum("n").alias("m")).select("slot", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("slot").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    kinds = bins.join(F.broadcast(slots), "slot").select("bin", "n", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first_id"))
    places = kinds.select("first_id", "n", F.inline(F.expr(
        "transform(sequence(0, size(bin) - 1), i -> named_struct('_len', bin[i], "
        "'offset', if(i = 0, 0L, aggregate(slice(bin, 1, i), 0L, (a, x) -> a + x))))")))
    before = Window.partitionBy("_len").orderBy("first_id", "offset").rowsBetween(Window.unboundedPreceding, -1)
    runs = places.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # One row for each place, in two steps so that no row holds a long array.
    chunks = runs.withColumn("c", F.explode(F.expr("sequence(0L, n - 1, 1024L)")))
    single = chunks.withColumn("i", F.explode(F.expr("sequence(c, least(c + 1023, n - 1))"))).select(
        "_len", (F.col("first") + F.col("i")).alias("_rank"), (F.col("first_id") + F.col("i")).alias("sequence_id"), "offset")

    start = Window.partitionBy("_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_len", "_part", F.coalesce(F.sum("n").over(start), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_len", "_part").orderBy("doc_id", "piece")
    ranked = slim.withColumn("_row", F.row_number().over(within) - 1).join(starts, ["_len", "_part"]).withColumn(
        "_rank", F.col("_start") + F.col("_row"))
    # The tables of bins are small until their places are listed; Spark would take their size on disk for it and broadcast them.
    return ranked.join(single.hint("merge"), ["_len", "_rank"]).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (bytes of its pieces in order of offset)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    whole = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("ids"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole texts: a row per piece with its sequence_id and offset.

    NULL texts are empty ones; very long texts are cut, never dropped; extra columns of ``docs`` play no part.
    """
    return pack_pieces(stored(tokenize_pieces(docs, id_col, text_col, size, with_ids), "pieces"), size)
