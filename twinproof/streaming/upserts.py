"""Upserts as state: the newest version of every key is kept by the stream itself and read back as a table.

A version log on storage has to be folded on every read. Here the fold is state: one entry per key with its newest version, advanced
only by newer versions, in whatever order and batch they arrive. Large values that an update did not send are filled from the
newest version that sent them, which may have come batches earlier, or later. The current table is the state itself (:func:`read_state`);
the stream's output is the accepted changes, for whoever follows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from twinproof.functions.names import DELETED, VERSION

from .buckets import BUCKETS, ROWS, Packed, bucket_of, from_ticks, in_ticks, name_of, unpacker
from .gate import use_state_store

LIVE, GONE, UNCHANGED = "live", "gone", "_unchanged"
#: Name of the state's column for the processing time (milliseconds) at which a deleted key is forgotten.
UNTIL = "_until"
#: How long a deleted key is remembered, so that an older version that arrives late cannot revive it.
TOMBSTONE_SECONDS = 7 * 24 * 3600


def _sent(column: str) -> str:
    """Name of the state's column for the version that ``column`` was last sent with."""
    return f"_sent_{column}"


class _Newest(StatefulProcessor):
    """For a bucket of keys: per key the newest version's columns, and for large columns the newest sent value with its version.

    Rows come and go as the bucket's number and columns named by place: ``keys``, version, deleted, ``columns``, then (only coming) those unsent.
    """

    def __init__(self, keys: int, columns: list[str], large: list[str], rows: Packed, ttl_ms: int):
        self._keys, self._rows, self._ttl = keys, rows, ttl_ms
        self._version, self._deleted = keys, keys + 1
        first, end = keys + 2, keys + 2 + len(columns)
        self._plain = [keys, keys + 1, *[first + i for i, c in enumerate(columns) if c not in large]]
        self._large = [(c, first + columns.index(c), end + i) for i, c in enumerate(large)]
        self._end = end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._live = handle.getValueState(LIVE, ROWS)
        self._gone = handle.getValueState(GONE, ROWS, self._ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        clock = timerValues.getCurrentProcessingTimeInMs()
        tables = [self._rows.read(self._live), self._rows.read(self._gone)]
        if self._ttl:
            tables[1] = tables[1].filter(pc.greater(tables[1].column(UNTIL), clock))
        held = {}
        for t, table in enumerate(tables):
            for i, k in enumerate(zip(*(table.column(j).to_pylist() for j in range(self._keys)))):
                held[name_of(k)] = t, i
        now, changed = {}, set()
        for _, *row in rows:
            name, version = name_of(row[: self._keys]), row[self._version]
            unsent = (row[self._end] or ()) if self._large else ()
            after, fresh = now.get(name), False
            if after is None:
                t, i = held.get(name, (None, None))
                fresh = t is None
                blank = [None] * (len(self._rows.schema) - self._keys)
                after = now[name] = [*row[: self._keys], *blank] if fresh else [c[i].as_py() for c in tables[t].columns]
            if fresh or version > after[self._version]:
                for j in self._plain:
                    after[j] = row[j]
                changed.add(name)
            for c, j, sent in self._large:
                if c not in unsent and (after[sent] is None or version > after[sent]):
                    after[j], after[sent] = row[j], version
                    changed.add(name)
        if not changed:
            return
        for name in changed:
            now[name][-1] = clock + self._ttl if now[name][self._deleted] else None
        for t, (state, table) in enumerate(zip((self._live, self._gone), tables)):
            moved = {held[name][1] for name in changed if held.get(name, (None,))[0] == t}
            came = [now[name] for name in changed if bool(now[name][self._deleted]) == (t == 1)]
            if moved or came:
                kept = table.filter(pa.array([i not in moved for i in range(table.num_rows)], pa.bool_()))
                self._rows.write(state, pa.concat_tables([kept, self._rows.table(came)]))
        out = Row(*[f"c{j}" for j in range(self._end)])
        for name in changed:
            yield out(*now[name][: self._end])

    def close(self) -> None:
        pass


def upsert_state_stream(
    changes: DataFrame, key: Sequence[str], large: Sequence[str] = (), tombstone_seconds: int = TOMBSTONE_SECONDS, buckets: int = BUCKETS
) -> DataFrame:
    """Accepted changes: per key and batch at most one row, the key's state after it (deletes as flagged rows).

    ``changes`` has the source's columns, ``_version`` and ``_is_deleted``; with ``large`` columns also ``_unchanged``, the
    array of columns a change did not carry. Of equal versions the first one seen counts. A deleted key is remembered for
    ``tombstone_seconds`` of processing time. NULL keys are a key of their own. State is kept in ``buckets`` of keys.
    """
    use_state_store(changes.sparkSession)
    fields = {f.name: f.dataType for f in changes.schema.fields}
    columns = [c for c in changes.columns if c not in (*key, VERSION, DELETED, UNCHANGED)]
    names = [*key, VERSION, DELETED, *columns]
    quoted = [F.col(f"`{c}`") for c in names]
    rows = in_ticks(changes.withColumn(VERSION, F.col(VERSION).cast("bigint")).select(*quoted, *([UNCHANGED] if large else [])))
    kinds = [f.dataType for f in rows.schema.fields][: len(names)]
    more = [*map(_sent, large), UNTIL]
    state = T.StructType([T.StructField(n, t) for n, t in zip([*names, *more], [*kinds, *[T.LongType()] * len(more)])])
    out = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(kinds)])
    placed = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    placed = placed.select(bucket_of(placed.columns[: len(key)], buckets).alias("bucket"), "*")
    processor = _Newest(len(key), columns, list(large), Packed(state, buckets), tombstone_seconds * 1000)
    accepted = placed.groupBy("bucket").transformWithState(processor, out, "Append", "ProcessingTime")
    instant = lambda t: T.TimestampType() if isinstance(t, T.TimestampNTZType) else t
    return accepted.select(*[from_ticks(F.col(f"c{i}"), instant(fields[n])).alias(n) for i, n in enumerate(names)])


def run_upserts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write accepted changes and keep the state under ``checkpoint``; stops once everything available is read.

    State that expires asks for a batch without data again and again, so that a query could never stop: such batches are off here.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        conf.set(name, before)


def read_state(spark: SparkSession, checkpoint: str, like: DataFrame, key: Sequence[str]) -> DataFrame:
    """The current table, as the state of :func:`upsert_state_stream` holds it: live rows with the columns and types of ``like``."""
    kept = spark.read.format("statestore").option("stateVarName", LIVE).load(checkpoint).select("value.rows")
    types = {f.name: f.dataType for f in like.schema.fields}
    wanted = [c for c in like.columns if c not in (VERSION, DELETED, UNCHANGED)]
    rows = kept.mapInArrow(unpacker(wanted), in_ticks(like.select(*[f"`{c}`" for c in wanted])).schema)
    return rows.select(*[from_ticks(F.col(f"`{c}`"), types[c]).alias(c) for c in wanted])
