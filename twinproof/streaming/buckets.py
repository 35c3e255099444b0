"""State by bucket of keys: one call of a stateful processor, and one state entry, serve many keys.

A call into Python and a visit to the state store take milliseconds, whether for one key or for thousands of them. Keys are therefore
dealt into buckets by hash; a bucket's rows lie in the state as one Arrow stream, and times as ticks, which lose nothing on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from twinproof.functions.clock import ticks

#: A batch reads and writes each bucket it touches as a whole: beyond some 50 million keys, choose about one for every 200,000.
BUCKETS = 256
ROWS = "rows binary"
TIMES = (T.TimestampType, T.TimestampNTZType)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def in_ticks(df: DataFrame) -> DataFrame:
    """Times, with a zone or without, as microseconds since the epoch."""
    return df.withColumns({f.name: ticks(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, TIMES)})


def from_ticks(c: Column, t: T.DataType) -> Column:
    """The reverse of :func:`in_ticks` for a column that had type ``t``."""
    return F.timestamp_micros(c).cast(t) if isinstance(t, TIMES) else c


def name_of(key: Sequence) -> tuple:
    """A key as Python can look it up: NaN equals itself, lists and structs go by their text."""
    return tuple(repr(v) if v != v or isinstance(v, (list, dict)) else v for v in key)


class Packed:
    """A bucket's rows as one state value. It knows the number of buckets, which must stay the same for a checkpoint."""

    def __init__(self, schema: T.StructType, buckets: int):
        self.schema = to_arrow_schema(schema).with_metadata({"buckets": str(buckets)})

    def table(self, rows: Sequence[Sequence]) -> pa.Table:
        columns = zip(*rows) if rows else [[] for _ in self.schema]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema)], schema=self.schema)

    def read(self, state) -> pa.Table:
        if not state.exists():
            return self.table([])
        found = unpack(state.get()[0])
        if found.schema.metadata != self.schema.metadata:
            raise ValueError(f"the checkpoint was begun with {found.schema.metadata}, not {self.schema.metadata}")
        return found

    def write(self, state, rows: pa.Table) -> None:
        if not rows.num_rows:
            state.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_table(rows.combine_chunks())
        state.update((sink.getvalue().to_pybytes(),))


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def unpacker(columns: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the named columns of all rows in a column of packed buckets."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from unpack(data.as_py()).select(list(columns)).replace_schema_metadata(None).to_batches()

    return of
