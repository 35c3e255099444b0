"""Waiting until a target equals its source, as a stream with timers: every wait ends as a record, met or missed.

Comparison attempts arrive per key (a cycle and target, say). The first equal attempt within the timeout is the record. When the watermark
passes the timeout without one, a timer records the miss: the first attempt past the timeout, or the last one there is if
none follows within the grace time. No driver loop, and a restart goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from twinproof.functions.clock import ticks
from twinproof.functions.names import MATCH_TIMEOUT_SECONDS
from twinproof.operators.intervals import MICROS

from .buckets import BUCKETS, ROWS, TIMES, Packed, bucket_of, from_ticks, in_ticks, name_of
from .gate import use_state_store

_ATTEMPT = "struct<at: bigint, pg: string, ch: string, err: string, match: boolean, waited_s: int>"
_WAIT = f"began bigint, recorded boolean, next bigint, hit {_ATTEMPT}, over {_ATTEMPT}, last {_ATTEMPT}"
_OUT = "ts bigint, pg string, ch string, match boolean, waited_s int, err string"


class _Wait(StatefulProcessor):
    """For a bucket of keys: per wait the best attempt of each sort, when it began, whether it has been recorded, and when to look at it next."""

    def __init__(self, keys: int, rows: Packed, timeout: int, grace: int, remember: int):
        self._keys, self._rows, self._timeout, self._grace, self._remember = keys, rows, timeout, grace, remember
        self._began, self._recorded, self._next, self._hit, self._over, self._last = range(keys, keys + 6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waits = handle.getValueState("waits", ROWS)

    def _read(self) -> dict[tuple, list]:
        columns = [c.to_pylist() for c in self._rows.read(self._waits).columns]
        return {name_of(wait[: self._keys]): list(wait) for wait in zip(*columns)}

    def _write(self, waits: dict[tuple, list]) -> None:
        self._rows.write(self._waits, self._rows.table(list(waits.values())))
        if waits:
            self._handle.registerTimer(min(wait[self._next] for wait in waits.values()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waits = self._read()
        for _, *row in rows:
            name = name_of(row[: self._keys])
            started, at, pg, ch, err = row[self._keys : self._keys + 5]
            wait = waits.setdefault(name, [*row[: self._keys], None, False, None, None, None, None])
            if wait[self._recorded]:
                continue
            micros = at - started
            waited = micros // MICROS if micros >= 0 else -(-micros // MICROS)
            equal = err is None and pg is not None and pg == ch
            now = {"at": at, "pg": pg, "ch": ch if err is None else "", "err": err, "match": equal, "waited_s": waited}
            hit, over, last = wait[self._hit :]
            if equal and waited <= self._timeout and (hit is None or waited < hit["waited_s"]):
                wait[self._hit] = now
            if waited > self._timeout and (over is None or waited < over["waited_s"]):
                wait[self._over] = now
            if last is None or waited >= last["waited_s"]:
                wait[self._last] = now
            wait[self._began], wait[self._next] = started, started // 1000 + self._timeout * 1000
        self._write(waits)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waits, watermark, ended = self._read(), timerValues.getCurrentWatermarkInMs(), []
        for name, wait in list(waits.items()):
            if wait[self._next] > watermark:
                continue
            if wait[self._recorded]:
                del waits[name]
                continue
            due = wait[self._began] // 1000 + self._timeout * 1000
            record, over, last = wait[self._hit :]
            if record is None and over is not None:
                if watermark <= over["at"] // 1000:
                    # An earlier attempt past the timeout may still come.
                    wait[self._next] = over["at"] // 1000 + 1
                    continue
                record = over
            if record is None:
                if watermark < due + self._grace * 1000:
                    wait[self._next] = due + self._grace * 1000
                    continue
                record = last
            wait[self._recorded :] = [True, watermark + max(self._remember * 1000, 1), None, None, None]
            ended.append([*wait[: self._keys], *(record[c] for c in ("at", "pg", "ch", "match", "waited_s", "err"))])
        self._write(waits)
        out = Row(*[f"c{i}" for i in range(self._keys)], "ts", "pg", "ch", "match", "waited_s", "err")
        for record in ended:
            yield out(*record)

    def close(self) -> None:
        pass


def freshness_wait_stream(
    attempts: DataFrame, keys: Sequence[str], timeout: int = MATCH_TIMEOUT_SECONDS, late: str = "1 minute",
    grace: int = MATCH_TIMEOUT_SECONDS, remember: int = 24 * 3600, buckets: int = BUCKETS,
) -> DataFrame:
    """Records ``keys``, ``ts``, ``pg``, ``ch``, ``match``, ``waited_s``, ``err``: one for every wait that is over.

    ``attempts`` has ``keys``, ``started``, ``at``, ``pg``, ``ch``, ``err``. Equals ``cycles.freshness_waits`` for every key whose
    timeout, and whose first attempt past it, the watermark has passed. Attempts more than ``late`` behind the newest do not count;
    neither do those of a recorded key, which is remembered for ``remember`` seconds. State is kept in ``buckets`` of keys.
    """
    use_state_store(attempts.sparkSession)
    types = {f.name: f.dataType for f in attempts.schema.fields}
    kinds = in_ticks(attempts.select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keys)])).schema.fields
    ticked = lambda k: ticks(F.col(f"`{k}`")) if isinstance(types[k], TIMES) else F.col(f"`{k}`")
    rows = attempts.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).select(
        bucket_of(keys, buckets).alias("bucket"), *[ticked(k).alias(f"c{i}") for i, k in enumerate(keys)],
        ticks("started").alias("started"), ticks("at").alias("tried"), "pg", "ch", "err", "at")
    state = T.StructType([*kinds, *T.StructType.fromDDL(_WAIT).fields])
    out = T.StructType([*kinds, *T.StructType.fromDDL(_OUT).fields])
    ended = rows.groupBy("bucket").transformWithState(
        _Wait(len(keys), Packed(state, buckets), timeout, grace, remember), out, "Append", "EventTime")
    return ended.select(
        *[from_ticks(F.col(f"c{i}"), types[k]).alias(k) for i, k in enumerate(keys)], F.timestamp_micros("ts").alias("ts"),
        "pg", "ch", "match", "waited_s", "err")
