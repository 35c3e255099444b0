"""Time-in-state over a stream of polls: a mirror may be checked once it has run without a break for long enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from twinproof.functions.names import SETTLE_SECONDS

OUTPUT = "mirror string, at timestamp, running boolean, running_since timestamp, ready boolean"


class _RunningSince(StatefulProcessor):
    """State per mirror: when the current uninterrupted run began (nothing while it is not running)."""

    def __init__(self, hold_seconds: int):
        self._hold = pd.Timedelta(seconds=hold_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._since = handle.getValueState("since", "since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values("at")
        since = self._since.get()[0] if self._since.exists() else None
        began, ready = [], []
        for at, running in zip(polls["at"], polls["running"]):
            since = None if not running else since if since is not None else at
            began.append(since)
            ready.append(since is not None and at - pd.Timestamp(since) >= self._hold)
        if since is None:
            self._since.clear()
        else:
            self._since.update((pd.Timestamp(since).to_pydatetime(),))
        yield pd.DataFrame({
            "mirror": key[0],
            "at": polls["at"].to_numpy(),
            "running": polls["running"].to_numpy(),
            "running_since": pd.to_datetime(pd.Series(began, dtype="datetime64[ns]")).to_numpy(),
            "ready": ready,
        })

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def running_since_stream(polls: DataFrame, hold_seconds: int = SETTLE_SECONDS) -> DataFrame:
    """Polls ``(mirror string, at timestamp, running boolean)`` with ``running_since`` and ``ready``.

    One micro-batch brings a few polls per mirror (one every 30 s); the batch operator ``series.running_since`` is the
    one for long histories.
    """
    return polls.groupBy("mirror").transformWithStateInPandas(
        statefulProcessor=_RunningSince(hold_seconds),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None",
    )
