"""Change feeds: the version log of a table under its changes, with the row-identity modes that decide what an update
or delete carries.

``full`` identity ships whole old rows. ``default`` identity ships only the primary key of a deleted row and leaves
out large values an update did not change; the resulting logs are kept reproducible here because every check must be
able to find them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from twinproof.functions.names import DELETED, VERSION

FULL, DELETE_MARKER, EMPTY_TEXT, KEY_MOVE = "full", "delete_marker", "empty_text", "key_move"

# What a replica writes for a column a change did not carry.
_DEFAULTS = {
    T.TimestampNTZType: "timestamp_ntz'1970-01-01 00:00:00'",
    T.TimestampType: "timestamp'1970-01-01 00:00:00'",
    T.DateType: "date'1970-01-01'",
    T.StringType: "''",
    T.BooleanType: "false",
}


def _default(t: T.DataType) -> Column:
    text = _DEFAULTS.get(type(t))
    return F.expr(text) if text else F.lit(0).cast(t)


def change_log(table: DataFrame, changes: Sequence[tuple[int, Column, bool, dict[str, Column]]]) -> DataFrame:
    """Version log of ``table``: version 0 for every row plus, per change ``(version, applies, deleted, new values)``,
    one more version for the rows it applies to.

    One pass: each row is repeated in place, so the table is read once however many kinds of change there are, and
    only the change number goes through the repetition, so unread columns are still pruned at the scan.
    """
    numbered = list(enumerate(changes, start=1))
    which = F.array(F.lit(0), *[F.when(applies, F.lit(i)) for i, (_, applies, _, _) in numbered])
    rows = table.withColumn("_change", F.explode(F.filter(which, lambda i: i.isNotNull())))

    def by_change(start: Column, pick) -> Column:
        out = start
        for i, change in numbered:
            value = pick(change)
            if value is not None:
                out = F.when(F.col("_change") == i, value).otherwise(out)
        return out

    return rows.select(
        *[
            by_change(F.col(f.name), lambda c, n=f.name: c[3].get(n)).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ],
        by_change(F.lit(0), lambda c: F.lit(c[0])).cast("bigint").alias(VERSION),
        by_change(F.lit(False), lambda c: F.lit(c[2])).alias(DELETED),
    )


def event_changes(mode: str = FULL) -> list[tuple[int, Column, bool, dict[str, Column]]]:
    """The deterministic changes the examples and tests use on ``events``: every fifth row updated, every twentieth
    deleted, optionally with one defect."""
    fifth, twentieth = F.col("event_id") % 5 == 0, F.col("event_id") % 20 == 7
    update = {"value": F.col("value") + 1}
    delete: dict[str, Column] = {}
    extra = []
    if mode == EMPTY_TEXT:
        update["props"] = F.lit("")
    if mode == DELETE_MARKER:
        delete = {"ts": _default(T.TimestampNTZType()), "user_id": F.lit(0)}
    if mode == KEY_MOVE:
        moved = {"user_id": F.col("user_id") + 1, "value": F.col("value") + 1}
        extra = [(1, F.col("event_id") % 50 == 3, False, moved)]
    return [(1, fifth, False, update), (2, twentieth, True, delete), *extra]


def event_log(events: DataFrame, mode: str = FULL) -> DataFrame:
    return change_log(events, event_changes(mode))


def events_after_changes(events: DataFrame, mode: str = FULL) -> DataFrame:
    """The source table once the same changes have been applied to it."""
    kept = events.where(F.col("event_id") % 20 != 7)
    updated = F.col("event_id") % 5 == 0
    if mode == KEY_MOVE:
        moved = F.col("event_id") % 50 == 3
        kept = kept.withColumn("user_id", F.when(moved, F.col("user_id") + 1).otherwise(F.col("user_id")))
        updated = updated | moved
    return kept.withColumn("value", F.when(updated, F.col("value") + 1).otherwise(F.col("value")))


def apply_identity(log: DataFrame, mode: str, key: Sequence[str], large: Sequence[str] = ()) -> DataFrame:
    """What a replica receives from a full change log under an identity mode.

    ``default``: delete markers keep only ``key``; updates blank the ``large`` columns they did not change (all of
    them, the worst case). ``full``: the log as it is.
    """
    if mode == FULL:
        return log
    if mode != "default":
        raise ValueError(f"identity mode {mode!r}: use 'full' or 'default'")
    fields = {f.name: f.dataType for f in log.schema.fields}
    deleted, updated = F.col(DELETED), (F.col(VERSION) > 0) & ~F.col(DELETED)
    out = {}
    for name, t in fields.items():
        if name in (*key, VERSION, DELETED):
            continue
        value = F.when(deleted, _default(t)).otherwise(F.col(name))
        out[name] = F.when(updated, F.lit("").cast(t)).otherwise(value) if name in large else value
    return log.withColumns(out)
