"""From a version log to its live view.

A version log holds every row several times: source columns + ``_version`` + ``_is_deleted``. The live view keeps the
newest version per whole sort key and then drops deleted rows. The order matters: the delete flag is tested only
after the fold.

Every fold has a map-side step, so a key that owns a third of all versions is reduced before the shuffle. All columns of a
live row come from one version, also where a key repeats a version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinproof.functions.names import DELETED, VERSION


def newest(log: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, order: str | Column = VERSION) -> DataFrame:
    """The newest version per key, deletes included.

    Where a source can repeat a version, pass an ``order`` that breaks the tie (for example ``F.struct("_version",
    "op_order")``); without one, any of the rows with the newest version is taken, as a whole.
    """
    columns = [c for c in (columns or log.columns) if c not in key]
    one = log.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return one.select(*key, *[F.col("_row").getField(c).alias(c) for c in columns])


def fold(
    log: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, order: str | Column = VERSION
) -> DataFrame:
    """The live view: newest version per key, deleted rows dropped. ``columns`` limits what is carried."""
    return fold_by_rank(log, key, columns, order)


def fold_by_rank(
    log: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, order: str | Column = VERSION
) -> DataFrame:
    """The same live view through ``row_number() = 1``, for rows that carry text or many columns.

    Spark keeps one row per key before the shuffle as well as after it, so a hot key stays small here too; text moves
    as it is instead of through sorted aggregation buffers.
    """
    wanted = list(columns) if columns is not None else [c for c in log.columns if c not in (VERSION, DELETED)]
    newest_first = (F.col(order) if isinstance(order, str) else order).desc()
    ranked = log.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(newest_first)))
    return ranked.where((F.col("_rank") == 1) & ~F.col(DELETED)).select(*wanted)


def fold_over_snapshot(snapshot: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The live view of a snapshot (one row per key) plus the changes after it.

    Only the changes are folded. Snapshot rows without a later change pass through an anti join; the bulk of the
    data is never aggregated, and not shuffled either as long as Spark finds the changed keys small enough to
    broadcast (its own size threshold decides, also at run time).
    """
    wanted = [c for c in snapshot.columns if c not in (VERSION, DELETED)]
    touched = changes.select(*key).distinct()
    if DELETED in snapshot.columns:
        snapshot = snapshot.where(~F.col(DELETED))
    untouched = snapshot.select(*wanted).join(touched, list(key), "left_anti")
    return untouched.unionByName(fold(changes, key, wanted))


def fold_terms(log: DataFrame, key: Sequence[str], terms: dict[str, Column], order: str | Column = VERSION) -> DataFrame:
    """Live rows reduced to the key and fixed-width per-row terms, computed before the shuffle.

    Terms over key columns are evaluated after the fold, all others before it.
    """
    slim = log.select(
        *key,
        *[F.col(c) for c in (VERSION, DELETED) if c not in key],
        *[e.alias(name) for name, e in terms.items()],
    )
    return fold(slim, key, [*key, *terms], order)


def carry_unchanged(log: DataFrame, key: Sequence[str], columns: Sequence[str], unchanged: str = "_unchanged") -> DataFrame:
    """Fill large values that an update left unchanged (and therefore did not send) from the version before it.

    ``unchanged`` is an array column naming the columns the change did not carry, so a real NULL stays NULL. The
    newest sent value per key is itself a ``max_by``, which keeps the fill inside one map-side aggregation.
    """
    sent = {c: ~F.coalesce(F.array_contains(F.col(unchanged), c), F.lit(False)) for c in columns}
    plain = [c for c in log.columns if c not in (*key, *columns, unchanged, VERSION, DELETED)]
    filled = log.groupBy(*key).agg(
        *[F.max_by(F.col(c), VERSION).alias(c) for c in plain],
        *[F.max_by(F.col(c), F.when(sent[c], F.col(VERSION))).alias(c) for c in columns],
        F.max_by(F.col(DELETED), VERSION).alias(DELETED),
    )
    return filled.where(~F.col(DELETED)).drop(DELETED)


def compact(log: DataFrame, key: Sequence[str], up_to: int) -> DataFrame:
    """A shorter log with the same live view: versions up to ``up_to`` are folded into one row per key.

    Delete markers stay (as the single version of their key), so replays of older versions cannot revive a row.
    """
    old = newest(log.where(F.col(VERSION) <= up_to), key)
    return old.select(*log.columns).unionByName(log.where(F.col(VERSION) > up_to))
