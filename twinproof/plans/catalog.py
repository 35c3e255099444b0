"""The catalog: one row per table with its key, columns and change counters, read from system tables or computed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from twinproof.functions.names import DELETED, VERSION

_TEXT, _COUNT = T.StringType(), T.LongType()
COLUMNS = T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("name", "typ", "storage")]))
CATALOG = T.StructType(
    [T.StructField(n, _TEXT) for n in ("schema", "name")]
    + [T.StructField(n, _COUNT) for n in ("rows", "size", "ins", "upd", "del")]
    + [T.StructField("repl_ident", _TEXT), T.StructField("pk", T.ArrayType(_TEXT)), T.StructField("cols", COLUMNS)]
)

# Relation kinds that hold rows, and schemas that belong to the system or to replication tools.
_KINDS = ["r", "p"]
_SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
_SYSTEM_PREFIXES = ["pg\\_toast%", "\\_peerdb%"]


def discover(
    relations: DataFrame,
    namespaces: DataFrame,
    stats: DataFrame,
    key_columns: DataFrame,
    attributes: DataFrame,
    types: DataFrame,
) -> DataFrame:
    """The catalog from a relational store's system tables, largest table first.

    ``relations(rel_id, namespace_id, name, kind, is_partition, rows, size, repl_ident)``, ``namespaces(namespace_id,
    schema)``, ``stats(rel_id, ins, upd, del)``, ``key_columns(rel_id, pos, attnum)``, ``attributes(rel_id, attnum,
    name, type_id, typ, dropped)``, ``types(type_id, storage)``. Partitions are left out (their parent stands for
    them); a relation without statistics counts zero changes.
    """
    schema = F.col("schema")
    system = schema.isin(_SYSTEM_SCHEMAS)
    for prefix in _SYSTEM_PREFIXES:
        system = system | schema.like(prefix)
    tables = (
        relations.where(F.col("kind").isin(_KINDS) & ~F.col("is_partition"))
        .join(namespaces, "namespace_id")
        .where(~system)
        .join(stats, "rel_id", "left")
    )
    live = attributes.where((F.col("attnum") > 0) & ~F.col("dropped"))
    keys = _in_order(
        key_columns.join(live.select("rel_id", "attnum", "name"), ["rel_id", "attnum"]), "pos", F.col("name"), "pk"
    )
    cols = _in_order(live.join(types, "type_id"), "attnum", F.struct("name", "typ", "storage"), "cols")
    joined = tables.join(keys, "rel_id", "left").join(cols, "rel_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "schema",
        "name",
        F.greatest(F.col("rows").cast("bigint"), zero).alias("rows"),
        F.coalesce(F.col("size"), zero).cast("bigint").alias("size"),
        *[F.coalesce(F.col(c), zero).cast("bigint").alias(c) for c in ("ins", "upd", "del")],
        "repl_ident",
        F.coalesce("pk", F.array().cast("array<string>")).alias("pk"),
        F.coalesce("cols", F.array().cast(COLUMNS)).alias("cols"),
    ).orderBy(F.desc("size"), "schema", "name")


def _in_order(rows: DataFrame, position: str, value: Column, name: str) -> DataFrame:
    """An array per relation in catalog order (bounded by the number of columns a table can have)."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), value.alias("v"))))
    return rows.groupBy("rel_id").agg(F.transform(sorted_, lambda s: s["v"]).alias(name))


# --- computed profile -------------------------------------------------------------------------------------------

_TYPE_NAMES = {
    T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint",
    T.BooleanType: "boolean", T.DateType: "date", T.TimestampNTZType: "timestamp without time zone",
    T.TimestampType: "timestamp with time zone", T.FloatType: "real", T.DoubleType: "double precision",
    T.StringType: "text", T.BinaryType: "bytea",
}


def type_name(t: T.DataType, json: bool = False) -> str:
    if json:
        return "jsonb"
    if isinstance(t, T.DecimalType):
        return f"numeric({t.precision},{t.scale})"
    if isinstance(t, T.ArrayType):
        return type_name(t.elementType) + "[]"
    return _TYPE_NAMES.get(type(t), t.simpleString())


def is_large(t: T.DataType) -> bool:
    """Types whose long values are stored out of line."""
    return isinstance(t, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


@dataclass(frozen=True)
class TableInput:
    """A table to profile; ``log`` is its version log, from which changes are counted."""

    name: str
    table: DataFrame
    key: Sequence[str] = ()
    log: DataFrame | None = None
    json_columns: Sequence[str] = field(default_factory=tuple)
    schema: str = "public"
    identity: str = "d"


def profile_tables(inputs: Iterable[TableInput]) -> DataFrame:
    """The catalog computed from the tables themselves.

    A key that repeats, or holds NULL, is not a primary key: it is reported as no key. Changes are counted in the
    version log, which is stronger evidence than a store's resettable counters. Per table this reads the key columns
    once (distinct count, reduced before the shuffle), the log's two marker columns once, and file metadata.
    """
    inputs = list(inputs)
    measured = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [part for i in inputs for part in _measures(i)]
    )
    zero = F.lit(0).cast("bigint")
    figures = measured.groupBy("name").agg(
        *[F.coalesce(F.max(c), zero).alias(c) for c in ("rows", "keys", "ins", "upd", "del", "size")]
    )
    known = figures.sparkSession.createDataFrame(
        [(i.schema, i.name, i.identity, list(i.key), _columns(i)) for i in inputs],
        "`schema` string, name string, repl_ident string, key array<string>, "
        "cols array<struct<name: string, typ: string, storage: string>>",
    )
    usable = F.when(F.col("rows") == F.col("keys"), F.col("key")).otherwise(F.array().cast("array<string>"))
    return known.join(figures, "name").withColumn("pk", usable).select(*CATALOG.names)


def _columns(i: TableInput) -> list[tuple[str, str, str]]:
    def storage(t: T.DataType) -> str:
        return "x" if is_large(t) else "m" if isinstance(t, T.DecimalType) else "p"

    return [(f.name, type_name(f.dataType, f.name in i.json_columns), storage(f.dataType)) for f in i.table.schema.fields]


def _measures(i: TableInput) -> list[DataFrame]:
    """One-row results of a table, each with the figures it contributes."""
    name = F.lit(i.name).alias("name")
    keys = F.count_distinct(*[F.col(k) for k in i.key]) if i.key else F.lit(-1).cast("bigint")
    parts = [i.table.agg(F.count(F.lit(1)).alias("rows"), keys.alias("keys")), _stored_bytes(i.table)]
    if i.log is not None:
        parts.append(i.log.agg(
            F.count_if(F.col(VERSION) == 0).alias("ins"),
            F.count_if((F.col(VERSION) > 0) & ~F.col(DELETED)).alias("upd"),
            F.count_if(F.col(DELETED)).alias("del"),
        ))
    else:
        parts.append(i.table.sparkSession.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in ("ins", "upd", "del")]))
    return [p.select(name, "*") for p in parts]


def _stored_bytes(table: DataFrame) -> DataFrame:
    """Total size of the files behind a table, from file metadata; 0 for tables that are not files."""
    try:
        files = table.select("_metadata.file_path", "_metadata.file_size").distinct()
    except AnalysisException:
        return table.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("size"))
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("size"))
