"""From catalog to proposal: which tables are event tables, how their copies are sorted, what makes copying unsafe.

Every rule is a column expression over the catalog; nothing is decided row by row on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinproof.functions.names import ENTITY_SHARE, MIN_ROWS, REWRITTEN_NAME, TENANT_NAMES, TIME_NAMES
from twinproof.session import pinned

MIRROR = "events_copy"
DATABASE = "events"


@dataclass(frozen=True)
class Plan:
    mirror: str
    database: str
    publication: str
    planned: DataFrame
    skipped: DataFrame
    fixes: DataFrame


def rewritten(name: Column) -> Column:
    """Does a time column's name say that updates rewrite it?"""
    return F.lower(name).rlike(REWRITTEN_NAME)


def is_time(typ: Column) -> Column:
    return typ.startswith("timestamp") | (typ == "date")


def _preferred(cols: Column, names: Sequence[str], accepts) -> Column:
    """The first of ``names`` that exists as an accepted column."""
    known = F.array(*[F.lit(n) for n in names])
    found = F.filter(known, lambda n: F.exists(cols, lambda c: (c["name"] == n) & accepts(c["typ"])))
    return F.get(found, F.lit(0))


def time_column(cols: Column) -> Column:
    """A well-known event-time name, else the first time column that updates do not rewrite."""
    other = F.filter(cols, lambda c: is_time(c["typ"]) & ~rewritten(c["name"]))
    return F.coalesce(_preferred(cols, TIME_NAMES, is_time), F.get(other, F.lit(0))["name"])


def rewritten_time(cols: Column) -> Column:
    return F.get(F.filter(cols, lambda c: is_time(c["typ"]) & rewritten(c["name"])), F.lit(0))["name"]


def quoted(*parts: Column) -> Column:
    ids = [F.concat(F.lit('"'), F.replace(p, F.lit('"'), F.lit('""')), F.lit('"')) for p in parts]
    return F.concat_ws(".", *ids)


def _notes(*notes: Column) -> Column:
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


def judged(catalog: DataFrame, tables: Sequence[str] = (), min_rows: int = MIN_ROWS) -> DataFrame:
    """The catalog with every decision of the planner as a column; ``reason`` is NULL for planned tables."""
    c = catalog.withColumn("source", F.concat_ws(".", "schema", "name"))
    if tables:
        c = c.where(F.col("source").isin(list(tables)))
    explicit = F.col("source").isin(list(tables)) if tables else F.lit(False)
    c = c.withColumns({
        "time_column": time_column(F.col("cols")),
        "rewritten_column": rewritten_time(F.col("cols")),
        "tenant": _preferred(F.col("cols"), TENANT_NAMES, lambda t: F.lit(True)),
        "changes": F.col("upd") + F.col("del"),
        "mutated": (F.col("upd") + F.col("del")) > 0,
    })
    no_time, text = F.col("time_column").isNull(), lambda x: F.col(x).cast("string")
    reason = (
        F.when(F.size("pk") == 0, F.lit("no primary key, so versions of a row would have no key to fold by"))
        .when(explicit, F.lit(None))
        .when(no_time & F.col("rewritten_column").isNotNull(), F.concat(
            F.lit("only "), "rewritten_column",
            F.lit(", which updates rewrite, holds its times; a table named in the call is planned by its key alone")))
        .when(no_time, F.lit("no timestamp column to sort and settle days by; a table named in the call is planned by its key alone"))
        .when(F.col("rows") < min_rows, F.concat(text("rows"), F.lit(f" rows < {min_rows}, the least that a plan takes up unasked")))
        .when((F.col("ins") > 0) & (F.col("changes") > F.lit(ENTITY_SHARE) * F.col("ins")), F.concat(
            F.lit("entity-like: "), text("changes"), F.lit(" changes of old rows against "), text("ins"), F.lit(" new ones")))
    )
    c = c.withColumn("reason", reason)

    # A time-first key is safe only while its leading columns never change for a row.
    events_like = ~F.col("mutated") & F.col("time_column").isNotNull()
    outside_key = lambda x: F.col(x).isNotNull() & ~F.array_contains("pk", F.col(x))
    lead = F.when(events_like & outside_key("tenant"), F.array("tenant")).otherwise(F.array().cast("array<string>"))
    then = F.when(events_like & outside_key("time_column"), F.array("time_column")).otherwise(F.array().cast("array<string>"))
    c = c.withColumns({
        "leading_tenant": F.when(events_like & outside_key("tenant"), F.col("tenant")),
        "order_by": F.concat(lead, then, F.col("pk")),
        "partition_by": F.when(events_like, F.concat(F.lit("month("), "time_column", F.lit(")"))),
        "time_type": F.get(F.filter("cols", lambda x: x["name"] == F.col("time_column")), F.lit(0))["typ"],
    })
    first = F.get("order_by", F.lit(0))
    unsafe = (
        F.when((F.size("order_by") > 0) & (F.size("pk") > 0) & (first != F.get("pk", F.lit(0))), F.concat(
            F.lit("its sort key starts with "), first, F.lit(", so a delete must carry more than the primary key to meet its row")))
        .when(F.col("mutated") & F.exists("cols", lambda x: x["storage"].isin("x", "e")), F.lit(
            "large-value columns are left out of updates that do not touch them, and would be folded as empty"))
    )
    return c.withColumn("identity_need", F.when(F.col("repl_ident") != "f", unsafe))


def plan_tables(
    catalog: DataFrame, tables: Sequence[str] = (), min_rows: int = MIN_ROWS, mirror: str = MIRROR, database: str = DATABASE
) -> Plan:
    """The proposal. An empty ``tables`` detects event tables; named tables are copied even if they do not look like
    event tables, as long as they have a key.

    The catalog (a row per table) is written once, so a computed profile is not scanned again for every part of the
    plan. Named tables that the catalog does not hold are refused.
    """
    catalog = pinned(catalog)
    # As many rows as names were given, at most.
    if tables and (unknown := sorted(r["source"] for r in missing_tables(catalog, tables).collect())):
        raise ValueError(f"the catalog has no table {', '.join(unknown)}")
    all_ = judged(catalog, tables, min_rows)
    publication = f"{mirror}_pub"
    notes = _notes(
        F.when(F.col("leading_tenant").isNotNull(), F.concat(
            F.lit("sorted by "), "leading_tenant", F.lit(" first; an update that changes a row's "), "leading_tenant",
            F.lit(" gets a new sort key, and the version under the old key is never superseded"))),
        F.when(F.col("mutated"), F.lit(
            "rows change: the primary key alone sorts them, and readers fold versions")),
        F.lit("a written log keeps its sort key and folders; another choice means another copy"),
        F.when(F.col("identity_need").isNotNull(), F.concat(F.lit("needs full row identity: "), "identity_need")),
    )
    planned = all_.where(F.col("reason").isNull())
    table = quoted(F.col("schema"), F.col("name"))
    identity = planned.where(F.col("identity_need").isNotNull()).select(
        F.lit(0).alias("step"), F.col("size").alias("size"), "source",
        F.concat(F.lit("ALTER TABLE "), table, F.lit(" REPLICA IDENTITY FULL")).alias("fix"),
    )
    # One line that names all planned tables (as many as there are tables, not rows).
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), F.col("source").alias("s"), table.alias("t"))))
    publish = planned.groupBy(F.lit(publication).alias("p")).agg(F.transform(in_order, lambda x: x["t"]).alias("ts")).select(
        F.lit(1).alias("step"), F.lit(0).cast("bigint").alias("size"), F.lit("").alias("source"),
        F.concat(F.lit("CREATE PUBLICATION "), "p", F.lit(" FOR TABLE "), F.array_join("ts", ", ")).alias("fix"),
    )
    return Plan(
        mirror=mirror,
        database=database,
        publication=publication,
        planned=planned.select(
            "source", F.col("name").alias("target"), "rows", "size", F.col("pk").alias("primary_key"), "time_column",
            "time_type", "order_by", "partition_by", "mutated", notes.alias("notes"),
        ),
        skipped=all_.where(F.col("reason").isNotNull()).select(F.col("source").alias("table"), "reason"),
        fixes=identity.unionByName(publish).orderBy("step", F.desc("size"), "source").select("step", "fix"),
    )


def pending_fixes(plan: Plan, identities: DataFrame, publications: DataFrame) -> DataFrame:
    """Planned fixes that are not in effect: ``identities(schema, name, repl_ident)``, ``publications(name)``."""
    done = identities.where(F.col("repl_ident") == "f").select(
        F.concat(F.lit("ALTER TABLE "), quoted(F.col("schema"), F.col("name")), F.lit(" REPLICA IDENTITY FULL")).alias("head")
    ).unionByName(publications.select(F.concat(F.lit("CREATE PUBLICATION "), "name").alias("head")))
    head = F.when(F.col("step") == 1, F.substring_index("fix", " FOR TABLE ", 1)).otherwise(F.col("fix"))
    return plan.fixes.withColumn("head", head).join(done, "head", "left_anti").drop("head")


def missing_tables(catalog: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Named tables the catalog does not hold."""
    spark = catalog.sparkSession
    wanted = spark.createDataFrame([(t.strip(),) for t in tables], "source string")
    return wanted.join(catalog.select(F.concat_ws(".", "schema", "name").alias("source")), "source", "left_anti")


# --- plans on storage --------------------------------------------------------------------------------------------

def save_plan(plan: Plan, path: str) -> None:
    """Write the plan as JSON for review; a plan is a few rows per table."""
    plan.planned.write.mode("errorifexists").json(f"{path}/planned")
    plan.skipped.write.mode("errorifexists").json(f"{path}/skipped")
    plan.fixes.write.mode("errorifexists").json(f"{path}/fixes")
    spark = plan.planned.sparkSession
    head = spark.createDataFrame(
        [(plan.mirror, plan.database, plan.publication)], "mirror string, database string, publication string"
    )
    head.write.mode("errorifexists").json(f"{path}/head")


PLANNED = (
    "source string, target string, rows bigint, size bigint, primary_key array<string>, time_column string, "
    "time_type string, order_by array<string>, partition_by string, mutated boolean, notes array<string>"
)


def load_plan(spark: SparkSession, path: str) -> Plan:
    head = spark.read.schema("mirror string, database string, publication string").json(f"{path}/head").first()
    return Plan(
        mirror=head["mirror"],
        database=head["database"],
        publication=head["publication"],
        planned=spark.read.schema(PLANNED).json(f"{path}/planned"),
        skipped=spark.read.schema("`table` string, reason string").json(f"{path}/skipped"),
        fixes=spark.read.schema("step int, fix string").json(f"{path}/fixes"),
    )
