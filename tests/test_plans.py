import pytest
from pyspark.sql import functions as F

from twinproof.plans import catalog, propose

BASE = {
    "schema": "public", "name": "events", "rows": 1_000_000, "size": 1, "ins": 1_000_000, "upd": 0, "del": 0, "repl_ident": "d",
    "pk": ["id"],
    "cols": [("id", "bigint", "p"), ("tenant_id", "integer", "p"), ("event_time", "timestamp with time zone", "p"), ("payload", "jsonb", "x")],
}
USERS = [("id", "bigint", "p"), ("account_id", "bigint", "p"), ("email", "text", "x"), ("updated_at", "timestamp with time zone", "p")]


def decide(spark, tables=(), **change):
    row = BASE | change
    df = spark.createDataFrame([tuple(row[n] for n in catalog.CATALOG.names)], catalog.CATALOG)
    return propose.judged(df, tables).first()


def test_append_only_tables_sort_by_tenant_time_and_key(spark):
    r = decide(spark)
    assert (r["reason"], r["order_by"], r["partition_by"]) == (None, ["tenant_id", "event_time", "id"], "month(event_time)")
    assert "starts with tenant_id" in r["identity_need"]


def test_mutated_tables_sort_by_key(spark):
    r = decide(spark, upd=10)
    assert (r["order_by"], r["partition_by"], r["mutated"]) == (["id"], None, True)
    assert "large-value" in r["identity_need"]
    assert decide(spark, upd=10, repl_ident="f")["identity_need"] is None
    assert decide(spark, upd=10, cols=[c for c in BASE["cols"] if c[2] != "x"])["identity_need"] is None


def test_time_first_without_tenant(spark):
    r = decide(spark, cols=[("id", "bigint", "p"), ("created_at", "timestamp without time zone", "p")])
    assert r["order_by"] == ["created_at", "id"] and "starts with created_at" in r["identity_need"]


def test_skips(spark):
    assert decide(spark, pk=[])["reason"].startswith("no primary key")
    assert decide(spark, ["public.events"], pk=[])["reason"].startswith("no primary key")
    assert decide(spark, rows=99_999)["reason"].startswith("99999 rows <")
    assert decide(spark, upd=500_000)["reason"].startswith("entity-like: 500000")
    assert decide(spark, upd=50_000)["reason"] is None  # exactly 5 % is still fine
    assert decide(spark, ["public.events"], upd=500_000)["reason"] is None
    assert decide(spark, cols=[("id", "bigint", "p")])["reason"].startswith("no timestamp column")
    assert decide(spark, ins=0, upd=10)["reason"] is None


def test_update_rewritten_time_never_leads(spark):
    r = decide(spark, name="users", cols=USERS)
    assert r["reason"].startswith("only updated_at, which updates rewrite")
    r = decide(spark, ["public.users"], name="users", cols=USERS)
    assert (r["reason"], r["order_by"], r["partition_by"]) == (None, ["id"], None)
    r = decide(spark, cols=[("id", "bigint", "p"), ("updated_at", "date", "p"), ("occurred", "date", "p")])
    assert r["time_column"] == "occurred"


def test_key_columns_are_not_repeated(spark):
    assert decide(spark, pk=["tenant_id", "id"])["order_by"] == ["event_time", "tenant_id", "id"]
    assert decide(spark, pk=["event_time", "id"])["order_by"] == ["tenant_id", "event_time", "id"]


def test_preference_order(spark):
    cols = [("id", "bigint", "p"), ("created_at", "date", "p"), ("occurred_at", "date", "p"), ("event_time", "text", "x")]
    assert decide(spark, cols=cols)["time_column"] == "occurred_at"
    cols = [("id", "bigint", "p"), ("user_id", "bigint", "p"), ("org_id", "bigint", "p"), ("ts", "date", "p")]
    assert decide(spark, cols=cols)["order_by"] == ["org_id", "ts", "id"]


@pytest.mark.parametrize("name, want", [
    ("updated_at", True), ("modified_at", True), ("last_seen_at", True), ("date_last", True), ("row_updated", True), ("DELETED_AT", True),
    ("created_at", False), ("event_time", False), ("logged_at", False), ("update_count_at", False), ("lasting", False),
])
def test_rewritten_names(spark, name, want):
    assert spark.range(1).select(propose.rewritten(F.lit(name))).first()[0] is want


def test_plan_notes_fixes_and_pending(spark, tmp_path):
    rows = [BASE | {"name": 'ev"x', "size": 9}, BASE | {"name": "b", "size": 5, "repl_ident": "f"}, BASE | {"name": "c", "pk": []}]
    df = spark.createDataFrame([tuple(r[n] for n in catalog.CATALOG.names) for r in rows], catalog.CATALOG)
    plan = propose.plan_tables(df, mirror="m")
    fixes = [r["fix"] for r in plan.fixes.collect()]
    assert fixes == [
        'ALTER TABLE "public"."ev""x" REPLICA IDENTITY FULL', 'CREATE PUBLICATION m_pub FOR TABLE "public"."ev""x", "public"."b"'
    ]
    notes = plan.planned.where("target = 'b'").first()["notes"]
    assert any("changes a row's tenant_id" in n for n in notes) and not any("full row identity" in n for n in notes)
    assert [r["table"] for r in plan.skipped.collect()] == ["public.c"]
    propose.save_plan(plan, str(tmp_path / "p"))
    back = propose.load_plan(spark, str(tmp_path / "p"))
    key = lambda d: sorted(map(str, d.collect()))
    assert key(back.planned) == key(plan.planned) and key(back.fixes) == key(plan.fixes) and back.mirror == "m"
    idents = df.select("schema", "name", F.when(F.col("name") == 'ev"x', "f").otherwise("d").alias("repl_ident"))
    none = spark.createDataFrame([], "name string")
    assert [r["step"] for r in propose.pending_fixes(plan, idents, none).collect()] == [1]
    made = spark.createDataFrame([("m_pub",)], "name string")
    assert propose.pending_fixes(plan, idents, made).count() == 0


def test_unknown_tables_are_named(spark):
    df = spark.createDataFrame([tuple(BASE[n] for n in catalog.CATALOG.names)], catalog.CATALOG)
    assert [r[0] for r in propose.missing_tables(df, ["public.events", " public.nope "]).collect()] == ["public.nope"]


def test_unknown_tables_are_refused(spark):
    df = spark.createDataFrame([tuple(BASE[n] for n in catalog.CATALOG.names)], catalog.CATALOG)
    assert propose.plan_tables(df, ["public.events"]).planned.count() == 1
    with pytest.raises(ValueError, match="no table public.evnts, sales.orders"):
        propose.plan_tables(df, ["sales.orders", "public.events", "public.evnts"])
