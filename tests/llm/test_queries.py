"""The registered queries against their SQL, and the pipeline against its stages."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import test_neardup, test_packing, test_quality_and_mixing, test_substrings
from tools.check_oracles import TABLES, compare
from twinproof.llm import neardup, queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    took, text, ok = compare(spark, con, DATA, name, queries.QUERIES[name], queries.SQL[name])
    assert ok, text


def test_every_operator_is_registered():
    import __spark_entry__

    assert [sum(q.startswith(f"op{n}_") for q in __spark_entry__.queries()) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs, before = spark.read.parquet(f"{tmp_path}/{k}"), docs
        kept[k] = docs
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    judged = queries.QUERIES["op7_quality_rules"](spark, DATA).filter("kept")
    assert kept[0].select("doc_id").exceptAll(judged.select("doc_id")).isEmpty() and kept[0].count() == judged.count()
    groups = neardup.near_duplicates(kept[0]).select("component_id").distinct().count()
    assert kept[1].count() == groups == kept[1].select("doc_id").distinct().count()
    assert kept[2].count() == groups
    cut = kept[1].alias("a").join(kept[2].alias("b"), "doc_id").select(F.length("a.text").alias("x"), F.length("b.text").alias("y"), "b.n_chars")
    assert cut.filter("y > x or y <> n_chars").isEmpty() and not cut.filter("y < x").isEmpty()
    assert kept[3].select("doc_id").exceptAll(kept[2].select("doc_id")).count() <= kept[3].count()
    assert kept[3].groupBy("doc_id").count().filter("count > 3").isEmpty()
    packed = kept[4].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.filter("n > 1024").isEmpty()
    assert kept[4].filter("piece = 0").count() == kept[3].count()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).isEmpty()


def plain_cut(texts):
    """Texts without the passages of 200 bytes and more that repeat; characters of one byte."""
    out = []
    for text, hits in zip(texts, test_substrings.flags(texts, 200)):
        gone = {i + j for i, hit in enumerate(hits) if hit for j in range(200)}
        out.append("".join(c for i, c in enumerate(text) if i not in gone))
    return out


def plain_pieces(rows):
    """(doc_id, piece, start, length, checksum) of texts in pieces of at most 1,024 ids, the first one short."""
    out = []
    for (i, _), ids in zip(rows, test_packing.library([t for _, t in rows])):
        ids = np.array([*ids, 2], "<u4")
        at, take, k = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            out.append((i, k, at, take, zlib.crc32(ids[at: at + take].tobytes())))
            at, take, k = at + take, 1024, k + 1
    return sorted(out)


def check_packed(packed, mixed):
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == plain_pieces(mixed)
    ends = collections.Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024 and sorted(ends) == list(range(len(ends)))


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rnd = random.Random(9)
    text = lambda k: " ".join(f"w{rnd.randrange(10**5)}" for _ in range(k))
    texts = [text(rnd.randrange(40, 160)) for _ in range(60)]
    texts += [f"{t} {text(3)}" for t in texts[:12]] + [f"{t} {text(1)}" for t in texts[60:]]
    passage = text(60)
    texts += [f"{text(70)} {passage} {text(50)}" for _ in range(6)] + [text(19), text(20), "a b c d e f g h " * 9, "", None, text(2500), passage]
    rows = [(i, t, "en", ["s0", "s1", "s1", "s2", None][i % 5], len(t or "")) for i, t in enumerate(texts)] + [(None, text(50), "en", "s0", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    collected = lambda df: sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=str)

    def next_stage(k):
        stages[k](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    docs = next_stage(0)  # so few labels certify no cutoff: the base rules alone
    plain = []
    for r in rows:
        words, _, _, _, repeated = test_quality_and_mixing.plain(r[1])
        if r[0] is not None and words >= 20 and 100 * repeated <= 30 * words:
            plain.append(r)
    assert collected(docs) == sorted(plain, key=str) and len(plain) < len(rows)

    docs = next_stage(1)
    groups = test_neardup.brute([r[:2] for r in plain], 5, 80)
    kept = [r for r in plain if groups[r[0]][1] == r[0]]
    assert collected(docs) == sorted(kept, key=str) and len(kept) < len(plain)

    docs = next_stage(2)
    cut = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(kept, plain_cut([r[1] for r in kept]))]
    assert collected(docs) == sorted(cut, key=str) and sorted(cut, key=str) != sorted(kept, key=str)

    docs = next_stage(3)
    mixed = collected(docs)
    size = {r[0]: len(test_quality_and_mixing.WORD.findall(r[1])) for r in cut}
    of = {s: [r[0] for r in cut if r[3] == s] for s in {r[3] for r in cut}}
    words = {s: sum(size[i] for i in ids) for s, ids in of.items()}
    copies = collections.Counter(r[0] for r in mixed)
    assert set(mixed) <= set(cut)
    for source, target in test_quality_and_mixing.filled(words).items():
        whole = min(int(target // words[source]), 3)
        reach = {0}
        for i in of[source]:
            reach |= {r + size[i] for r in reach}
        room = int(target + 0.5) - whole * words[source] if whole < 3 else 0
        assert sum(size[i] * copies[i] for i in of[source]) == whole * words[source] + max(r for r in reach if r <= room)
        assert {copies[i] for i in of[source]} <= {whole, whole + 1}

    check_packed(stages[4](spark, docs, str(tmp_path)).collect(), [r[:2] for r in mixed])
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), [r[:2] for r in mixed])
