"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, mixture, packing.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.

Decisions go by doc_id: documents without an id go in the first stage, and repeated rows of an id share its fate. NULL and
empty texts fail the quality rules. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.llm import mixing, neardup, packing, quality, substrings
from twinproof.llm.base import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    kept = quality.judge(docs, read(spark, sf_dir, "labels")).filter("kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, 80 per cent. Of several rows of its id, the first by text stays."""
    kept = neardup.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    left = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in rest if c != "text"])).alias("row"))
    return left.select("doc_id", *[f"row.{c}" for c in rest])


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that repeat go from every text; characters stay whole."""
    cut = substrings.cut_passages(docs, texts=True, keep=["lang", "source"])
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    mixed = mixing.mix(docs, keep=["text", "lang", "n_chars", "source"])
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens in their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Packing and mixing by dynamic programming have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
