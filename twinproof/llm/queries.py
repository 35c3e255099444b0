"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinproof.llm import collocations, lloyd, mainhtml, mixing, neardup, packing, quality, secretscan, substrings, tokens, urls, vectors, warc
from twinproof.llm.base import read


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, folder, "documents"), width=3, percent=85)


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(read(spark, folder, "pages"), read(spark, folder, "labels"))


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return mainhtml.extract(read(spark, folder, "pages"))


def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(read(spark, folder, "embeddings"))


def op5_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.cut_passages(read(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(read(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read(spark, folder, "pages"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return lloyd.centroid_clusters(read(spark, folder, "embeddings"))


def op12_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.scan(read(spark, folder, "documents")).drop("finds")


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_html_extraction": op3_html_extraction,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_secret_scans": op12_secret_scans,
    "op13_phrase_collocations": op13_phrase_collocations,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {
    "op7_quality_rules": quality.SQL,
    "op9_warc": warc.SQL,
    "op11_centroid_clustering": lloyd.SQL,
    "op12_secret_scans": secretscan.SQL,
    "op13_phrase_collocations": collocations.SQL,
}
