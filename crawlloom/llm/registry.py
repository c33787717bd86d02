"""The queries over the synthetic tables, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from crawlloom.llm import html, langid, lines, mixing, neighbors, packing, simhash, suffixes, syncmers, urlfilter
from crawlloom.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.nearest(table(spark, sf_dir, "embeddings"))


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_strings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the doc_id of its article; bad are toxic and poor ones."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    article = F.regexp_extract(urlfilter.host_and_path(F.col("url"))[1], "/([0-9]{1,18})(?:[./]|$)", 1)
    key = F.when(article != "", article.cast("long"))
    return urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, label_key=key).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    labels = table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))
    return mixing.mix(table(spark, sf_dir, "documents"), labels).drop("key")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder and is not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    prototypes = langid.profiles(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_line_dedup,
        op2_nearest_neighbors,
        op3_syncmer_fingerprints,
        op4_simhash_near_dedup,
        op5_suffix_dedup,
        op6_best_fit_packing,
        op7_url_filters,
        op8_source_mixing,
        op9_html_extraction,
        op10_language_id,
    )
    return {f.__name__: f for f in (*operators, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": lines.oracle_sql()}
