"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, as it
leaves them, in the columns of documents; the last returns the packed pieces. run() writes each
stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlloom.llm import langid, lines, mixing, packing, shingles
from crawlloom.llm.common import content_key, settle, table, written

#: Texts of so many letters or more whose profile is farther than this from every language's are in none: clean texts of that length have 0.4 or more.
LETTERS, LEAST = 100, 0.25
#: Words of a shingle for near-duplicates.
SHINGLE = 5
#: The Jaccard similarity of near-duplicates.
SIMILAR = Fraction(4, 5)
#: Toxic text all but goes, poor text is kept to a small part, and good text doesn't shrink. Rates from SPARE to 1 count as 1, in the fit too.
TARGETS, KEPT, SPARE = {"good": 0.93, "poor": 0.06, "toxic": 0.01}, ("good",), 0.5
LAST = (1 << 63) - 1


def boxed(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text and all other columns as one, so that their names can't meet those of an operator."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"), *more)


def unboxed(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | changed
    return df.select(*[own.get(c, F.col("_rest")[c]).alias(c) for c in columns])


def keyed(docs: DataFrame) -> DataFrame:
    return boxed(docs, F.coalesce("doc_id", F.lit(LAST)).alias("_pos"), content_key().alias("_key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: those without a letter, and longer ones whose profile is like that of no language.

    A low cosine rejects no short text, since short clean texts have it too. Where no document names its language there
    is nothing to compare with, and all that has letters stays.
    """
    prototypes = langid.profiles(docs)
    found = langid.identify(boxed(docs), prototypes)
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    if not prototypes:
        return unboxed(found.where(letters > 0), docs.columns)
    return unboxed(found.where((F.col("lang_pred") != langid.UND) & ((letters < LETTERS) | (F.col("score") >= LEAST))), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of runs of lines; documents with nothing else go."""
    kept = lines.dedup_lines(boxed(docs)).where("n_removed < n_lines")
    return unboxed(kept, docs.columns, n_chars=F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest (doc_id, key) of every group of near-duplicates, once; null ids come last.

    Groups are linked by SimHash and, beyond its few bits, by shared shingles; every link is verified.
    """
    near = shingles.near_groups(docs, SHINGLE, SIMILAR)
    heads = near.groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("_pos"), F.col("key").alias("_key"))).alias("head"))
    return unboxed(keyed(docs).join(heads.select("head.*"), ["_pos", "_key"], "left_semi").dropDuplicates(["_pos", "_key"]), docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the target weights ask, repeated rows included."""
    labels = table(spark, sf_dir, "labels")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    mixed = mixing.mix(docs, labels.select("doc_id", domain.alias("domain")), TARGETS, KEPT, SPARE)
    copies = mixed.where("copies > 0").select(F.coalesce("doc_id", F.lit(LAST)).alias("_pos"), F.col("key").alias("_key"), F.col("copies").alias("_copies")).distinct()
    out = keyed(docs).join(copies, ["_pos", "_key"])
    return unboxed(out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mix_domains), ("best_fit_packing", pack)]

#: Tokenizing, hyperdimensional profiles and the fitted classifier aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        rows = written(stage(spark, rows, sf_dir), name)
        if before is not None:
            settle(before)
        before = rows
    return rows
