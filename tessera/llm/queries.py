"""Queries over the driver's tables, one for each training-data operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licences, linededup, media, neardup, packing, pictures, quality, secrets, sql, substrings, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file in the folder of its language, in that of its source."""
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.bitmaps(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.clean(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media: each row of embeddings is drawn as a picture, edited as its id says."""
    return media.copies(pictures.pictures(table(spark, sf_dir, "embeddings")))


def _equals(value: str):
    return lambda x: x == value


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in secrets.BASE]))
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(r.kind))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_licences, op2_toxicity, op3_decontaminate, op4_quality, op5_packing, op6_line_dedup, op7_substring_dedup, op8_near_duplicates, op9_image_copies, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    """Queries that aren't here learn, pack or hash approximately; tests hold them against brute force or accuracy."""
    return {
        "op1_licences": sql.licences(), "op3_decontaminate": sql.DECONTAMINATE, "op6_line_dedup": sql.LINES, "op7_substring_dedup": sql.SUBSTRINGS,
        "op10_secrets": sql.secrets(),
    }
