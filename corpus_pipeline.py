"""A corpus pipeline: documents through quality, line, near-duplicate and benchmark filters into packed sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, linededup, neardup, packing, quality
from tessera.llm.common import shared_folder, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored by the base rate; rows with a null id, and repeated rows, by their text. Without
    labels all scores are a half and all rows stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in the largest doc_id alone.

    No document goes, even if it has lost all its lines. A null id is the least id, a null text stays null.
    """
    return linededup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each class of near-duplicates stays.

    Texts without words are one class. Rows with no id, or the same one, are in a class only if their texts are.
    """
    return neardup.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts stay, and all if the benchmark is empty."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences of 2048 tokens; a null or empty text is one token, the end."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("lines", line_dedup),
    ("near_duplicates", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]
#: Models, approximate hashing and tokenisers are beyond SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Each stage's rows are written, and read again by the next.

    What a stage has read goes once its own rows are written; the rows that the last one reads stay, as its result is
    worked out when it is asked for. Columns of any names pass through; empty documents give no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


def _removed(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
