"""Exact results: ground truth, first appearances, checks of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stratum(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def by_stratum(df: DataFrame, stratum: str | Column, value: str) -> DataFrame:
    return df.groupBy(_stratum(stratum).alias("stratum")).agg(F.count("*").alias("count"), F.sum(F.col(value).cast("double")).alias("sum"), F.avg(F.col(value).cast("double")).alias("mean"))


def ground_truth(df: DataFrame, stratum: str | Column, value: str) -> DataFrame:
    """count, sum and mean of each stratum and, with a null stratum, of all rows; from one pass."""
    parts = by_stratum(df, stratum, value)
    total = parts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.coalesce(F.sum("sum"), F.lit(0.0)).alias("sum"))
    mean = F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(F.lit(0.0))
    return parts.unionByName(total.select(F.lit(None).cast("string").alias("stratum"), "count", "sum", mean.alias("mean")))


def field_truth(df: DataFrame, stratum: str | Column, fields: list[str]) -> DataFrame:
    """rows of each stratum and the mean of each field."""
    return df.groupBy(_stratum(stratum).alias("stratum")).agg(F.count("*").alias("count"), *[F.avg(F.col(f).cast("double")).alias(f"mean_{f}") for f in fields])


def first_appearance(df: DataFrame, stratum: str | Column, position: str) -> DataFrame:
    """stratum, first_position, rows."""
    return df.groupBy(_stratum(stratum).alias("stratum")).agg(F.min(position).alias("first_position"), F.count("*").alias("rows"))


def deduplicated(df: DataFrame, seq: str = "seq", keep_last_of: str | None = None) -> DataFrame:
    """One row for each seq; with ``keep_last_of`` that with the largest such value, else the one that sorts first by all
    columns, so that conflicting rows give the same result whatever their order."""
    if keep_last_of is None:
        return df.groupBy(seq).agg(F.min(F.struct(*df.columns)).alias("row")).select("row.*")
    best = df.groupBy(seq).agg(F.max_by(F.struct(*df.columns), F.col(keep_last_of)).alias("row"))
    return best.select("row.*")


def archive_checks(df: DataFrame, seq: str, stratum: str, ts: str, values: list[str]) -> DataFrame:
    """One row: rows, distinct and duplicate seq, missing seq (from 0 to the largest), sensors, least and most rows of
    a sensor, first and last time in microseconds, and the mean of each value over deduplicated rows."""
    rows = df.agg(F.count("*").alias("rows"))
    one = deduplicated(df, seq)
    per = one.groupBy(stratum).agg(
        F.count("*").alias("n"), F.max(seq).alias("top"), F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("hi"),
        *[F.sum(F.col(v).cast("double")).alias(f"s_{v}") for v in values], *[F.count(v).alias(f"c_{v}") for v in values],
    )
    got = per.agg(
        F.sum("n").alias("distinct_seq"), (F.max("top") + 1 - F.sum("n")).alias("missing_seq"), F.count("*").alias("sensors"), F.min("n").alias("least_rows"), F.max("n").alias("most_rows"),
        F.min("lo").alias("first_micros"), F.max("hi").alias("last_micros"), *[(F.sum(f"s_{v}") / F.sum(f"c_{v}")).alias(f"mean_{v}") for v in values],
    )
    return rows.crossJoin(got).withColumn("duplicates", F.col("rows") - F.col("distinct_seq"))  # one row each


def latest(df: DataFrame, stratum: str, order: str) -> DataFrame:
    """The row with the largest order of each stratum."""
    return df.groupBy(stratum).agg(F.max_by(F.struct(*[c for c in df.columns if c != stratum]), order).alias("row")).select(stratum, "row.*")
