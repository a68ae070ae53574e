"""Bounded uniform and stratified samples.

A reservoir of capacity N is the N rows with the largest priorities: every row has the same chance, min(1, N / C), as
with one-by-one replacement, but samples of parts of the data can be merged, so that each task keeps N rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.priority import priority
from tessera.functions.shared import checkpointed, small

Ids = str | list[str]


def _ids(ids: Ids) -> list[str]:
    return [ids] if isinstance(ids, str) else list(ids)


@dataclass(frozen=True)
class Sample:
    """strata: stratum, total_seen, capacity, sample_size, weight, is_exact, sampling_fraction. rows: stratum, priority and the sampled rows' columns."""

    strata: DataFrame
    rows: DataFrame

    def weights(self) -> DataFrame:
        return self.strata.select("stratum", "weight")

    def only(self, *strata: str) -> Sample:
        """The sample of some strata alone."""
        return Sample(self.strata.where(F.col("stratum").isin(*strata)), self.rows.where(F.col("stratum").isin(*strata)))

    def cleared(self, keep_strata: bool = True) -> Sample:
        """Without rows; with the strata's names and capacities, counts at 0, or without strata either."""
        empty = self.strata.where(F.lit(keep_strata)).select(
            "stratum", F.lit(0).cast("long").alias("total_seen"), "capacity", F.lit(0).cast("long").alias("sample_size"),
            F.lit(1.0).alias("weight"), F.lit(True).alias("is_exact"), F.lit(1.0).alias("sampling_fraction"),
        )
        return Sample(empty, self.rows.where("false"))


def _stratum(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def strata_columns(total: Column, size: Column, filled: bool = True) -> list[Column]:
    """weight, is_exact and sampling_fraction.

    filled: a stratum weighs C / N once it has more rows than its capacity, as N = Y then. Else it weighs C / Y
    wherever Y > 0, which is the same unless a capacity was cut after rows had gone by.
    """
    weight = F.when(size > 0, total / size).otherwise(F.lit(1.0)) if not filled else F.when(total > F.col("capacity"), total / F.col("capacity")).otherwise(F.lit(1.0))
    return [weight.alias("weight"), (size >= total).alias("is_exact"), F.when(total > 0, size / total).otherwise(F.lit(1.0)).alias("sampling_fraction")]


def srs(df: DataFrame, ids: Ids, capacity: int, seed: int = 42) -> DataFrame:
    """A uniform sample of at most ``capacity`` rows, with its priorities."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    return df.withColumn("priority", priority(seed, *_ids(ids))).orderBy(F.desc("priority"), *_ids(ids)).limit(capacity)


def srs_representation(sample: DataFrame, stratum: str | Column) -> DataFrame:
    """stratum, sampled: rows of each stratum in a uniform sample; strata without any are absent."""
    return sample.groupBy(_stratum(stratum).alias("stratum")).agg(F.count("*").alias("sampled"))


def _floor(total: Column, bound: int) -> Column:
    """A priority that more than ``bound`` of ``total`` rows exceed, but for a chance of about 1e-9."""
    share = F.lit(bound + 6 * bound**0.5 + 16) / total
    return F.when(share >= 1, F.lit("")).otherwise(F.lower(F.lpad(F.hex(F.floor((1 - share) * float(1 << 52)).cast("long")), 13, "0")))


def _large(df: DataFrame) -> bool:
    """Whether Spark's plan expects more than a GB; it takes no job to tell."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1 << 30


def pruned_pool(df: DataFrame, stratum: str | Column, ids: Ids, bound: int, seed: int, counts: DataFrame) -> DataFrame:
    """pool(), for large data: rows that can't be in it are left out by comparison before anything is sorted.

    counts (stratum, total_seen) says from which priority on. Should a stratum get too few rows, nothing is left out.
    The pool is written: its rows are bounded.
    """
    least = small(counts.select("stratum", F.least("total_seen", F.lit(bound).cast("long")).alias("__least"), _floor(F.col("total_seen"), bound).alias("__floor")))
    keyed = df.withColumns({"stratum": _stratum(stratum), "priority": priority(seed, *_ids(ids))})
    some = keyed.join(least.select("stratum", "__floor"), keyed["stratum"].eqNullSafe(least["stratum"]), "inner").drop(least["stratum"]).where("priority >= __floor").drop("__floor")
    out = checkpointed(pool(some, "stratum", ids, bound, seed))
    got = out.groupBy("stratum").agg(F.count("*").alias("n"))
    short = least.join(got, least["stratum"].eqNullSafe(got["stratum"]), "left").where(F.coalesce("n", F.lit(0)) < F.col("__least"))
    return pool(df, stratum, ids, bound, seed) if short.limit(1).count() else out


def pool(df: DataFrame, stratum: str | Column, ids: Ids, bound: int, seed: int = 42) -> DataFrame:
    """The ``bound`` rows of largest priority of each stratum, with stratum, priority and rank.

    The bound is a literal, so that each task drops what can't be among them before anything is moved, and a stratum
    with a third of all rows sends as few rows as any other.
    """
    keyed = df.withColumns({"stratum": _stratum(stratum), "priority": priority(seed, *_ids(ids))})
    order = Window.partitionBy("stratum").orderBy(F.desc("priority"), *_ids(ids))
    return keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(int(bound)))


def totals(df: DataFrame, stratum: str | Column) -> DataFrame:
    return df.groupBy(_stratum(stratum).alias("stratum")).agg(F.count("*").alias("total_seen"))


def prefix(pooled: DataFrame, counts: DataFrame, capacities: DataFrame, default: int | None, filled: bool) -> Sample:
    """The sample that capacities (stratum, capacity) take from pooled rows; counts: stratum, total_seen.

    A stratum without a capacity gets the default, or else 0.
    """
    known = counts.join(small(capacities.select("stratum", "capacity")), "stratum", "left")
    known = known.withColumn("capacity", F.coalesce(F.col("capacity").cast("int"), F.lit(default or 0)))
    strata = known.withColumn("sample_size", F.least("total_seen", F.col("capacity").cast("long")))
    strata = strata.select("stratum", "total_seen", "capacity", "sample_size", *strata_columns(F.col("total_seen"), F.col("sample_size"), filled))
    dealt = small(strata.select(F.col("stratum").alias("__stratum"), F.col("capacity").alias("__capacity")))
    rows = pooled.join(dealt, F.col("stratum").eqNullSafe(F.col("__stratum"))).where("rank <= __capacity").drop("__stratum", "__capacity", "rank")
    return Sample(strata, rows)


def stratified(
    df: DataFrame,
    stratum: str | Column,
    ids: Ids,
    capacity: int | None = None,
    capacities: DataFrame | Mapping[str, int] | Callable[[str], int] | None = None,
    seed: int = 42,
    prune: bool | None = None,
) -> Sample:
    """A sample with a fixed capacity for each stratum; strata are whatever values df has.

    ``capacity`` holds for all, or for those that ``capacities`` leaves out: a table or mapping from stratum to
    capacity, or a function of a stratum's name. Capacities are at least 1.

    prune: whether to count first and sort only rows that can be in the sample (see pruned_pool); by default if df is
    large. The sample is the same.
    """
    counts = totals(df, stratum)
    prune = _large(df) if prune is None else prune
    if prune:
        counts = checkpointed(counts)
    if callable(capacities):
        found = [r.stratum for r in counts.select("stratum").collect()]
        capacities = {s: capacities(s) for s in found}
    if isinstance(capacities, Mapping):
        if any(int(n) < 1 for n in capacities.values()):
            raise ValueError("capacity must be at least 1")
        bound = max([*map(int, capacities.values()), capacity or 1])
        capacities = df.sparkSession.createDataFrame([(str(k), int(v)) for k, v in capacities.items()], "stratum string, capacity int")
    elif capacities is not None:
        most = capacities.agg(F.max("capacity").alias("most"), F.min("capacity").alias("least")).first()
        if most.least is not None and most.least < 1:
            raise ValueError("capacity must be at least 1")
        bound = max(most.most or 1, capacity or 1)
    else:
        if capacity is None or capacity < 1:
            raise ValueError("capacity must be at least 1")
        bound = capacity
    pooled = pruned_pool(df, stratum, ids, bound, seed, counts) if prune else pool(df, stratum, ids, bound, seed)
    if capacities is None:
        strata = counts.withColumns({"capacity": F.lit(int(bound)), "sample_size": F.least("total_seen", F.lit(int(bound)).cast("long"))})
        strata = strata.select("stratum", "total_seen", "capacity", "sample_size", *strata_columns(F.col("total_seen"), F.col("sample_size")))
        return Sample(strata, pooled.drop("rank"))
    return prefix(pooled, counts, capacities, capacity, filled=True)


def merged(a: Sample, b: Sample, ids: Ids, capacity: int) -> Sample:
    """The sample of two inputs without common rows, from the samples of either with the same seed and capacity."""
    order = Window.partitionBy("stratum").orderBy(F.desc("priority"), *_ids(ids))
    rows = a.rows.unionByName(b.rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(int(capacity))).drop("rank")
    both = a.strata.unionByName(b.strata).groupBy("stratum").agg(F.sum("total_seen").alias("total_seen"))
    strata = both.withColumns({"capacity": F.lit(int(capacity)), "sample_size": F.least("total_seen", F.lit(int(capacity)).cast("long"))})
    return Sample(strata.select("stratum", "total_seen", "capacity", "sample_size", *strata_columns(F.col("total_seen"), F.col("sample_size"))), rows)
