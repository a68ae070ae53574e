"""Linear queries over stratified samples: sums, means and counts, their variances and confidence limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import null_safe_join
from tessera.functions.stats import with_interval

from .sampling import Sample

ColumnLike = Column | str


def _value(value: ColumnLike) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def stratum_stats(sample: Sample, value: ColumnLike) -> DataFrame:
    """Of each stratum: its counts and weight, and the sampled values' number, sum, mean and variance (0 below two)."""
    of = sample.rows.select("stratum", _value(value).alias("v")).groupBy("stratum").agg(
        F.count("*").alias("y"), F.sum("v").alias("sampled_sum"), F.avg("v").alias("sampled_mean"), F.var_samp("v").alias("s2")
    )
    zero = F.lit(0.0)
    of = of.withColumnRenamed("stratum", "__stratum")
    return sample.strata.join(of, F.col("stratum").eqNullSafe(F.col("__stratum")), "left").select(
        "stratum", "total_seen", "capacity", "weight", F.coalesce("y", F.lit(0)).alias("y"),
        F.coalesce("sampled_sum", zero).alias("sampled_sum"), F.coalesce("sampled_mean", zero).alias("sampled_mean"),
        F.greatest(F.coalesce(F.when(F.col("y") > 1, F.col("s2")), zero), zero).alias("s2"),
    )


def stratum_sums(sample: Sample, value: ColumnLike) -> DataFrame:
    return stratum_stats(sample, value).select("stratum", (F.col("weight") * F.col("sampled_sum")).alias("sum"))


def stratum_means(sample: Sample, value: ColumnLike) -> DataFrame:
    return stratum_stats(sample, value).select("stratum", F.col("sampled_mean").alias("mean"))


def stratum_variances(sample: Sample, value: ColumnLike) -> DataFrame:
    """stratum, y, s2: variance of the sampled values; sum_variance: the stratum's part in a sum's variance."""
    return stratum_stats(sample, value).select("stratum", "y", "s2", _sum_term().alias("sum_variance"))


def approx_sum(sample: Sample, value: ColumnLike) -> DataFrame:
    """sum: each stratum's sampled sum times its weight."""
    return stratum_stats(sample, value).agg(F.coalesce(F.sum(F.col("weight") * F.col("sampled_sum")), F.lit(0.0)).alias("sum"))


def approx_mean(sample: Sample, value: ColumnLike) -> DataFrame:
    """mean: the sum over all rows that went by; 0 without rows."""
    total = F.sum("total_seen")
    return stratum_stats(sample, value).agg(F.when(total > 0, F.sum(F.col("weight") * F.col("sampled_sum")) / total).otherwise(F.lit(0.0)).alias("mean"))


def approx_count(sample: Sample, predicate: Column | None = None) -> DataFrame:
    """count: sampled rows (those that the predicate holds for) times their strata's weights.

    The predicate is applied after sampling: below it, it would change what is sampled and the strata's counts. A
    stratum without capacity counts 0, though its rows are known.
    """
    chosen = sample.rows if predicate is None else sample.rows.where(predicate)
    of = chosen.groupBy("stratum").agg(F.count("*").alias("n"))
    both = sample.strata.join(of.withColumnRenamed("stratum", "__stratum"), F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    return both.agg(F.coalesce(F.sum(F.col("weight") * F.coalesce("n", F.lit(0))), F.lit(0.0)).alias("count"))


def _sum_term() -> Column:
    c, y = F.col("total_seen").cast("double"), F.col("y")
    plain = (c <= F.col("capacity")) | (c <= y) | (y <= 1)
    return F.when(plain, F.lit(0.0)).otherwise(c * (c - y) * F.col("s2") / y)


def _degenerate() -> Column:
    """Strata with rows but one sampled row at most: they add no variance, so the limits are too narrow."""
    return F.coalesce(F.sum(F.when((F.col("y") <= 1) & (F.col("total_seen") > F.col("y")), 1).otherwise(0)), F.lit(0)).cast("long").alias("degenerate_strata")


def estimate_sum(sample: Sample, value: ColumnLike, level: float = 0.95, z: float | None = None) -> DataFrame:
    """estimate, variance and limits of the sum over all rows, and the number of degenerate strata."""
    got = stratum_stats(sample, value).agg(
        F.coalesce(F.sum(F.col("weight") * F.col("sampled_sum")), F.lit(0.0)).alias("estimate"), F.coalesce(F.sum(_sum_term()), F.lit(0.0)).alias("variance"), _degenerate()
    )
    return with_interval(got, level, z)


def estimate_mean(sample: Sample, value: ColumnLike, level: float = 0.95, z: float | None = None) -> DataFrame:
    """estimate, variance and limits of the mean over all rows, and the number of degenerate strata."""
    total = F.sum("total_seen").cast("double")
    got = stratum_stats(sample, value).agg(
        F.when(total > 0, F.sum(F.col("weight") * F.col("sampled_sum")) / total).otherwise(F.lit(0.0)).alias("estimate"),
        F.when(total > 0, F.sum(_sum_term()) / (total * total)).otherwise(F.lit(0.0)).alias("variance"), _degenerate(),
    )
    return with_interval(got, level, z)


estimate_sum_error, estimate_mean_error = estimate_sum, estimate_mean


def estimate_means(sample: Sample, values: list[str], level: float = 0.95) -> DataFrame:
    """One row for each of several columns (field): the mean's estimate and limits, all from one sample."""
    parts = [F.struct(F.lit(v).alias("field"), _value(v).alias("v")) for v in values]
    long = sample.rows.select("stratum", F.explode(F.array(*parts)).alias("x")).select("stratum", "x.field", "x.v")
    of = long.groupBy("field", "stratum").agg(F.count("v").alias("y"), F.sum("v").alias("sampled_sum"), F.var_samp("v").alias("s2"))
    both = null_safe_join(of, sample.strata.select("stratum", "total_seen", "capacity", "weight"), ["stratum"]).withColumn("s2", F.coalesce("s2", F.lit(0.0)))
    total = F.sum("total_seen").cast("double")
    got = both.groupBy("field").agg((F.sum(F.col("weight") * F.col("sampled_sum")) / total).alias("estimate"), (F.sum(_sum_term()) / (total * total)).alias("variance"), _degenerate())
    return with_interval(got, level)


def srs_estimate(sample: DataFrame, total: int | Column, capacity: int, value: ColumnLike) -> DataFrame:
    """sum and mean from a uniform sample, and the mean's standard error."""
    from tessera.functions.stats import srs_mean_error

    c = total if isinstance(total, Column) else F.lit(int(total))
    got = sample.select(_value(value).alias("v")).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.avg("v").alias("m"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s2"))
    weight = F.when(c > capacity, c / F.lit(float(capacity))).otherwise(F.lit(1.0))
    return got.select(
        F.coalesce(weight * F.col("s"), F.lit(0.0)).alias("sum"), F.coalesce("m", F.lit(0.0)).alias("mean"), F.col("n").alias("sample_size"), weight.alias("weight"),
        F.coalesce(srs_mean_error(F.col("s2"), F.col("n"), c), F.lit(0.0)).alias("mean_error"),
    )
