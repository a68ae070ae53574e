"""Confidence levels, intervals and error measures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-sided normal quantiles that are looked up for a level.
Z_SCORES = {0.68: 1.0, 0.80: 1.2816, 0.90: 1.645, 0.95: 1.96, 0.98: 2.326, 0.99: 2.576, 0.995: 2.807, 0.997: 3.0}
#: Two-sided 95% quantiles of Student's t, for 1 to 30 degrees of freedom.
T_95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)


def normal_quantile(p: float) -> float:
    """The normal distribution's quantile, by bisection on its error function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def z_score(level: float = 0.95, z: float | None = None) -> float:
    """z if given (not negative), else the score of a confidence level between 0 and 1."""
    if z is not None:
        if not z >= 0:
            raise ValueError("z must not be negative")
        return float(z)
    if not 0 < level < 1:
        raise ValueError("a confidence level lies between 0 and 1")
    near = [v for k, v in Z_SCORES.items() if abs(k - level) < 1e-4]
    return near[0] if near else normal_quantile(1 - (1 - level) / 2)


def t_score(n: Column) -> Column:
    """The 95% quantile for n observations: Student's t up to 30 degrees of freedom, then 1.96; null below two."""
    table = F.array(*[F.lit(x) for x in T_95])
    return F.when(n < 2, F.lit(None).cast("double")).when(n <= 31, F.element_at(table, F.greatest(n - 1, F.lit(1)).cast("int"))).otherwise(F.lit(1.96))


def with_interval(df: DataFrame, level: float = 0.95, z: float | None = None) -> DataFrame:
    """df with limits around ``estimate``, from ``variance``: standard error, bound, lower and upper end, relative bound."""
    score = z_score(level, z)
    return (
        df.withColumn("standard_error", F.sqrt(F.greatest("variance", F.lit(0.0))))
        .withColumn("confidence_level", F.lit(float(level)))
        .withColumn("z_score", F.lit(score))
        .withColumn("error_bound", F.col("standard_error") * score)
        .withColumn("lower_bound", F.col("estimate") - F.col("error_bound"))
        .withColumn("upper_bound", F.col("estimate") + F.col("error_bound"))
        .withColumn("relative_bound", F.when(F.col("estimate") == 0, F.lit(0.0)).otherwise(F.col("error_bound") / F.abs("estimate")))
    )


def sigma_ranges(estimate: Column, error: Column, most: int = 3) -> Column:
    """A map from 1, 2, ... to the range (low, high) so many standard errors around the estimate."""
    parts = [x for k in range(1, most + 1) for x in (F.lit(k), F.struct((estimate - k * error).alias("low"), (estimate + k * error).alias("high")))]
    return F.create_map(*parts)


def absolute_error(approx: Column, exact: Column) -> Column:
    return F.abs(approx - exact)


def relative_error(approx: Column, exact: Column) -> Column:
    """The error over the exact value; for an exact 0: 0 if the estimate is 0 too, else infinite."""
    return F.when(exact == 0, F.when(approx == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.abs(approx - exact) / F.abs(exact))


def relative_error_eps(approx: Column, exact: Column, eps: float = 1e-12) -> Column:
    """The error over the exact value, or over eps if that is larger."""
    return F.abs(approx - exact) / F.greatest(F.abs(exact), F.lit(eps))


def accuracy_loss(approx: Column, exact: Column) -> Column:
    return 100 * relative_error(approx, exact)


def covered(approx: Column, error: Column, exact: Column, z: float = 1.96) -> Column:
    """Whether the exact value lies in the interval."""
    return F.abs(approx - exact) <= z * error


def srs_mean_error(variance: Column, n: Column, total: Column) -> Column:
    """Standard error of the mean of n of ``total`` rows drawn at random, with the finite population correction."""
    return F.sqrt(variance / n * (total - n) / F.greatest(total, F.lit(1)))


def expected_accepted(total_seen: Column, capacity: Column) -> Column:
    """How many of so many records a reservoir takes in on their way, on average: the first ones, then each with the
    probability that capacity has among the records so far. The sum over records is close to a logarithm."""
    seen, held = total_seen.cast("double"), capacity.cast("double")
    return F.when(seen <= held, seen).when(held <= 0, F.lit(0.0)).otherwise(held * (1 + F.log((seen + 0.5) / (held + 0.5))))
