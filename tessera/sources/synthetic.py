"""Generated streams. Values depend on seed and record number alone, not on partitions."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.priority import uniform


@dataclass(frozen=True)
class StratumSpec:
    """A stratum's name, distribution (uniform, gaussian, poisson or constant) with parameters, and share of arrivals."""

    name: str
    distribution: str
    params: Mapping[str, float] = field(default_factory=dict)
    weight: float = 1.0

    def __post_init__(self):
        if self.distribution not in ("uniform", "gaussian", "poisson", "constant"):
            raise ValueError(f"unknown distribution {self.distribution!r}")
        if self.weight < 0:
            raise ValueError("a weight must not be negative")


def _unit(seed: int, salt: str) -> Column:
    return uniform(f"{seed}/{salt}", "id")


def normal(seed: int, salt: str) -> Column:
    """A standard normal number from two uniform ones."""
    radius = F.sqrt(-2 * F.log(1 - _unit(seed, salt + "r")))
    return radius * F.cos(_unit(seed, salt + "a") * (2 * math.pi))


#: Rates up to which Poisson numbers come from their distribution function; above, from a normal number.
TABLE_RATE = 400.0


def poisson(rate: float, seed: int, salt: str = "v") -> Column:
    """A Poisson number of the given rate by id: the first whose cumulated probability is above a uniform number.

    For a rate above TABLE_RATE, a normal number with the correction for skewness, rounded; its error is less than one.
    """
    if rate > TABLE_RATE:
        z = normal(seed, salt)
        return F.greatest(F.lit(0.0), F.floor(z * math.sqrt(rate) + (z * z - 1) / 6 + (rate + 0.5)).cast("double"))
    ends, total, log = [], 0.0, -rate
    for k in range(int(rate + 12 * math.sqrt(rate) + 25)):
        total += math.exp(log)
        ends.append(min(1.0, total))
        log += math.log(rate) - math.log(k + 1) if rate > 0 else -math.inf
    u = _unit(seed, salt)
    return F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda x: x <= u)).cast("double")


def _frame(spark: SparkSession, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("a stream can't have fewer than no records")
    return spark.range(n)


def _times(start: float, step: float) -> Column:
    return (F.lit(float(start)) + F.col("id") * float(step)).alias("timestamp")


def uniform_stream(spark: SparkSession, n: int, low=0.0, high=1.0, name="S1", start=0.0, step=0.001, seed=42) -> DataFrame:
    return _frame(spark, n).select("id", F.lit(name).alias("sensor_id"), (_unit(seed, "v") * (high - low) + low).alias("value"), _times(start, step))


def gaussian_stream(spark: SparkSession, n: int, mean=0.0, std=1.0, name="S1", start=0.0, step=0.001, seed=42) -> DataFrame:
    return _frame(spark, n).select("id", F.lit(name).alias("sensor_id"), (normal(seed, "v") * std + mean).alias("value"), _times(start, step))


def poisson_stream(spark: SparkSession, n: int, rate=1.0, name="S1", start=0.0, step=0.001, seed=42) -> DataFrame:
    return _frame(spark, n).select("id", F.lit(name).alias("sensor_id"), poisson(float(rate), seed).alias("value"), _times(start, step))


def multi_strata_stream(spark: SparkSession, specs: list[StratumSpec], n: int, start=0.0, step=0.001, seed=42) -> DataFrame:
    """Records of several strata, mixed by their weights; if all weights are 0, equally."""
    if not specs:
        raise ValueError("no strata")
    weights = np.array([s.weight for s in specs], float)
    ends = np.cumsum(weights / weights.sum() if weights.sum() else np.full(len(specs), 1 / len(specs)))
    pick = _unit(seed, "stratum")
    which = F.lit(len(specs) - 1)
    for i in reversed(range(len(specs) - 1)):
        which = F.when(pick < float(ends[i]), F.lit(i)).otherwise(which)
    rows = _frame(spark, n).withColumn("which", which)
    value = F.lit(None).cast("double")
    for i, s in enumerate(specs):
        p, here = s.params, F.col("which") == i
        draw = {
            "poisson": lambda p=p: poisson(float(p["lam"]), seed),
            "gaussian": lambda p=p: normal(seed, "v") * float(p.get("std", 1)) + float(p.get("mean", 0)),
            "uniform": lambda p=p: _unit(seed, "v") * float(p.get("high", 1) - p.get("low", 0)) + float(p.get("low", 0)),
            "constant": lambda p=p: F.lit(float(p["value"])),
        }[s.distribution]()
        value = F.when(here, draw).otherwise(value)
    names = F.element_at(F.array(*[F.lit(s.name) for s in specs]), F.col("which") + 1)
    rows = rows.withColumn("value", value)
    return rows.select("id", names.alias("sensor_id"), "value", _times(start, step))


def _specs(kind: str, rows: list[tuple]) -> list[StratumSpec]:
    keys = ("mean", "std") if kind == "gaussian" else ("lam",)
    return [StratumSpec(name, kind, dict(zip(keys, params, strict=True)), weight) for name, params, weight in rows]


#: The parameters of the usual workloads: name, distribution's parameters, share of arrivals.
PRESETS = {
    "gaussian": _specs("gaussian", [("A", (10, 5), 8000), ("B", (1000, 50), 2000), ("C", (10_000, 500), 100)]),
    "poisson": _specs("poisson", [("A", (10,), 8000), ("B", (1000,), 2000), ("C", (100_000_000,), 100)]),
    "skewed_gaussian": _specs("gaussian", [("A", (100, 10), 80), ("B", (1000, 100), 19), ("C", (10_000, 1000), 1)]),
    "skewed_poisson": _specs("poisson", [("A", (10,), 80), ("B", (1000,), 19.99), ("C", (100_000_000,), 0.01)]),
}
#: The five-stratum workload's means, its skewed shares, and levels of population skew.
MEANS, SKEWED = (10, 12, 14, 16, 18), (60, 20, 10, 5, 5)
SKEWS = {"low": (1, 1, 1, 1, 1), "moderate": (50, 20, 10, 10, 10), "high": (20, 5, 2, 1, 0), "extreme": (100, 10, 2, 1, 0)}
KINDS = ("uniform", "population_skew", "variance_skew", "combined_skew", "distribution_shift")


def preset(spark: SparkSession, name: str, n: int, seed: int = 42) -> DataFrame:
    return multi_strata_stream(spark, PRESETS[name], n, seed=seed)


def five_strata(spark: SparkSession, kind: str, n: int, seed: int = 42, ratio: float = 100.0, skew: str | None = None) -> DataFrame:
    """id, sensor_id (S1 to S5), value, timestamp (the record's number).

    Deviations are 1, or with variance skew 1 for two strata and the root of ``ratio`` for three; with a shift, those of
    S4 and S5 are eightfold from the middle on. Shares are equal, skewed, or those of a level of ``skew``.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown workload {kind!r}")
    shares = SKEWS[skew] if skew else SKEWED if kind in ("population_skew", "combined_skew") else SKEWS["low"]
    ends = np.cumsum([max(s, 1e-6) for s in shares]) / sum(max(s, 1e-6) for s in shares)
    root = math.sqrt(ratio)
    deviations = (1, 1, root, root, root) if kind in ("variance_skew", "combined_skew") or skew else (1,) * 5
    pick, which = _unit(seed, "stratum"), F.lit(5)
    for i in reversed(range(4)):
        which = F.when(pick < float(ends[i]), F.lit(i + 1)).otherwise(which)
    rows = _frame(spark, n).withColumn("which", which)
    table = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("which"))
    late = F.when((F.col("id") >= n // 2) & (F.col("which") >= 4), 8.0).otherwise(1.0) if kind == "distribution_shift" else F.lit(1.0)
    return rows.select("id", F.concat(F.lit("S"), F.col("which").cast("string")).alias("sensor_id"), (table(MEANS) + normal(seed, "v") * table(deviations) * late).alias("value"), F.col("id").alias("timestamp"))


#: The late-strata workload's deviations.
LATE_DEVIATIONS = (1, 2, 4, 1, 15, 25)


def late_strata(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id, sensor_id, value, position (from 1): S1 to S4 from the start, S5 from a quarter on, S6 from the middle on."""
    present = F.when(F.col("id") >= n // 2, 6).when(F.col("id") >= n // 4, 5).otherwise(4)
    rows = _frame(spark, n).withColumn("which", (F.floor(_unit(seed, "stratum") * present) + 1).cast("int"))
    table = F.element_at(F.array(*[F.lit(float(x)) for x in LATE_DEVIATIONS]), F.col("which"))
    value = F.lit(10.0) * F.col("which") + normal(seed, "v") * table
    return rows.select("id", F.concat(F.lit("S"), F.col("which").cast("string")).alias("sensor_id"), value.alias("value"), (F.col("id") + 1).alias("position"))
