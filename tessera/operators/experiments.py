"""Comparisons of methods: summaries with t-intervals, paired differences, error sweeps, workload evaluations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stats import accuracy_loss, covered, relative_error, t_score
from tessera.sources import synthetic

from . import exact, sampling
from .adaptive import dynamic_va, static_va
from .allocation import hamilton
from .estimates import estimate_mean, srs_estimate

METHODS = ("exact", "uniform", "oasrs", "static", "dynamic")


def summary(runs: DataFrame, keys: list[str], error: str, coverage: str | None = None, rate: str | None = None) -> DataFrame:
    """n, mean and deviation of the error, its 95% t-interval (from 0 up), share of covered runs and mean throughput."""
    e = F.col(error).cast("double")
    got = runs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e).alias("mean_error"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("sd_error"),
        *([F.avg(F.col(coverage).cast("double")).alias("coverage")] if coverage else []), *([F.avg(rate).alias("mean_rate")] if rate else []),
    )
    half = F.coalesce(t_score(F.col("n")) * F.col("sd_error") / F.sqrt("n"), F.lit(0.0))
    return got.withColumns({"low": F.greatest(F.lit(0.0), F.col("mean_error") - half), "high": F.col("mean_error") + half})


def error_bars(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and half the 95% interval: 2.776 deviations of the mean for five runs, else 1.96."""
    got = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    return got.withColumn("half", F.when(F.col("n") == 5, F.lit(2.776)).otherwise(F.lit(1.96)) * F.col("sd") / F.sqrt("n"))


def paired_difference(runs: DataFrame, keys: list[str], pair: str, method: str, error: str, base: str) -> DataFrame:
    """Of each other method: pairs, mean and deviation of the base method's error minus its own, and the t-interval."""
    left = runs.where(F.col(method) == base).select(*keys, pair, F.col(error).alias("__base"))
    both = runs.where(F.col(method) != base).join(left, [*keys, pair]).withColumn("__d", F.col("__base") - F.col(error))
    got = both.groupBy(*keys, method).agg(F.count("*").alias("pairs"), F.avg("__d").alias("mean_difference"), F.coalesce(F.stddev_samp("__d"), F.lit(0.0)).alias("sd_difference"))
    half = F.coalesce(t_score(F.col("pairs")) * F.col("sd_difference") / F.sqrt("pairs"), F.lit(0.0))
    return got.withColumns({"low": F.col("mean_difference") - half, "high": F.col("mean_difference") + half})


def median_error(runs: DataFrame, keys: list[str], error: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.median(F.col(error).cast("double")).alias("median_error"))


def seeded_means(df: DataFrame, stratum: str, value: str, ids, capacity: int, seeds: list[int]) -> DataFrame:
    """seed, estimate, standard_error, exact and covered: the mean from a sample for each seed."""
    truth = df.agg(F.avg(F.col(value).cast("double")).alias("exact"))
    runs = [estimate_mean(sampling.stratified(df, stratum, ids, capacity, seed=s), value).select(F.lit(s).alias("seed"), "estimate", "standard_error") for s in seeds]
    out = reduce(DataFrame.unionAll, runs).crossJoin(truth)  # one row
    return out.withColumn("covered", covered(F.col("estimate"), F.col("standard_error"), F.col("exact")))


def fraction_sweep(df: DataFrame, stratum: str, value: str, ids, fractions: list[float], seed: int = 42, rounding: str = "floor") -> DataFrame:
    """fraction, method, sampled, estimate, exact and loss (per cent) of uniform and stratified samples of a size.

    A stratum's capacity is the size over the number of strata, rounded down or, with "ceil", up.
    """
    n, k = df.count(), df.select(stratum).distinct().count()
    truth = df.agg(F.avg(F.col(value).cast("double")).alias("exact"))
    out = []
    for f in fractions:
        size = max(1, int(n * f))
        per = max(1, -(-size // k) if rounding == "ceil" else size // k)
        drawn = sampling.srs(df, ids, size, seed)
        out.append(srs_estimate(drawn, n, size, value).select(F.lit(f).alias("fraction"), F.lit("uniform").alias("method"), F.col("sample_size").alias("sampled"), F.col("mean").alias("estimate")))
        s = sampling.stratified(df, stratum, ids, per, seed=seed)
        both = estimate_mean(s, value).crossJoin(s.strata.agg(F.sum("sample_size").alias("sampled")))  # one row each
        out.append(both.select(F.lit(f).alias("fraction"), F.lit("oasrs").alias("method"), "sampled", "estimate"))
    got = reduce(DataFrame.unionAll, out).crossJoin(truth)
    return got.withColumn("loss", accuracy_loss(F.col("estimate"), F.col("exact")))


def evaluate(df: DataFrame, stratum: str, position: str, value: str, ids, budget: int, seed: int = 42, interval: int = 500, methods=METHODS) -> DataFrame:
    """method, exact, estimate, standard_error, relative_error, covered and sampled of each method at one budget."""
    names = [r.s for r in df.select(F.col(stratum).cast("string").alias("s")).distinct().collect()]
    truth = exact.ground_truth(df, stratum, value).where("stratum is null").select(F.col("mean").alias("exact"))
    n = df.count()
    out = []
    for m in methods:
        if m == "exact":
            got = truth.select(F.col("exact").alias("estimate"), F.lit(0.0).alias("standard_error"), F.lit(n).cast("long").alias("sampled"))
        elif m == "uniform":
            got = srs_estimate(sampling.srs(df, ids, budget, seed), n, budget, value).select(F.col("mean").alias("estimate"), F.col("mean_error").alias("standard_error"), F.col("sample_size").alias("sampled"))
        else:
            if m == "oasrs":
                s = sampling.stratified(df, stratum, ids, capacities=hamilton(budget, dict.fromkeys(names, 1.0)), seed=seed)
            elif m == "static":
                s = static_va(df, stratum, position, value, ids, budget, interval, seed=seed)
            else:
                s = dynamic_va(df, stratum, position, value, ids, budget, interval, seed=seed).sample
            got = estimate_mean(s, value).crossJoin(s.strata.agg(F.sum("sample_size").alias("sampled"))).select("estimate", "standard_error", "sampled")
        out.append(got.select(F.lit(m).alias("method"), "estimate", "standard_error", "sampled"))
    both = reduce(DataFrame.unionAll, out).crossJoin(truth)
    return both.withColumns({"relative_error": relative_error(F.col("estimate"), F.col("exact")), "covered": covered(F.col("estimate"), F.col("standard_error"), F.col("exact"))})


def sweep(cases: Iterable[tuple[dict, DataFrame]], stratum: str, position: str, value: str, ids, budgets: list[int], seeds: list[int], interval: int = 500, methods=METHODS) -> DataFrame:
    """evaluate() of each case (columns that name it, and its records), budget and seed, with these as columns."""
    out = []
    for names, df in cases:
        for budget in budgets:
            for seed in seeds:
                got = evaluate(df, stratum, position, value, ids, budget, seed, interval, methods)
                marks = {**names, "budget": budget, "seed": seed}
                out.append(got.select(*[F.lit(v).alias(k) for k, v in marks.items()], *got.columns))
    return reduce(DataFrame.unionAll, out)


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.col("id") + 1)


def workload_sweep(spark: SparkSession, n: int, budgets: list[int], seeds: list[int], kinds=synthetic.KINDS, interval: int = 500, methods=METHODS) -> DataFrame:
    """All methods over the five-stratum workloads, at several budgets."""
    cases = [({"dataset": k}, _numbered(synthetic.five_strata(spark, k, n))) for k in kinds]
    return sweep(cases, "sensor_id", "position", "value", "id", budgets, seeds, interval, methods)


def heterogeneity_sweep(spark: SparkSession, n: int, ratios: list[float], seeds: list[int], budget: int = 200, interval: int = 500, methods=METHODS) -> DataFrame:
    """All methods over strata whose variances differ by several ratios."""
    cases = [({"ratio": float(r)}, _numbered(synthetic.five_strata(spark, "variance_skew", n, ratio=r))) for r in ratios]
    return sweep(cases, "sensor_id", "position", "value", "id", [budget], seeds, interval, methods)


def population_sweep(spark: SparkSession, n: int, seeds: list[int], levels=tuple(synthetic.SKEWS), budget: int = 200, interval: int = 500, methods=METHODS) -> DataFrame:
    """All methods over strata of several skews of size."""
    cases = [({"skew": k}, _numbered(synthetic.five_strata(spark, "combined_skew", n, skew=k))) for k in levels]
    return sweep(cases, "sensor_id", "position", "value", "id", [budget], seeds, interval, methods)


@dataclass(frozen=True)
class LateStress:
    """results: a row for each method and seed; allocations: what each stratum got at each event; first: where strata
    appear; late: seed, stratum, capacity at the end and the position of its first sampled row, of the dynamic method."""

    results: DataFrame
    allocations: DataFrame
    first: DataFrame
    late: DataFrame


def late_strata_stress(spark: SparkSession, n: int, seeds: list[int], budget: int = 300, interval: int = 10_000, methods=("uniform", "oasrs", "static", "dynamic")) -> LateStress:
    """Strata that appear after a quarter and after half of the records: what they get, and what it does to errors."""
    rows = synthetic.late_strata(spark, n)
    results = sweep([({"dataset": "late_strata"}, rows)], "sensor_id", "position", "value", "id", [budget], seeds, interval, methods)
    runs = [(s, dynamic_va(rows, "sensor_id", "position", "value", "id", budget, interval, seed=s)) for s in seeds]
    allocations = reduce(DataFrame.unionAll, [d.history.withColumn("seed", F.lit(s)) for s, d in runs])
    sampled = [d.sample.rows.groupBy("stratum").agg(F.min("position").alias("first_sampled")).withColumn("seed", F.lit(s)) for s, d in runs]
    last = allocations.groupBy("seed", "stratum").agg(F.max_by("capacity", "event_id").alias("capacity"))
    late = last.join(reduce(DataFrame.unionAll, sampled), ["seed", "stratum"], "left").where(F.col("stratum").isin("S5", "S6"))
    return LateStress(results, allocations, exact.first_appearance(rows, "sensor_id", "position"), late)


@dataclass
class Measured:
    """Time of an action: seconds, records a second, microseconds a record."""

    name: str
    records: int
    seconds: float
    cpu_seconds: float

    @property
    def rate(self) -> float:
        return self.records / self.seconds if self.seconds else float("inf")

    @property
    def micros(self) -> float:
        return self.seconds / self.records * 1e6 if self.records else 0.0

    def row(self) -> dict:
        return asdict(self) | {"rate": self.rate, "micros": self.micros, "cpu_percent": 100 * self.cpu_seconds / self.seconds if self.seconds else 0.0}


def measured(name: str, records: int, action: Callable[[], object]) -> Measured:
    wall, cpu = time.perf_counter(), time.process_time()
    action()
    return Measured(name, records, time.perf_counter() - wall, time.process_time() - cpu)


def throughput_sweep(make: Callable[[int], DataFrame], sizes: list[int], stratum: str, ids, capacity: int, position: str | None = None, value: str | None = None) -> list[Measured]:
    """Times of a full scan, a uniform and a stratified sample at several sizes; with position and value, which adaptive
    samples need, of these as well, the dynamic one with twenty intervals."""
    out = []
    for n in sizes:
        df = make(n).cache()
        df.count()
        plans = {
            "scan": lambda df=df: df.groupBy(stratum).count(), "uniform": lambda df=df: sampling.srs(df, ids, capacity),
            "oasrs": lambda df=df: sampling.stratified(df, stratum, ids, capacity, prune=True).rows,
        }
        if position and value:
            plans["static"] = lambda df=df, n=n: static_va(df, stratum, position, value, ids, capacity, max(1, n // 20)).rows
            plans["dynamic"] = lambda df=df, n=n: dynamic_va(df, stratum, position, value, ids, capacity, max(1, n // 20)).sample.rows
        for name, plan in plans.items():
            out.append(measured(name, n, lambda plan=plan: plan().write.format("noop").mode("overwrite").save()))
        df.unpersist()
    return out
