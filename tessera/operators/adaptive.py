"""Variance-aware samples: one allocation after a burn-in, or allocations that follow the stream.

Rows carry a dense position (1, 2, ...). What depends on their order, the exponentially weighted variance, is put
together from segments: over a segment, mean and variance at its end are polynomials of the mean and variance at its
start, and polynomials of segments compose. So no stratum has to pass through one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .allocation import hamilton, hysteresis
from .sampling import Ids, Sample, pool, prefix, totals

#: Rows of a stratum that one segment holds at most, and segments that the driver folds at most.
SEGMENT, SEGMENTS = 1 << 16, 5_000_000


def welford(df: DataFrame, stratum: str, value: str) -> DataFrame:
    """stratum, count, mean, variance (0 below two rows)."""
    v = F.col(value).cast("double")
    return df.groupBy(F.col(stratum).cast("string").alias("stratum")).agg(F.count("*").alias("count"), F.avg(v).alias("mean"), F.greatest(F.coalesce(F.var_samp(v), F.lit(0.0)), F.lit(0.0)).alias("variance"))


def _composed(alpha: float) -> Column:
    """Of the sorted (position, v) in ``rows``: a, b, p, q, r such that mean' = a m + b and var' = a s + p m² + q m + r."""
    keep = 1 - alpha
    start = F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("abpqr", (1, 0, 0, 0, 0), strict=True)])

    def step(acc, row):
        d = row["v"] - acc["b"]
        return F.struct(
            (acc["a"] * keep).alias("a"), (acc["b"] * keep + row["v"] * alpha).alias("b"), ((acc["p"] + alpha * acc["a"] * acc["a"]) * keep).alias("p"),
            ((acc["q"] - 2 * alpha * acc["a"] * d) * keep).alias("q"), ((acc["r"] + alpha * d * d) * keep).alias("r"),
        )

    return F.aggregate("rows", start, step)


def segments(df: DataFrame, stratum: str, position: str, value: str, alpha: float, event: Column) -> DataFrame:
    """A row for each stratum, event and SEGMENT positions: rows, sum, sum of squares about the mean, first value, and
    the segment's composition."""
    rows = df.select(F.col(stratum).cast("string").alias("stratum"), event.alias("event"), F.col(position).alias("position"), F.col(value).cast("double").alias("v"))
    grouped = rows.groupBy("stratum", "event", F.floor(F.col("position") / SEGMENT).alias("part")).agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), (F.coalesce(F.var_pop("v"), F.lit(0.0)) * F.count("*")).alias("m2"), F.array_sort(F.collect_list(F.struct("position", "v"))).alias("rows")
    )
    return grouped.select("stratum", "event", "part", "n", "mean", "m2", F.element_at("rows", 1)["v"].alias("first"), _composed(alpha).alias("c"))


def ema_variance(df: DataFrame, stratum: str, position: str, value: str, alpha: float) -> DataFrame:
    """stratum, count, ema_mean, ema_variance after all rows in order of position.

    The first row sets the mean; each row then moves it by alpha of its distance d, and the variance s becomes
    (1 - alpha)(s + alpha d²).
    """
    parts = segments(df, stratum, position, value, alpha, F.lit(0))
    grouped = parts.groupBy("stratum").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct("part", "first", "c"))).alias("parts"))
    start = F.struct(F.element_at("parts", 1)["first"].alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        c, m = x["c"], acc["m"]
        return F.struct((c["a"] * m + c["b"]).alias("m"), (c["a"] * acc["s"] + c["p"] * m * m + c["q"] * m + c["r"]).alias("s"))

    end = F.aggregate("parts", start, step)
    return grouped.select("stratum", "count", end.alias("end")).select("stratum", "count", F.col("end.m").alias("ema_mean"), F.col("end.s").alias("ema_variance"))


def static_va(
    df: DataFrame, stratum: str, position: str, value: str, ids: Ids, budget: int, interval: int = 1000, minimum: int = 1, burn_in: int | None = None, max_fraction: float = 1.0, seed: int = 42
) -> Sample:
    """One allocation by rows times deviation, once ``burn_in`` and ``interval`` rows have gone by, then frozen.

    A stratum that comes later keeps capacity 0. With fewer rows than that, the allocation is made at the end.
    """
    start = max(interval if burn_in is None else burn_in, interval)
    before = welford(df.where(F.col(position) <= start), stratum, value).collect()  # a row for each stratum
    scores = {r.stratum: r["count"] * (math.sqrt(r.variance) if r["count"] > 1 else 1.0) for r in before}
    cap = max(int(budget * max_fraction), minimum)
    got = hamilton(budget, scores, minimum, dict.fromkeys(scores, cap)) if scores else {}
    capacities = df.sparkSession.createDataFrame(list(got.items()), "stratum string, capacity int")
    return prefix(pool(df, stratum, ids, budget, seed), totals(df, stratum), capacities, 0, filled=False)


@dataclass(frozen=True)
class Dynamic:
    """sample; history: event_id, records_seen, stratum, target, capacity, score, count, welford_variance, ema_variance; and first: stratum, first_position."""

    sample: Sample
    history: DataFrame
    first: DataFrame


def schedule(firsts: list[int], interval: int, rows: int) -> list[int]:
    """Positions of allocations: each first appearance, and whenever ``interval`` rows have gone by since the last; and the last row."""
    out, last = [], 0
    for p in [*sorted(firsts), rows + 1]:
        while last + interval < p and last + interval <= rows:
            last += interval
            out.append(last)
        if p <= rows and p != last:
            last = p
            out.append(p)
    if rows and last != rows:
        out.append(rows)
    return out


def _event_of(position: Column, events: list[int]) -> Column:
    """The number of the first event at or after a position. Between two irregular ones (first appearances) events lie
    evenly, so that a few stretches say all: where each starts, its first event's number, and its step."""
    stretches: list[list[int]] = []  # position and number of the first event, step, events
    for i, p in enumerate(events):
        if stretches and (stretches[-1][3] == 1 or p - events[i - 1] == stretches[-1][2]):
            stretches[-1][2:] = p - events[i - 1], stretches[-1][3] + 1
        else:
            stretches.append([p, i, 1, 1])
    out = F.lit(len(events))
    for start, first, step, n in reversed(stretches):
        last = start + (n - 1) * step
        number = F.lit(first) + F.greatest(F.ceil((position - start) / F.lit(float(step))), F.lit(0)).cast("int")
        out = F.when(position <= last, number).otherwise(out)
    return out.cast("int")


def reallocate(old: dict[str, int], counts: dict[str, int], variances: dict[str, float], budget: int, minimum: int, max_fraction: float, max_change: float, newcomers: int = 0):
    """Target and new capacities, and the scores: rows times the deviation that is being followed."""
    scores = {k: n * math.sqrt(max(variances[k], 1e-12)) for k, n in counts.items()}
    most = {k: min(n, max(minimum, int(budget * max_fraction))) for k, n in counts.items()}
    least = {k: min(minimum, most[k]) for k in counts}
    target = hamilton(budget, scores, least, most)
    return target, hysteresis(old, target, scores, max(1, math.ceil(budget * max_change)), least, most, newcomers), scores


def flink_allocation(counts: dict[str, int], variances: dict[str, float], budget: int) -> dict[str, int]:
    """The variant of the streaming job: minimum 1, caps after the largest remainders, smaller names first on ties."""
    scores = {k: max(n * math.sqrt(max(variances[k], 0.0)), 1e-12) for k, n in counts.items()}
    got = hamilton(budget, scores, 1, ascending_ties=True)
    return {k: min(v, counts[k]) for k, v in got.items()}


def dynamic_va(
    df: DataFrame, stratum: str, position: str, value: str, ids: Ids, budget: int, interval: int = 10_000, minimum: int = 1,
    alpha: float = 0.01, max_fraction: float = 1.0, max_change: float = 0.25, seed: int = 42, newcomers: int = 0,
) -> Dynamic:
    """Capacities that follow the stream: at each event a new target by rows times deviation, approached in steps.

    position: dense, from 1. Events are first appearances of strata and every ``interval`` rows; the driver folds one
    row for each stratum, event and segment, at most SEGMENTS of them: ``interval`` should grow with the data.
    """
    first = df.groupBy(F.col(stratum).cast("string").alias("stratum")).agg(F.min(position).alias("first_position"))
    found = {r.stratum: r.first_position for r in first.collect()}
    if len(found) > budget // max(minimum, 1):
        raise ValueError("the budget is less than the minimum of all strata")
    rows = df.agg(F.coalesce(F.max(position), F.lit(0)).alias("n")).first().n
    events = schedule(list(found.values()), interval, rows)
    if len(events) * max(len(found), 1) + rows / SEGMENT > SEGMENTS:
        raise ValueError("too many allocations: raise the interval")
    parts = segments(df, stratum, position, value, alpha, _event_of(F.col(position).cast("long"), events)).select("stratum", "event", "part", "n", "mean", "m2", "first", "c.*").toPandas()
    by_event = {e: g for e, g in parts.sort_values(["event", "part", "stratum"]).groupby("event")}
    counts: dict[str, int] = {}
    means, m2, ema, follow, capacities = {}, {}, {}, {}, {}
    history = []
    for i, p in enumerate(events):
        for x in by_event[i].itertuples() if i in by_event else ():
            k, n = x.stratum, counts.get(x.stratum, 0)
            if not n:
                means[k], m2[k], ema[k], follow[k] = 0.0, 0.0, x.first, 0.0
            d = x.mean - means[k]
            means[k] += d * x.n / (n + x.n)
            m2[k] += x.m2 + d * d * n * x.n / (n + x.n)
            counts[k] = n + x.n
            m = ema[k]
            ema[k], follow[k] = x.a * m + x.b, x.a * follow[k] + x.p * m * m + x.q * m + x.r
        target, capacities, scores = reallocate(capacities, counts, follow, budget, minimum, max_fraction, max_change, newcomers)
        history += [(i, p, k, target[k], capacities[k], scores[k], counts[k], m2[k] / (counts[k] - 1) if counts[k] > 1 else 0.0, follow[k]) for k in sorted(counts)]
    spark = df.sparkSession
    table = spark.createDataFrame(history, "event_id int, records_seen long, stratum string, target int, capacity int, score double, count long, welford_variance double, ema_variance double")
    dealt = spark.createDataFrame(list(capacities.items()), "stratum string, capacity int")
    return Dynamic(prefix(pool(df, stratum, ids, budget, seed), totals(df, stratum), dealt, 0, filled=False), table, first)
