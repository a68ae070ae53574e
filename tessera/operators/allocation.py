"""How a budget of sample slots is dealt to strata."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import null_safe_join


def hamilton(budget: int, weights: Mapping[str, float], minimum: int | Mapping[str, int] = 1, maximums: Mapping[str, int] | None = None, ascending_ties: bool = False) -> dict[str, int]:
    """Largest remainders with caps: every stratum gets its minimum, the rest goes by weight (equally if all are 0).

    In rounds: whole shares as far as caps allow, then single slots by the largest fraction; of equal fractions, the
    larger name, or with ``ascending_ties`` the smaller. What caps leave over goes on to the next round. A negative
    weight counts as 0. The result adds up to min(budget, all caps).
    """
    keys = sorted(weights)
    least = {k: minimum if isinstance(minimum, int) else int(minimum[k]) for k in keys}
    most = {k: budget if maximums is None else int(maximums[k]) for k in keys}
    if budget < 0 or any(v < 0 for v in least.values()) or any(v < 0 for v in most.values()):
        raise ValueError("budget, minimums and maximums must not be negative")
    if not all(math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be finite")
    weights = {k: max(0.0, float(w)) for k, w in weights.items()}
    if budget < sum(least.values()):
        raise ValueError("the budget is less than the minimum of all strata")
    if any(most[k] < least[k] for k in keys):
        raise ValueError("a maximum is less than the minimum")
    got, rest = dict(least), budget - sum(least.values())
    while rest > 0 and (free := [k for k in keys if got[k] < most[k]]):
        total = sum(weights[k] for k in free)
        share = {k: rest * (weights[k] / total if total > 0 else 1 / len(free)) for k in free}
        whole = {k: min(math.floor(share[k]), most[k] - got[k]) for k in free}
        for k, n in whole.items():
            got[k] += n
        rest -= sum(whole.values())
        order = sorted(free, reverse=not ascending_ties)
        order.sort(key=lambda k: share[k] - math.floor(share[k]), reverse=True)
        single = [k for k in order if got[k] < most[k]][:rest]
        got.update({k: got[k] + 1 for k in single})
        rest -= len(single)
    return got


def hamilton_table(strata: DataFrame, weight: str | Column, budget: int, minimum: int = 1) -> DataFrame:
    """stratum, weight and capacity by largest remainders without caps, as a plan. strata: one row for each stratum.

    The window runs over the strata alone, a table that grouping has made small.
    """
    w = (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    every = Window.partitionBy(F.lit(1))
    shares = strata.select(F.col("stratum").cast("string").alias("stratum"), w.alias("weight"))
    shares = shares.withColumn("k", F.count("*").over(every)).withColumn("total", F.sum("weight").over(every))
    shares = shares.withColumn("share", (F.lit(budget) - F.col("k") * minimum) * F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(1 / F.col("k")))
    shares = shares.withColumns({"whole": F.floor("share").cast("int"), "fraction": F.round(F.col("share") - F.floor("share"), 9)})
    left = F.lit(budget) - F.col("k") * minimum - F.sum("whole").over(every)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("fraction"), F.desc("stratum"))
    extra = F.when(F.row_number().over(order) <= left, 1).otherwise(0)
    return shares.select("stratum", "weight", (F.lit(minimum) + F.col("whole") + extra).cast("int").alias("capacity"))


def pilot(df: DataFrame, stratum: str, position: str, value: str, per_stratum: int) -> DataFrame:
    """stratum, pilot_rows, pilot_sd: the first rows of each stratum."""
    order = Window.partitionBy("stratum").orderBy(position)
    rows = df.select(F.col(stratum).cast("string").alias("stratum"), position, F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(int(per_stratum)))
    return rows.groupBy("stratum").agg(F.count("*").alias("pilot_rows"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("pilot_sd"))


def policy_weights(counts: DataFrame, pilots: DataFrame, policy: str, counts_from: str = "full") -> DataFrame:
    """stratum, weight by policy: "equal", "proportional" (rows) or "neyman" (rows times deviation), at least 1e-12.

    counts_from: "full" takes the rows of all data, "pilot" those of the pilot.
    """
    both = null_safe_join(counts, pilots, ["stratum"])
    n = F.col("total_seen" if counts_from == "full" else "pilot_rows").cast("double")
    weight = {"equal": F.lit(1.0), "proportional": n, "neyman": n * F.col("pilot_sd")}
    if policy not in weight:
        raise ValueError(f"unknown policy {policy!r}")
    return both.select("stratum", F.greatest(weight[policy], F.lit(1e-12)).alias("weight"))


def equal(strata: list[str], budget: int) -> dict[str, int]:
    return hamilton(budget, dict.fromkeys(strata, 1.0))


def hysteresis(
    old: Mapping[str, int], target: Mapping[str, int], scores: Mapping[str, float], step: int, least: Mapping[str, int], most: Mapping[str, int], newcomers: int = 0
) -> dict[str, int]:
    """Capacities moved from old towards target by at most ``step`` each; a new stratum starts at its minimum, or with
    ``newcomers`` slots if these are more: with a minimum of 0 it would never get any.

    Then single slots go where most are lacking, or are taken where most are over, until the sum is the target's or
    nothing may move. Of equal differences the score decides, then the name. As each slot that a stratum gets makes it
    lack one less, these are simply the first ones of all slots that could be given, in that order.
    """
    reach = {}
    for k in target:
        if old.get(k, 0):
            low = max(least[k], min(old[k] - step, most[k]))
            reach[k] = low, max(low, min(most[k], old[k] + step))
        else:
            reach[k] = least[k], max(least[k], min(most[k], newcomers))
    out = {k: min(max(target[k], low), high) for k, (low, high) in reach.items()}
    missing = sum(target.values()) - sum(out.values())
    if missing > 0:
        slots = ((target[k] - out[k] - i, scores[k], k) for k in out for i in range(reach[k][1] - out[k]))
        moved = [(k, 1) for _, _, k in heapq.nlargest(missing, slots)]
    else:
        slots = ((target[k] - out[k] + i, scores[k], k) for k in out for i in range(out[k] - reach[k][0]))
        moved = [(k, -1) for _, _, k in heapq.nsmallest(-missing, slots)]
    for k, n in moved:
        out[k] += n
    return out
