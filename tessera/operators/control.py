"""Budgets and feedback: what a sample may cost, and how large the next one should be."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CostFunction(Protocol):
    def sample_size(self, budget: float, strata: int) -> int: ...


@dataclass(frozen=True)
class LinearCost:
    """Slots for each stratum that a budget buys, between a least and a most."""

    items_per_unit: float = 1.0
    least: int = 1
    most: int = 100_000

    def __post_init__(self):
        if self.items_per_unit <= 0 or self.least < 1 or self.most < self.least:
            raise ValueError("a cost function needs positive items, and 1 <= least <= most")

    def sample_size(self, budget: float, strata: int = 1) -> int:
        if budget < 0 or strata < 1:
            raise ValueError("a budget must not be negative, and there is one stratum at least")
        return max(self.least, min(self.most, int(budget * self.items_per_unit / strata)))

    def column(self, budget: Column, strata: Column) -> Column:
        """The same of columns; a negative budget counts as 0 and no strata as one."""
        n = F.floor(budget * self.items_per_unit / F.greatest(strata, F.lit(1)))
        return F.greatest(F.lit(self.least), F.least(F.lit(self.most), n)).cast("int")


@dataclass
class AdaptiveController:
    """The next capacity from the last result: smaller if its relative error is on target, else larger, up to twofold;
    always between a least and a most."""

    target: float = 0.05
    least: int = 1
    most: int = 100_000
    shrink: float = 0.5

    def __post_init__(self):
        if self.target <= 0 or not 1 <= self.least <= self.most or not 0 < self.shrink <= 1:
            raise ValueError("a controller needs a positive target, 1 <= least <= most, and 0 < shrink <= 1")

    def next_size(self, current: int, estimate: float, error: float) -> int:
        if current < 1 or error < 0:
            raise ValueError("a capacity is 1 at least, and an error not negative")
        ratio = error / abs(estimate) if estimate else (float("inf") if error else 0.0)
        factor = 1 - self.shrink if ratio <= self.target else min(2.0, max(1.1, ratio / self.target))
        return min(self.most, max(self.least, int(current * factor)))

    def column(self, current: Column, estimate: Column, error: Column) -> Column:
        ratio = F.when(estimate != 0, error / F.abs(estimate)).otherwise(F.when(error > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
        up = F.least(F.lit(2.0), F.greatest(F.lit(1.1), ratio / self.target))
        factor = F.when(ratio <= self.target, F.lit(1 - self.shrink)).otherwise(up)
        return F.least(F.lit(self.most), F.greatest(F.lit(self.least), F.floor(current * factor))).cast("int")


@dataclass
class CapacityFeedback:
    """Capacities of windows as they are closed one after another: each result sets that of windows made later."""

    controller: AdaptiveController
    capacity: int
    on_result: Callable[[dict], None] | None = None
    log: list[tuple[int, int]] = field(default_factory=list)

    def closed(self, result: dict) -> int:
        self.log.append((result["window_start"], self.capacity))
        self.capacity = self.controller.next_size(self.capacity, result["estimate"], result["standard_error"])
        if self.on_result:
            self.on_result(result)
        return self.capacity

    def replay(self, results: Iterable[dict]) -> list[tuple[int, int]]:
        for r in sorted(results, key=lambda r: r["window_start"]):
            self.closed(r)
        return self.log


def cheapest(configs: DataFrame, cost: str, error: str, coverage: str, target: float, least_coverage: float = 0.9) -> DataFrame:
    """The configuration of least cost whose error and coverage are good enough; if none is, that of least error."""
    good = (F.col(error) <= target) & (F.col(coverage) >= least_coverage)
    ranked = configs.withColumn("feasible", good)
    return ranked.orderBy(F.desc("feasible"), F.when(F.col("feasible"), F.col(cost)), F.col(error), F.col(cost)).limit(1)


def pareto(configs: DataFrame, cost: str, error: str) -> DataFrame:
    """Configurations that no other one beats in one measure without being worse in the other."""
    other = configs.select(F.col(cost).alias("__c"), F.col(error).alias("__e")).distinct()
    best = other.groupBy("__c").agg(F.min("__e").alias("__e"))  # of equal cost, the least error dominates the rest
    beats = (F.col("__c") <= F.col(cost)) & (F.col("__e") <= F.col(error)) & ((F.col("__c") < F.col(cost)) | (F.col("__e") < F.col(error)))
    return configs.join(best, beats, "left_anti")
