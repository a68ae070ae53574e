"""Operators that keep their own state: a reservoir by replacement, count windows, and the global adaptive sampler.

They run over one key, or one for each stratum, as their results depend on the order of arrival. For anything that
doesn't, pools.py is the way that scales.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.priority import uniform
from tessera.operators.adaptive import flink_allocation


class Reservoir:
    """At most ``capacity`` of the values seen, each with the same chance; draws are seeded by the count, so that a replay repeats them."""

    def __init__(self, capacity: int, seed: int = 42, seen: int = 0, items: list | None = None):
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        self.capacity, self.seed, self.seen, self.items = capacity, seed, seen, list(items or [])

    def update(self, item) -> bool:
        """Whether the item was taken in."""
        self.seen += 1
        if len(self.items) < self.capacity:
            self.items.append(item)
            return True
        at = random.Random(f"{self.seed}:{self.seen}").randrange(self.seen)
        if at < self.capacity:
            self.items[at] = item
        return at < self.capacity

    @property
    def is_full(self) -> bool:
        return len(self.items) == self.capacity

    @property
    def weight(self) -> float:
        return self.seen / self.capacity if self.seen > self.capacity else 1.0

    def reset(self) -> None:
        self.seen, self.items = 0, []


def reservoirs(df: DataFrame, stratum: str, value: str, capacity: int, seed: int = 42) -> DataFrame:
    """A row for each stratum and batch: stratum, total_seen, samples."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, items = state.get if state.exists else (0, [])
        r = Reservoir(capacity, seed, seen, items)
        for frame in frames:
            for v in frame["value"]:
                r.update(float(v))
        state.update((r.seen, r.items))
        yield pd.DataFrame({"stratum": [key[0]], "total_seen": [r.seen], "samples": [r.items]})

    keyed = df.select(F.col(stratum).cast("string").alias("stratum"), F.col(value).cast("double").alias("value"))
    return keyed.groupBy("stratum").applyInPandasWithState(
        run, "stratum string, total_seen long, samples array<double>", "seen long, items array<double>", "update", GroupStateTimeout.NoTimeout
    )


def count_windows(df: DataFrame, value: str, size: int, partial: bool = False) -> DataFrame:
    """Windows of ``size`` records each: window_start, window_end (record indexes), count, sum, mean.

    Each is given once it is full; with ``partial`` (and output mode "update") what there is of the last one as well,
    anew after each batch: of a window's rows the one with the largest count is its result, the short tail included.
    One key numbers all records, as numbers run over the whole stream: its throughput is that of one task.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, held = state.get if state.exists else (0, [])
        values, out = [float(v) for v in held], []
        for frame in frames:
            values.extend(frame["value"].astype(float))
            full = len(values) // size * size
            for at in range(0, full, size):
                part = values[at : at + size]
                out.append((start + at, start + at + size, size, sum(part), sum(part) / size))
            start, values = start + full, values[full:]
        if partial and values:
            out.append((start, start + len(values), len(values), sum(values), sum(values) / len(values)))
        state.update((start, values))
        yield pd.DataFrame(out, columns=["window_start", "window_end", "count", "sum", "mean"])

    keyed = df.select(F.lit("global").alias("key"), F.col(value).cast("double").alias("value"))
    return keyed.groupBy("key").applyInPandasWithState(
        run, "window_start long, window_end long, count long, sum double, mean double", "start long, held array<double>", "update" if partial else "append", GroupStateTimeout.NoTimeout
    )


def adaptive_sampler(df: DataFrame, stratum: str, value: str, ids: list[str], budget: int, interval: int = 1000, report: int = 1000, alpha: float = 0.01, seed: int = 42) -> DataFrame:
    """Summaries of one global sampler, every ``report`` records: records_seen, mean, and capacities by stratum (JSON).

    Priorities come from ids, so that a restart neither repeats nor loses draws.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"seen": 0, "last": 0, "strata": {}, "capacities": {}}
        strata, out = held["strata"], []
        for frame in frames:
            for s, v, p in zip(frame["stratum"], frame["value"], frame["p"], strict=True):
                held["seen"] += 1
                x = strata.get(s)
                if x is None:
                    x = strata[s] = {"n": 0, "m": float(v), "s": 0.0, "pool": []}
                x["n"] += 1
                d = float(v) - x["m"]
                x["m"] += alpha * d
                x["s"] = (1 - alpha) * (x["s"] + alpha * d * d)
                x["pool"].append([float(p), float(v)])
                if len(x["pool"]) > 2 * budget:
                    x["pool"] = sorted(x["pool"], reverse=True)[:budget]
                if x["n"] == 1 or held["seen"] - held["last"] >= interval:
                    held["capacities"] = flink_allocation({k: y["n"] for k, y in strata.items()}, {k: y["s"] for k, y in strata.items()}, budget)
                    held["last"] = held["seen"]
                if held["seen"] % report == 0:
                    total = 0.0
                    for k, y in strata.items():
                        top = sorted(y["pool"], reverse=True)[: held["capacities"].get(k, 0)]
                        total += y["n"] * sum(t[1] for t in top) / len(top) if top else 0.0
                    out.append((held["seen"], total / held["seen"], json.dumps(held["capacities"], sort_keys=True)))
        for x in strata.values():
            x["pool"] = sorted(x["pool"], reverse=True)[:budget]
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["records_seen", "mean", "capacities"])

    keyed = df.select(F.lit("global").alias("key"), F.col(stratum).cast("string").alias("stratum"), F.col(value).cast("double").alias("value"), uniform(seed, *ids).alias("p"))
    return keyed.groupBy("key").applyInPandasWithState(run, "records_seen long, mean double, capacities string", "held string", "append", GroupStateTimeout.NoTimeout)
