"""Event-time and count windows: samples, estimates and exact results of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.priority import priority
from tessera.functions.shared import event_time, null_safe_join
from tessera.functions.stats import z_score

from .sampling import Ids, _ids


def windowed(df: DataFrame, ts: str, size: float, slide: float | None = None, base: float = 0.0) -> DataFrame:
    """df with window_start and window_end (microseconds), a row for each window that covers the row.

    size, slide (at most size) and base are seconds; windows are [start, end) and start at base plus multiples of the
    slide. Rows whose time is null or not finite are left out. ts: a timestamp, or seconds as a number.
    """
    slide = size if slide is None else slide
    if not 0 < slide <= size:
        raise ValueError("a slide is more than 0 and at most the size")
    shift = round(base * 1e6) % round(slide * 1e6)
    at = event_time(F.col(ts), df.schema[ts].dataType)
    rows = df.withColumn("__at", at).where("__at is not null")
    micros = lambda s: f"{round(s * 1e6)} microseconds"
    out = rows.withColumn("__window", F.window("__at", micros(size), micros(slide), micros(shift / 1e6)))
    return out.withColumns({"window_start": F.unix_micros("__window.start"), "window_end": F.unix_micros("__window.end")}).drop("__window", "__at")


def count_windowed(df: DataFrame, position: str, size: int) -> DataFrame:
    """df with window_start and window_end as record indexes; position is dense, from 1. The last window may be short."""
    start = F.floor((F.col(position) - 1) / size) * size
    last = df.agg(F.max(position).alias("__last"))
    out = df.crossJoin(F.broadcast(last))  # one row
    return out.withColumn("window_start", start.cast("long")).withColumn("window_end", F.least(F.col("window_start") + size, F.col("__last")).cast("long")).drop("__last")


def virtual_clock(df: DataFrame, position: str, name: str = "timestamp") -> DataFrame:
    """df with a time in seconds that starts at 0 and grows by 1 with each record."""
    return df.withColumn(name, (F.col(position) - 1).cast("double"))


def resolved_time(explicit: Column | None = None, extracted: Column | None = None, field: Column | None = None, position: Column | None = None) -> Column:
    """The first that isn't null of: a given time, an extracted one, the record's own field, the virtual clock."""
    parts = [x.cast("double") for x in (explicit, extracted, field) if x is not None]
    return F.coalesce(*parts, *([(position - 1).cast("double")] if position is not None else []))


def on_time(df: DataFrame, position: str, ts: str, lateness: float = 0.0, block: int = 100_000) -> DataFrame:
    """Windowed rows (window_end) whose window is still open when they arrive, in order of position.

    The watermark is the largest event time so far less the lateness, and never goes back; a window is closed once
    the watermark has reached its end. The running maximum is taken in blocks of positions, then over the blocks.
    """
    rows = df.withColumn("__t", F.unix_micros(event_time(F.col(ts), df.schema[ts].dataType))).withColumn("__block", F.floor(F.col(position) / block))
    tops = rows.groupBy("__block").agg(F.max("__t").alias("__top"))
    earlier = tops.select("__block", F.max("__top").over(Window.partitionBy(F.lit(1)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy(position).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(earlier, "__block").withColumn("__mark", F.greatest(F.max("__t").over(inside), F.col("__before")) - round(lateness * 1e6))
    return out.where("window_end > __mark").drop("__t", "__block", "__before", "__mark")


def pooled(df: DataFrame, stratum: str, ids: Ids, capacity: int, seed: int = 42) -> DataFrame:
    """The sampled rows of each window and stratum; every window draws anew. df has window_start and window_end."""
    keyed = df.withColumns({"stratum": F.col(stratum).cast("string"), "priority": priority(seed, "window_start", *_ids(ids))})
    order = Window.partitionBy("window_start", "window_end", "stratum").orderBy(F.desc("priority"), *_ids(ids))
    return keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(int(capacity)))


def estimates(df: DataFrame, stratum: str, value: str, ids: Ids, capacity: int, seed: int = 42, level: float = 0.95, exact: bool = False) -> DataFrame:
    """A row for each window: rows, sampled rows, strata, count, and sum and mean with variance and limits.

    exact: with exact_sum, exact_mean and exact_count, from plain grouping. df has window_start and window_end.
    """
    keys, z = ["window_start", "window_end"], z_score(level)
    v = F.col(value).cast("double")
    seen = df.groupBy(*keys, F.col(stratum).cast("string").alias("stratum")).agg(F.count("*").alias("c"), F.sum(v).alias("all"))
    drawn = pooled(df, stratum, ids, capacity, seed).groupBy(*keys, "stratum").agg(F.count("*").alias("y"), F.sum(v).alias("s"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("s2"))
    both = null_safe_join(seen, drawn, [*keys, "stratum"]).withColumn("w", F.when(F.col("c") > capacity, F.col("c") / F.lit(float(capacity))).otherwise(F.lit(1.0)))
    c = F.col("c").cast("double")
    term = F.when((c > F.col("y")) & (F.col("y") > 1), c * (c - F.col("y")) * F.col("s2") / F.col("y")).otherwise(F.lit(0.0))
    more = [F.sum("all").alias("exact_sum"), (F.sum("all") / F.sum("c")).alias("exact_mean"), F.sum("c").alias("exact_count")] if exact else []
    got = both.groupBy(*keys).agg(
        F.sum("c").alias("total_seen"), F.sum("y").alias("sample_size"), F.count("*").alias("num_strata"), F.sum(F.col("w") * F.col("y")).alias("count"),
        F.sum(F.col("w") * F.col("s")).alias("sum"), F.sum(term).alias("sum_variance"), *more,
    )
    total = F.col("total_seen").cast("double")
    got = got.withColumns({"mean": F.col("sum") / total, "mean_variance": F.col("sum_variance") / (total * total)})
    return got.withColumns({f"{q}_{end}": F.col(q) + sign * z * F.sqrt(f"{q}_variance") for q in ("sum", "mean") for end, sign in (("lower", -1), ("upper", 1))})


def exact_windows(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy("window_start", "window_end").agg(F.count("*").alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"))


def micro_batches(df: DataFrame, ts: str, interval: float) -> DataFrame:
    """df with ``batch``: the number of the interval (in seconds) that a row's time falls in."""
    t = F.unix_micros(event_time(F.col(ts), df.schema[ts].dataType))
    return df.withColumn("batch", F.floor(t / round(interval * 1e6)))
