"""Small helpers for plans: shared checkpoints, dense positions, bounded broadcasts."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of up to so many rows may be broadcast; the operators count before they do so.
BROADCAST_ROWS = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that ``spark.checkpoint.dir`` names. Where the session names none, a local master (tests)
    gets one of this machine; a cluster is refused, as its machines would not share it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined to right by keys, where a null equals a null: such rows are a stratum like any other."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"__right_{k}" for k in keys])


def positioned(df: DataFrame, *order: str, name: str = "position", first: int = 1) -> DataFrame:
    """df with dense positions in the order of the given columns, without bringing all rows to one task.

    Rows are dealt by range and sorted; each partition's rows are counted, and the counts, one number for each
    partition, say where its positions start.
    """
    spark: SparkSession = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    marked = checkpointed(dealt.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = {r.part: r["count"] for r in marked.select(part.alias("part")).groupBy("part").count().collect()}
    starts, total = [], first
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    offsets = spark.createDataFrame(starts, "__part long, __start long")
    out = marked.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__start")


def event_time(value: Column, kind: T.DataType) -> Column:
    """A timestamp from a timestamp, a timestamp without zone (taken as UTC), a text, or seconds as a number.

    Seconds that aren't finite give null.
    """
    if isinstance(kind, T.NumericType):
        seconds = value.cast("double")
        finite = ~F.isnan(seconds) & (F.abs(seconds) < F.lit(float("inf")))
        return F.when(finite, F.timestamp_micros(F.floor(seconds * 1_000_000).cast("long")))
    return value.cast("timestamp")


def micros(value: Column) -> Column:
    return F.unix_micros(value)
