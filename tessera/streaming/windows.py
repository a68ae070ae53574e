"""Windows over streams: watermarks for late rows, counters, replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessera.functions.shared import event_time


def timed(df: DataFrame, ts: str = "ts", mode: str = "event", lateness: str = "0 seconds") -> DataFrame:
    """df with event_time and a watermark. mode "processing" takes the time of arrival, with no lateness.

    Rows without a finite time are left out; quarantine() has them.
    """
    if mode not in ("event", "processing"):
        raise ValueError("a time mode is event or processing")
    time = F.current_timestamp() if mode == "processing" else event_time(F.col(ts), df.schema[ts].dataType)
    out = df.withColumn("event_time", time).where("event_time is not null")
    return out.withWatermark("event_time", "0 seconds" if mode == "processing" else lateness)


def quarantine(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.where(event_time(F.col(ts), df.schema[ts].dataType).isNull())


def exact_windows(df: DataFrame, value: str, size: str, slide: str | None = None, base: str | None = None) -> DataFrame:
    """count, sum and mean of each window; rows later than the watermark are dropped by Spark."""
    window = F.window("event_time", size, slide or size, base) if base else F.window("event_time", size, slide or size)
    v = F.col(value).cast("double")
    got = df.groupBy(window.alias("w")).agg(F.count("*").alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"))
    return got.select(F.unix_micros("w.start").alias("window_start"), F.unix_micros("w.end").alias("window_end"), "count", "sum", "mean")


def deduplicated(df: DataFrame, key: str = "seq") -> DataFrame:
    """Rows of each key once, as far as the watermark reaches."""
    return df.dropDuplicatesWithinWatermark([key])


def replay(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over all that is there now, batch by batch, then stops."""
    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def flushed(rows: DataFrame, emitted: DataFrame, value: str, size: str, slide: str | None = None, base: str | None = None) -> DataFrame:
    """emitted, and the windows that were still open when a stream came to its end.

    rows: all that the stream has read, with event_time; emitted: what exact_windows has given in append mode. A row is
    late only for a window that is closed, so that those left open hold all their rows.
    """
    open_ = exact_windows(rows, value, size, slide, base).join(emitted.select("window_start"), "window_start", "left_anti")
    return emitted.unionByName(open_)


class Counters(StreamingQueryListener):
    """Totals over the batches of all queries of a session: records read, rows dropped as late, batches, and whatever
    observed() counts, by its name; and how long batches took."""

    def __init__(self):
        self.totals: dict[str, float] = {"records_total": 0, "late_total": 0, "batches_total": 0}
        self.batch_seconds: list[float] = []

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.totals["records_total"] += p.numInputRows
        self.totals["late_total"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self.totals["batches_total"] += 1
        self.batch_seconds.append(p.durationMs.get("triggerExecution", 0) / 1000)
        for name, row in p.observedMetrics.items():
            for k, v in row.asDict().items():
                self.totals[f"{name}.{k}"] = self.totals.get(f"{name}.{k}", 0) + (v or 0)


def observed(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
    """df with counters that a streaming listener or an Observation reads: records, and sum of a value."""
    extra = [F.sum(value).alias("value_total")] if value is not None else []
    return df.observe(name, F.count(F.lit(1)).alias("records_total"), *extra)
