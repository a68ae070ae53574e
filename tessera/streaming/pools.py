"""Samples of a stream, kept as priority pools that each micro-batch is merged into.

A pool is the rows of largest priority of each stratum (and window). Pools of parts merge to the pool of the whole, so
that a batch is merged with at most ``bound`` rows per stratum. Each batch is written as a version of its own, made
from the version before: a batch that is run again writes the same version again and counts nothing twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.priority import priority
from tessera.operators.control import CapacityFeedback
from tessera.operators.estimates import estimate_mean
from tessera.operators.sampling import Sample, prefix


@dataclass
class StreamPool:
    """path: a folder that driver and executors share; bound: the largest capacity that may ever be asked for."""

    path: str
    stratum: str
    ids: list[str]
    bound: int
    seed: int = 42
    keys: tuple[str, ...] = ()

    def _version(self, batch: int) -> str:
        return f"{self.path}/version={batch:09d}"

    def merge(self, df: DataFrame, batch: int) -> None:
        """For foreachBatch: the pool after this batch."""
        spark = df.sparkSession
        groups = ["stratum", *self.keys]
        rows = df.withColumns({"stratum": F.col(self.stratum).cast("string"), "priority": priority(self.seed, *self.keys, *self.ids)})
        counts = rows.groupBy(*groups).agg(F.count("*").alias("total_seen"))
        if batch > 0 and self._exists(spark, self._version(batch - 1)):
            old = spark.read.parquet(f"{self._version(batch - 1)}/rows")
            rows = old.unionByName(rows, allowMissingColumns=True)
            counts = spark.read.parquet(f"{self._version(batch - 1)}/counts").unionByName(counts).groupBy(*groups).agg(F.sum("total_seen").alias("total_seen"))
        order = Window.partitionBy(*groups).orderBy(F.desc("priority"), *self.ids)
        kept = rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= F.lit(int(self.bound))).drop("__rank")
        kept.write.mode("overwrite").parquet(f"{self._version(batch)}/rows")
        counts.write.mode("overwrite").parquet(f"{self._version(batch)}/counts")

    @staticmethod
    def _exists(spark: SparkSession, path: str) -> bool:
        jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts/_SUCCESS")
        return jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)

    def last(self, spark: SparkSession) -> int:
        batch = -1
        while self._exists(spark, self._version(batch + 1)):
            batch += 1
        return batch

    def sample(self, spark: SparkSession, capacity: int, batch: int | None = None) -> Sample:
        """The sample that a capacity of at most ``bound`` takes from a version, the last one by default."""
        if capacity > self.bound:
            raise ValueError("the pool keeps fewer rows than that")
        version = self._version(self.last(spark) if batch is None else batch)
        rows, counts = spark.read.parquet(f"{version}/rows"), spark.read.parquet(f"{version}/counts")
        order = Window.partitionBy("stratum").orderBy(F.desc("priority"), *self.ids)
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(int(capacity)))
        return prefix(ranked, counts, spark.createDataFrame([], "stratum string, capacity int"), capacity, filled=True)


def feedback_batch(pool: StreamPool, feedback: CapacityFeedback, value: str):
    """For foreachBatch: merges a batch, then lets its result set the capacity of the next."""

    def run(df: DataFrame, batch: int) -> None:
        pool.merge(df, batch)
        got = estimate_mean(pool.sample(df.sparkSession, min(feedback.capacity, pool.bound), batch), value).first()
        feedback.closed({"window_start": batch, "estimate": got.estimate, "standard_error": got.standard_error})

    return run
