"""Times of the headline queries: one JSON line, seconds by query, at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans import queries as plans

HEADLINE = (
    "exact_ground_truth", "srs_sample_sum_mean", "oasrs_strata_snapshot", "oasrs_many_strata", "estimate_sum_ci", "estimate_mean_ci", "approx_count_where",
    "hamilton_neyman", "static_va_estimate", "dv_estimate", "ema_variance", "tumbling_approx", "sliding_approx", "count_window_approx", "late_drop_batch",
    "multi_field_means", "fraction_sweep", "archive_checks", "stream_pool",
)


def throughput(spark: SparkSession, n: int = 10_000_000) -> dict[str, int]:
    """Records a second of a full scan, and of uniform, stratified, static and dynamic samples over generated records."""
    from pyspark.sql import functions as F

    from tessera.operators import experiments

    def make(size):
        return spark.range(size).select(F.col("id"), F.when(F.col("id") % 101 < 80, "A").when(F.col("id") % 101 < 100, "B").otherwise("C").alias("sensor_id"), (F.col("id") % 1000).cast("double").alias("value"), (F.col("id") + 1).alias("position"))

    experiments.throughput_sweep(make, [n // 10], "sensor_id", "id", 1000, "position", "value")  # once for the compiler
    return {m.name: round(m.rate) for m in experiments.throughput_sweep(make, [n], "sensor_id", "id", 1000, "position", "value")}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    rows = plans.events(spark, sf_dir).count()
    for name in HEADLINE:
        run = plans.QUERIES[name]
        run(spark, sf_dir).collect()  # once for the compiler
        times = []
        for _ in range(2):
            start = time.perf_counter()
            run(spark, sf_dir).collect()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 4)
        rates[name] = round(rows / min(times))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "records_per_sec": rates, "generated_records_per_sec": throughput(spark), "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
