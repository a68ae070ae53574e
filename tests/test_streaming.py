import pytest
from pyspark.sql import functions as F

from tessera.operators import estimates, sampling
from tessera.operators.control import AdaptiveController, CapacityFeedback
from tessera.streaming import pools, stateful, windows

SCHEMA = "id long, s string, v double, ts timestamp"


@pytest.fixture
def files(spark, tmp_path):
    df = spark.range(600).select("id", (F.col("id") % 3).cast("string").alias("s"), (F.col("id") % 17).cast("double").alias("v"), F.timestamp_seconds("id").alias("ts"))
    for i in range(4):
        df.where(f"id div 150 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in"), tmp_path


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_pool_of_batches_is_the_pool_of_all(spark, files):
    df, path, tmp = files
    pool = pools.StreamPool(str(tmp / "pool"), "s", ["id"], 20)
    windows.replay(stream(spark, path), pool.merge, str(tmp / "offsets"))
    assert pool.last(spark) == 3
    got, want = pool.sample(spark, 20), sampling.stratified(df, "s", "id", 20)
    assert sorted(r.id for r in got.rows.collect()) == sorted(r.id for r in want.rows.collect())
    assert estimates.approx_mean(got, "v").first()[0] == pytest.approx(estimates.approx_mean(want, "v").first()[0])
    before = sorted(map(tuple, got.strata.collect()))
    last = df.where("id >= 450")
    pool.merge(last, 3)  # the same batch again counts nothing twice
    assert sorted(map(tuple, pool.sample(spark, 20).strata.collect())) == before
    assert pool.sample(spark, 5).rows.count() == 15
    with pytest.raises(ValueError):
        pool.sample(spark, 21)


def test_feedback(spark, files):
    _, path, tmp = files
    feedback = CapacityFeedback(AdaptiveController(0.01, 2, 40, 0.1), 5)
    pool = pools.StreamPool(str(tmp / "pool"), "s", ["id"], 40)
    windows.replay(stream(spark, path), pools.feedback_batch(pool, feedback, "v"), str(tmp / "offsets"))
    assert [c for _, c in feedback.log] == sorted(c for _, c in feedback.log) and feedback.capacity > 5


def test_windows_close_with_the_watermark(spark, files):
    _, path, tmp = files
    got = windows.exact_windows(windows.timed(stream(spark, path), "ts", "event", "10 seconds"), "v", "100 seconds")
    windows.replay(got, lambda df, i: df.write.mode("append").parquet(str(tmp / "out")), str(tmp / "offsets"), "append")
    rows = spark.read.parquet(str(tmp / "out")).collect()
    assert {r.window_start // 1_000_000: r["count"] for r in rows} == dict.fromkeys(range(0, 500, 100), 100)  # the last is withheld
    with pytest.raises(ValueError):
        windows.timed(stream(spark, path), "ts", "other")


def test_quarantine(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "ts double")
    assert windows.quarantine(df).count() == 2


def test_duplicates(spark, files):
    df, path, tmp = files
    df.where("id < 50").coalesce(1).write.mode("append").parquet(path)
    got = windows.deduplicated(windows.timed(stream(spark, path), "ts", "event", "1 hour"), "id")
    windows.replay(got, lambda df, i: df.write.mode("append").parquet(str(tmp / "out")), str(tmp / "offsets"), "append")
    assert spark.read.parquet(str(tmp / "out")).where("id > 0").count() == 599


def test_reservoir():
    r = stateful.Reservoir(10, 1)
    assert sum(r.update(i) for i in range(10)) == 10 and r.is_full and r.weight == 1
    for i in range(10, 100):
        r.update(i)
    assert len(r.items) == 10 and r.seen == 100 and r.weight == 10
    hits = [0] * 20
    for seed in range(1000):
        x = stateful.Reservoir(5, seed)
        for i in range(20):
            x.update(i)
        for i in x.items:
            hits[i] += 1
    assert all(abs(h / 1000 - 0.25) < 0.06 for h in hits)
    again = stateful.Reservoir(10, 1)
    for i in range(100):
        again.update(i)
    assert again.items == r.items
    r.reset()
    assert r.seen == 0 and not r.items
    with pytest.raises(ValueError):
        stateful.Reservoir(0)


def test_stateful_streams(spark, files):
    _, path, tmp = files
    windows.replay(stateful.reservoirs(stream(spark, path), "s", "v", 15), lambda df, i: df.write.mode("append").parquet(str(tmp / "r")), str(tmp / "o1"))
    got = spark.read.parquet(str(tmp / "r")).groupBy("stratum").agg(F.max("total_seen").alias("n"), F.max(F.size("samples")).alias("k")).collect()
    assert {(r.n, r.k) for r in got} == {(200, 15)}
    windows.replay(stateful.count_windows(stream(spark, path), "v", 70), lambda df, i: df.write.mode("append").parquet(str(tmp / "c")), str(tmp / "o2"), "append")
    got = spark.read.parquet(str(tmp / "c")).orderBy("window_start").collect()
    assert [(r.window_start, r.window_end) for r in got] == [(i, i + 70) for i in range(0, 560, 70)]
    windows.replay(stateful.adaptive_sampler(stream(spark, path), "s", "v", ["id"], 30, 50, 100), lambda df, i: df.write.mode("append").parquet(str(tmp / "a")), str(tmp / "o3"), "append")
    got = spark.read.parquet(str(tmp / "a")).orderBy("records_seen").collect()
    assert [r.records_seen for r in got] == list(range(100, 700, 100)) and 5 < got[-1]["mean"] < 11


def test_observed(spark):
    from pyspark.sql import Observation

    o = Observation("seen")
    spark.range(10).observe(o, F.count(F.lit(1)).alias("n")).count()
    assert o.get["n"] == 10
    assert windows.observed(spark.range(3), "x", F.col("id")).count() == 3


def test_counters_add_up_batches(spark, files):
    import time

    _, path, tmp = files
    counters = windows.Counters()
    spark.streams.addListener(counters)
    try:
        rows = windows.observed(stream(spark, path), "seen", F.col("v"))
        windows.replay(rows, lambda df, i: df.count(), str(tmp / "o4"), "append")
        for _ in range(50):  # the listener hears of a batch a little later
            if counters.totals["records_total"] >= 600:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals["records_total"] == 600 and counters.totals["batches_total"] >= 4 and counters.totals["seen.records_total"] == 600
    assert counters.totals["late_total"] == 0 and len(counters.batch_seconds) >= 4


def test_windows_left_open_are_flushed(spark, files):
    df, path, tmp = files
    got = windows.exact_windows(windows.timed(stream(spark, path), "ts", "event", "10 seconds"), "v", "1 minute")
    windows.replay(got, lambda df, i: df.write.mode("append").parquet(str(tmp / "w")), str(tmp / "o5"), "append")
    emitted = spark.read.schema(got.schema).parquet(str(tmp / "w"))
    every = windows.flushed(df.withColumn("event_time", F.col("ts")), emitted, "v", "1 minute").collect()
    assert emitted.count() < 10 and sorted((r.window_start, r["count"]) for r in every) == [(i * 60_000_000, 60) for i in range(10)]


def test_the_short_tail_of_count_windows(spark, files):
    _, path, tmp = files
    got = stateful.count_windows(stream(spark, path), "v", 70, partial=True)
    windows.replay(got, lambda df, i: df.write.mode("append").parquet(str(tmp / "t")), str(tmp / "o6"))
    last = spark.read.parquet(str(tmp / "t")).groupBy("window_start").agg(F.max("count").alias("n")).collect()
    assert sorted((r.window_start, r.n) for r in last) == [(i, 70) for i in range(0, 560, 70)] + [(560, 40)]
