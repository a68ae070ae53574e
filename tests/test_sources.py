import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import replay, sensors, synthetic

LINES = [
    "2004-03-31 03:38:15.757551 2 1 122.153 -3.91901 11.04 2.03397",
    "2004-02-28 00:59:16.02785 3 2 19.9884 37.0933 45.08 2.69964",
    "2004-02-28 01:03:16 11 54 19.3 38.4 45.0 2.68  ",
    "2004-02-28 01:06:16.013453 17 55 19.1 38.8 45.0 2.68",
    "2004-02-28 01:06:16.013453 17 x 19.1 38.8 45.0 2.68",
    "2004-02-28 01:06:46.778088 18 1 19.1 38.8 45.0",
    "2004-99-28 01:06:46.778088 18 1 19.1 38.8 45.0 2.1",
    "",
]


def test_lines(spark, tmp_path):
    path = tmp_path / "data.txt.gz"
    path.write_bytes(gzip.compress("\n".join(LINES).encode()))
    got = sensors.parse_lines(sensors.lines(spark, str(path))).orderBy("epoch").collect()
    assert [(r.epoch, r.mote_id) for r in got] == [(2, 1), (3, 2), (11, 54)]
    assert [r.event_ts.microsecond for r in got] == [757551, 27850, 0] and got[0].temperature == 122.153
    assert sensors.parse_lines(sensors.lines(spark, str(path)), with_time=False).count() == 4


def test_messages(spark):
    good = {"seq": 1, "event_ts": "2004-02-28 00:59:16.5", "mote_id": 3, "temperature": 19.5}
    texts = [json.dumps(good), json.dumps(good | {"temperature": None}), "{", "", None, "[1]"]
    records, bad = sensors.parse_messages(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert [(r.seq, r.mote_id, r.temperature, r.event_ts.second) for r in records.collect()] == [(1, 3, 19.5, 16)] and bad.count() == 5
    flexible = [{"mote_id": 1, "temperature": 2}, {"sensor_id": "b", "value": 3.5}, {"sensor_id": "c"}, {"value": "x", "mote_id": 1}]
    got = sensors.parse_flexible(spark.createDataFrame([(json.dumps(t),) for t in flexible], "value string"))
    assert sorted(map(tuple, got.collect())) == [("1", 2.0), ("b", 3.5)]


def test_extracted(spark):
    df = spark.createDataFrame([("s", 1.5)], "sensor_id string, val double")
    assert sensors.extracted(df).first().value == 1.5
    assert sensors.extracted(df, F.col("val") * 2, F.lit("x")).first()[-2:] == ("x", 3.0)
    with pytest.raises(KeyError):
        sensors.extracted(df, "nope")


def test_archive(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 20_000).alias("event_ts"), F.lit(1).cast("short").alias("mote_id"))
    for f in sensors.ARCHIVE:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    path = str(tmp_path / "archive")
    sensors.write_archive(df, path)
    sensors.write_archive(df.where("seq = 0"), path)
    assert sensors.read_archive(spark, path).count() == 11
    day = sensors.read_archive(spark, path, "1970-01-02")
    assert sorted(r.seq for r in day.collect()) == [5, 6, 7, 8]
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    sensors.write_results(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, sensors.read_results(spark, str(tmp_path / "csv"), "k string, v double").collect()), key=str) == [("a", 1.5), ("b", None)]
    sensors.write_results(df, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert json.loads(sensors.to_messages(df, "k").orderBy("key").first().value) == {"k": "a", "v": 1.5}


def test_rates(spark):
    r = replay.RateSchedule("2000:30,10000:10")
    assert [r.rate_at(t) for t in (0, 29.9, 30, 39.9, 40, 75)] == [2000, 2000, 10000, 10000, 2000, 10000]
    got = spark.createDataFrame([(t,) for t in (0.0, 29.9, 30.0, 39.9, 40.0, 75.0)], "t double").select(r.column(F.col("t")).alias("r")).collect()
    assert [x.r for x in got] == [2000, 2000, 10000, 10000, 2000, 10000]
    assert r.records_by(45) == 60_000 + 100_000 + 10_000 and replay.RateSchedule("0:5").records_by(1) == float("inf")
    with pytest.raises(ValueError):
        replay.RateSchedule("-1:5")
    for_ever = replay.RateSchedule("2000:30,1000")
    assert [for_ever.rate_at(t) for t in (0, 29.9, 30, 40, 10_000)] == [2000, 2000, 1000, 1000, 1000] and for_ever.records_by(40) == 70_000
    assert replay.RateSchedule("5").rate_at(7) == 5 and replay.RateSchedule("10:1,0").records_by(1) == 10
    got = spark.createDataFrame([(29.0,), (30.0,), (4000.0,)], "t double").select(for_ever.column(F.col("t")).alias("r")).collect()
    assert [x.r for x in got] == [2000, 1000, 1000]


def test_a_paced_replay_sends_what_is_due_and_waits(spark):
    rows = spark.range(1, 31).withColumnRenamed("id", "position")
    sent, waits = [], []
    replay.RateSchedule("4:2,10").run(rows, "position", lambda df: sent.append(sorted(r.position for r in df.collect())), 1.0, waits.append)
    assert [len(x) for x in sent] == [4, 4, 10, 10, 2] and sum(sent, []) == list(range(1, 31)) and len(waits) == 4 and all(w <= 1 for w in waits)
    fast = []
    assert replay.RateSchedule("0").run(rows, "position", lambda df: fast.append(df.count())) == 30 and fast == [30]


def test_generators(spark):
    u = synthetic.uniform_stream(spark, 5000, 5, 25).agg(F.min("value"), F.max("value"), F.avg("value"), F.max("timestamp")).first()
    assert 5 <= u[0] < u[1] < 25 and abs(u[2] - 15) < 0.5 and u[3] == pytest.approx(4.999)
    g = synthetic.gaussian_stream(spark, 20_000, 10, 5).agg(F.avg("value"), F.stddev("value")).first()
    assert abs(g[0] - 10) < 0.2 and abs(g[1] - 5) < 0.1
    large = synthetic.poisson_stream(spark, 4000, 5000).agg(F.avg("value"), F.variance("value"), F.skewness("value")).first()
    assert abs(large[0] - 5000) < 5 and abs(large[1] - 5000) < 500 and abs(large[2]) < 0.15
    assert synthetic.poisson_stream(spark, 10, 0).agg(F.max("value")).first()[0] == 0
    p = synthetic.poisson_stream(spark, 4000, 7).agg(F.avg("value"), F.variance("value")).first()
    assert abs(p[0] - 7) < 0.2 and abs(p[1] - 7) < 0.7
    specs = [synthetic.StratumSpec("a", "gaussian", {"mean": 1, "std": 2}, 3), synthetic.StratumSpec("b", "constant", {"value": 4}, 1)]
    m = {r.sensor_id: r["count"] for r in synthetic.multi_strata_stream(spark, specs, 4000).groupBy("sensor_id").count().collect()}
    assert abs(m["a"] - 3000) < 120
    zero = [synthetic.StratumSpec(n, "constant", {"value": 1}, 0) for n in "ab"]
    assert synthetic.multi_strata_stream(spark, zero, 1000).where("sensor_id = 'a'").count() > 400
    with pytest.raises(ValueError):
        synthetic.StratumSpec("a", "zipf")
    for name in synthetic.PRESETS:
        assert synthetic.preset(spark, name, 500).count() == 500


def test_streams_dont_depend_on_partitions(spark):
    a = synthetic.five_strata(spark, "variance_skew", 500)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, a.repartition(7).collect()))


def test_workloads(spark):
    shift = synthetic.five_strata(spark, "distribution_shift", 20_000)
    sd = lambda half: shift.where(f"sensor_id = 'S5' and id {'<' if half == 0 else '>='} 10000").agg(F.stddev("value")).first()[0]
    assert sd(1) / sd(0) == pytest.approx(8, rel=0.15)
    skew = {r.sensor_id: r["count"] for r in synthetic.five_strata(spark, "uniform", 10_000, skew="extreme").groupBy("sensor_id").count().collect()}
    assert skew["S1"] > 8000 and skew.get("S5", 0) < 5
    late = {r.sensor_id: r["min(position)"] for r in synthetic.late_strata(spark, 8000).groupBy("sensor_id").agg(F.min("position")).collect()}
    assert late["S5"] > 2000 and late["S6"] > 4000 and late["S1"] < 50
    with pytest.raises(ValueError):
        synthetic.five_strata(spark, "nope", 10)
