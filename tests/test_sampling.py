import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.priority import priority, uniform
from tessera.operators import estimates, sampling


def stream(spark, **strata):
    """A row for each stratum's value or values, numbered."""
    rows = [(s, float(v)) for s, vs in strata.items() for v in vs]
    return spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(rows)], "id long, s string, v double")


def strata(sample):
    return {r.stratum: r for r in sample.strata.collect()}


def test_weights_of_strata(spark):
    s = sampling.stratified(stream(spark, S1=[1] * 6, S2=[1] * 4, S3=[1] * 2), "s", "id", 3)
    got = strata(s)
    assert [got[k].weight for k in ("S1", "S2", "S3")] == [2.0, pytest.approx(4 / 3), 1.0]
    assert sum(r.total_seen for r in got.values()) == 12 and s.rows.count() == 8


@pytest.mark.parametrize("c,weight", [(5, 1.0), (6, 1.2), (20, 4.0)])
def test_weight_at_the_capacity(spark, c, weight):
    assert strata(sampling.stratified(stream(spark, S=[1] * c), "s", "id", 5))["S"].weight == pytest.approx(weight)


def test_constant_strata_are_exact(spark):
    s = sampling.stratified(stream(spark, S1=[1] * 100, S2=[2] * 50, S3=[3] * 5), "s", "id", 10)
    assert {k: r.weight for k, r in strata(s).items()} == {"S1": 10, "S2": 5, "S3": 1}
    assert estimates.approx_sum(s, "v").first()[0] == 215
    assert estimates.approx_mean(s, "v").first()[0] == pytest.approx(215 / 155)
    e = estimates.estimate_sum(s, "v").first()
    assert e.variance == 0 and e.lower_bound == e.upper_bound == 215


def test_small_strata_are_kept_whole(spark):
    s = sampling.stratified(stream(spark, s1=[10, 20], s2=[30, 40, 50]), "s", "id", 50)
    assert [estimates.approx_sum(s, "v").first()[0], estimates.approx_mean(s, "v").first()[0], estimates.approx_count(s).first()[0]] == [150, 30, 5]
    assert all(r.is_exact for r in strata(s).values())


def test_weighted_mean(spark):
    s = sampling.stratified(stream(spark, heavy=[10] * 10_000, light=[1000] * 100), "s", "id", 100)
    assert estimates.approx_sum(s, "v").first()[0] == pytest.approx(200_000)
    assert estimates.approx_mean(s, "v").first()[0] == pytest.approx(19.80198, abs=1e-5)


def test_count_where(spark):
    s = sampling.stratified(stream(spark, a=[1] * 9, b=[2]), "s", "id", 2)
    assert estimates.approx_count(s).first()[0] == 10
    assert estimates.approx_count(s, F.col("v") > 1).first()[0] == 1


def test_bounded_rows(spark):
    df = spark.range(200_000).withColumn("s", (F.col("id") % 5).cast("string"))
    s = sampling.stratified(df, "s", "id", 100)
    assert s.rows.count() == 500 and {r.total_seen for r in s.strata.collect()} == {40_000}


def test_rows_of_a_stratum_are_cut_before_they_are_moved(spark):
    df = spark.range(1000).withColumn("s", (F.col("id") % 5).cast("string"))
    plan = sampling.stratified(df, "s", "id", 10).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_capacity_table_function_and_errors(spark):
    df = stream(spark, a=range(20), b=range(20))
    got = strata(sampling.stratified(df, "s", "id", 5, capacities={"a": 3}))
    assert (got["a"].capacity, got["b"].capacity) == (3, 5)
    got = strata(sampling.stratified(df, "s", "id", capacities=lambda s: 7 if s == "b" else 2))
    assert (got["a"].sample_size, got["b"].sample_size) == (2, 7)
    for bad in ({"capacity": 0}, {"capacities": {"a": 0}}, {}):
        with pytest.raises(ValueError):
            sampling.stratified(df, "s", "id", **bad)


def test_samples_dont_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("s", (F.col("id") % 3).cast("string"))
    a, b = (sorted(r.id for r in sampling.stratified(x, "s", "id", 20, seed=3).rows.collect()) for x in (df.repartition(1), df.repartition(7)))
    c = sorted(r.id for r in sampling.stratified(df, "s", "id", 20, seed=4).rows.collect())
    assert a == b != c


def test_merged_halves(spark):
    df = spark.range(2000).withColumn("s", (F.col("id") % 2).cast("string"))
    whole = sampling.stratified(df, "s", "id", 30)
    halves = [sampling.stratified(df.where(f"id % 4 in ({a})"), "s", "id", 30) for a in ("0, 1", "2, 3")]
    both = sampling.merged(*halves, "id", 30)
    assert sorted(r.id for r in both.rows.collect()) == sorted(r.id for r in whole.rows.collect())
    assert sorted(map(tuple, both.strata.collect())) == sorted(map(tuple, whole.strata.collect()))


def test_cleared(spark):
    s = sampling.stratified(stream(spark, a=[1] * 9, b=[2]), "s", "id", 2)
    assert [(r.total_seen, r.sample_size) for r in s.cleared().strata.collect()] == [(0, 0)] * 2
    assert s.cleared(keep_strata=False).strata.count() == 0 and s.cleared().rows.count() == 0
    assert estimates.approx_mean(s.cleared(), "v").first()[0] == 0


def test_srs(spark):
    df = stream(spark, a=[20] * 20)
    d = sampling.srs(df, "id", 10)
    got = estimates.srs_estimate(d, 20, 10, "v").first()
    assert (got["sum"], got["mean"], got.sample_size, got.mean_error) == (400, 20, 10, 0)
    assert {r.stratum: r.sampled for r in sampling.srs_representation(d, "s").collect()} == {"a": 10}
    with pytest.raises(ValueError):
        sampling.srs(df, "id", 0)


def test_inclusion_is_uniform(spark):
    """Each of ten rows is among the three of largest priority in about 30 per cent of 1500 seeds."""
    seeds = spark.range(1500).withColumnRenamed("id", "seed").crossJoin(spark.range(10))
    p = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("id").cast("string")))
    from pyspark.sql import Window

    top = seeds.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc(p)))).where("r <= 3")
    for r in top.groupBy("id").count().collect():
        assert abs(r["count"] / 1500 - 0.3) < 0.05


def test_uniform_numbers(spark):
    got = spark.range(20_000).select(uniform(1, "id").alias("u"), priority(1, "id").alias("p"))
    r = got.agg(F.min("u"), F.max("u"), F.avg("u"), F.countDistinct("p")).first()
    assert 0 <= r[0] < r[1] < 1 and abs(r[2] - 0.5) < 0.01 and r[3] == 20_000


def test_variance_is_that_of_the_formula(spark):
    s = sampling.stratified(stream(spark, a=[10, 20, 30, 40, 50, 60, 70], b=[5, 5.5, 9]), "s", "id", 3)
    rows = {k: [r.v for r in s.rows.collect() if r.stratum == k] for k in "ab"}
    c = {"a": 7, "b": 3}
    want = 0.0
    for k, v in rows.items():
        m = sum(v) / len(v)
        s2 = sum((x - m) ** 2 for x in v) / (len(v) - 1)
        want += c[k] * (c[k] - len(v)) * s2 / len(v)
    e, m = estimates.estimate_sum(s, "v").first(), estimates.estimate_mean(s, "v").first()
    assert e.variance == pytest.approx(want) and m.variance == pytest.approx(want / 100)
    assert m.standard_error == pytest.approx(math.sqrt(want) / 10)


def test_confidence_intervals_cover(spark):
    """95% limits hold the mean in at least 85 of 100 samples."""
    from tessera.sources.synthetic import StratumSpec, multi_strata_stream

    specs = [StratumSpec(n, "gaussian", {"mean": m, "std": s}, w) for n, m, s, w in (("a", 10, 2, 500), ("b", 50, 5, 300), ("c", 100, 10, 200))]
    df = multi_strata_stream(spark, specs, 1000).cache()
    from tessera.operators.experiments import seeded_means

    got = seeded_means(df, "sensor_id", "value", "id", 50, list(range(25))).collect()
    assert sum(r.covered for r in got) >= 21


def test_degenerate_strata_are_counted(spark):
    s = sampling.stratified(stream(spark, a=range(10), b=range(10)), "s", "id", 5, capacities={"a": 1})
    assert estimates.estimate_mean(s, "v").first().degenerate_strata == 1


def test_nulls_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0, "x"), (2, "a", None, "y"), (None, "a", 3.0, "z")], "id long, s string, v double, total_seen string")
    s = sampling.stratified(df, "s", "id", 5)
    assert s.rows.count() == 3
    assert estimates.approx_count(s).first()[0] == 3 and estimates.approx_sum(s, "v").first()[0] == 5
    assert sampling.stratified(df, "s", "id", 5, capacities={"a": 1}).rows.count() == 2
    empty = sampling.stratified(df.where("false"), "s", "id", 5)
    assert estimates.estimate_sum(empty, "v").first().estimate == 0 and estimates.approx_mean(empty, "v").first()[0] == 0


def test_estimates_of_several_fields(spark):
    df = stream(spark, a=[1] * 9, b=[5]).withColumn("w", F.col("v") * 2)
    got = {r.field: r.estimate for r in estimates.estimate_means(sampling.stratified(df, "s", "id", 3), ["v", "w"]).collect()}
    assert got == {"v": pytest.approx(1.4), "w": pytest.approx(2.8)}


def test_pruning_changes_nothing(spark, monkeypatch):
    df = spark.range(20_000).withColumn("s", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 7 == 0, "b").otherwise("a"))
    plain = sampling.stratified(df, "s", "id", 40, prune=False)
    want = sorted(r.id for r in plain.rows.collect())
    got = sampling.stratified(df, "s", "id", 40, prune=True)
    assert sorted(r.id for r in got.rows.collect()) == want and got.rows.columns == plain.rows.columns
    assert sorted(map(str, got.strata.collect())) == sorted(map(str, plain.strata.collect()))
    monkeypatch.setattr(sampling, "_floor", lambda total, bound: F.lit("fff"))  # too few rows: the whole is taken
    assert sorted(r.id for r in sampling.stratified(df, "s", "id", 40, prune=True).rows.collect()) == want
    assert sampling.stratified(df.where("false"), "s", "id", 40, prune=True).rows.count() == 0
