"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.priority import priority
from tessera.functions.shared import checkpointed, positioned
from tessera.operators import adaptive, allocation, control, estimates, exact, experiments, sampling, windows
from tessera.sources import replay, sensors, synthetic
from tessera.streaming import pools, stateful
from tessera.streaming import windows as stream_windows

from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
N, SEED, BUDGET = 100, 42, 200
DAY, HOUR = 86_400_000_000, 3_600_000_000


def query(text: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def drawn(spark: SparkSession, sf_dir: str, n: int = N, seed: int = SEED) -> sampling.Sample:
    return sampling.stratified(events(spark, sf_dir), "event_type", "event_id", n, seed=seed)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def _rounded_sql(with_: str, columns: list[str], rest: str, digits: int = 4) -> str:
    parts = [c[1:] if c.startswith("=") else f"round(({c.split(' AS ')[0]})::DOUBLE, {digits}) AS {c.split(' AS ')[-1]}" for c in columns]
    return f"{with_}\nSELECT {', '.join(parts)} {rest}"


# Samples


@query("SELECT event_type AS stratum, count(*) AS \"count\", round(sum(value), 4) AS \"sum\", round(avg(value), 4) AS mean FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*), round(sum(value), 4), round(avg(value), 4) FROM events")
def exact_ground_truth(spark, sf_dir):
    return rounded(exact.ground_truth(events(spark, sf_dir), "event_type", "value"))


_SRS = f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY {sql.priority(SEED, "event_id")} DESC, event_id) AS rk FROM events),
d AS (SELECT * FROM s WHERE rk <= 300), c AS (SELECT count(*) AS n FROM events)"""


@query(f"""{_SRS} SELECT round(sum(value) * CASE WHEN any_value(n) > 300 THEN any_value(n) / 300.0::DOUBLE ELSE 1 END, 4) AS "sum", round(avg(value), 4) AS mean, count(*) AS sample_size,
round((CASE WHEN any_value(n) > 300 THEN any_value(n) / 300.0::DOUBLE ELSE 1 END)::DOUBLE, 4) AS weight FROM d, c""")
def srs_sample_sum_mean(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(estimates.srs_estimate(sampling.srs(e, "event_id", 300, SEED), e.count(), 300, "value").select("sum", "mean", "sample_size", "weight"))


@query(f"{_SRS} SELECT round(avg(value), 6) AS mean, round(sqrt(var_samp(value) / count(*) * (any_value(n) - count(*)) / greatest(any_value(n), 1)), 6) AS mean_error FROM d, c")
def srs_mean_se(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(estimates.srs_estimate(sampling.srs(e, "event_id", 300, SEED), e.count(), 300, "value").select("mean", "mean_error"), 6)


@query(f"{_SRS} SELECT event_type AS stratum, count(*) AS sampled FROM d GROUP BY 1")
def srs_stratum_representation(spark, sf_dir):
    return sampling.srs_representation(sampling.srs(events(spark, sf_dir), "event_id", 300, SEED), "event_type")


@query(f"{_SRS} SELECT event_id, event_type, value FROM d")
def uniform_reservoir_rows(spark, sf_dir):
    return sampling.srs(events(spark, sf_dir), "event_id", 300, SEED).select("event_id", "event_type", "value")


@query(f"""{sql.sample(N)} SELECT stratum, total_seen, {N} AS capacity, y AS sample_size, round(w, 6) AS weight, y >= total_seen AS is_exact, round(y / total_seen::DOUBLE, 6) AS sampling_fraction FROM st""")
def oasrs_strata_snapshot(spark, sf_dir):
    return rounded(drawn(spark, sf_dir).strata, 6)


@query(f"{sql.sample(N)} SELECT stratum, id AS event_id, v AS value FROM smp")
def oasrs_rows(spark, sf_dir):
    return drawn(spark, sf_dir).rows.select("stratum", "event_id", "value")


_CAPACITY = "CASE stratum WHEN (SELECT min(event_type) FROM events) THEN 20 WHEN (SELECT max(event_type) FROM events) THEN 80 ELSE 50 END"


@query(f"""WITH {sql.source()}, tot AS (SELECT stratum, count(*) AS total_seen, {_CAPACITY} AS capacity FROM src GROUP BY stratum),
rk AS (SELECT src.stratum, v, row_number() OVER (PARTITION BY src.stratum ORDER BY {sql.priority(SEED, "id")} DESC, id) AS rk FROM src),
agg AS (SELECT tot.stratum, any_value(total_seen) AS total_seen, any_value(capacity) AS capacity, count(*) AS sample_size, sum(v) AS s FROM rk JOIN tot ON tot.stratum = rk.stratum WHERE rk <= capacity GROUP BY tot.stratum)
SELECT stratum, total_seen, capacity, sample_size, round(CASE WHEN total_seen > capacity THEN total_seen / capacity::DOUBLE ELSE 1 END, 6) AS weight, round(s, 6) AS sampled_sum FROM agg""")
def oasrs_capacity_table(spark, sf_dir):
    e = events(spark, sf_dir)
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    s = sampling.stratified(e, "event_type", "event_id", 50, capacities={ends.a: 20, ends.b: 80}, seed=SEED)
    return rounded(estimates.stratum_stats(s, "value").select("stratum", "total_seen", "capacity", F.col("y").alias("sample_size"), "weight", "sampled_sum"), 6)


@query(f"SELECT DISTINCT event_type AS stratum, 0::BIGINT AS total_seen, {N} AS capacity, 0::BIGINT AS sample_size, 1.0::DOUBLE AS weight FROM events")
def oasrs_soft_reset(spark, sf_dir):
    return drawn(spark, sf_dir).cleared().strata.select("stratum", "total_seen", "capacity", "sample_size", "weight")


_USERS = {"stratum": "user_id", "ident": "event_id"}


@query(f"{sql.sample(5, **_USERS)} SELECT count(*) AS strata, sum(y)::BIGINT AS sampled, sum(total_seen)::BIGINT AS total_seen, round(sum(w * s), 4) AS estimate FROM st")
def oasrs_many_strata(spark, sf_dir):
    s = sampling.stratified(events(spark, sf_dir), "user_id", "event_id", 5, seed=SEED)
    return rounded(estimates.stratum_stats(s, "value").agg(F.count("*").alias("strata"), F.sum("y").alias("sampled"), F.sum("total_seen").alias("total_seen"), F.sum(F.col("weight") * F.col("sampled_sum")).alias("estimate")))


@query(f"{sql.sample(N)} SELECT stratum, y AS sample_size, total_seen, round(s, 4) AS sampled_sum FROM st")
def merged_samples(spark, sf_dir):
    """The sample of all events, from the samples of two halves."""
    e = events(spark, sf_dir)
    halves = [sampling.stratified(e.where(F.col("event_id") % 2 == i), "event_type", "event_id", N, seed=SEED) for i in (0, 1)]
    s = sampling.merged(*halves, "event_id", N)
    return rounded(estimates.stratum_stats(s, "value").select("stratum", F.col("y").alias("sample_size"), "total_seen", "sampled_sum"))


# Linear queries


@query(f"{sql.sample(N)} SELECT round(sum(w * s), 4) AS \"sum\" FROM st")
def approx_sum(spark, sf_dir):
    return rounded(estimates.approx_sum(drawn(spark, sf_dir), "value"))


@query(f"{sql.sample(N)} SELECT round(sum(w * s) / sum(total_seen), 6) AS mean FROM st")
def approx_mean(spark, sf_dir):
    return rounded(estimates.approx_mean(drawn(spark, sf_dir), "value"), 6)


@query(f"{sql.sample(N)} SELECT round(sum(w * y), 4) AS \"count\" FROM st")
def approx_count(spark, sf_dir):
    return rounded(estimates.approx_count(drawn(spark, sf_dir)))


@query(f"{sql.sample(N)} SELECT round(sum(w * k), 4) AS \"count\" FROM st JOIN (SELECT stratum, count(*) AS k FROM smp WHERE v > 50 GROUP BY stratum) AS f ON f.stratum = st.stratum")
def approx_count_where(spark, sf_dir):
    return rounded(estimates.approx_count(drawn(spark, sf_dir), F.col("value") > 50))


@query(f"{sql.sample(N)} SELECT stratum, round(w * s, 4) AS \"sum\" FROM st")
def approx_stratum_sums(spark, sf_dir):
    return rounded(estimates.stratum_sums(drawn(spark, sf_dir), "value"))


@query(f"{sql.sample(N)} SELECT stratum, round(m, 6) AS mean FROM st")
def approx_stratum_means(spark, sf_dir):
    return rounded(estimates.stratum_means(drawn(spark, sf_dir), "value"), 6)


_LIMITS = ["estimate", "variance", "standard_error", "=0.95::DOUBLE AS confidence_level", "=1.96::DOUBLE AS z_score", "error_bound", "lower_bound", "upper_bound"]
_ESTIMATE = ", standard_error * 1.96 AS error_bound, estimate - 1.96 * standard_error AS lower_bound, estimate + 1.96 * standard_error AS upper_bound"


def _limits(estimate: str, variance: str) -> str:
    return f"""{sql.sample(N)}, e AS (SELECT {estimate} AS estimate, {variance} AS variance FROM st), f AS (SELECT *, sqrt(variance) AS standard_error FROM e), g AS (SELECT *{_ESTIMATE} FROM f)"""


@query(_rounded_sql(_limits("sum(w * s)", "sum(term)"), _LIMITS, "FROM g", 3))
def estimate_sum_ci(spark, sf_dir):
    return rounded(estimates.estimate_sum(drawn(spark, sf_dir), "value").drop("degenerate_strata", "relative_bound"), 3)


@query(_rounded_sql(_limits("sum(w * s) / sum(total_seen)", "sum(term) / (sum(total_seen)::DOUBLE * sum(total_seen))"), _LIMITS, "FROM g", 6))
def estimate_mean_ci(spark, sf_dir):
    return rounded(estimates.estimate_mean(drawn(spark, sf_dir), "value").drop("degenerate_strata", "relative_bound"), 6)


@query(f"{_limits('sum(w * s) / sum(total_seen)', 'sum(term) / (sum(total_seen)::DOUBLE * sum(total_seen))')} SELECT k::INTEGER AS sigma, round(estimate - k * standard_error, 6) AS low, round(estimate + k * standard_error, 6) AS high FROM g, range(1, 4) AS r(k)")
def sigma_ranges(spark, sf_dir):
    got = estimates.estimate_mean(drawn(spark, sf_dir), "value")
    return rounded(got.select(F.explode(stats.sigma_ranges(F.col("estimate"), F.col("standard_error"))).alias("sigma", "r")).select("sigma", "r.low", "r.high"), 6)


@query(f"{sql.sample(N)} SELECT stratum, y, round(s2, 6) AS s2, round(term, 3) AS sum_variance FROM st")
def stratum_variances(spark, sf_dir):
    got = estimates.stratum_variances(drawn(spark, sf_dir), "value")
    return got.select("stratum", "y", F.round("s2", 6).alias("s2"), F.round("sum_variance", 3).alias("sum_variance"))


@query(f"{sql.sample(N)} SELECT round(abs(a - x), 6) AS absolute_error, round(abs(a - x) / abs(x), 9) AS relative_error, round(100 * abs(a - x) / abs(x), 7) AS accuracy_loss FROM (SELECT sum(w * s) / sum(total_seen) AS a FROM st) AS p, (SELECT avg(v) AS x FROM src) AS q")
def accuracy_loss(spark, sf_dir):
    a, x = F.col("mean"), F.col("x")
    both = estimates.approx_mean(drawn(spark, sf_dir), "value").crossJoin(events(spark, sf_dir).agg(F.avg("value").alias("x")))
    return both.select(
        F.round(stats.absolute_error(a, x), 6).alias("absolute_error"), F.round(stats.relative_error(a, x), 9).alias("relative_error"), F.round(stats.accuracy_loss(a, x), 7).alias("accuracy_loss")
    )


@query("SELECT event_type AS stratum, round(abs(count(*) FILTER (value > 1e9) - 0.0) / greatest(0.0, 1e-12::DOUBLE), 6) AS error_eps, round(abs(min(value) - avg(value)) / greatest(abs(avg(value)), 1e-12::DOUBLE), 6) AS mean_error_eps FROM events GROUP BY 1")
def relative_error_eps(spark, sf_dir):
    got = events(spark, sf_dir).groupBy(F.col("event_type").alias("stratum")).agg(F.sum((F.col("value") > 1e9).cast("double")).alias("a"), F.min("value").alias("lo"), F.avg("value").alias("m"))
    return rounded(got.select("stratum", stats.relative_error_eps(F.col("a"), F.lit(0.0)).alias("error_eps"), stats.relative_error_eps(F.col("lo"), F.col("m")).alias("mean_error_eps")), 6)


def _covered(seed: int) -> str:
    e = f"{sql.sample(50, seed)} SELECT {seed} AS seed, sum(w * s) / sum(total_seen) AS estimate, sqrt(sum(term)) / sum(total_seen) AS standard_error, (SELECT avg(v) FROM src) AS exact FROM st"
    return f"SELECT seed, round(estimate, 6) AS estimate, round(standard_error, 6) AS standard_error, round(exact, 6) AS exact, abs(estimate - exact) <= 1.96 * standard_error AS covered FROM ({e})"


@query(" UNION ALL ".join(_covered(s) for s in (1, 2, 3, 4, 5)))
def ci_coverage_seeds(spark, sf_dir):
    return rounded(experiments.seeded_means(events(spark, sf_dir), "event_type", "value", "event_id", 50, [1, 2, 3, 4, 5]), 6)


# Allocation and control

_COUNTS = "SELECT event_type AS stratum, count(*) AS total_seen FROM events GROUP BY 1"
_PILOT = "SELECT event_type AS stratum, count(*) AS pilot_rows, coalesce(stddev_samp(value), 0.0) AS pilot_sd FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rk FROM events) WHERE rk <= 50 GROUP BY 1"


def _policy(spark, sf_dir, policy: str) -> DataFrame:
    e = events(spark, sf_dir)
    weights = allocation.policy_weights(sampling.totals(e, "event_type"), allocation.pilot(e, "event_type", "event_id", "value", 50), policy)
    return allocation.hamilton_table(weights, "weight", BUDGET).select("stratum", "capacity")


@query(f"WITH {sql.hamilton('SELECT stratum, 1.0::DOUBLE AS weight FROM (' + _COUNTS + ')', BUDGET)} SELECT stratum, capacity FROM sh")
def hamilton_equal(spark, sf_dir):
    return _policy(spark, sf_dir, "equal")


@query(f"WITH {sql.hamilton('SELECT stratum, total_seen::DOUBLE AS weight FROM (' + _COUNTS + ')', BUDGET)} SELECT stratum, capacity FROM sh")
def hamilton_proportional(spark, sf_dir):
    return _policy(spark, sf_dir, "proportional")


_NEYMAN = f"SELECT c.stratum, greatest(total_seen * pilot_sd, 1e-12::DOUBLE) AS weight FROM ({_COUNTS}) AS c JOIN ({_PILOT}) AS p ON p.stratum = c.stratum"


@query(f"WITH {sql.hamilton(_NEYMAN, BUDGET)} SELECT stratum, capacity FROM sh")
def hamilton_neyman(spark, sf_dir):
    return _policy(spark, sf_dir, "neyman")


_CAPS = "SELECT event_type AS stratum, count(*)::DOUBLE AS weight, 20 + 10 * row_number() OVER (ORDER BY event_type) AS cap FROM events GROUP BY 1"


@query(f"{sql.capped_hamilton(_CAPS, BUDGET)} SELECT stratum, got::INTEGER AS capacity FROM dealt")
def hamilton_capped(spark, sf_dir):
    """Caps of 30, 40, 50, ... by name bind some strata, and what they leave over goes to the others."""
    rows = sampling.totals(events(spark, sf_dir), "event_type").collect()
    caps = {name: 30 + 10 * i for i, name in enumerate(sorted(r.stratum for r in rows))}
    got = allocation.hamilton(BUDGET, {r.stratum: float(r.total_seen) for r in rows}, 1, caps)
    return spark.createDataFrame(sorted(got.items()), "stratum string, capacity int")


@query(f"SELECT stratum, pilot_rows, round(pilot_sd, 6) AS pilot_sd FROM ({_PILOT})")
def pilot_stats(spark, sf_dir):
    return rounded(allocation.pilot(events(spark, sf_dir), "event_type", "event_id", "value", 50), 6)


@query("SELECT c_mktsegment AS segment, greatest(2, least(50, floor(sum(c_acctbal) / 100000.0 * 100 / 5)::BIGINT))::INTEGER AS capacity FROM customer GROUP BY 1")
def linear_cost_capacity(spark, sf_dir):
    cost = control.LinearCost(100, 2, 50)
    got = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("c_acctbal").cast("double").alias("b"))
    return got.select("segment", cost.column(F.col("b") / 100000.0, F.lit(5)).alias("capacity"))


_STEP = f"""{sql.sample(N)}, e AS (SELECT stratum, y AS current, w * s AS estimate, sqrt(term) AS error FROM st), r AS (SELECT *, CASE WHEN estimate <> 0 THEN error / abs(estimate) WHEN error > 0 THEN 'inf'::DOUBLE ELSE 0 END AS ratio FROM e)
SELECT stratum, (CASE WHEN ratio <= 0.05::DOUBLE THEN least(60, greatest(10, floor(current * 0.5::DOUBLE))) ELSE least(60, greatest(10, floor(current * least(2.0::DOUBLE, greatest(1.1::DOUBLE, ratio / 0.05::DOUBLE))))) END)::INTEGER AS capacity FROM r"""


@query(_STEP)
def adaptive_capacity_step(spark, sf_dir):
    c = control.AdaptiveController(0.05, 10, 60)
    got = estimates.stratum_stats(drawn(spark, sf_dir), "value").join(estimates.stratum_variances(drawn(spark, sf_dir), "value").select("stratum", "sum_variance"), "stratum")
    return got.select("stratum", c.column(F.col("y"), F.col("weight") * F.col("sampled_sum"), F.sqrt("sum_variance")).alias("capacity"))


_CONFIGS = "SELECT user_id, count(*) AS cost, round(stddev_samp(value) / sqrt(count(*)), 6) AS error, count(*) FILTER (value > 20) / count(*)::DOUBLE AS coverage FROM events GROUP BY 1 HAVING count(*) > 1"


def _configs(spark, sf_dir) -> DataFrame:
    got = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("cost"), F.round(F.stddev_samp("value") / F.sqrt(F.count("*")), 6).alias("error"), F.avg((F.col("value") > 20).cast("double")).alias("coverage"))
    return got.where("cost > 1")


@query(f"WITH c AS ({_CONFIGS}) SELECT user_id, cost, error FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.cost <= c.cost AND o.error <= c.error AND (o.cost < c.cost OR o.error < c.error))")
def pareto_front(spark, sf_dir):
    return control.pareto(_configs(spark, sf_dir), "cost", "error").select("user_id", "cost", "error")


@query(f"WITH c AS ({_CONFIGS}) SELECT cost, error FROM c ORDER BY (error <= 4 AND coverage >= 0.5) DESC, CASE WHEN error <= 4 AND coverage >= 0.5 THEN cost END, error, cost LIMIT 1")
def cheapest_feasible(spark, sf_dir):
    return control.cheapest(_configs(spark, sf_dir), "cost", "error", "coverage", 4.0, 0.5).select("cost", "error")


# Windows


def _windows_sql(size: int, slide: int, n: int, base: int = 0, exact_too: bool = False) -> str:
    more = ', round(exact_sum, 4) AS exact_sum, round(exact_mean, 9) AS exact_mean, exact_count' if exact_too else ""
    return f"""WITH {sql.windows(size, slide, base)}, {sql.window_estimates(n, SEED, exact_too)}
SELECT window_start, window_end, total_seen, sample_size, num_strata, round("count", 4) AS "count", round("sum", 4) AS "sum", round("sum" / total_seen, 9) AS mean, round(sum_variance, 6) AS sum_variance{more} FROM est"""


def _window_result(got: DataFrame, *more: str) -> DataFrame:
    return got.select("window_start", "window_end", "total_seen", "sample_size", "num_strata", F.round("count", 4).alias("count"), F.round("sum", 4).alias("sum"), F.round("mean", 9).alias("mean"),
                      F.round("sum_variance", 6).alias("sum_variance"), *[F.round(c, 9 if c == "exact_mean" else 4).alias(c) if c != "exact_count" else F.col(c) for c in more])


@query(_windows_sql(DAY, DAY, 10))
def tumbling_approx(spark, sf_dir):
    w = windows.windowed(events(spark, sf_dir), "ts", 86_400)
    return _window_result(windows.estimates(w, "event_type", "value", "event_id", 10, SEED))


@query(_windows_sql(2 * HOUR, HOUR, 3, 600_000_000))
def sliding_approx(spark, sf_dir):
    w = windows.windowed(events(spark, sf_dir), "ts", 7200, 3600, 600)
    return _window_result(windows.estimates(w, "event_type", "value", "event_id", 3, SEED))


@query(f"WITH {sql.windows(2 * HOUR, HOUR, 600_000_000)} SELECT window_start, window_end, count(*) AS \"count\", round(sum(v), 4) AS \"sum\", round(avg(v), 6) AS mean FROM win GROUP BY 1, 2")
def sliding_exact(spark, sf_dir):
    got = windows.exact_windows(windows.windowed(events(spark, sf_dir), "ts", 7200, 3600, 600), "value")
    return got.select("window_start", "window_end", "count", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"))


@query(_windows_sql(DAY, DAY, 20, 0, True))
def window_exact_vs_approx(spark, sf_dir):
    w = windows.windowed(events(spark, sf_dir), "ts", 86_400)
    return _window_result(windows.estimates(w, "event_type", "value", "event_id", 20, SEED, exact=True), "exact_sum", "exact_mean", "exact_count")


_POSITIONS = "SELECT *, row_number() OVER (ORDER BY event_id) AS position FROM events"


@query(f"""WITH p AS ({_POSITIONS}), win AS (SELECT ((position - 1) // 700) * 700 AS window_start, least(((position - 1) // 700) * 700 + 700, (SELECT max(position) FROM p)) AS window_end, event_id AS id, event_type AS stratum, value::DOUBLE AS v FROM p),
{sql.window_estimates(20, SEED)} SELECT window_start, window_end, total_seen, sample_size, num_strata, round("count", 4) AS "count", round("sum", 4) AS "sum", round("sum" / total_seen, 9) AS mean, round(sum_variance, 6) AS sum_variance FROM est""")
def count_window_approx(spark, sf_dir):
    w = windows.count_windowed(positioned(events(spark, sf_dir), "event_id"), "position", 700)
    return _window_result(windows.estimates(w, "event_type", "value", "event_id", 20, SEED))


@query(f"""WITH p AS ({_POSITIONS}), m AS (SELECT *, max(epoch_us(ts)) OVER (ORDER BY position) - {6 * HOUR}::BIGINT AS mark, (epoch_us(ts) // {DAY}::BIGINT) * {DAY}::BIGINT AS window_start FROM (SELECT * REPLACE (row_number() OVER (ORDER BY md5(event_id::VARCHAR)) AS position) FROM p))
SELECT window_start, count(*) AS rows, round(sum(value), 4) AS "sum" FROM m WHERE window_start + {DAY}::BIGINT > mark GROUP BY 1""")
def late_drop_batch(spark, sf_dir):
    """Events arrive in a shuffled order; those whose day is closed are dropped."""
    shuffled = positioned(events(spark, sf_dir).withColumn("arrival", F.md5(F.col("event_id").cast("string"))), "arrival")
    w = windows.windowed(shuffled, "ts", 86_400)
    got = windows.on_time(w, "position", "ts", 6 * 3600, block=1000)
    return rounded(got.groupBy("window_start").agg(F.count("*").alias("rows"), F.sum("value").alias("sum")))


@query(f"WITH p AS ({_POSITIONS}) SELECT ((position - 1) // 300) * 300000000 AS window_start, count(*) AS \"count\", round(sum(value), 4) AS \"sum\" FROM p GROUP BY 1")
def virtual_clock_window(spark, sf_dir):
    rows = windows.virtual_clock(positioned(events(spark, sf_dir), "event_id"), "position")
    return windows.exact_windows(windows.windowed(rows, "timestamp", 300), "value").select("window_start", "count", F.round("sum", 4).alias("sum"))


@query(f"""WITH b AS (SELECT epoch_us(ts) // {6 * HOUR}::BIGINT AS batch, event_id, value FROM events), n AS (SELECT batch, count(*) AS rows FROM b GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY {sql.priority(SEED, "batch", "event_id")} DESC, event_id) AS rk FROM b)
SELECT r.batch, any_value(rows) AS rows, count(*) AS sampled, round(avg(value), 6) AS mean FROM r JOIN n ON n.batch = r.batch WHERE rk <= greatest(1, floor(rows * 0.6::DOUBLE)) GROUP BY 1""")
def micro_batch_interval(spark, sf_dir):
    """A uniform sample of 60 per cent of each interval's rows."""
    b = windows.micro_batches(events(spark, sf_dir), "ts", 6 * 3600)
    n = b.groupBy("batch").agg(F.count("*").alias("rows"))
    ranked = b.withColumn("rk", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc(priority(SEED, "batch", "event_id")), "event_id")))
    got = ranked.join(n, "batch").where(F.col("rk") <= F.greatest(F.lit(1), F.floor(F.col("rows") * 0.6)))
    return got.groupBy("batch").agg(F.first("rows").alias("rows"), F.count("*").alias("sampled"), F.round(F.avg("value"), 6).alias("mean"))


# Variance-aware samples

_STATIC = f"""p AS ({_POSITIONS}), burn AS (SELECT event_type AS stratum, count(*) * CASE WHEN count(*) > 1 THEN sqrt(var_samp(value)) ELSE 1 END AS weight FROM p WHERE position <= 1000 GROUP BY 1),
{sql.hamilton("SELECT * FROM burn", BUDGET)}, rk AS (SELECT event_type AS stratum, value, row_number() OVER (PARTITION BY event_type ORDER BY {sql.priority(SEED, "event_id")} DESC, event_id) AS rk FROM events),
t AS (SELECT event_type AS stratum, count(*) AS c FROM events GROUP BY 1), g AS (SELECT sh.stratum, capacity, any_value(c) AS c, count(*) AS y, sum(value) AS s, coalesce(var_samp(value), 0) AS s2 FROM sh JOIN rk ON rk.stratum = sh.stratum JOIN t ON t.stratum = sh.stratum WHERE rk <= capacity GROUP BY 1, 2)"""


@query(f"WITH {_STATIC} SELECT stratum, c AS total_seen, capacity, y AS sample_size, round(c / y::DOUBLE, 6) AS weight FROM g")
def static_va_strata(spark, sf_dir):
    s = adaptive.static_va(positioned(events(spark, sf_dir), "event_id"), "event_type", "position", "value", "event_id", BUDGET, 1000, seed=SEED)
    return rounded(s.strata.select("stratum", "total_seen", "capacity", "sample_size", "weight"), 6)


@query(f"WITH {_STATIC} SELECT round(sum(c * s / y) / sum(c), 6) AS estimate, round(sqrt(sum(CASE WHEN c > y AND y > 1 THEN c::DOUBLE * (c - y) * s2 / y ELSE 0 END)) / sum(c), 6) AS standard_error FROM g")
def static_va_estimate(spark, sf_dir):
    s = adaptive.static_va(positioned(events(spark, sf_dir), "event_id"), "event_type", "position", "value", "event_id", BUDGET, 1000, seed=SEED)
    return rounded(estimates.estimate_mean(s, "value").select("estimate", "standard_error"), 6)


@query("SELECT event_type AS stratum, count(*) AS \"count\", round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 4) AS variance FROM events GROUP BY 1")
def welford_variance(spark, sf_dir):
    got = adaptive.welford(events(spark, sf_dir), "event_type", "value")
    return got.select("stratum", "count", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query(f"SELECT stratum, n AS \"count\", round(m, 6) AS ema_mean, round(s, 4) AS ema_variance FROM ({sql.followed('events', 'event_type', 'event_id', 'value', 0.01)})")
def ema_variance(spark, sf_dir):
    got = adaptive.ema_variance(positioned(events(spark, sf_dir), "event_id"), "event_type", "position", "value", 0.01)
    return got.select("stratum", "count", F.round("ema_mean", 6).alias("ema_mean"), F.round("ema_variance", 4).alias("ema_variance"))


@query(f"SELECT stratum, event_id, rank FROM (SELECT event_type AS stratum, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {sql.priority(SEED, 'event_id')} DESC, event_id) AS rank FROM events) WHERE rank <= {BUDGET}")
def dv_pool(spark, sf_dir):
    got = sampling.pool(events(spark, sf_dir), "event_type", "event_id", BUDGET, SEED)
    return got.select("stratum", "event_id", F.col("rank").cast("long").alias("rank"))


def _dynamic(spark, sf_dir) -> adaptive.Dynamic:
    return adaptive.dynamic_va(positioned(events(spark, sf_dir), "event_id"), "event_type", "position", "value", "event_id", BUDGET, 500, seed=SEED)


@query()
def dv_estimate(spark, sf_dir):
    return rounded(estimates.estimate_mean(_dynamic(spark, sf_dir).sample, "value"), 6)


@query()
def dv_history(spark, sf_dir):
    return rounded(_dynamic(spark, sf_dir).history, 6)


@query(f"""{sql.sample(N, value="o_totalprice", table="orders", stratum="o_orderpriority", ident="o_orderkey")}, o AS (SELECT smp.stratum, o_totalprice::DOUBLE AS a, o_custkey::DOUBLE AS b FROM smp JOIN orders ON o_orderkey = id),
f AS (SELECT stratum, 'o_totalprice' AS field, a AS x FROM o UNION ALL SELECT stratum, 'o_custkey', b FROM o), g AS (SELECT field, f.stratum, any_value(total_seen) AS c, any_value(w) AS w, count(*) AS y, sum(x) AS s, var_samp(x) AS s2 FROM f JOIN st ON st.stratum = f.stratum GROUP BY 1, 2)
SELECT field, round(sum(w * s) / sum(c), 4) AS estimate, round(sqrt(sum(CASE WHEN c > y THEN c::DOUBLE * (c - y) * s2 / y ELSE 0 END)) / sum(c), 4) AS standard_error FROM g GROUP BY 1""")
def multi_field_means(spark, sf_dir):
    s = sampling.stratified(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", N, seed=SEED)
    return rounded(estimates.estimate_means(s, ["o_totalprice", "o_custkey"]).select("field", "estimate", "standard_error"))


@query("SELECT event_type AS stratum, min(event_id) AS first_position, count(*) AS rows FROM events GROUP BY 1")
def first_appearance(spark, sf_dir):
    return exact.first_appearance(events(spark, sf_dir), "event_type", "event_id")


# Experiments

_RUNS = "SELECT event_type AS dataset, user_id % 5 AS seed, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS method, abs(avg(value) - 50) / 50 AS error, avg(value) > 45 AS covered, count(*)::DOUBLE AS rate FROM events GROUP BY 1, 2, 3"


def _runs(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    got = e.groupBy(F.col("event_type").alias("dataset"), (F.col("user_id") % 5).alias("seed"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("method"))
    return got.agg((F.abs(F.avg("value") - 50) / 50).alias("error"), (F.avg("value") > 45).alias("covered"), F.count("*").cast("double").alias("rate"))


@query(f"""WITH r AS ({_RUNS}), g AS (SELECT dataset, method, count(*) AS n, avg(error) AS mean_error, coalesce(stddev_samp(error), 0) AS sd_error, avg(covered::INTEGER) AS coverage, avg(rate) AS mean_rate FROM r GROUP BY 1, 2), h AS (SELECT *, 2.776::DOUBLE * sd_error / sqrt(n) AS half FROM g)
SELECT dataset, method, n, round(mean_error, 6) AS mean_error, round(sd_error, 6) AS sd_error, round(coverage, 6) AS coverage, round(mean_rate, 6) AS mean_rate, round(greatest(0, mean_error - half), 6) AS low, round(mean_error + half, 6) AS high FROM h""")
def summary_t_ci(spark, sf_dir):
    return rounded(experiments.summary(_runs(spark, sf_dir), ["dataset", "method"], "error", "covered", "rate"), 6)


@query(f"""WITH r AS ({_RUNS}), d AS (SELECT b.dataset, b.method, a.error - b.error AS d FROM r AS a JOIN r AS b ON a.dataset = b.dataset AND a.seed = b.seed AND a.method = 'a' AND b.method = 'b'), g AS (SELECT dataset, method, count(*) AS pairs, avg(d) AS m, coalesce(stddev_samp(d), 0) AS s FROM d GROUP BY 1, 2)
SELECT dataset, method, pairs, round(m, 6) AS mean_difference, round(s, 6) AS sd_difference, round(m - 2.776::DOUBLE * s / sqrt(pairs), 6) AS low, round(m + 2.776::DOUBLE * s / sqrt(pairs), 6) AS high FROM g""")
def paired_difference(spark, sf_dir):
    return rounded(experiments.paired_difference(_runs(spark, sf_dir), ["dataset"], "seed", "method", "error", "a"), 6)


@query(f"WITH r AS ({_RUNS}) SELECT dataset, method, round(median(error), 6) AS median_error FROM r GROUP BY 1, 2")
def median_error(spark, sf_dir):
    return rounded(experiments.median_error(_runs(spark, sf_dir), ["dataset", "method"], "error"), 6)


@query(f"WITH r AS ({_RUNS}) SELECT dataset, count(*) AS n, round(avg(error), 6) AS mean, round(coalesce(stddev_samp(error), 0), 6) AS sd, round(CASE WHEN count(*) = 5 THEN 2.776::DOUBLE ELSE 1.96::DOUBLE END * coalesce(stddev_samp(error), 0) / sqrt(count(*)), 6) AS half FROM r GROUP BY 1")
def error_bars(spark, sf_dir):
    return rounded(experiments.error_bars(_runs(spark, sf_dir), ["dataset"], "error"), 6)


def _sweep(f: float) -> str:
    size, per = f"greatest(1, floor(n * {f}::DOUBLE)::BIGINT)", f"greatest(1, floor(n * {f}::DOUBLE)::BIGINT // k)"
    base = f"""SELECT *, row_number() OVER (ORDER BY {sql.priority(SEED, "event_id")} DESC, event_id) AS rk, row_number() OVER (PARTITION BY event_type ORDER BY {sql.priority(SEED, "event_id")} DESC, event_id) AS sk FROM events,
(SELECT count(*) AS n, count(DISTINCT event_type) AS k, avg(value) AS exact FROM events) AS c"""
    u = f"SELECT {f}::DOUBLE AS fraction, 'uniform' AS method, count(*) AS sampled, avg(value) AS estimate, any_value(exact) AS exact FROM ({base}) WHERE rk <= {size}"
    g = f"SELECT event_type, count(*) AS y, sum(value) AS s, any_value(exact) AS exact, any_value({per}) AS cap, any_value(n) AS n FROM ({base}) WHERE sk <= {per} GROUP BY 1"
    o = f"SELECT {f}::DOUBLE, 'oasrs', sum(y)::BIGINT, sum(s * CASE WHEN t.c > cap THEN t.c / cap::DOUBLE ELSE 1 END) / any_value(g.n), any_value(exact) FROM ({g}) AS g JOIN (SELECT event_type, count(*) AS c FROM events GROUP BY 1) AS t ON t.event_type = g.event_type"
    return f"({u}) UNION ALL ({o})"


@query(f"SELECT fraction, method, sampled, round(estimate, 9) AS estimate, round(exact, 9) AS exact, round(100 * abs(estimate - exact) / abs(exact), 9) AS loss FROM ({_sweep(0.1)} UNION ALL {_sweep(0.4)})")
def fraction_sweep(spark, sf_dir):
    return rounded(experiments.fraction_sweep(events(spark, sf_dir), "event_type", "value", "event_id", [0.1, 0.4], SEED), 9)


@query()
def five_methods(spark, sf_dir):
    return rounded(experiments.evaluate(positioned(events(spark, sf_dir), "event_id"), "event_type", "position", "value", "event_id", BUDGET, SEED), 6)


@query()
def heterogeneity_sweep(spark, sf_dir):
    return rounded(experiments.heterogeneity_sweep(spark, 4_000, [1, 100], [SEED], methods=("exact", "oasrs", "dynamic")), 6)


@query()
def population_sweep(spark, sf_dir):
    return rounded(experiments.population_sweep(spark, 4_000, [SEED], ("low", "extreme"), methods=("uniform", "oasrs", "static")), 6)


@query()
def late_strata_stress(spark, sf_dir):
    return experiments.late_strata_stress(spark, 8_000, [SEED], 120, 500, ("oasrs",)).late


@query(f"SELECT event_type AS stratum, round(CASE WHEN count(*) <= {N} THEN count(*) ELSE {N} * (1 + ln((count(*) + 0.5::DOUBLE) / {N + 0.5}::DOUBLE)) END, 4) AS accepted FROM events GROUP BY 1")
def accepted_rows(spark, sf_dir):
    strata = drawn(spark, sf_dir).strata
    return rounded(strata.select("stratum", stats.expected_accepted(F.col("total_seen"), F.col("capacity")).alias("accepted")))


@query("SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rk FROM events) WHERE rk = 1")
def latest_per_stratum(spark, sf_dir):
    return exact.latest(events(spark, sf_dir).select("event_type", "event_id", "user_id", "value"), "event_type", "event_id")


# Records, archives and generators

_ARCHIVE = "SELECT event_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS seq, user_id, ts, value FROM events"


def _archive(spark, sf_dir) -> DataFrame:
    """Sequence numbers with gaps and repeats."""
    return events(spark, sf_dir).select((F.col("event_id") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("seq"), "event_id", "user_id", "ts", "value")


@query(f"""WITH a AS ({_ARCHIVE}), one AS (SELECT DISTINCT seq FROM a) SELECT (SELECT count(*) FROM a) AS rows, count(*) AS distinct_seq, (SELECT count(*) FROM a) - count(*) AS duplicates, max(seq) + 1 - count(*) AS missing_seq FROM one""")
def archive_checks(spark, sf_dir):
    got = exact.archive_checks(_archive(spark, sf_dir), "seq", "user_id", "ts", ["value"])
    return got.select("rows", "distinct_seq", "duplicates", "missing_seq")


@query(f"SELECT seq, max(event_id) AS event_id FROM (SELECT event_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS seq, event_id FROM events) GROUP BY 1")
def dedup_seq(spark, sf_dir):
    return exact.deduplicated(_archive(spark, sf_dir).select("seq", "event_id"), "seq", "event_id")


@query("SELECT event_type AS stratum, count(*) AS \"count\", round(avg(value), 6) AS mean_value, round(avg(user_id), 6) AS mean_user_id FROM events GROUP BY 1")
def field_truth(spark, sf_dir):
    return rounded(exact.field_truth(events(spark, sf_dir), "event_type", ["value", "user_id"]), 6)


@query("SELECT (user_id % 60 + 1)::SMALLINT AS mote_id, count(*) AS rows, round(sum(value), 4) AS temperature FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY 1")
def json_records(spark, sf_dir):
    """Events as JSON messages, some cut off and some without a measure."""
    e = events(spark, sf_dir)
    body = F.to_json(F.struct(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_ts"), (F.col("user_id") % 60 + 1).alias("mote_id"), F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("temperature")))
    good, _ = sensors.parse_messages(e.select(F.when(F.col("event_id") % 11 == 0, F.substring(body, 1, 20)).otherwise(body).alias("value")))
    return rounded(good.groupBy("mote_id").agg(F.count("*").alias("rows"), F.sum("temperature").alias("temperature")))


@query("""SELECT (user_id % 60 + 1)::SMALLINT AS mote_id, count(*) AS rows, round(sum(value), 4) AS temperature, min(epoch_us(ts)) AS first_micros FROM events WHERE event_id % 7 <> 0 AND user_id % 60 + 1 <= 54 GROUP BY 1""")
def parsed_lines(spark, sf_dir):
    """Events as text lines of eight fields, every seventh a field short."""
    e = events(spark, sf_dir)
    parts = [F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss.SSSSSS"), F.col("event_id"), F.col("user_id") % 60 + 1, F.format_string("%.10f", F.col("value")), F.lit("40.5"), F.lit("11.04")]
    line = F.concat_ws(" ", *[p.cast("string") for p in parts], F.when(F.col("event_id") % 7 != 0, F.lit("2.7")))
    got = sensors.parse_lines(e.select(line.alias("value")))
    return rounded(got.groupBy("mote_id").agg(F.count("*").alias("rows"), F.sum("temperature").alias("temperature"), F.min(F.unix_micros("event_ts")).alias("first_micros")))


@query("SELECT event_type AS stratum, count(*) AS rows, round(sum(value), 4) AS \"sum\" FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def flexible_records(spark, sf_dir):
    """Messages that name their fields in either way, and some without a value."""
    e = events(spark, sf_dir)
    first = F.to_json(F.struct(F.col("event_type").alias("mote_id"), F.col("value").alias("temperature")))
    other = F.to_json(F.struct(F.col("event_type").alias("sensor_id"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value")))
    got = sensors.parse_flexible(e.select(F.when((F.col("event_id") % 2 == 0) & (F.col("event_id") % 5 != 0), first).otherwise(other).alias("value")))
    return rounded(got.groupBy("stratum").agg(F.count("*").alias("rows"), F.sum("value").alias("sum")))


@query(f"SELECT floor({sql.uniform('7/v', 'id')} * 10)::BIGINT AS decile, count(*) AS rows, round(sum({sql.uniform('7/v', 'id')} * 20 + 5), 4) AS \"sum\" FROM range(5000) AS r(id) GROUP BY 1")
def synthetic_uniform(spark, sf_dir):
    got = synthetic.uniform_stream(spark, 5000, 5, 25, seed=7)
    return rounded(got.groupBy(F.floor((F.col("value") - 5) / 2).alias("decile")).agg(F.count("*").alias("rows"), F.sum("value").alias("sum")))


def _normal(seed: int, ident: str = "id") -> str:
    return f"(sqrt(-2 * ln(1 - {sql.uniform(f'{seed}/vr', ident)})) * cos({sql.uniform(f'{seed}/va', ident)} * 2 * pi()))"


@query(f"""WITH s AS (SELECT id, {sql.uniform('42/stratum', 'id')} AS p, {_normal(42)} AS z FROM range(10000) AS r(id)), t AS (SELECT CASE WHEN p < 8000 / 10100.0::DOUBLE THEN 'A' WHEN p < 10000 / 10100.0::DOUBLE THEN 'B' ELSE 'C' END AS sensor_id, z FROM s)
SELECT sensor_id, count(*) AS rows, round(avg(CASE sensor_id WHEN 'A' THEN z * 5 + 10 WHEN 'B' THEN z * 50 + 1000 ELSE z * 500 + 10000 END), 4) AS mean FROM t GROUP BY 1""")
def synthetic_gaussian(spark, sf_dir):
    return rounded(synthetic.preset(spark, "gaussian", 10_000).groupBy("sensor_id").agg(F.count("*").alias("rows"), F.avg("value").alias("mean")))


def _large_poisson(rate: float) -> str:
    """A Poisson number of a large rate, from the normal number z."""
    return f"greatest(0, floor(z * sqrt({rate}::DOUBLE) + (z * z - 1) / 6 + {rate + 0.5}::DOUBLE))"


@query(f"""WITH s AS (SELECT id, {sql.uniform('42/stratum', 'id')} AS p, {sql.uniform('42/v', 'id')} AS u, {_normal(42)} AS z FROM range(5000) AS r(id)),
t AS (SELECT id, u, z, CASE WHEN p < 0.8::DOUBLE THEN 'A' WHEN p < 0.9999::DOUBLE THEN 'B' ELSE 'C' END AS sensor_id FROM s),
cdf AS (SELECT sum(exp(-10 + k * ln(10::DOUBLE) - lgamma(k + 1))) OVER (ORDER BY k) AS c FROM range(72) AS q(k)),
a AS (SELECT id, count(c) AS v FROM t LEFT JOIN cdf ON c <= u WHERE sensor_id = 'A' GROUP BY id)
SELECT sensor_id, count(*) AS rows, round(avg(CASE sensor_id WHEN 'A' THEN a.v WHEN 'B' THEN {_large_poisson(1000.0)} ELSE {_large_poisson(1e8)} END), 4) AS mean FROM t LEFT JOIN a ON a.id = t.id GROUP BY 1""")
def synthetic_poisson(spark, sf_dir):
    return rounded(synthetic.preset(spark, "skewed_poisson", 5_000).groupBy("sensor_id").agg(F.count("*").alias("rows"), F.avg("value").alias("mean")))


def _five_strata(kind: str) -> str:
    shares = synthetic.SKEWED if kind in ("population_skew", "combined_skew") else (1,) * 5
    pick = " ".join(f"WHEN p < {sum(shares[: i + 1])} / {sum(shares)}.0::DOUBLE THEN {i + 1}" for i in range(4))
    sd = "CASE WHEN which >= 3 THEN 10.0 ELSE 1.0 END" if kind in ("variance_skew", "combined_skew") else "1.0"
    late = "CASE WHEN id >= 2500 AND which >= 4 THEN 8.0 ELSE 1.0 END" if kind == "distribution_shift" else "1.0"
    return f"""SELECT 'S' || which AS sensor_id, count(*) AS rows, stddev_samp(8 + 2 * which + z * {sd} * {late}) AS sd, '{kind}' AS workload
FROM (SELECT id, z, CASE {pick} ELSE 5 END AS which FROM (SELECT id, {sql.uniform('42/stratum', 'id')} AS p, {_normal(42)} AS z FROM range(5000) AS r(id))) GROUP BY which"""


@query(f"SELECT sensor_id, rows, round(sd, 4) AS sd, workload FROM ({' UNION ALL '.join(map(_five_strata, synthetic.KINDS))})")
def five_strata_workloads(spark, sf_dir):
    parts = [synthetic.five_strata(spark, k, 5_000).groupBy("sensor_id").agg(F.count("*").alias("rows"), F.stddev_samp("value").alias("sd")).withColumn("workload", F.lit(k)) for k in synthetic.KINDS]
    return rounded(reduce(DataFrame.unionAll, parts))


@query(f"""WITH s AS (SELECT id, 1 + floor({sql.uniform('42/stratum', 'id')} * CASE WHEN id >= 4000 THEN 6 WHEN id >= 2000 THEN 5 ELSE 4 END)::INTEGER AS which, {_normal(42)} AS z FROM range(8000) AS r(id))
SELECT 'S' || which AS sensor_id, count(*) AS rows, min(id) + 1 AS first_position, round(avg(10.0 * which + z * [1, 2, 4, 1, 15, 25][which]), 4) AS mean FROM s GROUP BY which""")
def late_strata_rows(spark, sf_dir):
    got = synthetic.late_strata(spark, 8_000).groupBy("sensor_id").agg(F.count("*").alias("rows"), F.min("position").alias("first_position"), F.avg("value").alias("mean"))
    return rounded(got)


@query()
def late_strata_workload(spark, sf_dir):
    rows = synthetic.late_strata(spark, 8_000)
    return rounded(experiments.evaluate(rows, "sensor_id", "position", "value", "id", 120, SEED, interval=500), 6)


@query(f"""WITH {sql.windows(DAY, DAY)}, {sql.window_estimates(5, SEED)} SELECT window_start::VARCHAR || ':' || window_end::VARCHAR AS key, total_seen, num_strata, sample_size AS sampled FROM est""")
def window_messages(spark, sf_dir):
    """Window results with nested strata as JSON, read back."""
    w = windows.windowed(events(spark, sf_dir), "ts", 86_400)
    keys = ["window_start", "window_end"]
    rows = windows.pooled(w, "event_type", "event_id", 5, SEED).select(*keys, "stratum", "event_id", "value")
    parts = w.groupBy(*keys, F.col("event_type").alias("stratum")).agg(F.count("*").alias("count"))
    out = sensors.window_messages(windows.exact_windows(w, "value"), parts, rows)
    schema = "struct<strata: map<string, struct<count: bigint, samples: array<struct<event_id: bigint, value: double>>>>>"
    got = out.select("key", F.from_json("value", schema).alias("r")).select("key", F.map_values("r.strata").alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return got.select("key", total(lambda x: x["count"]).alias("total_seen"), F.size("s").cast("long").alias("num_strata"), total(lambda x: F.size(x["samples"])).alias("sampled"))


# Streams: the driver's events, read as files


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; a single file is found by its name in the folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(f"{sql.sample(N)} SELECT stratum, total_seen, y AS sample_size, round(s, 4) AS sampled_sum FROM st")
def stream_pool(spark, sf_dir):
    """A sample kept by micro-batches is the sample of the table."""
    folder = _shared(spark)
    pool = pools.StreamPool(f"{folder}/pool", "event_type", ["event_id"], N, SEED)
    stream_windows.replay(_stream(spark, sf_dir).select("event_id", "event_type", "value"), pool.merge, f"{folder}/offsets")
    return rounded(estimates.stratum_stats(pool.sample(spark, N), "value").select("stratum", "total_seen", F.col("y").alias("sample_size"), "sampled_sum"))


@query(f"SELECT (epoch_us(ts) // {DAY}::BIGINT) * {DAY}::BIGINT AS window_start, count(*) AS \"count\", round(sum(value), 4) AS \"sum\" FROM events GROUP BY 1")
def stream_windows_update(spark, sf_dir):
    """Daily windows in update mode; the last state of each window is its result."""
    folder = _shared(spark)
    got = stream_windows.exact_windows(stream_windows.timed(_stream(spark, sf_dir), "ts", "event", "1 hour"), "value", "1 day")
    stream_windows.replay(got, lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/out"), f"{folder}/offsets")
    last = spark.read.parquet(f"{folder}/out").groupBy("window_start").agg(F.max_by(F.struct("count", "sum"), "batch").alias("r"))
    return rounded(last.select("window_start", "r.count", "r.sum"))


@query(f"SELECT (epoch_us(ts) // {DAY}::BIGINT) * {DAY}::BIGINT AS window_start, (epoch_us(ts) // {DAY}::BIGINT + 1) * {DAY}::BIGINT AS window_end, count(*) AS \"count\", round(sum(value), 4) AS \"sum\", round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def stream_windows_append(spark, sf_dir):
    """Windows that the watermark has closed, and at the end of the stream those that it has left open."""
    folder = _shared(spark)
    got = stream_windows.exact_windows(stream_windows.timed(_stream(spark, sf_dir), "ts", "event", "1 hour"), "value", "1 day")
    stream_windows.replay(got, lambda df, i: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/offsets", "append")
    rows = events(spark, sf_dir).withColumn("event_time", F.col("ts"))
    return rounded(stream_windows.flushed(rows, spark.read.schema(got.schema).parquet(f"{folder}/out"), "value", "1 day"))


@query("SELECT event_type AS stratum, count(*) AS total_seen, least(count(*), 50)::INTEGER AS sample_size FROM events GROUP BY 1")
def stream_reservoirs(spark, sf_dir):
    folder = _shared(spark)
    got = stateful.reservoirs(_stream(spark, sf_dir), "event_type", "value", 50)
    stream_windows.replay(got, lambda df, i: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/offsets")
    return spark.read.parquet(f"{folder}/out").groupBy("stratum").agg(F.max("total_seen").alias("total_seen"), F.max(F.size("samples")).alias("sample_size"))


@query()
def stream_adaptive_sampler(spark, sf_dir):
    folder = _shared(spark)
    got = stateful.adaptive_sampler(_stream(spark, sf_dir), "event_type", "value", ["event_id"], BUDGET, 500, 1000)
    stream_windows.replay(got, lambda df, i: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/offsets", "append")
    return spark.read.parquet(f"{folder}/out")


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS rows, min(event_id) AS first_seq FROM events GROUP BY 1")
def archive_by_day(spark, sf_dir):
    """Events written as an archive by day, and read back."""
    folder = _shared(spark)
    e = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("ts").alias("event_ts"), (F.col("user_id") % 54 + 1).cast("short").alias("mote_id"), F.col("value").alias("temperature"))
    for f in sensors.ARCHIVE:
        if f.name not in e.columns:
            e = e.withColumn(f.name, F.lit(None).cast(f.dataType))
    sensors.write_archive(e.select(*[f.name for f in sensors.ARCHIVE]), f"{folder}/archive")
    return sensors.read_archive(spark, f"{folder}/archive").groupBy("date").agg(F.count("*").alias("rows"), F.min("seq").alias("first_seq"))


@query("SELECT CASE WHEN event_id % 40 < 30 THEN 2000.0::DOUBLE ELSE 10000.0::DOUBLE END AS rate, count(*) AS rows FROM events GROUP BY 1")
def replay_rates(spark, sf_dir):
    schedule = replay.RateSchedule("2000:30,10000:10")
    return events(spark, sf_dir).select(schedule.column(F.col("event_id").cast("double")).alias("rate")).groupBy("rate").agg(F.count("*").alias("rows"))


@query("SELECT count(DISTINCT event_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS rows FROM events")
def stream_dedup(spark, sf_dir):
    """Rows of a stream with repeated sequence numbers, once each."""
    folder = _shared(spark)
    seq = (F.col("event_id") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("seq")
    rows = stream_windows.timed(_stream(spark, sf_dir).select(seq, "ts"), "ts", "event", "3650 days")
    stream_windows.replay(stream_windows.deduplicated(rows, "seq"), lambda df, i: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/offsets", "append")
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("rows"))


@query("SELECT n * 700 AS window_start, least((n + 1) * 700, (SELECT count(*) FROM events)) AS window_end, least(700, (SELECT count(*) FROM events) - n * 700) AS \"count\" FROM range((SELECT (count(*) + 699) // 700 FROM events)) AS r(n)")
def stream_count_windows(spark, sf_dir):
    """Full windows, and the short one that the stream ends with."""
    folder = _shared(spark)
    got = stateful.count_windows(_stream(spark, sf_dir), "value", 700, partial=True)
    stream_windows.replay(got, lambda df, i: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/offsets")
    return spark.read.schema(got.schema).parquet(f"{folder}/out").groupBy("window_start").agg(F.max("window_end").alias("window_end"), F.max("count").alias("count"))


@query(f"""WITH RECURSIVE {sql.windows(DAY, DAY)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY window_start, stratum ORDER BY {sql.priority(SEED, 'window_start', 'id')} DESC, id) AS rk, count(*) OVER (PARTITION BY window_start, stratum) AS c FROM win),
part AS (SELECT window_start, n, stratum, any_value(c) AS c, count(*) AS y, sum(v) AS s, coalesce(var_samp(v), 0.0) AS s2 FROM ranked JOIN range(2, 101) AS k(n) ON rk <= n GROUP BY ALL),
day AS (SELECT window_start, n, sum(CASE WHEN c > n THEN c / n::DOUBLE ELSE 1 END * s) / sum(c) AS mean, sqrt(sum(CASE WHEN c > y AND y > 1 THEN c::DOUBLE * (c - y) * s2 / y ELSE 0 END)) / sum(c) AS error FROM part GROUP BY ALL),
after AS (SELECT window_start, n, least(100, greatest(2, floor(n * CASE WHEN ratio <= 0.05::DOUBLE THEN 0.9::DOUBLE ELSE least(2.0::DOUBLE, greatest(1.1::DOUBLE, ratio / 0.05::DOUBLE)) END)))::INTEGER AS next
  FROM (SELECT *, CASE WHEN mean <> 0 THEN error / abs(mean) WHEN error > 0 THEN 'inf'::DOUBLE ELSE 0 END AS ratio FROM day)),
days AS (SELECT window_start, row_number() OVER (ORDER BY window_start) AS d FROM (SELECT DISTINCT window_start FROM win)),
steps AS (SELECT d, window_start, 10 AS capacity FROM days WHERE d = 1 UNION ALL SELECT days.d, days.window_start, after.next FROM steps JOIN after ON after.window_start = steps.window_start AND after.n = steps.capacity JOIN days ON days.d = steps.d + 1)
SELECT window_start, capacity FROM steps""")
def capacity_feedback(spark, sf_dir):
    """Capacities of daily windows, each set by the result of the one before."""
    w = windows.windowed(events(spark, sf_dir), "ts", 86_400)
    days = sorted(r.window_start for r in w.select("window_start").distinct().collect())
    feedback = control.CapacityFeedback(control.AdaptiveController(0.05, 2, 100, 0.1), 10)
    for day in days:
        got = windows.estimates(w.where(F.col("window_start") == day), "event_type", "value", "event_id", feedback.capacity, SEED).first()
        feedback.closed({"window_start": day, "estimate": got["mean"], "standard_error": got.mean_variance**0.5})
    return spark.createDataFrame(feedback.log, "window_start long, capacity int")


@query(f"""WITH f AS ({sql.followed('events', 'event_type', 'event_id', 'value', 0.01)}), w AS (SELECT stratum, n, greatest(n * sqrt(greatest(s, 0)), 1e-12::DOUBLE) AS weight FROM f),
p AS (SELECT *, {BUDGET} - count(*) OVER () AS rest, weight / sum(weight) OVER () AS part FROM w), q AS (SELECT *, floor(rest * part) AS whole, rest * part - floor(rest * part) AS fraction FROM p),
r AS (SELECT *, rest - sum(whole) OVER () AS spare, row_number() OVER (ORDER BY fraction DESC, stratum) AS rk FROM q) SELECT stratum, least(n, 1 + whole + CASE WHEN rk <= spare THEN 1 ELSE 0 END)::INTEGER AS capacity FROM r""")
def flink_allocation(spark, sf_dir):
    """The streaming job's variant of an allocation, from counts and followed variances."""
    rows = adaptive.ema_variance(positioned(events(spark, sf_dir), "event_id"), "event_type", "position", "value", 0.01).collect()
    got = adaptive.flink_allocation({r.stratum: r["count"] for r in rows}, {r.stratum: r.ema_variance for r in rows}, BUDGET)
    return spark.createDataFrame(sorted(got.items()), "stratum string, capacity int")


def _shared(spark: SparkSession) -> str:
    """A new folder that the driver and executors share."""
    checkpointed(spark.range(0))  # sets a folder where the session names none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
