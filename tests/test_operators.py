import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.shared import positioned
from tessera.operators import adaptive, allocation, control, estimates, exact, experiments, sampling, windows


def test_hamilton_sums_minimums_caps_and_ties():
    assert allocation.hamilton(10, {"a": 1, "b": 1, "c": 1}) == {"a": 3, "b": 3, "c": 4}
    assert allocation.hamilton(10, {"a": 1, "b": 1, "c": 1}, ascending_ties=True) == {"a": 4, "b": 3, "c": 3}
    assert allocation.hamilton(7, {"a": 0, "b": 0}, 1) == {"a": 3, "b": 4}
    assert allocation.hamilton(10, {"a": 8, "b": 1}, 1, {"a": 3, "b": 20}) == {"a": 3, "b": 7}
    assert allocation.hamilton(10, {"a": 8, "b": 1}, 1, {"a": 3, "b": 2}) == {"a": 3, "b": 2}
    for bad in ((1, {"a": 1, "b": 1}), (-1, {"a": 1}), (5, {"a": 1}, 2, {"a": 1})):
        with pytest.raises(ValueError):
            allocation.hamilton(*bad)


def test_hamilton_table_equals_the_function(spark):
    weights = {"a": 3.0, "b": 7.5, "c": 0.2, "d": 11.0}
    got = allocation.hamilton_table(spark.createDataFrame(list(weights.items()), "stratum string, w double"), "w", 37)
    assert {r.stratum: r.capacity for r in got.collect()} == allocation.hamilton(37, weights)


def plain_hamilton(budget, weights, minimum, caps):
    """The rule round by round: floors as far as caps allow, then one slot each by (fraction, name) from above."""
    weights = {k: max(0.0, w) for k, w in weights.items()}
    got, left = dict.fromkeys(weights, minimum), min(budget, sum(caps.values())) - minimum * len(weights)
    while left > 0:
        free = [k for k in weights if got[k] < caps[k]]
        total, before = sum(weights[k] for k in free), left
        share = {k: before * weights[k] / total if total else before / len(free) for k in free}
        for k in free:
            n = min(caps[k] - got[k], int(share[k]))
            got[k], left = got[k] + n, left - n
        for k in sorted(free, key=lambda k: (share[k] % 1, k), reverse=True):
            if left and got[k] < caps[k]:
                got[k], left = got[k] + 1, left - 1
    return got


def test_capped_allocation_follows_the_rule():
    import random

    assert allocation.hamilton(42, dict(zip("abcd", (34, 13, 38, 35))), 1, dict(zip("abcd", (19, 10, 15, 3)))) == dict(zip("abcd", (16, 8, 15, 3)))
    rng = random.Random(3)
    for _ in range(3000):
        names = "abcdefg"[: rng.randint(1, 7)]
        minimum = rng.randint(0, 2)
        weights = {k: rng.choice([0, -3, rng.randint(1, 40)]) for k in names}
        caps = {k: minimum + rng.randint(0, 20) for k in names}
        budget = minimum * len(names) + rng.randint(0, 60)
        assert allocation.hamilton(budget, weights, minimum, caps) == plain_hamilton(budget, weights, minimum, caps)


def test_hysteresis_gives_and_takes_slot_by_slot():
    import random

    rng = random.Random(5)
    for _ in range(1000):
        names = "abcdef"[: rng.randint(1, 6)]
        most = {k: rng.randint(1, 30) for k in names}
        minimum, step = rng.randint(0, 2), rng.randint(1, 8)
        least = {k: min(minimum, most[k]) for k in names}
        old = {k: rng.randint(0, most[k]) for k in names if rng.random() < 0.8}
        target = {k: rng.randint(least[k], most[k]) for k in names}
        scores = {k: float(rng.randint(0, 3)) for k in names}
        low = {k: min(max(minimum, old[k] - step) if old.get(k) else minimum, most[k]) for k in names}
        high = {k: max(low[k], min(most[k], old[k] + step) if old.get(k) else min(most[k], minimum)) for k in names}
        want = {k: min(max(target[k], low[k]), high[k]) for k in names}
        rank = lambda k: (target[k] - want[k], scores[k], k)  # noqa: B023, E731
        while sum(want.values()) < sum(target.values()) and (free := [k for k in names if want[k] < high[k]]):
            want[max(free, key=rank)] += 1
        while sum(want.values()) > sum(target.values()) and (free := [k for k in names if want[k] > low[k]]):
            want[min(free, key=rank)] -= 1
        assert allocation.hysteresis(old, target, scores, step, least, most) == want
    assert allocation.hysteresis({}, {"a": 5}, {"a": 1.0}, 3, {"a": 0}, {"a": 9}) == {"a": 0}
    assert allocation.hysteresis({}, {"a": 5}, {"a": 1.0}, 3, {"a": 0}, {"a": 9}, newcomers=1) == {"a": 1}


def test_events_are_found_without_a_list_of_them(spark):
    import bisect

    events = [1, 3, 4, 104, 204, 304, 310, 410, 510, 515]
    got = spark.range(1, 516).select("id", adaptive._event_of(F.col("id"), events).alias("e")).collect()
    assert all(r.e == bisect.bisect_left(events, r.id) for r in got)


def test_the_null_stratum_counts_everywhere(spark):
    rows = [(i, None if i % 2 else "a", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, s string, v double")
    got = estimates.estimate_means(sampling.stratified(df, "s", "id", 50), ["v"]).first()
    assert got.estimate == 9.5 and got.degenerate_strata == 0
    timed = df.withColumn("ts", F.col("id").cast("double"))
    window = windows.estimates(windows.windowed(timed, "ts", 100), "s", "v", "id", 50).first()
    assert window.total_seen == 20 and window.num_strata == 2 and window["mean"] == 9.5
    counts, pilots = sampling.totals(df, "s"), allocation.pilot(df, "s", "id", "v", 5)
    assert allocation.policy_weights(counts, pilots, "proportional").count() == 2


def test_budgets_and_controllers_refuse_what_makes_no_sense():
    c = control.AdaptiveController(0.05, 1, 400, 0.1)
    assert c.next_size(1000, 100, 0) == 400 and c.next_size(1000, 100, 50) == 400
    assert control.AdaptiveController().next_size(100, 10, 0) == 50 and control.LinearCost().sample_size(7) == 7
    for bad in (lambda: control.LinearCost().sample_size(-1, 2), lambda: control.LinearCost().sample_size(1, 0), lambda: control.LinearCost(0), lambda: control.AdaptiveController(0),
                lambda: control.AdaptiveController(shrink=0), lambda: c.next_size(0, 1, 1), lambda: c.next_size(5, 1, -1)):
        with pytest.raises(ValueError):
            bad()


def test_conflicting_duplicates_give_the_same_row_whatever_their_order(spark):
    rows = [(i % 7, i % 3, float(i)) for i in range(40)]
    got = [sorted(map(tuple, exact.deduplicated(spark.createDataFrame(r, "seq long, m long, v double").repartition(n)).collect())) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert got[0] == got[1] == sorted(min(r for r in rows if r[0] == k) for k in range(7))


def test_hysteresis_moves_in_steps():
    least, most = {"a": 1, "b": 1}, {"a": 100, "b": 100}
    got = allocation.hysteresis({"a": 50, "b": 50}, {"a": 90, "b": 10}, {"a": 1.0, "b": 1.0}, 10, least, most)
    assert got == {"a": 60, "b": 40}
    assert allocation.hysteresis({"a": 5}, {"a": 50, "b": 50}, {"a": 1.0, "b": 1.0}, 10, least, most) == {"a": 15, "b": 1}


def _one_by_one(rows, budget, interval, alpha, minimum=1, change=0.25):
    """The adaptive sample's schedule and state, a record at a time."""
    counts, mean, var, caps, events, last = {}, {}, {}, {}, [], 0
    for n, (s, x) in enumerate(rows, 1):
        new = s not in counts
        counts[s] = counts.get(s, 0) + 1
        if new:
            mean[s], var[s] = x, 0.0
        else:
            d = x - mean[s]
            mean[s] += alpha * d
            var[s] = (1 - alpha) * (var[s] + alpha * d * d)
        if new or n - last >= interval:
            _, caps, _ = adaptive.reallocate(caps, counts, var, budget, minimum, 1.0, change)
            last = n
            events.append((n, dict(caps)))
    if last != len(rows):
        _, caps, _ = adaptive.reallocate(caps, counts, var, budget, minimum, 1.0, change)
        events.append((len(rows), dict(caps)))
    return events, var


def test_dynamic_equals_one_record_at_a_time(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("abc") if i < 700 else rng.choice("abcd"), rng.gauss(10, 1 if i < 900 else 20)) for i in range(2000)]
    df = spark.createDataFrame([(i + 1, s, x) for i, (s, x) in enumerate(rows)], "position long, s string, v double")
    got = adaptive.dynamic_va(df, "s", "position", "v", "position", 60, 150)
    events, var = _one_by_one(rows, 60, 150, 0.01)
    history = got.history.collect()
    assert [p for p, _ in events] == sorted({r.records_seen for r in history})
    for p, caps in events:
        assert {r.stratum: r.capacity for r in history if r.records_seen == p} == caps
    for r in history:
        if r.records_seen == 2000:
            assert r.ema_variance == pytest.approx(var[r.stratum])
    assert sum(events[-1][1].values()) <= 60 and {r.stratum: r.sample_size for r in got.sample.strata.collect()} == events[-1][1]


def test_dynamic_budget_and_new_strata(spark):
    rows = [(i + 1, "a" if i < 500 else "b", float(i % 7)) for i in range(501)]
    got = adaptive.dynamic_va(spark.createDataFrame(rows, "position long, s string, v double"), "s", "position", "v", "position", 20, 100)
    caps = {r.stratum: r.capacity for r in got.sample.strata.collect()}
    assert caps["b"] >= 1 and sum(caps.values()) <= 20
    with pytest.raises(ValueError, match="budget"):
        adaptive.dynamic_va(spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "position long, s string, v double"), "s", "position", "v", "position", 1)


def test_capacity_follows_a_shift(spark):
    from tessera.sources.synthetic import normal

    df = spark.range(2000).select((F.col("id") + 1).alias("position"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"), (normal(3, "x") * F.when((F.col("id") >= 1000) & (F.col("id") % 2 == 1), 20.0).otherwise(1.0)).alias("v"), "id")
    h = adaptive.dynamic_va(df, "s", "position", "v", "position", 100, 200).history.where("stratum = 'b'").orderBy("event_id").collect()
    before = [r.capacity for r in h if r.records_seen <= 1000][-1]
    assert h[-1].capacity > before


def test_schedule():
    assert adaptive.schedule([1, 4], 5, 12) == [1, 4, 9, 12]
    assert adaptive.schedule([1], 5, 11) == [1, 6, 11]
    assert adaptive.schedule([], 5, 0) == []


def test_ema_in_segments_equals_the_loop(spark, monkeypatch):
    monkeypatch.setattr(adaptive, "SEGMENT", 7)
    rows = [(i + 1, "a" if i % 3 else "b", math.sin(i) * 10) for i in range(100)]
    got = {r.stratum: r for r in adaptive.ema_variance(spark.createDataFrame(rows, "position long, s string, v double"), "s", "position", "v", 0.05).collect()}
    for s in "ab":
        xs = [v for _, t, v in rows if t == s]
        m, w = xs[0], 0.0
        for x in xs[1:]:
            d = x - m
            m += 0.05 * d
            w = 0.95 * (w + 0.05 * d * d)
        assert got[s].ema_mean == pytest.approx(m) and got[s].ema_variance == pytest.approx(w)


def test_static_allocation(spark):
    df = spark.range(400).select((F.col("id") + 1).alias("position"), (F.col("id") % 2).cast("string").alias("s"), (F.col("id") % 13).cast("double").alias("v"))
    s = adaptive.static_va(df, "s", "position", "v", "position", 40, 100)
    assert s.rows.count() == 40 and s.strata.agg(F.sum("capacity")).first()[0] == 40
    late = df.withColumn("s", F.when(F.col("position") > 300, F.lit("late")).otherwise(F.col("s")))
    got = {r.stratum: r for r in adaptive.static_va(late, "s", "position", "v", "position", 40, 100).strata.collect()}
    assert got["late"].capacity == 0 and got["late"].weight == 1.0
    assert estimates.estimate_mean(adaptive.static_va(late, "s", "position", "v", "position", 40, 100), "v").first().degenerate_strata == 1


def test_scores_and_quantiles(spark):
    assert [stats.z_score(x) for x in (0.68, 0.95, 0.997)] == [1.0, 1.96, 3.0]
    assert stats.z_score(0.8) == pytest.approx(1.2816, abs=1e-4) and stats.z_score(0.9545) == pytest.approx(2.0, abs=1e-3) and stats.z_score(z=2.5) == 2.5
    for bad in ({"level": 1.5}, {"level": 0}, {"z": -1}):
        with pytest.raises(ValueError):
            stats.z_score(**bad)
    t = spark.createDataFrame([(1,), (2,), (5,), (31,), (32,)], "n int").select(stats.t_score(F.col("n")).alias("t")).collect()
    assert [r.t for r in t] == [None, 12.706, 2.776, 2.042, 1.96]


def test_errors(spark):
    got = spark.createDataFrame([(90.0, 100.0), (0.0, 0.0), (2.0, 0.0)], "a double, x double").select(stats.relative_error(F.col("a"), F.col("x")).alias("r"), stats.relative_error_eps(F.col("a"), F.col("x")).alias("e")).collect()
    assert [r.r for r in got] == [pytest.approx(0.1), 0.0, float("inf")] and got[2].e == 2e12
    one = spark.range(1).select(F.lit(10.0).alias("estimate"), F.lit(4.0).alias("variance"))
    r = stats.with_interval(one, z=3).first()
    assert (r.lower_bound, r.upper_bound, r.relative_bound) == (4, 16, 0.6)


def test_control(spark):
    assert control.LinearCost(100, 2, 50).sample_size(1, 2) == 50
    c = control.AdaptiveController(0.05, 1, 40, 0.1)
    assert c.next_size(20, 10, 2) == 40 and c.next_size(20, 10, 0.1) == 18 and c.next_size(20, 0, 1) == 40 and c.next_size(1, 5, 0) == 1
    rows = [(20, 10.0, 2.0), (20, 10.0, 0.1), (20, 0.0, 1.0), (30, 7.0, 0.4)]
    got = spark.createDataFrame(rows, "n int, e double, s double").select(c.column(F.col("n"), F.col("e"), F.col("s")).alias("c")).collect()
    assert [r.c for r in got] == [c.next_size(*r) for r in rows]
    f = control.CapacityFeedback(c, 20)
    assert f.replay([{"window_start": 5, "estimate": 10, "standard_error": 0.1}, {"window_start": 0, "estimate": 10, "standard_error": 2}]) == [(0, 20), (5, 40)] and f.capacity == 36
    configs = spark.createDataFrame([(1, 5.0, 0.9), (2, 3.0, 0.95), (3, 3.5, 1.0), (4, 1.0, 0.5)], "cost int, err double, cov double")
    assert sorted(r.cost for r in control.pareto(configs, "cost", "err").collect()) == [1, 2, 4]
    assert control.cheapest(configs, "cost", "err", "cov", 4).first().cost == 2
    assert control.cheapest(configs, "cost", "err", "cov", 0.1).first().cost == 4


def _rows(spark, *pairs):
    return spark.createDataFrame([(i + 1, float(t), float(v), "s") for i, (t, v) in enumerate(pairs)], "position long, ts double, v double, s string")


def _by_start(df, *columns):
    return {r.window_start / 1e6: tuple(r[c] for c in columns) for r in df.collect()}


def test_tumbling_and_sliding_windows(spark):
    df = _rows(spark, (1, 10), (5, 20), (9.5, 30), (10.1, 40), (15, 50))
    got = windows.estimates(windows.windowed(df, "ts", 10), "s", "v", "position", 10)
    assert _by_start(got, "total_seen", "sum", "mean") == {0: (3, 60, 20), 10: (2, 90, 45)}
    df = _rows(spark, (2, 10), (7, 20), (12, 30))
    assert _by_start(windows.exact_windows(windows.windowed(df, "ts", 10, 5), "v"), "sum") == {-5: (10,), 0: (30,), 5: (50,), 10: (30,)}
    assert _by_start(windows.exact_windows(windows.windowed(df, "ts", 10, base=2), "v"), "sum") == {2: (30,), 12: (30,)}
    with pytest.raises(ValueError):
        windows.windowed(df, "ts", 5, 10)


def test_times_that_arent_finite_are_left_out(spark):
    df = _rows(spark, (1, 10), (float("nan"), 20), (float("inf"), 30))
    assert windows.windowed(df, "ts", 10).count() == 1


def test_count_windows_and_virtual_clock(spark):
    df = _rows(spark, *((0, v) for v in range(12)))
    got = windows.exact_windows(windows.count_windowed(df, "position", 5), "v").orderBy("window_start").collect()
    assert [(r.window_start, r.window_end, r["sum"]) for r in got] == [(0, 5, 10), (5, 10, 35), (10, 12, 21)]
    clock = windows.virtual_clock(_rows(spark, *[(9, 1)] * 4), "position")
    assert _by_start(windows.exact_windows(windows.windowed(clock, "timestamp", 3), "v"), "count") == {0: (3,), 3: (1,)}


@pytest.mark.parametrize("block", [1, 2, 100])
def test_late_rows(spark, block):
    df = _rows(spark, (1, 2), (6, 4), (2, 8), (7, 1))
    kept = windows.on_time(windows.windowed(df, "ts", 5), "position", "ts", 0, block)
    assert _by_start(windows.exact_windows(kept, "v"), "count") == {0: (1,), 5: (2,)}
    df = _rows(spark, (1, 1), (12, 3), (3, 5), (20, 7))
    kept = windows.on_time(windows.windowed(df, "ts", 5), "position", "ts", 10, block)
    assert _by_start(windows.exact_windows(kept, "v"), "count", "sum")[0] == (2, 6)


def test_exact_tracking(spark):
    df = _rows(spark, (1, 2), (2, 4), (6, 8))
    got = windows.estimates(windows.windowed(df, "ts", 5), "s", "v", "position", 1, exact=True)
    assert _by_start(got, "exact_sum", "exact_mean", "exact_count", "sample_size")[0] == (6, 3, 2, 1)


def test_positions(spark):
    df = spark.createDataFrame([(v, str(v)) for v in (5, 3, 9, 1, 7)], "k long, t string").repartition(3)
    assert [(r.k, r.position) for r in positioned(df, "k").orderBy("k").collect()] == [(1, 1), (3, 2), (5, 3), (7, 4), (9, 5)]


def test_exact_results(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (1, "a", 3.0), (4, "b", 5.0)], "seq long, s string, v double").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r.stratum: (r["count"], r["sum"], r["mean"]) for r in exact.ground_truth(df, "s", "v").collect()}
    assert got == {"a": (3, 7, pytest.approx(7 / 3)), "b": (1, 5, 5), None: (4, 12, 3)}
    r = exact.archive_checks(df, "seq", "s", "ts", ["v"]).first()
    assert (r.rows, r.distinct_seq, r.duplicates, r.missing_seq, r.sensors, r.least_rows, r.most_rows, r.first_micros, r.last_micros, r.mean_v) == (4, 3, 1, 2, 2, 1, 2, 0, 4_000_000, 3)
    assert exact.ground_truth(df.where("false"), "s", "v").first()["mean"] == 0


def test_summaries(spark):
    rows = [("d", m, s, e) for m, es in (("x", (1, 2, 3, 4, 5)), ("y", (2, 2, 2, 2, 2))) for s, e in enumerate(es)]
    df = spark.createDataFrame([(d, m, s, float(e)) for d, m, s, e in rows], "d string, m string, seed int, e double")
    got = {r.m: r for r in experiments.summary(df, ["d", "m"], "e").collect()}
    assert got["x"].mean_error == 3 and got["x"].high == pytest.approx(3 + 2.776 * math.sqrt(2.5) / math.sqrt(5)) and got["y"].low == got["y"].high == 2
    p = experiments.paired_difference(df, ["d"], "seed", "m", "e", "x").first()
    assert (p.pairs, p.mean_difference) == (5, 1)
    assert {r.m: r.median_error for r in experiments.median_error(df, ["m"], "e").collect()} == {"x": 3, "y": 2}


def test_evaluation_and_measures(spark):
    from tessera.sources.synthetic import late_strata

    got = {r.method: r for r in experiments.evaluate(late_strata(spark, 3000), "sensor_id", "position", "value", "id", 60, interval=300).collect()}
    assert set(got) == set(experiments.METHODS) and got["exact"].relative_error == 0 and got["dynamic"].sampled <= 60
    assert got["static"].relative_error > got["dynamic"].relative_error
    m = experiments.measured("x", 10, lambda: None)
    assert m.records == 10 and m.row()["rate"] > 0


def test_sweeps_name_their_cases(spark):
    got = experiments.workload_sweep(spark, 600, [20, 40], [1], ("uniform", "distribution_shift"), 100, ("exact", "oasrs")).collect()
    assert {(r.dataset, r.budget, r.method) for r in got} == {(d, b, m) for d in ("uniform", "distribution_shift") for b in (20, 40) for m in ("exact", "oasrs")}
    assert all(r.sampled <= r.budget for r in got if r.method == "oasrs") and all(r.relative_error < 1e-9 for r in got if r.method == "exact")
    assert {r.ratio for r in experiments.heterogeneity_sweep(spark, 300, [1, 9], [1], 20, 100, ("oasrs",)).collect()} == {1.0, 9.0}
    assert {r.skew for r in experiments.population_sweep(spark, 300, [1], ("low", "high"), 20, 100, ("oasrs",)).collect()} == {"low", "high"}


def test_late_strata_get_their_share(spark):
    got = experiments.late_strata_stress(spark, 4000, [1], 60, 250, ("static", "dynamic"))
    late = {r.stratum: r for r in got.late.collect()}
    assert set(late) == {"S5", "S6"} and all(r.capacity > 0 for r in late.values()) and late["S5"].first_sampled > 1000 and late["S6"].first_sampled > 2000
    assert {r.method: r.relative_error for r in got.results.collect()}.keys() == {"static", "dynamic"}
    assert got.first.count() == 6 and got.allocations.where("stratum = 'S6' and records_seen < 2000").count() == 0


def test_accepted_rows_are_as_many_as_a_reservoir_takes(spark):
    n = 10 + sum(10 / i for i in range(11, 5001))
    got = spark.createDataFrame([(5000, 10), (7, 10), (9, 0)], "c long, n int").select(stats.expected_accepted(F.col("c"), F.col("n")).alias("x")).collect()
    assert got[0].x == pytest.approx(n, rel=1e-3) and got[1].x == 7 and got[2].x == 0
