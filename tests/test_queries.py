"""Every query with SQL gives the SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else float(f"{x:.9g}")
        return None if x is None else x if isinstance(x, (bool, int, str)) else str(x)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, tables, tiny, name):
    got = entry.queries()[name](spark, tiny)
    names = got.columns
    result = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(names) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], names) == plain(result.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_feedback_and_followed_variances_cover_all_events(spark, tmp_path):
    """Over 14 days and 300 users: a window for each day, and each stratum's variance as a loop over its rows gives it."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=i), i % 300, "abc"[i * i % 3], float(i * 37 % 101)) for i in range(14 * 24)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    log = entry.queries()["capacity_feedback"](spark, str(tmp_path)).collect()
    assert len({r.window_start for r in log}) == len(log) == 14
    got = {r.stratum: r for r in entry.queries()["ema_variance"](spark, str(tmp_path)).collect()}
    for kind in {r[3] for r in rows}:
        values = [r[4] for r in rows if r[3] == kind]
        m, s = values[0], 0.0
        for v in values[1:]:
            d = v - m
            m, s = m + 0.01 * d, 0.99 * (s + 0.01 * d * d)
        assert got[kind]["count"] == len(values)
        assert got[kind].ema_mean == pytest.approx(m, abs=1e-6) and got[kind].ema_variance == pytest.approx(s, abs=1e-4)
