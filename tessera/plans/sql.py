"""Pieces of SQL that the queries' equivalents are put together from."""

from __future__ import annotations


def priority(seed: int, *ids: str) -> str:
    return "md5('" + str(seed) + "' || " + " || ".join(f"':' || ({i})::VARCHAR" for i in ids) + ")"


def uniform(seed: str, id_: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || ({id_})::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def source(table: str = "events", stratum: str = "event_type", ident: str = "event_id", value: str = "value") -> str:
    return f"src AS (SELECT ({stratum})::VARCHAR AS stratum, {ident} AS id, ({value})::DOUBLE AS v FROM {table})"


def sample(n: int = 100, seed: int = 42, **names: str) -> str:
    """src, tot (stratum, total_seen), smp (stratum, id, v) and st (a stratum's counts, sampled sum, mean, variance, weight)."""
    return f"""WITH {source(**names)},
tot AS (SELECT stratum, count(*) AS total_seen FROM src GROUP BY stratum),
smp AS (SELECT stratum, id, v FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {priority(seed, "id")} DESC, id) AS rk FROM src) WHERE rk <= {n}),
st AS (SELECT tot.stratum, total_seen, y, s, m, s2, CASE WHEN total_seen > {n} THEN total_seen / {n}::DOUBLE ELSE 1.0::DOUBLE END AS w,
  CASE WHEN total_seen <= y OR y <= 1 THEN 0.0::DOUBLE ELSE total_seen::DOUBLE * (total_seen - y) * s2 / y END AS term
  FROM tot JOIN (SELECT stratum, count(*) AS y, sum(v) AS s, avg(v) AS m, coalesce(var_samp(v), 0.0) AS s2 FROM smp GROUP BY stratum) AS agg ON agg.stratum = tot.stratum)"""


def hamilton(weights: str, budget: int, minimum: int = 1) -> str:
    """sh (stratum, weight, capacity) from a table expression of stratum and weight."""
    return f"""wt AS ({weights}),
s1 AS (SELECT stratum, weight, ({budget} - count(*) OVER () * {minimum}) AS rest, sum(weight) OVER () AS total, count(*) OVER () AS k FROM wt),
s2 AS (SELECT stratum, weight, rest, rest * CASE WHEN total > 0 THEN weight / total ELSE 1.0::DOUBLE / k END AS share FROM s1),
s3 AS (SELECT stratum, weight, rest, floor(share)::BIGINT AS whole, round(share - floor(share), 9) AS fraction FROM s2),
s4 AS (SELECT stratum, weight, whole, rest - sum(whole) OVER () AS spare, row_number() OVER (ORDER BY fraction DESC, stratum DESC) AS rk FROM s3),
sh AS (SELECT stratum, weight, ({minimum} + whole + CASE WHEN rk <= spare THEN 1 ELSE 0 END)::INTEGER AS capacity FROM s4)"""


def capped_hamilton(strata: str, budget: int, minimum: int = 1) -> str:
    """dealt (stratum, got) from a table expression of stratum, weight and cap: a row of the recursion for each round."""
    return f"""WITH RECURSIVE capped AS ({strata}), r AS (SELECT 0 AS turn, stratum, weight, cap, {minimum}::BIGINT AS got FROM capped UNION ALL
SELECT turn + 1, stratum, weight, cap, got + whole + CASE WHEN got + whole < cap AND row_number() OVER (ORDER BY got + whole < cap DESC, fraction DESC, stratum DESC) <= rest - sum(whole) OVER () THEN 1 ELSE 0 END
FROM (SELECT *, least(cap - got, floor(share)::BIGINT) AS whole, share - floor(share) AS fraction
  FROM (SELECT *, CASE WHEN got >= cap THEN 0.0::DOUBLE WHEN sum(CASE WHEN got < cap THEN weight ELSE 0 END) OVER () > 0 THEN rest * weight / sum(CASE WHEN got < cap THEN weight ELSE 0 END) OVER () ELSE rest / sum(CASE WHEN got < cap THEN 1.0::DOUBLE ELSE 0 END) OVER () END AS share
    FROM (SELECT *, least({budget}, sum(cap) OVER ())::BIGINT - (sum(got) OVER ())::BIGINT AS rest FROM r) WHERE rest > 0))),
dealt AS (SELECT stratum, got FROM r WHERE turn = (SELECT max(turn) FROM r))"""


def followed(table: str, stratum: str, ident: str, value: str, alpha: float) -> str:
    """stratum, n rows, and the exponentially weighted mean m and variance s after the last, row by row."""
    keep, step = f"{1 - alpha}::DOUBLE", f"{alpha}::DOUBLE"
    moved = f"{{'n': a.n + 1, 'm': a.m + {step} * (x.m - a.m), 's': {keep} * (a.s + {step} * (x.m - a.m) * (x.m - a.m))}}"
    return f"""SELECT stratum, e.n AS n, e.m AS m, e.s AS s FROM (SELECT ({stratum})::VARCHAR AS stratum,
list_reduce(list({{'n': 1::BIGINT, 'm': ({value})::DOUBLE, 's': 0.0::DOUBLE}} ORDER BY {ident}), lambda a, x: {moved}) AS e FROM {table} GROUP BY 1)"""


def windows(size: int, slide: int, base: int = 0, table: str = "events") -> str:
    """win: a row for each window (microseconds) that covers an event."""
    return f"""win AS (SELECT w.ws AS window_start, w.ws + {size}::BIGINT AS window_end, event_id AS id, event_type AS stratum, value::DOUBLE AS v FROM
  (SELECT *, unnest(list_transform(range(0, {size // slide}), lambda k: ((epoch_us(ts) - {base}::BIGINT) // {slide}::BIGINT) * {slide}::BIGINT + {base}::BIGINT - k * {slide}::BIGINT)) AS ws FROM {table}) AS w)"""


def window_estimates(n: int, seed: int = 42, exact: bool = False) -> str:
    more = ", sum(a) AS exact_sum, sum(a) / sum(c) AS exact_mean, sum(c)::BIGINT AS exact_count" if exact else ""
    return f"""seen AS (SELECT window_start, window_end, stratum, count(*) AS c, sum(v) AS a FROM win GROUP BY ALL),
drawn AS (SELECT window_start, window_end, stratum, count(*) AS y, sum(v) AS s, coalesce(var_samp(v), 0.0) AS s2 FROM
  (SELECT *, row_number() OVER (PARTITION BY window_start, window_end, stratum ORDER BY {priority(seed, "window_start", "id")} DESC, id) AS rk FROM win) WHERE rk <= {n} GROUP BY ALL),
parts AS (SELECT seen.window_start, seen.window_end, c, a, y, s, CASE WHEN c > {n} THEN c / {n}::DOUBLE ELSE 1.0::DOUBLE END AS w,
  CASE WHEN c > y AND y > 1 THEN c::DOUBLE * (c - y) * s2 / y ELSE 0.0 END AS term FROM seen JOIN drawn ON seen.window_start = drawn.window_start AND seen.window_end = drawn.window_end AND seen.stratum = drawn.stratum),
est AS (SELECT window_start, window_end, sum(c)::BIGINT AS total_seen, sum(y)::BIGINT AS sample_size, count(*) AS num_strata, sum(w * y) AS "count", sum(w * s) AS "sum", sum(term) AS sum_variance{more} FROM parts GROUP BY window_start, window_end)"""
