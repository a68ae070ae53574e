"""Priorities that decide which rows are sampled: hashes of seed and record id.

They depend on nothing else, so that a sample is the same for any partitioning, and a replay repeats it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _text(c: ColumnLike) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def priority(seed: int | str, *ids: ColumnLike) -> Column:
    """A text whose order is random; larger ones are sampled first. ids: what tells a record from all others."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *map(_text, ids)))


def uniform(seed: int | str, *ids: ColumnLike) -> Column:
    """A number in [0, 1), from the first 52 bits of the priority."""
    return F.conv(F.substring(priority(seed, *ids), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def derived_seed(seed: int | str, *parts: ColumnLike) -> Column:
    """A seed for each stratum or window: the priority of its name."""
    return priority(seed, *parts)
