"""First occurrences in range-partitioned order: rows of a key stand together, sorted, and are streamed once.

A key with very many rows spans several partitions, since the range bounds run over the key and the rank. Each
partition then tells the driver about its first and its last key alone, so that the driver gets two rows per
partition whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import checkpointed, partitions

_COLUMNS = ["h1", "h2", "rank"]


def ranked(rows: DataFrame) -> DataFrame:
    """rows (h1, h2, rank, row, at: all long), dealt by range and sorted by key, rank, row and position; written out."""
    order = ["h1", "h2", "rank", "row", "at"]
    n = partitions(rows.sparkSession)
    return checkpointed(rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order))


def _edges_of(batches):
    """The first and the last key of this partition: rank of its first row, of its last row, and number of ranks."""
    first = last = None
    for batch in batches:
        h1, h2, rank = (batch[c].to_numpy() for c in _COLUMNS)
        if not len(h1):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        ends = np.append(starts[1:], len(h1))
        for i in sorted({0, len(starts) - 1}):
            piece = rank[starts[i] : ends[i]]
            run = [int(h1[starts[i]]), int(h2[starts[i]]), int(piece[0]), int(piece[-1]), int(1 + (piece[1:] != piece[:-1]).sum())]
            if last is not None and last[:2] == run[:2]:
                last[4] += run[4] - (last[3] == run[2])
                last[3] = run[3]
            else:
                last = run
                first = first or run
    if first is not None:
        p = TaskContext.get().partitionId()
        runs = [first] if first is last else [first, last]
        yield pa.RecordBatch.from_pylist([dict(zip(_EDGE.names, [p, i, *r], strict=True)) for i, r in enumerate(runs)], schema=_EDGE)


_EDGE = pa.schema([(c, pa.int64()) for c in ("p", "i", "h1", "h2", "a", "b", "n")])


def edges(sorted_rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Keys that touch a partition's border: the rank of their first row, and their number of ranks, over all partitions."""
    schema = ", ".join(f"{f.name} long" for f in _EDGE)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    last = None
    for r in sorted(sorted_rows.select(*_COLUMNS).mapInArrow(_edges_of, schema).collect(), key=lambda r: (r.p, r.i)):
        key = (r.h1, r.h2)
        if key in out:
            first, n = out[key]
            out[key] = first, n + r.n - (last == (key, r.a))
        else:
            out[key] = r.a, r.n
        last = key, r.b
    return out


def later(sorted_rows: DataFrame, least: int) -> DataFrame:
    """(rank, row, at) of rows that aren't of their key's first rank, for keys with at least ``least`` ranks."""
    known = edges(sorted_rows)

    def run(batches):
        key, first, last, n, held = None, 0, 0, 0, []
        for batch in batches:
            h1, h2, rank, row, at = (batch[c].to_numpy() for c in ("h1", "h2", "rank", "row", "at"))
            if not len(h1):
                continue
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = key != (int(h1[0]), int(h2[0]))
            ranks = new.copy()
            ranks[1:] |= rank[1:] != rank[:-1]
            ranks[0] |= last != rank[0]
            run_of = np.cumsum(new)  # 0 is the run that the batch before has begun
            starts = np.flatnonzero(new)
            firsts = np.concatenate([[first], rank[starts]])
            counts = np.bincount(run_of, ranks, len(starts) + 1).astype(np.int64)
            counts[0] += n
            for i, s in ((0, None), (1, starts[0] if len(starts) else None), (len(starts), starts[-1] if len(starts) else None)):
                k = key if i == 0 else (int(h1[s]), int(h2[s])) if s is not None else None
                if k in known:
                    firsts[i], counts[i] = known[k]
            if counts[0] >= least:
                yield from held
                held = []
            elif len(starts):
                held = []
            here = (rank != firsts[run_of]) & (counts[run_of] >= least)
            if here.any():
                yield _out(rank[here], row[here], at[here])
            i = len(starts)
            if counts[i] < least:
                wait = (run_of == i) & (rank != firsts[i])
                if wait.any():
                    held.append(_out(rank[wait], row[wait], at[wait]))
            key, first, last, n = (int(h1[-1]), int(h2[-1])), firsts[i], rank[-1], counts[i]

    return sorted_rows.mapInArrow(run, "rank long, row long, at long")


def _out(rank, row, at):
    return pa.RecordBatch.from_arrays([pa.array(rank), pa.array(row), pa.array(at)], ["rank", "row", "at"])
