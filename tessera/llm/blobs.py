"""Columns of numbers moved as compressed blobs: one row for each batch and target instead of one row for each number."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_KINDS = ["<u8", "<i8", "<u4", "<i4", "<u2", "u1"]


def pack(columns: list[np.ndarray]) -> bytes:
    parts = [struct.pack("<H", len(columns))]
    for x in columns:
        x = np.ascontiguousarray(x)
        parts += [struct.pack("<BQ", _KINDS.index(x.dtype.str.replace("|", "")), x.nbytes), x.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<H", raw), 2, []
    for _ in range(n):
        kind, size = struct.unpack_from("<BQ", raw, at)
        out.append(np.frombuffer(raw, _KINDS[kind], size // np.dtype(_KINDS[kind]).itemsize, at + 9))
        at += 9 + size
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(starts.dtype), lengths)
    out += np.arange(total, dtype=starts.dtype)
    return out


def split_by(block: np.ndarray):
    """Each different number with the places where it stands."""
    order = np.argsort(block, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        if len(some):
            yield int(block[some[0]]), some
