"""Lexical retrieval packing: windows filled with a seed document and its BM25 neighbours that are still unused.

Texts are tokenised once and written out. What is left of each document after its full windows is dealt to shards by
the least hash of its terms, so that texts with terms in common tend to meet, and range bounds over that hash and the
id keep shards even, whatever the terms. A shard takes its documents in blocks; each block has an inverted index with
BM25 weights from counts over all documents. The longest unused document is a seed; the neighbours that its terms
retrieve fill its window, best first, and the last one is cut to fit. What a block can't fill goes to the next block, so
that a shard has one padded window at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import ranges
from .common import checkpointed, chunks, kept_for, mix, partitions
from .tokens import default_path, word_tokens

LENGTH, END = 2048, 1
#: Tokens of a block, and the least that a shard is for: a shard has no more than one window that isn't full.
BLOCK_TOKENS, SHARD_TOKENS = 2_000_000, 1_000_000
#: Neighbours that are looked at together: the next ones come when all of these are used.
NEIGHBOURS = 64
#: An id that one in so many documents of a block has lies in a table, not in postings. Speed depends on it, results don't.
DENSE = 10
_K1, _B = 1.2, 0.75
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """A row for each row of docs: doc_id, n (ids and the end), key (least hash of its ids), ids (deflated, 16 bits each).

    And rows with a null n: ids then holds, for some documents, the number of them that have each id.
    """

    def run(batches):
        tokens = word_tokens(path)
        press = zstandard.ZstdCompressor(level=1)
        order = mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(1)
        counts, place, n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

        def last_place(x):
            """Where each different id stands last."""
            at = np.arange(len(x))
            place[x] = at
            return place[x] == at

        for batch in batches:
            ids, sizes, keys, blobs = batch["doc_id"], [], [], []
            for texts in chunks([x or "" for x in batch["text"].to_pylist()], 8_000_000):
                for x in tokens.encode(texts):
                    x = np.append(x, np.uint16(END))
                    counts[x[last_place(x)]] += 1
                    n += 1
                    sizes.append(len(x))
                    keys.append(int(order[x[:-1]].min()) if len(x) > 1 else 0)
                    blobs.append(press.compress(x.tobytes()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n", "key", "ids"])
        if n:
            blob = press.compress(counts.tobytes())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())], ["doc_id", "n", "key", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key long, ids binary")


def _frequencies(written: DataFrame) -> np.ndarray:
    """Documents that have each id: at most 2**16 numbers, summed up by the executors."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for blob in batch["ids"].to_pylist():
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    parts = written.where("n is null").select("ids").mapInArrow(run, "id long, n long")
    got = parts.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


class _Left:
    """What is left of a document: its ids from ``start`` on, and the terms of the whole."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id, ids, start):
        self.doc_id, self.ids, self.start, self.total = doc_id, ids, start, len(ids)

    def __len__(self):
        return self.total - self.start


class _Index:
    """The inverted index of a block: BM25 weights of all its documents for each id.

    Ids that one in DENSE documents of the block has or more are rows of a table, the others have postings.
    """

    def __init__(self, block: list[_Left], weights: np.ndarray, mean: float):
        sizes = np.array([x.total for x in block])
        ids = np.concatenate([x.ids for x in block])
        which = np.repeat(np.arange(len(block)), sizes)
        some = weights[ids] > 0
        key, tf = np.unique(ids[some].astype(np.int64) * len(block) + which[some], return_counts=True)
        term, doc = key // len(block), key % len(block)
        weight = (weights[term] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * sizes[doc] / mean))).astype(np.float32)
        by_doc = np.argsort(doc, kind="stable")
        self.terms, self.own = term[by_doc], np.searchsorted(doc[by_doc], np.arange(len(block) + 1))
        common = np.flatnonzero(np.bincount(term, minlength=1 << 16) * DENSE >= len(block))
        self.line = np.full(1 << 16, -1)
        self.line[common] = np.arange(len(common))
        at = self.line[term]
        self.rows, self.table = np.arange(len(block)), np.zeros((len(common), len(block)), np.float32)
        self.table[at[at >= 0], doc[at >= 0]] = weight[at >= 0]
        self.begin = np.searchsorted(term[at < 0], np.arange((1 << 16) + 1))
        self.doc, self.weight, self.size = doc[at < 0], weight[at < 0], len(block)

    def scores(self, i: int) -> np.ndarray:
        """BM25 of each document of the block for all terms of document i, each asked for once."""
        terms = self.terms[self.own[i] : self.own[i + 1]]
        line, out = self.line[terms], np.zeros(self.size)
        out[self.rows] = self.table[line[line >= 0]].sum(axis=0)
        rare = terms[line < 0]
        at = ranges(self.begin[rare], self.begin[rare + 1] - self.begin[rare])
        return out + np.bincount(self.doc[at], self.weight[at], self.size)

    def without(self, used: np.ndarray) -> None:
        """Used documents leave the index."""
        keep = ~used[self.doc]
        self.begin, self.doc, self.weight = np.append(0, np.cumsum(keep))[self.begin], self.doc[keep], self.weight[keep]
        stay = ~used[self.rows]
        self.rows, self.table = self.rows[stay], self.table[:, stay]


class _Packer:
    def __init__(self, shard: int, weights: np.ndarray, mean: float, length: int):
        self.weights, self.mean, self.length = weights, mean, length
        self.sequence = shard << 32
        self.out: list[tuple] = []

    def piece(self, left: _Left, size: int, offset: int) -> None:
        ids = left.ids[left.start : left.start + size].astype("<u4").tobytes()
        self.out.append((left.doc_id, left.start, size, zlib.crc32(ids), left.total, self.sequence, offset))
        left.start += size

    def full(self, left: _Left) -> None:
        """Takes the full windows off the front of a document."""
        while len(left) >= self.length:
            self.piece(left, self.length, 0)
            self.sequence += 1

    def pack(self, block: list[_Left], last: bool) -> list[_Left]:
        """Fills windows while there are ids for one; gives back the rest, or at the end pads one window with it."""
        index = _Index(block, self.weights, self.mean)
        sizes = np.array([len(x) for x in block])
        total = int(sizes.sum())
        queue = list(np.lexsort((np.arange(len(block)), -sizes))[::-1])
        spare, shortest = 0, list(queue)  # for windows that retrieval leaves open
        indexed = len(block)
        while total >= self.length or last and total:
            while not sizes[queue[-1]]:
                queue.pop()
            seed = queue[-1]
            offset = self._put(block, sizes, seed, 0)
            if (unused := np.count_nonzero(sizes)) < indexed * 0.7:
                indexed = unused
                index.without(sizes == 0)
            if offset < self.length:
                score = index.scores(seed)
                score[sizes == 0] = 0
                while offset < self.length:
                    near = np.argpartition(-score, min(NEIGHBOURS, len(score) - 1))[:NEIGHBOURS]
                    near = near[score[near] > 0]
                    if not len(near):
                        break
                    near = near[np.lexsort((near, -score[near]))]
                    for i in near:  # whole neighbours that fit, best first
                        if sizes[i] and sizes[i] <= self.length - offset:
                            offset = self._put(block, sizes, i, offset)
                    for i in near:  # then the best that is left, cut to fit
                        if sizes[i] and offset < self.length:
                            offset = self._put(block, sizes, i, offset)
                    score[near] = 0
            while offset < self.length and spare < len(shortest):
                if sizes[shortest[spare]]:
                    offset = self._put(block, sizes, shortest[spare], offset)
                else:
                    spare += 1
            total -= offset
            self.sequence += 1
        return [x for x in block if len(x)]

    def _put(self, block, sizes, i, offset) -> int:
        size = min(int(sizes[i]), self.length - offset)
        self.piece(block[i], size, offset)
        sizes[i] -= size
        return offset + size

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.out, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])
            self.out = []


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is its ids by the vocabulary at ``path``, then id 1; a null or empty text is id 1 alone. Each id lies in
    exactly one piece, pieces stand in a sequence without gaps from offset 0, and all sequences but one of each shard
    have exactly ``length`` ids. Rows that repeat an id, or whose id is null, are documents of their own. Other columns
    are passed over. Empty docs give no rows.
    """
    path = path or default_path()
    written = checkpointed(tokenized(docs, path))
    texts = written.where("n is not null")
    totals = texts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids")).first()
    df = _frequencies(written)
    weights = np.log1p((totals.docs - df + 0.5) / (df + 0.5))
    weights[df == 0] = 0
    weights[END] = 0
    mean = totals.ids / max(totals.docs, 1)
    shards = int(max(1, min(partitions(docs.sparkSession), totals.ids // SHARD_TOKENS)))

    def run(batches):
        kept_for("packing")
        packer = _Packer(TaskContext.get().partitionId(), weights, mean, length)
        press = zstandard.ZstdDecompressor()
        block, size = [], 0
        for batch in batches:
            for doc_id, blob in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                left = _Left(doc_id, np.frombuffer(press.decompress(blob), np.uint16), 0)
                packer.full(left)
                if len(left):
                    block.append(left)
                    size += left.total
                if size > BLOCK_TOKENS:
                    block = packer.pack(block, False)
                    size = sum(x.total for x in block)
                    yield from packer.batch()
                elif len(packer.out) > 50_000:
                    yield from packer.batch()
        if block:
            packer.pack(block, True)
        yield from packer.batch()

    dealt = texts.repartitionByRange(shards, "key", "doc_id", "n").sortWithinPartitions("key", "doc_id", "n", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(run, _PIECES)
