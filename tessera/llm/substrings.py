"""Substring de-duplication by relative Lempel-Ziv parsing against reference blocks.

Every window of ``window`` words has an anchor, the k-gram with the least hash in it (k = 5). A phrase is a run of
windows with the same anchor, that is, the stretch of text around one anchor. The corpus' phrases, dealt by anchor,
are the reference blocks, and the anchors are their index. A document is parsed greedily, phrase by phrase, each
against the one block that can hold it: the longest run of a phrase's windows that an earlier document has becomes a
factor. A window that crosses from one factor into the next is a window of either phrase, so that factors are checked
at their borders, and no shared window is missed. Only phrases are moved, as blobs; no pairs of documents arise.

A window is known by its anchor's 64-bit hash, the anchor's place in it, and 40 bits of a hash of its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack, ranges, split_by, unpack
from .common import Words, chunks, hash64, id_back, id_key, mix, partitions

WINDOW = 13
_K = 5
_CHUNK = 4_000_000
#: Bytes of text whose phrases make a block, about: a task holds one block, however large the corpus is.
BLOCK_BYTES = 64 << 20
_WINDOW_BYTES = 5
_PLACE_BITS = np.uint64(24)
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0x6A09E667F3BCC909 << i) & (1 << 64) - 1 | 1 for i in range(64)], np.uint64)


def _word_rows(word: bytes) -> tuple[int, int]:
    return hash64(word), hash64(b"\x00" + word)


def _sums(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total += hashes[i : i + size] * _ODD[i]
    return mix(total)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = n - width
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


def phrases(hashes: np.ndarray, docs: np.ndarray, window: int):
    """anchor, document, first window and number of windows of each phrase, where its anchor stands, and all windows' hashes.

    hashes: two for each word of a few documents; docs: the document that a word is in.
    """
    size = len(hashes) - window + 1
    if size <= 0:
        return tuple(np.zeros(0, np.uint64) for _ in range(6))
    grams = _sums(hashes[:, 0], _K)
    mask = np.uint64((1 << int(_PLACE_BITS)) - 1)
    places = np.arange(len(grams), dtype=np.uint64) & mask
    least = _sliding_min(mix(grams) & ~mask | places, window - _K + 1)
    start = np.arange(size)
    anchor = start + ((least - start.astype(np.uint64)) & mask).astype(np.int64)
    inside = docs[:size] == docs[window - 1 :]
    start, anchor = start[inside], anchor[inside]
    if not len(start):
        return tuple(np.zeros(0, np.uint64) for _ in range(6))
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(start)))
    whole = _sums(hashes[:, 1], window)[start]
    at = start[first]
    return grams[anchor[first]], docs[at], at, length, anchor[first] - at, whole


def _parse(keyed: DataFrame, window: int, n: int) -> DataFrame:
    """block, blob: the phrases of each batch of documents, by the block that they belong to.

    Of equal phrases in a batch, only that of the least document is sent: the windows of the others are known to repeat.
    Their places go past the blocks, as block n and on, to where their documents' factors meet: so a passage that most
    documents hold gives its block one phrase for each batch.
    """

    def run(batches):
        words = Words(_word_rows, 2)
        for batch in batches:
            docs, rows = batch["doc"].to_numpy(), batch["row"].to_numpy()
            at = 0
            for texts in chunks(batch["text"].to_pylist(), _CHUNK):
                split = [x.split() for x in texts]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                which = np.repeat(np.arange(len(split)), sizes)
                begins = np.cumsum(sizes) - sizes
                anchors, doc, start, length, place, whole = phrases(words.hashes([w for s in split for w in s]), which, window)
                ids, row = docs[at : at + len(split)], rows[at : at + len(split)]
                at += len(split)
                if not len(anchors):
                    continue
                doc = doc.astype(np.int64)
                start = start - begins[doc]
                firsts = np.cumsum(length) - length
                content = mix(anchors + _run_sums(mix(whole), length) + (place * 64 + length).astype(np.uint64))
                order = np.lexsort((start, ids[doc], content))
                same = np.concatenate([[False], content[order][1:] == content[order][:-1]])
                least = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                copies = same & (ids[doc[order]] > ids[doc[order]][least])
                repeated = np.zeros(len(anchors), bool)
                repeated[order[copies]] = True
                block = (anchors % np.uint64(n)).astype(np.int64)
                whole = (whole >> np.uint64(64 - 8 * _WINDOW_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WINDOW_BYTES]
                out = []
                for b, some in split_by(block):
                    some = some[~repeated[some]]
                    if len(some):
                        used, number = np.unique(doc[some], return_inverse=True)
                        columns = [ids[used].astype("<i8"), row[used].astype("<i8"), number.astype("<u4"), start[some].astype("<u4"), length[some].astype("u1")]
                        out.append((b, pack([*columns, anchors[some].astype("<u8"), place[some].astype("u1"), whole[ranges(firsts[some], length[some])].ravel()])))
                out += [(n + part, blob) for part, blob in _by_part(doc[repeated], start[repeated], length[repeated], ids, row, n)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["block", "blob"])

    return keyed.mapInArrow(run, "block int, blob binary")


def _run_sums(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of hashes, each weighted by its place, over consecutive runs."""
    weight = _ODD[ranges(np.zeros(len(length), np.int64), length) % len(_ODD)]
    return np.add.reduceat(x * weight, np.cumsum(length) - length)


def _factor(parsed: DataFrame, n: int) -> DataFrame:
    """part, blob: places of windows that an earlier document has, by a part of the documents.

    One task holds one block, whose size spans() bounds.
    """

    def run(batches):
        blobs = []
        for batch in batches:
            past = [(b - n, x) for b, x in zip(batch["block"].to_pylist(), batch["blob"].to_pylist(), strict=True) if b >= n]
            if past:
                yield _parts(past)
            blobs += [unpack(x) for b, x in zip(batch["block"].to_pylist(), batch["blob"].to_pylist(), strict=True) if b < n]
        if not blobs:
            return
        base = np.cumsum([0, *(len(b[0]) for b in blobs)])
        ids, rows = (np.concatenate([b[i] for b in blobs]) for i in (0, 1))
        doc = np.concatenate([b[2] + k for b, k in zip(blobs, base, strict=False)]).astype(np.int64)
        start, length = (np.concatenate([b[i] for b in blobs]).astype(np.int64) for i in (3, 4))
        anchors, place = np.concatenate([b[5] for b in blobs]), np.concatenate([b[6] for b in blobs]).astype(np.int64)
        whole = np.concatenate([b[7] for b in blobs]).reshape(-1, _WINDOW_BYTES)
        del blobs
        firsts = np.cumsum(length) - length
        order = np.argsort(anchors, kind="stable")
        ordered = anchors[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        shared = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        some = order[shared]
        at = ranges(firsts[some], length[some])
        owner = np.repeat(some, length[some])
        offset = ranges(np.zeros(len(some), np.int64), length[some])
        value = np.zeros((len(at), 8), np.uint8)
        value[:, :_WINDOW_BYTES] = whole[at]
        value = value.view("<u8").ravel() << np.uint64(8) | (place[owner] - offset).astype(np.uint64)
        who = ids[doc[owner]]
        sort = np.lexsort((who, value, anchors[owner]))
        a, v, w = anchors[owner][sort], value[sort], who[sort]
        begin = np.concatenate([[True], (a[1:] != a[:-1]) | (v[1:] != v[:-1])])[: len(a)]
        least = w[np.maximum.accumulate(np.where(begin, np.arange(len(a)), 0))] if len(a) else w
        hit = sort[w > least]
        out = _by_part(doc[owner[hit]], start[owner[hit]] + offset[hit], np.ones(len(hit), np.int64), ids, rows, n)
        if out:
            yield _parts(out)

    return parsed.repartitionById(2 * n, "block").mapInArrow(run, "part int, blob binary")


def _parts(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "blob"])


def _by_part(doc, start, length, ids, rows, n) -> list[tuple[int, bytes]]:
    """Windows merged into factors, by the part of the documents where theirs meet."""
    if not len(doc):
        return []
    parts = (mix(ids[doc].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    out = []
    for part, some in split_by(parts):
        used, number = np.unique(doc[some], return_inverse=True)
        order = np.lexsort((start[some], number))
        s, e, d = start[some][order], (start[some] + length[some])[order], number[order]
        cut = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > e[:-1])])
        head = np.flatnonzero(cut)
        ends = np.maximum.reduceat(e, head)
        out.append((part, pack([ids[used].astype("<i8"), rows[used].astype("<i8"), d[head].astype("<u4"), s[head].astype("<u4"), (ends - s[head]).astype("<u4")])))
    return out


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, row, spans: what repeats an earlier document, as word positions start, end, start, end, ... of each text.

    A word is in a span if it's in a window of ``window`` (9 to 48) words that also starts in a document with a
    smaller doc_id.
    """
    if not 9 <= window <= 48:
        raise ValueError("window must be 9 to 48")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(partitions(docs.sparkSession), -(-size // BLOCK_BYTES))

    def run(batches):
        blobs = [unpack(x) for batch in batches for x in batch["blob"].to_pylist()]
        if not blobs:
            return
        base = np.cumsum([0, *(len(b[0]) for b in blobs)])
        ids, rows = (np.concatenate([b[i] for b in blobs]) for i in (0, 1))
        doc = np.concatenate([b[2] + k for b, k in zip(blobs, base, strict=False)]).astype(np.int64)
        start, end = (x.astype(np.int64) for x in (np.concatenate([b[3] for b in blobs]), np.concatenate([b[3] + b[4] for b in blobs])))
        end += window - 1
        order = np.lexsort((start, rows[doc], ids[doc]))
        i, r, s, e = ids[doc][order], rows[doc][order], start[order], end[order]
        of = np.cumsum(np.concatenate([[0], (i[1:] != i[:-1]) | (r[1:] != r[:-1])]))
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for a, b in zip(heads, np.append(heads[1:], len(i)), strict=True):
            reach = np.maximum.accumulate(e[a:b])
            cut = np.flatnonzero(np.concatenate([[True], s[a + 1 : b] > reach[:-1]]))
            flat = np.stack([s[a:b][cut], reach[np.append(cut[1:] - 1, b - a - 1)]], 1).ravel()
            yield i[a], r[a], flat

    def batched(batches):
        held = []
        for x in run(batches):
            held.append(x)
            if len(held) == 10_000:
                yield _spans(held)
                held = []
        if held:
            yield _spans(held)

    factors = _factor(_parse(_keyed(docs), window, n), n)
    return factors.repartitionById(n, "part").mapInArrow(batched, "doc long, row long, spans array<int>")


def _spans(held):
    columns = [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([x[2].tolist() for x in held], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["doc", "row", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc: the id, where null is the least; row: hash of the text, so that rows that share an id are told apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(id_key().alias("doc"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept (the other words, joined by one space) and kept_sha256 of every row.

    Words are split at ASCII white space and compared as they stand; null and empty texts have none. Rows that share a
    doc_id never remove each other's words; a null id is the smallest id. Repeated rows lose the same words. Other
    columns are passed over. Empty docs give no rows.
    """

    def run(batches):
        for batch in batches:
            n, gone, kept, sums = [], [], [], []
            for text, cut in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                if cut:
                    edges = [0, *cut, len(words)]
                    words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
                sums.append(hashlib.sha256(kept[-1]).hexdigest())
            columns = [batch["doc"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), batch["spans"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_removed", "spans", "kept", "kept_sha256"])

    # The spans are the smaller side: hashed, so that texts need no sort.
    both = _keyed(docs).join(spans(docs, window).hint("shuffle_hash"), ["doc", "row"], "left").select("doc", "text", "spans")
    out = both.mapInArrow(run, "doc long, n_words long, n_removed long, spans array<int>, kept string, kept_sha256 string")
    return out.select(id_back("doc").alias("doc_id"), "n_words", "n_removed", "spans", "kept", "kept_sha256")
