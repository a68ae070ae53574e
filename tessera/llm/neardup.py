"""Near-duplicates by order MinHash and banded alignment.

A text's shingles are its 5-word runs, each labelled with how many equal ones came before. Each of several hash
functions picks the few least shingles; their text order is kept, so that a bucket holds texts that share shingles in
the same order. Texts of a bucket are compared with the bucket's least document (a star, not all pairs). Where that
leaves a bucket in more than one class, its other texts are open: an exact join finds the pairs among them that can
still be similar. It rests on prefixes: with shingles in one global order, rare ones first, two similar texts share
one among their first few. Of a large group of edits of one text, most pairs share one, and many are similar. So a few
texts of each shingle are compared with its other texts first, and what becomes one class needs no more pairs; there
are GROWTH times as many in each round, until all pairs that are left between classes are few. These are then joined, so
that none is passed over. Classes are the connected components of the links.

A comparison aligns the shingles of two texts within a band as wide as a similarity of 0.8 allows; the similarity is
the number of aligned shingles over the number of different shingles in either text.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import pack, unpack
from .common import Words, checkpointed, chunks, columns, hash64, id_back, id_key, mix, spare, split_join, trimmed

WORDS, SIMILARITY = 5, 0.8
#: Hash functions, and shingles that each picks: a pair of similarity 0.8 shares no bucket with probability 1e-5.
PICKS = (16, 3)
#: Cells of the table of shingle counts, parts that it is summed in, and the ratio of neighbouring classes of size.
CELLS, PARTS, STEP = 1 << 18, 64, 1.1
#: Links that one task follows: so many are 16 MB.
ONE_TASK = 1_000_000
#: Longs of parities that tell most texts apart before they are compared.
MARKS = 8
#: Texts of a shingle that are compared with its others in the first round, and how many times as many in each later one.
HEADS, GROWTH = 4, 8
_MARKS = [f"m{i}" for i in range(MARKS)]
_ODD = np.random.default_rng(5).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _word_rows(word: bytes) -> tuple[int]:
    return (hash64(word),)


def shingles(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the shingles of each text; a text of fewer than five words has one of all its words, if any."""
    n = max(0, len(hashes) - WORDS + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(WORDS):
        grams += hashes[i : i + n] * _ODD[i]
    grams = mix(grams)
    ends = np.cumsum(sizes)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        if size >= WORDS:
            out.append(grams[end - size : end - WORDS + 1])
        else:
            out.append(mix((hashes[end - size : end] * _ODD[:size]).sum(keepdims=True, dtype=np.uint64) + np.uint64(size)) if size else grams[:0])
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """Each shingle's hash, changed by the number of equal ones before it."""
    order = np.argsort(grams, kind="stable")
    same = np.concatenate([[False], grams[order][1:] == grams[order][:-1]]) if len(grams) else np.zeros(0, bool)
    if not same.any():
        return grams
    at = np.arange(len(grams))
    out = grams.copy()
    out[order] += mix((at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64))
    return mix(out)


def picks(grams: np.ndarray, functions: int, least: int, seed: int) -> np.ndarray:
    """A bucket for each hash function: the ``least`` shingles of least hash, in text order."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    marks = labelled(grams)
    salt = mix(np.arange(1, functions + 1, dtype=np.uint64) + np.uint64(seed << 20))
    rows = max(1, (1 << 21) // len(marks))
    least = min(least, len(marks))
    out = []
    for a in range(0, functions, rows):
        v = (marks[None, :] ^ salt[a : a + rows, None]) * _ODD[40]
        v ^= v >> np.uint64(29)
        v *= _ODD[41]
        at = np.sort(np.argpartition(v, least - 1, axis=1)[:, :least], axis=1) if least < len(marks) else np.tile(np.arange(least), (len(v), 1))
        out.append((marks[at] * _ODD[8 : 8 + least]).sum(axis=1, dtype=np.uint64) + salt[a : a + rows])
    return mix(np.concatenate(out))


def _texts(batch, column: str, vocabulary: Words):
    """Words' hashes and sizes of a batch's texts, in chunks."""
    for texts in chunks(batch[column].to_pylist()):
        split = [x.split() for x in texts]
        yield vocabulary.hashes([w for s in split for w in s])[:, 0], np.fromiter(map(len, split), np.int64, len(split))


def sketches(keyed: DataFrame, functions: int, least: int) -> DataFrame:
    """doc, row, c1 and c2 (hash of the words), and buckets, of every text."""

    def run(batches):
        vocabulary = Words(_word_rows, 1)
        for batch in batches:
            c, buckets = [], []
            for hashes, sizes in _texts(batch, "text", vocabulary):
                ends = np.cumsum(sizes)
                c += [xxhash.xxh3_128_digest(hashes[e - s : e].tobytes()) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                buckets += [picks(g, functions, least, 1).view(np.int64).tolist() for g in shingles(hashes, sizes)]
            both = np.frombuffer(b"".join(c), "<i8").reshape(-1, 2)
            columns = [batch["doc"], batch["row"], pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "row", "c1", "c2", "buckets"])

    return keyed.mapInArrow(run, "doc long, row long, c1 long, c2 long, buckets array<long>")


def _sequences(texts: DataFrame) -> DataFrame:
    """doc, grams (32 bits of each shingle's hash, in text order)."""

    def run(batches):
        vocabulary = Words(_word_rows, 1)
        for batch in batches:
            grams = []
            for hashes, sizes in _texts(batch, "text", vocabulary):
                grams += [(g >> np.uint64(32)).astype("<u4").tobytes() for g in shingles(hashes, sizes)]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(grams, pa.binary())], ["doc", "grams"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, grams binary")


def _rising(x: list[int]) -> int:
    """Length of the longest strictly rising subsequence."""
    tails: list[int] = []
    for v in x:
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


class _Side:
    """A text's different shingles and where each stands first."""

    __slots__ = ("grams", "at", "size")

    def __init__(self, blob: bytes):
        grams = np.frombuffer(blob, "<u4")
        self.grams, self.at = np.unique(grams, return_index=True)
        self.size = len(grams)


def similarity(a: _Side, b: _Side, least: float) -> float:
    """Aligned shingles over all different ones; 0 where less than ``least`` is sure before the alignment."""
    na, nb = len(a.grams), len(b.grams)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    _, i, j = np.intersect1d(a.grams, b.grams, assume_unique=True, return_indices=True)
    if len(i) < least * (na + nb - len(i)):
        return 0.0
    i, j = a.at[i], b.at[j]
    # Each shingle that isn't aligned shifts the rest by one at most, repeated ones included.
    band = (1 - least) * (na + nb) + (a.size - na) + (b.size - nb) + WORDS
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    aligned = len(j) if (j[1:] > j[:-1]).all() else _rising(j.tolist())
    return aligned / (na + nb - aligned)


def linked(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches):
        held, last = None, None
        for batch in batches:
            good = []
            for a, left, right in zip(batch["a"].to_pylist(), batch["left"], batch["right"], strict=True):
                if held != a or held is None:
                    held, last = a, _Side(left.as_py())
                good.append(similarity(last, _Side(right.as_py()), least) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sequences.select(F.col("doc").alias("a"), F.col("grams").alias("left"))
    right = sequences.select(F.col("doc").alias("b"), F.col("grams").alias("right"))
    return split_join(pairs.join(right, "b"), left, ["a"], ["b"], pairs.groupBy("a").agg(F.count("*").alias("n"))).select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc, root: the least document that links (a, b) lead to, for documents in links, and in ``known``.

    known: such a table for links that came before. In each round a document goes to its least neighbour, if that is
    less than itself, and on to where that one goes, to the end; links are then between where their ends have gone, and
    those within one place are done. So stars and chains take one round, and later rounds have few links. Once there are
    no more than ONE_TASK, one task follows them all.
    """
    roots = known
    edges = links.where("a <> b")
    edges = checkpointed(_moved(edges, known) if known is not None else edges.select("a", "b").distinct())
    while (n := edges.count()) > ONE_TASK:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("doc"), F.least("a", "b").alias("root"))
        step = checkpointed(step)
        while True:  # to the end of each chain, twice as far each time
            on = step.select(F.col("doc").alias("root"), F.col("root").alias("up"))
            far = checkpointed(step.join(on, "root").select("doc", F.col("root").alias("was"), F.col("up").alias("root")))
            step = far.select("doc", "root")
            if not far.where("root <> was").limit(1).count():
                break
        edges = checkpointed(_moved(edges, step))
        roots = checkpointed(_on(roots, step))
    if n or roots is None:
        roots = checkpointed(_on(roots, edges.repartition(1).mapInArrow(_followed, "doc long, root long")))
    return roots


def _on(roots: DataFrame | None, step: DataFrame) -> DataFrame:
    """roots, and on from there as step leads; documents that only step has go as it says."""
    if roots is None:
        return step
    up = step.select(F.col("doc").alias("root"), F.col("root").alias("up"))
    members = roots.groupBy("root").agg(F.count("*").alias("n"))
    both = split_join(roots, up, ["root"], ["doc"], members, how="left").select("doc", F.coalesce("up", "root").alias("root"))
    return both.unionByName(step.join(roots, "doc", "left_anti"))


def _followed(batches):
    """doc, root of all documents in some links."""
    ends = [np.zeros((2, 0), np.int64), *(np.stack([batch[c].to_numpy() for c in "ab"]) for batch in batches)]
    nodes, number = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    x, y = number.reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least_ends(x, y, len(nodes))])], ["doc", "root"])


def least_ends(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least of 0..n-1 that links x, y lead to, for each."""
    root = np.arange(n)
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        for ends in (x, y):
            np.minimum.at(root, root[ends].copy(), low)
        while (root != root[root]).any():
            root = root[root]
    return root


def _moved(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between the roots of their ends, each once, without those that have become one."""
    a, b = (roots.select(F.col("doc").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    both = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
    return both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def _heads(members: DataFrame) -> DataFrame:
    """bucket, head (a text of the least id in it) and n, the texts in it, of buckets with more than one."""
    return checkpointed(members.groupBy("bucket").agg(F.min_by("doc", "row").alias("head"), F.count("*").alias("n")).where("n > 1"))


def _open(members: DataFrame, heads: DataFrame, roots: DataFrame) -> DataFrame:
    """doc, root of texts in buckets that are in more than one class, without the buckets' heads, which are done."""
    rest = split_join(members, heads, ["bucket"], ["doc"]).where("doc <> head").select("bucket", "doc")
    known = checkpointed(rest.join(roots, "doc", "left").select("bucket", "doc", F.coalesce("root", "doc").alias("root")))
    mixed = known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("bucket", "n")
    return split_join(known, mixed, ["bucket"], ["doc"]).select("doc", "root").distinct()


def _rooted_texts(docs: DataFrame, least: float, by_id: bool) -> DataFrame:
    """doc (hash of id and text), row (the id), and root (a doc for each class) of every row of docs.

    Each different text of an id is compared. by_id: rows that share an id share a class, too.
    """
    keyed = docs.select(_node().alias("doc"), id_key().alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    trimmed()  # the driver has many small plans ahead
    sketched = checkpointed(sketches(keyed, *PICKS))
    first = checkpointed(sketched.groupBy("c1", "c2").agg(F.min("doc").alias("a"), F.count("*").alias("n")))
    # Of copies, the one with the least hash stands for all, and they have its class.
    each = checkpointed(split_join(sketched.select("doc", "row", "c1", "c2"), first, ["c1", "c2"], ["doc"]).select("doc", "row", F.col("a").alias("stands")))
    own = sketched.join(first.select(F.col("a").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"])
    members = checkpointed(own.select("doc", "row", F.explode("buckets").alias("bucket")).distinct())
    heads = _heads(members)
    stars = checkpointed(split_join(members, heads, ["bucket"], ["doc"]).where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct())
    asked = stars.select(F.col("a").alias("doc")).union(stars.select("b")).distinct()
    sequences = checkpointed(_sequences(keyed.join(asked.hint("shuffle_hash"), "doc", "left_semi")).dropDuplicates(["doc"]))
    links = linked(stars, sequences, least)
    if by_id:
        several = each.groupBy("row").agg(F.min("stands").alias("a"), F.max("stands").alias("most")).where("a <> most").select("row", "a")
        links = links.unionAll(each.select("row", F.col("stands").alias("b")).distinct().join(several, "row").where("b <> a").select("a", "b"))
    roots = components(checkpointed(links))

    rest = checkpointed(_open(members, heads, roots))
    if rest.limit(1).count():
        texts = checkpointed(sequences.join(rest.select("doc", "root"), "doc"))
        roots = _joined(checkpointed(_prefixes(texts, _counts(texts), least)), texts.select("doc", "grams"), roots, least)

    out = each.join(roots.withColumnRenamed("doc", "stands"), "stands", "left")
    return out.select("doc", "row", F.coalesce("root", "stands").alias("root"))


def _node() -> Column:
    return F.xxhash64(id_key(), F.coalesce(F.col("text"), F.lit("")))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_docs (rows in the class) of every row of docs.

    A link needs a similarity of ``least`` over different shingles, and is found with the probability that the head of
    this module gives if repetitions, which order MinHash counts, don't set the two texts apart. Words are split at
    ASCII white space. Texts with the same words are copies; so are all texts without words. Rows
    that share a doc_id are one document, whose links are those of all its texts; a null id is the least id. Other
    columns are passed over. Empty docs give no rows.
    """
    out = checkpointed(_rooted_texts(docs, least, True))
    # Counted in shares first: the rows of a large class needn't meet.
    shares = out.groupBy("root", F.pmod(F.hash("doc"), F.lit(64)).alias("share")).agg(F.count("*").alias("n"), F.min("row").alias("least"))
    sizes = shares.groupBy("root").agg(F.sum("n").alias("n_docs"), F.min("least").alias("class"))
    return split_join(out, sizes, ["root"], ["doc", "row"], n="n_docs").select(id_back("row").alias("doc_id"), id_back("class").alias("class_id"), "n_docs")


def _cells(grams: np.ndarray) -> np.ndarray:
    return grams >> np.uint32(32 - CELLS.bit_length() + 1)


def _counts(texts: DataFrame) -> np.ndarray:
    """How many texts have the shingles of each of CELLS cells: a table of fixed size, summed up in PARTS parts.

    Any table gives a right order of shingles; a good one makes few pairs.
    """
    size = CELLS // PARTS

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            cells = [_cells(np.unique(np.frombuffer(grams, "<u4"))) for grams in batch["grams"].to_pylist()]
            total += np.bincount(np.concatenate(cells) if cells else np.zeros(0, np.int64), minlength=CELLS)
        used = [p for p in range(PARTS) if total[p * size : (p + 1) * size].any()]
        blobs = [pack([total[p * size : (p + 1) * size]]) for p in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def summed(batches):
        total = {}
        for batch in batches:
            for part, blob in zip(batch["part"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                total[part] = total.get(part, 0) + unpack(blob)[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack([x]) for x in total.values()], pa.binary())], ["part", "blob"])

    schema = "part int, blob binary"
    out = np.zeros(CELLS, np.int64)
    for r in texts.select("grams").mapInArrow(run, schema).repartitionById(PARTS, "part").mapInArrow(summed, schema).collect():  # PARTS rows at most
        out[r.part * size : (r.part + 1) * size] = unpack(bytes(r.blob))[0]
    return out


def _class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(STEP) + 1e-9).astype(np.int64)


def _parities(grams: np.ndarray) -> np.ndarray:
    """64 * MARKS bits: whether an odd number of the shingles falls on each. Sets that differ in d shingles differ in d
    bits at most."""
    odd = np.bincount((grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (64 * MARKS), minlength=64 * MARKS) % 2
    return np.packbits(odd.astype(bool)).view("<i8")


def _prefixes(texts: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """key (of shingle and class of size), larger, doc, root, n, rank and marks (parities): the shingles of each text's prefix.

    Of two texts with x <= y shingles that are similar, the first x - t + 1 and y - t + 1 share one, if t is the number
    that they share at least, (x + y) least / (1 + least). A text stands in its own class as the smaller one, and as
    the larger one in the classes that a shingle's rank admits.
    """
    part = least / (1 + least)

    def run(batches):
        for batch in batches:
            out = []
            for doc, root, blob in zip(batch["doc"].to_pylist(), batch["root"].to_pylist(), batch["grams"].to_pylist(), strict=True):
                grams = np.unique(np.frombuffer(blob, "<u4"))
                grams = grams[np.lexsort((grams, counts[_cells(grams)]))].astype(np.uint64)
                n = len(grams)
                if not n:
                    continue
                own = n - int(np.ceil(2 * part * n - 1e-9)) + 1
                low = int(np.ceil(least * n - 1e-9))
                rank = np.arange(1, n + 1)
                top = np.minimum(n, np.floor((n - rank + 1) / part - n + 1e-9)).astype(np.int64)
                rank, top = rank[top >= low], top[top >= low]
                each = _class(top) - _class(low) + 1
                at = np.repeat(rank, each)
                classes = _class(low) + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
                classes = np.concatenate([np.full(own, _class(n)), classes])
                at = np.concatenate([np.arange(1, own + 1), at])
                keys = mix(grams[at - 1] << np.uint64(20) | classes.astype(np.uint64)).view(np.int64)
                out.append([keys, np.arange(len(at)) >= own, np.full(len(at), doc), np.full(len(at), root), np.full(len(at), n), at, *(np.full(len(at), x) for x in _parities(grams))])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    names = ["key", "larger", "doc", "root", "n", "rank", *_MARKS]
    return texts.select("doc", "root", "grams").mapInArrow(run, "key long, larger boolean, doc long, root long, n long, rank long, " + ", ".join(f"{m} long" for m in _MARKS))


def _joined(rows: DataFrame, sequences: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """roots, and on from there by the links between texts of rows (_prefixes), whose root says where they are by now.

    Rounds end with a join of all pairs that are left, be they few or most of what the next round would compare.
    """
    heads = HEADS
    while True:
        rows, keys, many, most, pairs = _mixed(rows)
        if not pairs:
            return roots
        few = pairs <= HEADS * many or most <= 2 * heads
        found = checkpointed(_prefix_pairs(rows, keys, least) if few else _head_pairs(rows, keys, heads, least))
        roots = components(checkpointed(linked(found, sequences, least)), roots)
        if few:
            return roots
        rows = checkpointed(rows.drop("root").join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc")))
        heads *= GROWTH


def _mixed(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int, int]:
    """The rows of keys with a pair of different roots, with many (the rows of the key), and key and many; how many rows
    there are, in all and for a key at most, and how many such pairs.

    Roots only ever become fewer, so that other keys have no such pair later on, either.
    """
    rows = rows.drop("many")
    each = rows.groupBy("key", "root").agg(F.count_if("larger").alias("l"), F.count_if(~F.col("larger")).alias("s"))
    pairs = (F.sum("l") * F.sum("s") - F.sum(F.col("l") * F.col("s"))).alias("pairs")
    keys = checkpointed(each.groupBy("key").agg(F.sum(F.col("l") + F.col("s")).alias("many"), pairs).where("pairs > 0"))
    total = keys.agg(F.sum("many"), F.max("many"), F.sum("pairs")).first()
    keys = keys.drop("pairs")
    return checkpointed(split_join(rows, keys, ["key"], ["doc"], n="many")), keys, *(x or 0 for x in total)


def _can(na, i, nb, j, least: float):
    """Whether shingles of rank i and j of texts with na <= nb shingles lie in the prefixes of a similar pair, and the
    texts' marks don't differ in more bits than such a pair has shingles of one text only."""
    shared = F.ceil((na + nb) * (least / (1 + least)) - 1e-9)
    differ = reduce(Column.__add__, [F.bit_count(F.col(m).bitwiseXOR(F.col(f"other_{m}"))) for m in _MARKS])
    return (na >= nb * least - 1e-9) & (i <= na - shared + 1) & (j <= nb - shared + 1) & (differ <= na + nb - 2 * shared)


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of texts as the smaller one of a pair, and as the larger one."""
    x = rows.where("not larger").select("key", "many", F.col("doc").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("rank").alias("i"), *_MARKS)
    y = rows.where("larger").select("key", "many", F.col("doc").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("rank").alias("j"), *[F.col(m).alias(f"other_{m}") for m in _MARKS])
    return x, y


def _good(least: float) -> Column:
    """Whether a row of either side is a pair of texts of different roots that can be similar."""
    na, i, nb, j = (F.col(c) for c in ("na", "i", "nb", "j"))
    return ((na < nb) | ((na == nb) & (F.col("a") < F.col("b")))) & (F.col("ra") != F.col("rb")) & _can(na, i, nb, j, least)


def _prefix_pairs(rows: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """a, b: all pairs of texts of different roots that can be similar."""
    x, y = _sides(rows)
    return split_join(y, x.drop("many"), ["key"], ["b"], keys, "many").where(_good(least)).select("a", "b").distinct()


def _head_pairs(rows: DataFrame, keys: DataFrame, heads: int, least: float) -> DataFrame:
    """Those of a key's pairs with a head in them: about as many texts of each key, the same ones wherever they can be."""
    x, y = _sides(rows)
    head = lambda doc: F.shiftrightunsigned(F.xxhash64(doc, F.lit(heads)), 11) * 2.0**-53 * F.col("many") < heads
    small = split_join(y, x.where(head("a")).drop("many"), ["key"], ["b"], keys, "many")
    large = split_join(x.where(~head("a")), y.where(head("b")).drop("many"), ["key"], ["a"], keys, "many")
    return small.where(_good(least)).select("a", "b").union(large.where(_good(least)).select("a", "b")).distinct()


def clean(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of docs, with all its columns, for each class of texts: a row of the least doc_id.

    Rows that share an id, or have none, are in one class only if their texts are; a null id is the least. Texts without
    words, null or empty, are copies of each other, of which one row stays. Of rows with the same id and text one stays,
    of two texts with the same id in a class the one with the lesser hash. Any other columns, whatever their names, stay
    as they are. Empty docs give no rows.
    """
    (name,) = spare(docs, "node")
    best = _rooted_texts(docs, least, False).groupBy("root").agg(F.min(F.struct("row", "doc")).alias("best")).select(F.col("best.doc").alias(name))
    kept = docs.withColumn(name, _node()).join(best.hint("shuffle_hash"), name, "left_semi")
    return kept.dropDuplicates([name]).select(*columns(docs))
