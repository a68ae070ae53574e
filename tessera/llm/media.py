"""Cropped and edited copies among images, by local descriptors.

Corners are found at several scales. Around each, binary tests on a blurred patch, turned by the patch's own direction,
give 252 bits. Six tables of 42 bits each join descriptors of different images: two that differ in at most five bits
share a table's value for sure, and more distant ones often do. Matches of two images count if one turn, scale and
shift explains several of them. A value's images are matched with one of them first, and with each other only where that
leaves them in different classes, so that a large group of copies makes no pairs of all its members. Matches move as
blobs, so that rows are for images, not for pairs.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack, ranges, split_by, unpack
from .common import checkpointed, id_back, id_key, mix, partitions, split_join
from .neardup import components, least_ends

#: Scales, corners of a scale, and pixels around a corner that its descriptor looks at.
SCALES, CORNERS, RADIUS = (1.0, 2**-0.5, 0.5), 16, 12
TABLES, BITS = 6, 42
#: Matches that one transformation must explain, and by how many pixels it may miss.
LEAST, MISS = 5, 4.0
#: Matches that are made at once.
MATCHES = 1_000_000
_TESTS = np.random.default_rng(42).uniform(-1, 1, (4 * TABLES * BITS, 2))
_TESTS = (_TESTS[(_TESTS**2).sum(1) <= 1][: 2 * TABLES * BITS] * RADIUS).reshape(TABLES * BITS, 2, 2)
_DISC = np.stack(np.meshgrid(np.arange(-7, 8), np.arange(-7, 8)), -1).reshape(-1, 2)
_DISC = _DISC[(_DISC**2).sum(1) <= 49]


def encode_png(gray: np.ndarray) -> bytes:
    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = gray.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 1)) + part(b"IEND", b"")


def _unfiltered(raw: bytes, h: int, w: int, step: int) -> np.ndarray:
    """The bytes of h lines of w pixels of ``step`` bytes, each line filtered as its first byte says."""
    rows = np.frombuffer(raw, np.uint8, h * (w * step + 1)).reshape(h, w * step + 1)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            line = np.array(_guessed(line.tolist(), above.tolist(), step, kind == 4), np.uint8)
        out[y] = above = line
    return out


def _guessed(line: list[int], above: list[int], step: int, paeth: bool) -> list[int]:
    """A line whose bytes were stored as differences to a guess from the bytes to the left, above, and between."""
    out = [0] * step + line
    corners = [0] * step + above
    for x, value in enumerate(line):
        left, up = out[x], above[x]
        if paeth:
            corner = corners[x]
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        else:
            guess = (left + up) // 2
        out[x + step] = (value + guess) & 255
    return out[step:]


_PNM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def _png(blob: bytes) -> np.ndarray | None:
    at, data, head, palette = 8, [], None, None
    while at + 8 <= len(blob):
        size, kind = struct.unpack_from(">I4s", blob, at)
        part = blob[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3).mean(-1)
        elif kind == b"IDAT":
            data.append(part)
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth not in (8, 16) or interlaced or not w * h:
        return None
    step = channels * depth // 8
    raw = _unfiltered(zlib.decompress(b"".join(data)), h, w, step).reshape(h, w, channels, depth // 8)
    pixels = raw[..., 0].astype(float) if depth == 8 else raw[..., 0] + raw[..., 1] / 256
    if colour == 3:
        return palette[pixels[..., 0].astype(int)]
    return pixels[..., :3].mean(-1) if channels > 2 else pixels[..., 0]


def decode(blob: bytes | None) -> np.ndarray | None:
    """Grey values of a PNG (grey, colour or palette, of 8 or 16 bits, not interlaced) or 8-bit binary PGM or PPM.

    None for anything else: null and empty values, pictures without pixels, cut or broken files, other formats.
    """
    try:
        if blob and blob[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(blob)
        if blob and (found := _PNM.match(blob)):
            w, h, most = (int(x) for x in found.groups()[1:])
            step = 1 if found[1] == b"5" else 3
            if 0 < w * h and 0 < most < 256:
                return np.frombuffer(blob, np.uint8, w * h * step, found.end()).reshape(h, w, step).mean(-1)
    except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
        pass
    return None


def resized(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = (max(1, round(n * scale)) for n in x.shape)
    ys, xs = np.arange(h) / scale, np.arange(w) / scale
    y0, x0 = np.minimum(ys.astype(int), x.shape[0] - 1), np.minimum(xs.astype(int), x.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], xs - x0
    top = x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx
    return top * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def _blurred(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r + 1."""
    s = np.cumsum(np.cumsum(np.pad(x, ((r + 1, r), (r + 1, r)), mode="edge"), 0), 1)
    n = 2 * r + 1
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, y, scale and direction of an image's corners; and the TABLES numbers of BITS bits of each."""
    places, codes = [], []
    for scale in SCALES:
        x = image if scale == 1 else resized(_blurred(image, 1), scale)
        margin = RADIUS + 2
        if min(x.shape) <= 2 * margin:
            continue
        gy, gx = np.gradient(x)
        a, b, c = _blurred(gx * gx, 2), _blurred(gy * gy, 2), _blurred(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        inner = r[margin:-margin, margin:-margin]
        h, w = inner.shape
        top = np.max([r[margin + i : margin + i + h, margin + j : margin + j + w] for i in range(-2, 3) for j in range(-2, 3)], axis=0)
        ys, xs = np.nonzero((inner >= top) & (inner > 25))
        best = np.lexsort((xs, ys, -inner[ys, xs]))[:CORNERS]
        ys, xs = ys[best] + margin, xs[best] + margin
        if not len(ys):
            continue
        soft = _blurred(x, 2)
        disc = x[ys[:, None] + _DISC[:, 1], xs[:, None] + _DISC[:, 0]]
        turn = np.arctan2((disc * _DISC[:, 1]).sum(1), (disc * _DISC[:, 0]).sum(1))
        cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
        px = np.rint(xs[:, None, None] + _TESTS[..., 0] * cos - _TESTS[..., 1] * sin).astype(int)
        py = np.rint(ys[:, None, None] + _TESTS[..., 0] * sin + _TESTS[..., 1] * cos).astype(int)
        seen = soft[py, px]
        bits = (seen[..., 0] < seen[..., 1]).reshape(len(ys), TABLES, BITS).astype(np.int64)
        codes.append((bits << np.arange(BITS)).sum(-1))
        places.append(np.stack([xs / scale, ys / scale, np.full(len(xs), 1 / scale), turn], 1))
    if not codes:
        return np.zeros((0, 4)), np.zeros((0, TABLES), np.int64)
    return np.concatenate(places), np.concatenate(codes)


def descriptors(images: DataFrame) -> DataFrame:
    """node, image, pixels (hash of size and grey values, null if there is no picture), places (32-bit numbers) and codes
    (the table values of one corner after another) of each row of images."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                hashes, places, codes = [], [], []
                for blob in part["picture"].to_pylist():
                    x = decode(blob)
                    p, c = describe(x) if x is not None else (np.zeros((0, 4)), np.zeros((0, TABLES), np.int64))
                    hashes.append(None if x is None else xxhash.xxh3_128_hexdigest(np.ascontiguousarray(x).tobytes() + struct.pack("<qq", *x.shape)))
                    places.append(p.astype("<f4").tobytes())
                    codes.append((c + (np.arange(TABLES) << BITS)).astype("<u8").tobytes())
                columns = [part["node"], part["image"], pa.array(hashes, pa.string()), pa.array(places, pa.binary()), pa.array(codes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "image", "pixels", "places", "codes"])

    return images.mapInArrow(run, "node long, image long, pixels string, places binary, codes binary")


def _side(n: int) -> int:
    """Groups of nodes whose pairs of groups make n blocks at most."""
    return max(1, int(((8 * n + 1) ** 0.5 - 1) / 2))


def _group(node: np.ndarray, side: int) -> np.ndarray:
    return (mix(node.astype("<i8").view(np.uint64)) % np.uint64(side)).astype(np.int64)


def _pair_block(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    low, high = np.minimum(g, h), np.maximum(g, h)
    return high * (high + 1) // 2 + low


def _blobs(out: list, kind: int) -> pa.RecordBatch:
    columns = pa.array([kind] * len(out), pa.int32()), pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())
    return pa.RecordBatch.from_arrays(list(columns), ["kind", "block", "blob"])


def _valued(own: DataFrame, n: int) -> DataFrame:
    """Blobs of nodes' table values, for n blocks of values. own: node, root (what it belongs to by now) and codes."""

    def run(batches):
        for batch in batches:
            node, root = (batch[c].to_numpy(zero_copy_only=False).astype("<i8") for c in ("node", "root"))
            codes = [np.frombuffer(x, "<u8") for x in batch["codes"].to_pylist()]
            bucket = np.concatenate([np.zeros(0, "<u8"), *codes])
            owner = np.repeat(np.arange(len(node)), [len(c) for c in codes])
            corner = np.concatenate([np.zeros(0, "<u2"), *(np.arange(len(c)) // TABLES for c in codes)]).astype("<u2")
            out = []
            for b, some in split_by((mix(bucket) % np.uint64(n)).astype(np.int64)):
                used, number = np.unique(owner[some], return_inverse=True)
                out.append((b, pack([bucket[some], node[used], root[used], number.astype("<u4"), corner[some]])))
            yield _blobs(out, 0)

    return own.select("node", "root", "codes").mapInArrow(run, "kind int, block int, blob binary")


def _placed(own: DataFrame, n: int) -> DataFrame:
    """Blobs of where nodes' corners are, for all blocks of pairs that they can be in."""
    side = _side(n)

    def run(batches):
        for batch in batches:
            node = batch["node"].to_numpy(zero_copy_only=False).astype("<i8")
            places = [np.frombuffer(x, "<u4") for x in batch["places"].to_pylist()]
            out = []
            for g, some in split_by(_group(node, side)):
                blob = pack([node[some], np.array([len(places[k]) // 4 for k in some], "<u4"), np.concatenate([places[k] for k in some])])
                out += [(int(b), blob) for b in _pair_block(np.full(side, g), np.arange(side))]
            yield _blobs(out, 1)

    return own.select("node", "places").mapInArrow(run, "kind int, block int, blob binary")


def meetings(bucket: np.ndarray, node: np.ndarray, root: np.ndarray, star: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows, and for each row in it the first one and how many of those after it that it meets.

    star: a table value's node of least hash meets all others, so that n rows make n meetings. Else each node meets
    those of other roots: rows of one root stand together, and what comes behind them is met.
    """
    if not len(bucket):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    order = np.lexsort((node, mix(node.astype(np.int64).view(np.uint64)), bucket)) if star else np.lexsort((node, root, bucket))
    b, own = bucket[order], (node if star else root)[order]
    last = np.append(b[1:] != b[:-1], True)
    ends = np.flatnonzero(last) + 1
    end = np.repeat(ends, np.diff(ends, prepend=0))
    runs = np.flatnonzero(last | np.append(own[1:] != own[:-1], True)) + 1
    behind = np.repeat(runs, np.diff(runs, prepend=0))
    many = end - behind
    if star:  # the first run of a value alone
        first = np.append(0, ends[:-1])
        many[behind != np.repeat(behind[first], np.diff(ends, prepend=0))] = 0
    return order, behind, many


def _matches(values: DataFrame, n: int, star: bool) -> DataFrame:
    """Blobs of matches, corners of two nodes of different roots that have the same table value, by blocks of pairs of nodes."""
    side = _side(n)

    def run(batches):
        blobs = [unpack(x) for batch in batches for x in batch["blob"].to_pylist()]
        if not blobs:
            return
        bucket, corner = (np.concatenate([b[i] for b in blobs]) for i in (0, 4))
        node, root = (np.concatenate([b[i][b[3]] for b in blobs]) for i in (1, 2))
        del blobs
        order, start, many = meetings(bucket, node, root, star)
        node, root, corner = node[order], root[order], corner[order]
        rows = np.flatnonzero(many)
        for some in np.split(rows, np.flatnonzero(np.diff(np.cumsum(many[rows]) // MATCHES)) + 1):
            left, right = np.repeat(some, many[some]), ranges(start[some], many[some])
            differ = root[left] != root[right]
            left, right = left[differ], right[differ]
            turned = node[left] > node[right]
            left, right = np.where(turned, right, left), np.where(turned, left, right)
            out = []
            for b, at in split_by(_pair_block(_group(node[left], side), _group(node[right], side))):
                at = at[np.lexsort((node[right[at]], node[left[at]]))]
                used, number = np.unique(np.concatenate([node[left[at]], node[right[at]]]), return_inverse=True)
                number = number.astype("<u4")
                out.append((b, pack([used, number[: len(at)], number[len(at) :], corner[left[at]], corner[right[at]]])))
            yield _blobs(out, 2)

    return values.repartitionById(n, "block").mapInArrow(run, "kind int, block int, blob binary")


def _links(blobs: DataFrame, n: int, least: int) -> DataFrame:
    """a, b: of each block of pairs, the nodes b that matches link, and the least node that these lead to. blobs: places
    and matches; a pair's matches of all table values are counted together."""

    def run(batches):
        places, matches = [], []
        for batch in batches:
            for kind, blob in zip(batch["kind"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                (places if kind == 1 else matches).append(unpack(blob))
        if not matches:
            return
        nodes, sizes, flat = (np.concatenate([p[i] for p in places]) for i in range(3))
        flat = flat.view("<f4").reshape(-1, 4)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        order = np.argsort(nodes, kind="stable")
        nodes, starts = nodes[order], starts[order]
        a, b = (np.searchsorted(nodes, np.concatenate([m[0][m[i]] for m in matches])) for i in (1, 2))
        i, j = (np.concatenate([m[k] for m in matches]).astype(np.int64) for k in (3, 4))
        del places, matches
        order = np.lexsort((j, i, b, a))
        a, b, i, j = a[order], b[order], i[order], j[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        once = new | np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(a)]
        a, b, i, j, new = a[once], b[once], i[once], j[once], new[once]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(new))[: len(begin)]
        many = end - begin >= least
        good = []
        for s, e in zip(begin[many], end[many], strict=True):
            left, right = flat[starts[a[s]] + i[s:e]].astype(float), flat[starts[b[s]] + j[s:e]].astype(float)
            if explained(left, right) >= least:
                good.append(s)
        ends, number = np.unique(np.concatenate([a[good], b[good]]), return_inverse=True)
        root = least_ends(number[: len(good)], number[len(good) :], len(ends))
        for k in range(0, len(ends), 100_000):
            part = slice(k, k + 100_000)
            columns = [nodes[ends[root[part]]], nodes[ends[part]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return blobs.repartitionById(n, "block").mapInArrow(run, "a long, b long")


def explained(left: np.ndarray, right: np.ndarray) -> int:
    """The most matches (rows of x, y, scale, direction in either image) that one turn, scale and shift explains.

    Each match proposes one, by its scales, directions and places. A corner counts once.
    """
    best = 0
    a, b = left[:, 0] + 1j * left[:, 1], right[:, 0] + 1j * right[:, 1]
    factor = right[:, 2] / left[:, 2] * np.exp(1j * (right[:, 3] - left[:, 3]))
    for f, x, y in zip(factor, a, b, strict=True):
        good = np.abs(b - (y + f * (a - x))) <= MISS * max(1.0, abs(f))
        if good.sum() > best:
            best = max(best, min(len(np.unique(np.round(p[good]))) for p in (a, b)))
    return best


def copies(images: DataFrame, least: int = LEAST) -> DataFrame:
    """image_id and class_id (the least image_id of its class) of every row of images (image_id, picture).

    Classes are what links lead to: two pictures are linked if one transformation explains ``least`` of their matches.
    First each table value's pictures are matched with one of them alone; then, of all values, pictures that are not
    yet in one class are matched with each other, so that no link between two classes is lost. Equal pictures are one.
    What isn't a picture has a class of its own. A null id is the least id; rows that share an id share a class. Other
    columns are passed over. Empty images give no rows.
    """
    n = partitions(images.sparkSession)
    picture = F.col("picture").cast("binary")
    keyed = images.select(F.xxhash64("image_id", picture).alias("node"), id_key("image_id").alias("image"), picture.alias("picture"))
    found = checkpointed(descriptors(keyed))
    first = checkpointed(found.where("pixels is not null").groupBy("pixels").agg(F.min("node").alias("a"), F.count("*").alias("n")))
    seen = found.where("pixels is not null").select("node", "pixels", F.xxhash64("pixels").alias("key"))
    equal = split_join(seen, first.select("pixels", "a", "n", F.xxhash64("pixels").alias("key")), ["key", "pixels"], ["node"]).select("a", F.col("node").alias("b")).where("a <> b").distinct()
    ids = found.select("node", "image").distinct()
    alike = ids.join(ids.groupBy("image").agg(F.min("node").alias("a")), "image").select("a", F.col("node").alias("b")).where("a <> b")
    # Of equal pictures the least node stands for all.
    own = found.dropDuplicates(["node"]).join(first.select(F.col("a").alias("node")), "node", "left_semi")
    places = checkpointed(_placed(own, n))
    roots = components(checkpointed(equal.unionAll(alike)))
    for star in (True, False):
        codes = own.select("node", "codes").join(roots.withColumnRenamed("doc", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        matches = _matches(_valued(codes, n), n, star)
        roots = components(checkpointed(_links(matches.unionAll(places), n, least)), roots)
    base = checkpointed(found.select("node", "image").join(roots.withColumnRenamed("doc", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = base.groupBy("root").agg(F.min("image").alias("class"), F.count("*").alias("n"))
    return split_join(base, names, ["root"], ["node", "image"]).select(id_back("image").alias("image_id"), id_back("class").alias("class_id"))
