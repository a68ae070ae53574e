"""Line de-duplication: hashes of lines in range-partitioned order, first occurrences streamed, bitmaps returned."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, id_back, id_key, spare
from .firsts import later, ranked

#: A line counts from this many code points, once stripped, and goes if this many documents have it.
LEAST_POINTS, LEAST_DOCS = 20, 3
_STRIP = b" \t\n\x0b\x0c\r"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc: the id, where null is the least; row: hash of the text, so that rows that share an id are told apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(id_key().alias("doc"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))


def lines(keyed: DataFrame, least_points: int) -> DataFrame:
    """A row for each line that counts: its key's hash, ~doc (so that the largest id ranks first), row, and position."""

    def run(batches):
        for batch in batches:
            digests, docs, rows, at = [], [], [], []
            for doc, row, text in zip(batch["doc"].to_pylist(), batch["row"].to_pylist(), batch["text"], strict=True):
                for i, line in enumerate(text.as_py().split(b"\n")):
                    if len(line) < least_points:
                        continue
                    key = line.strip(_STRIP).lower()
                    if len(key) < least_points or len(key) < 4 * least_points and len(key.decode(errors="replace")) < least_points:
                        continue
                    digests.append(xxhash.xxh3_128_digest(key))
                    docs.append(doc)
                    rows.append(row)
                    at.append(i)
                if len(at) > 100_000:
                    yield _lines(digests, docs, rows, at)
                    digests, docs, rows, at = [], [], [], []
            if at:
                yield _lines(digests, docs, rows, at)

    return keyed.mapInArrow(run, "h1 long, h2 long, rank long, row long, at long")


def _lines(digests, docs, rows, at):
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    columns = [h[:, 0].copy(), h[:, 1].copy(), ~np.array(docs, np.int64), np.array(rows, np.int64), np.array(at, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "rank", "row", "at"])


def dropped(docs: DataFrame, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, row, drops: positions of the lines that go, for documents that lose any.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Of keys with at least
    ``least_points`` code points in at least ``least_docs`` documents, the largest doc_id keeps its lines.
    """
    found = later(ranked(lines(_keyed(docs), least_points)), least_docs)
    return found.groupBy(F.bitwise_not("rank").alias("doc"), "row").agg(F.collect_set("at").alias("drops"))


def _apply(docs: DataFrame, drops: DataFrame, run, schema: str) -> DataFrame:
    # The drops are the smaller side by far: hashed, so that texts need no sort.
    both = _keyed(docs).join(drops.hint("shuffle_hash"), ["doc", "row"], "left")
    return both.select("doc", "text", "drops").mapInArrow(run, schema).withColumn("doc_id", id_back("doc"))


def keep_bits(n: int, drops) -> np.ndarray:
    keep = np.ones(n, bool)
    if drops is not None:
        keep[np.asarray(drops, np.int64)] = False
    return keep


def bitmaps(docs: DataFrame, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep (deflated bits, one for each line, 1: stays) and kept_sha256 of every row of docs.

    Null and empty texts have one empty line, which stays. Rows that share a doc_id count as one document; a null id
    is the smallest id. Repeated rows get the same bitmap. Other columns are passed over. Empty docs give no rows.
    """

    def run(batches):
        for batch in batches:
            n, gone, bits, sums = [], [], [], []
            for text, drops in zip(batch["text"], batch["drops"].to_pylist(), strict=True):
                parts = text.as_py().split(b"\n")
                keep = keep_bits(len(parts), drops)
                n.append(len(parts))
                gone.append(int(len(parts) - keep.sum()))
                bits.append(zlib.compress(np.packbits(keep).tobytes(), 1))
                sums.append(hashlib.sha256(_join(parts, keep, drops)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(bits, pa.binary()), pa.array(sums, pa.string())], ["doc", "n_lines", "n_dropped", "keep", "kept_sha256"])

    out = _apply(docs, dropped(docs, least_points, least_docs), run, "doc long, n_lines long, n_dropped long, keep binary, kept_sha256 string")
    return out.select("doc_id", "n_lines", "n_dropped", "keep", "kept_sha256")


def _join(parts, keep, drops) -> bytes:
    return b"\n".join(parts if drops is None else [x for x, k in zip(parts, keep, strict=True) if k])


def clean(docs: DataFrame, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with all its columns, and with text and n_chars as they are without the lines that go.

    A null text stays null, an empty one empty; neither holds lines that count. Rows that share a doc_id count as one
    document, a null id is the least id, and repeated rows lose the same lines. A document that loses all its lines
    stays, with an empty text. Columns may have any names; n_chars, where there is one, counts code points. Empty docs
    give no rows.
    """
    doc, row, lost = spare(docs, "doc", "row", "drops")
    drops = dropped(docs, least_points, least_docs).toDF(doc, row, lost)
    keys = docs.withColumns({doc: id_key(), row: F.xxhash64(F.coalesce("text", F.lit("")))})
    # Columns go by number through Arrow, which takes names as expressions.
    number = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    both = keys.join(drops.hint("shuffle_hash"), [doc, row], "left").select(*[c.alias(n) for c, n in zip(columns(docs), number.values(), strict=True)], F.col(lost).alias("drops"))

    def run(batches):
        for batch in batches:
            texts, size = [], []
            for text, gone in zip(batch[number["text"]].to_pylist(), batch["drops"].to_pylist(), strict=True):
                if gone is not None:
                    parts = text.split("\n")
                    text = "\n".join(x for x, k in zip(parts, keep_bits(len(parts), gone), strict=True) if k)
                texts.append(text)
                size.append(len(text) if text is not None else None)
            out = {n: batch[n] for n in number.values()} | {number["text"]: pa.array(texts, pa.string())}
            if "n_chars" in number:
                out[number["n_chars"]] = pa.array(size, out[number["n_chars"]].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = T.StructType([T.StructField(number[f.name], f.dataType) for f in docs.schema.fields])
    return both.mapInArrow(run, schema).toDF(*docs.columns)
