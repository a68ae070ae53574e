"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id wherever ids are ordered or joined: a null id is the smallest id.
NULL_ID = -(1 << 63)
#: Text handled at once by the numeric code, in characters.
CHUNK_CHARS = 4_000_000


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> Column:
    return F.when(F.col(name) == NULL_ID, F.lit(None).cast("long")).otherwise(F.col(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where the session names none, a local master (tests) gets one of
    this machine; a cluster is refused, as its machines would not share it."""
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    if named.isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        named = context._jsc.sc().getCheckpointDir()
    return named.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` its files go when
    nothing refers to them any more; else they stay until the folder is emptied."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes for df to have none of them."""
    taken, pad = {c.lower() for c in df.columns}, "_"
    while any((pad + n).lower() in taken for n in names):
        pad += "_"
    return [pad + n for n in names]


def columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Rows of one key that a task joins, and the keys that are dealt to several tasks: the fullest ones beyond that.
FULL, FULL_KEYS = 1000, 1000


def split_join(rows: DataFrame, side: DataFrame, keys: list[str], by: list[str], counts: DataFrame | None = None, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined to side (how: "inner" or "left"), where keys with very many rows are dealt to several tasks by the columns ``by``.

    counts (or side).n: how many rows have a key, more or less. The driver learns FULL_KEYS keys at most, so that of any
    other a task gets a thousandth of all rows at most. For a full key, what side has is repeated for each part of it.
    keys[0] is a long.
    """
    counts, key = side if counts is None else counts, keys[0]
    full = counts.where(F.col(n) > FULL).select(key, n).orderBy(F.col(n).desc(), key).limit(FULL_KEYS).collect()
    if not full:
        return rows.join(side, keys, how)
    parts = min(-(-max(r[n] for r in full) // FULL), max(2, partitions(rows.sparkSession)))
    is_full = F.col(key).isin([r[key] for r in full])
    dealt = rows.withColumn("_part", F.when(is_full, F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).otherwise(0))
    each = side.withColumn("_part", F.explode(F.when(is_full, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(each, [*keys, "_part"], how).drop("_part")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_column: str = "doc_id") -> Column:
    """True for a fifth of the ids, by CRC-32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chunks(texts: Iterable[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive lists of texts with about ``most`` characters; a longer text is alone in its list."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


#: What a worker process keeps from one task to the next of the same kind.
KEPT: dict = {}


def kept_for(kind: str) -> dict:
    """KEPT for a kind of task; what other kinds have kept goes, and its memory back to the system."""
    if KEPT.get("kind") != kind:
        KEPT.clear()
        KEPT["kind"] = kind
        trimmed()
    return KEPT


def trimmed() -> None:
    """Gives memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Words(dict):
    """Numbers words as they come and keeps ``width`` hashes of each; forgets all beyond ``limit`` words."""

    def __init__(self, rows_of, width: int, limit: int = 1 << 19):
        super().__init__()
        kept_for("words")
        self.rows_of, self.limit = rows_of, limit
        self.store = np.zeros((1 << 12, width), np.uint64)

    def __missing__(self, word):
        at = self[word] = len(self)
        if at >= len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[at] = self.rows_of(word)
        return at

    def hashes(self, words: list) -> np.ndarray:
        """One row of hashes per word."""
        if len(self) > self.limit:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.store[at]


def hash64(value: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(value)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low and high bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
