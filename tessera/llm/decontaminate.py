"""Benchmark decontamination by winnowing, in DataFrame functions throughout.

Fingerprints are hashes of 7 consecutive words; of each 4 consecutive ones the least is kept. A shared run of 10 words
therefore always shares a kept fingerprint. The kept fingerprints of a text make runs of places: windows of 10 words
that have the same one. Documents' runs are joined to the benchmark's fingerprints, and each hit is extended to the
windows of its run alone, which are compared word by word. Items of fewer words are one window, with fingerprints of as
many words as their length allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, columns, id_back, id_key, spare, split_join

WINDOW = 10
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark tables of up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased words; letters other than A-Z keep their case."""
    plain = F.length(text) == F.octet_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _APART, -1), "")


def _pairs(x: Column, shift: int, f) -> Column:
    return F.zip_with(x, F.slice(x, F.lit(shift + 1), F.greatest(F.size(x) - shift, F.lit(0))), f)


def _span(length: int) -> int:
    """Of so many consecutive fingerprints one is kept, so that any window of ``length`` words has one."""
    return max(1, length * 2 // 5)


def _slid(df: DataFrame, name: str, size: int, f) -> DataFrame:
    """df with f over each ``size`` consecutive elements of df[name]; what stands at the end, beyond these, has no meaning.

    Each step is a column of its own, so that none is worked out twice.
    """
    width = 1
    while width < size:
        shift = min(width, size - width)
        df = df.withColumn(name, _pairs(F.col(name), shift, f))
        width += shift
    return df


def _starts(name: str) -> Column:
    """The places where df[name] has another value than just before."""
    places = F.when(F.size(name) > 0, F.sequence(F.lit(0), F.size(name) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (F.get(name, i) != F.get(name, i - 1)))


def _between(name: str, starts: str, length: int) -> Column:
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(name)))
    mark = lambda i: F.xxhash64(F.get(name, i), F.lit(length))
    return F.zip_with(starts, ends, lambda i, j: F.struct(i.alias("at"), j.alias("end"), F.lit(length).alias("length"), mark(i).alias("fingerprint")))


def _runs(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """texts (with words) and runs: at, end, length and fingerprint of windows from place ``at`` up to ``end`` that have
    the same kept fingerprint, for each length of windows."""
    df = texts.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    each = []
    for length in lengths:
        span, name = _span(length), f"m{length}"
        df = _slid(df.withColumn(name, F.col("h")), name, length - span + 1, lambda a, b: F.xxhash64(a, b))
        df = _slid(df, name, span, lambda a, b: F.least(a, b))
        df = df.withColumn(name, F.slice(name, F.lit(1), F.greatest(F.size("words") - (length - 1), F.lit(0))))
        df = df.withColumn(f"s{length}", _starts(name))
        each.append(_between(name, f"s{length}", length))
    # Of an empty list of places the zip has its end alone, which no fingerprint goes with.
    return df.withColumn("runs", F.filter(F.concat(*each), lambda r: r["at"].isNotNull())).select(*texts.columns, "runs")


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _windows(runs: Column) -> Column:
    """The windows of runs, with their words."""

    def of(run):
        text = lambda i: F.array_join(F.slice(F.col("words"), i + 1, run["length"]), " ")
        return F.transform(F.sequence(run["at"], run["end"] - 1), lambda i: F.struct(i.alias("at"), run["length"].alias("length"), text(i).alias("window")))

    # That the words are asked for twice keeps Spark from splitting the text anew for each window.
    return F.when(F.size("words") > 0, F.flatten(F.transform(runs, of)))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc, row, spans (at, length) and items of docs with hits.

    Arrays are exploded with a null for an empty one, which no join finds: else Spark works the arrays out twice, to
    filter by their size.
    """
    keyed = _keyed(docs)
    split = keyed.select("doc", "row", words(F.col("text")).alias("words"))
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")).where("size(words) > 0")
    items = checkpointed(items.withColumn("length", F.least(F.size("words"), F.lit(WINDOW))))
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # at most WINDOW numbers
    if not lengths:
        return keyed.where("false").select("doc", "row", F.array().cast("array<struct<at:int,length:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))

    own = F.filter("runs", lambda r: r["length"] == F.col("length"))
    known = _runs(items, lengths).withColumn("runs", own)
    marks = checkpointed(known.select(F.explode_outer("runs.fingerprint").alias("fingerprint")).distinct())
    of = checkpointed(known.select("item", F.explode_outer(_windows(F.col("runs"))).alias("w")).select("item", F.xxhash64("w.window").alias("key"), "w.length", "w.window").distinct())

    each = _runs(split, lengths).select("doc", "row", F.explode_outer("runs").alias("run")).select("doc", "row", "run.*")
    found = each.join(F.broadcast(marks) if _small(marks) else marks, "fingerprint", "left_semi")
    found = checkpointed(found.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "end", "length")).alias("runs")))

    some = keyed.join(found.hint("shuffle_hash"), ["doc", "row"]).select("doc", "row", "runs", words(F.col("text")).alias("words"))
    some = some.select("doc", "row", F.explode_outer(_windows(F.col("runs"))).alias("w")).select("doc", "row", "w.at", F.xxhash64("w.window").alias("key"), "w.length", "w.window")
    if _small(of):
        at = some.join(F.broadcast(of), ["key", "length", "window"])
    else:
        some = checkpointed(some)
        at = split_join(some, of, ["key", "length", "window"], ["doc", "at"], some.groupBy("key").agg(F.count("*").alias("n")))
    return at.groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct("at", "length"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc: the id, where null is the least; row: hash of the text, so that rows that share an id are told apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(id_key().alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, which are in order."""

    def step(acc, s):
        end = s["at"] + s["length"]
        more = F.greatest(end - F.greatest(s["at"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(end, acc["end"]).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings) and spans (at, length, in words) of every row of docs.

    Null and empty texts have no words and no hits; so have null and wordless items. An item of fewer than ten words
    is one window; one with a null id is the item "". Items that share an id are one item. A null doc_id stays null;
    rows that share an id are judged by their own text, and rows that repeat id and text give one row each. Other
    columns of either table are passed over. Empty tables give no rows or no hits.
    """
    at = hits(docs, benchmark)
    counted = _keyed(docs).select("doc", "row", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(at.hint("shuffle_hash"), ["doc", "row"], "left").select(
        id_back("doc").alias("doc_id"), "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<at:int,length:int>>")).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item.

    Null and empty texts stay; rows that share an id are judged by their own text; repeated rows stay or go together.
    Columns may have any names. Without items all rows stay. Empty docs give no rows.
    """
    doc, row = spare(docs, "doc", "row")
    bad = hits(docs, benchmark).select(F.col("doc").alias(doc), F.col("row").alias(row))
    keys = docs.withColumns({doc: id_key(), row: F.xxhash64(F.coalesce("text", F.lit("")))})
    return keys.join(bad.hint("shuffle_hash"), [doc, row], "left_anti").select(*columns(docs))
