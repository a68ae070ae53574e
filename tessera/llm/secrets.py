"""Secret scans: rules are regular expressions, and a trigram index tells which texts can match.

From each rule's regular expression a Boolean query over trigrams is derived that any match satisfies. The index is
inverted: a posting is a trigram that a text holds, and the document. Postings are intersected and united as the query
says, and only documents that satisfy it are scanned for the rule. A rule without a mandatory trigram (runs of
hexadecimal digits) scans every text. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key
from .trigrams import ALL, Query, trigram_query


@dataclass(frozen=True)
class Rule:
    """``group`` of a match (0: all of it) must have at least ``least`` characters; other matches are dropped."""

    kind: str
    pattern: str
    group: int
    least: int

    def trigrams(self) -> Query:
        return trigram_query(self.pattern)


#: The base rules come first, in the order of their kinds. A shorter form of the same matches stands for
#: ``AKIA[A-Z0-9]+`` of 18 characters and ``[0-9a-f]+`` of 16: both match whole runs, from the leftmost on.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=~-]{20,}", 0, 20),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    Rule("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 20),
)


def _any_of(trigrams: list[str]) -> str:
    """A regular expression that finds, at each place of a text, the trigram that begins there, if it is one of these."""
    quoted = lambda x: "".join(c if c.isalnum() else "\\" + c for c in x)
    by_first = {c: [quoted(t[1:]) for t in trigrams if t[0] == c] for c in sorted({t[0] for t in trigrams})}
    return "(?=(" + "|".join(f"{quoted(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + "))"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc, row: the inverted index of docs (doc, row, text), of the trigrams that rules can ask for.

    Letters A-Z count as a-z.
    """
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(trigrams)), F.lit(1)))
    return docs.select("doc", "row", F.explode_outer(held).alias("trigram")).where("trigram is not null")


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc, row, and for each of the rules, all with a trigram query, whether the document satisfies it."""
    queries = {r.kind: sorted(map(sorted, r.trigrams())) for r in rules}
    has = {t: F.max(F.col("trigram") == t) for t in sorted({t for q in queries.values() for all_ in q for t in all_})}
    holds = {kind: reduce(Column.__or__, [reduce(Column.__and__, [has[t] for t in all_]) for all_ in q]) for kind, q in queries.items()}
    return index.groupBy("doc", "row").agg(*[c.alias(f"may_{kind}") for kind, c in holds.items()])


def spans_of(text: Column, rule: Rule) -> Column:
    """kind, start, end (code points, end exclusive) and value of each match, leftmost and not overlapping.

    The pieces between the matches and the matches themselves, in turn, give the places.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("found"), groups.alias("group"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out"))

    def step(acc, part):
        begin = acc["at"] + part["gap"]
        end = begin + F.length(part["found"])
        span = F.struct(F.lit(rule.kind).alias("kind"), begin.alias("start"), end.alias("end"), part["found"].alias("value"))
        good = F.length(part["group"]) >= rule.least
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """doc_id and secrets (an array of kind, start, end and value by start, then rule) of every row of docs.

    Places are in code points. Null and empty texts have no secrets. A null id stays null; rows that share an id are
    scanned each. Other columns of docs are passed over. Empty docs give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(id_key().alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    asked = [r for r in rules if r.trigrams() != ALL]
    trigrams = sorted({t for r in asked for all_ in r.trigrams() for t in all_})
    may = candidates(postings(keyed, trigrams), asked)
    both = keyed.join(may.hint("shuffle_hash"), ["doc", "row"], "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    found = both.select("doc", *[
        (F.when(F.col(f"may_{r.kind}") if r in asked else F.col("text").rlike(r.pattern), spans_of(F.col("text"), r)).otherwise(none)).alias(r.kind) for r in rules
    ])
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    ordered = F.array_sort(F.transform(F.flatten(F.array(*[r.kind for r in rules])), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s.alias("span"))))
    return found.select(id_back("doc").alias("doc_id"), F.transform(ordered, lambda x: x["span"]).alias("secrets"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
