"""Hashed features of texts, and the two models over them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import ranges
from .common import Words, chunks, hash64, held_out, mix

#: Rows that a model is fitted on at most, and the longest text among them, in characters. Scoring has no limits.
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 50_000
#: Characters whose features are held at once.
CHUNK = 2_000_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_STEPS = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F], np.uint64)


def shape(word: str) -> str:
    """The kind of a token: case pattern of a word, or a run of marks cut to three."""
    if word[0].isalnum() or word[0] == "_":
        if word.isdigit():
            return "0"
        return "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a" if word.islower() else "aA"
    return word[:3]


#: Lengths of the beginnings of words that count as terms of their own, for inflected and compound words.
STEMS = (4, 5, 6)


def _word_rows(word: str) -> tuple[int, int]:
    return hash64(word.lower()), hash64("shape " + shape(word))


def _stem_rows(word: str) -> tuple[int, ...]:
    low = word.lower()
    return *_word_rows(word), *(hash64(f"stem {low[:n]}") if len(low) >= n else 0 for n in STEMS)


def _grams(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of tokens, none of which cross from one document into the next."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total = total * _STEPS[0] + hashes[i : i + size] * _STEPS[i % 3]
    inside = docs[:size] == docs[n - 1 : n - 1 + size]
    return mix(total + np.uint64(n))[inside], docs[:size][inside]


class Features:
    """Hashed n-grams of the words, and of their shapes, in 2**bits places.

    ``words`` and ``shapes`` name the lengths of the n-grams taken of each; ``repeats`` adds a feature for a word
    that equals the one before, ``stems`` one for each beginning of 4 to 6 letters of a word.
    """

    def __init__(self, bits: int, words=(1, 2), shapes=(), repeats: bool = False, stems: bool = False):
        self.bits, self.words, self.shapes, self.repeats, self.stems = bits, words, shapes, repeats, stems
        self.forget()

    def forget(self) -> None:
        """Drops the words that have been numbered so far."""
        self.vocabulary = Words(_stem_rows, 2 + len(STEMS)) if self.stems else Words(_word_rows, 2)

    def __getstate__(self):
        return {"bits": self.bits, "words": self.words, "shapes": self.shapes, "repeats": self.repeats, "stems": self.stems}

    def __setstate__(self, state):
        self.__init__(**state)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and the documents they are in, aligned; and tokens in each document."""
        tokens = [_TOKEN.findall(x) for x in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(texts))
        docs = np.repeat(np.arange(len(texts)), sizes)
        rows = self.vocabulary.hashes([x for one in tokens for x in one])
        parts = [_grams(rows[:, 0], docs, n) for n in self.words] + [_grams(rows[:, 1], docs, n) for n in self.shapes]
        if self.repeats and len(rows):
            same = np.flatnonzero((rows[1:, 0] == rows[:-1, 0]) & (docs[1:] == docs[:-1]))
            parts.append((np.full(len(same), 0x5851F42D4C957F2D, np.uint64), docs[same]))
        for column in range(2, rows.shape[1]):
            has = np.flatnonzero(rows[:, column])
            parts.append((rows[has, column], docs[has]))
        places = np.concatenate([p for p, _ in parts]) >> np.uint64(64 - self.bits)
        return places.astype(np.int64), np.concatenate([d for _, d in parts]), sizes


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, balanced: bool = False) -> tuple[list[str], np.ndarray, float]:
    """A bounded, repeatable choice of labelled texts, and the log odds of label 1 among all labels that may be learnt.

    Only rows outside the held-out fifth are taken, those with the least id hashes; ``balanced`` takes as many of
    either label if there are enough. Labels other than 0 and 1 and null ids are passed over; of repeated labels the
    larger counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    if balanced:
        ones = known.where("label = 1").orderBy(*order).limit(rows // 2)
        some = ones.unionAll(known.where("label = 0").orderBy(*order).limit(rows // 2))
    else:
        some = known.orderBy(*order).limit(rows)
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars)
    # The broadcast side has at most ``rows`` rows of two numbers; repeated ids in docs are bounded by the last limit.
    got = texts.join(F.broadcast(some), "doc_id").orderBy(*order, "text").limit(rows).select("text", "label").toArrow()
    odds = float(np.log((counts.ones + 0.5) / (counts.n - counts.ones + 0.5)))
    return got["text"].to_pylist(), np.asarray(got["label"].to_pylist(), np.float64), odds


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def prior(y: np.ndarray) -> float:
    """Log odds of label 1, drawn towards even odds by one row."""
    return float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))


@dataclass
class Logistic:
    """Logistic regression over hashed n-grams; a feature's value is its count over the square root of all counts."""

    features: Features
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, texts, y, features: Features, epochs=6, alpha=0.3, beta=1.0, l1=0.05, l2=0.5, batch=32) -> Logistic:
        """FTRL-proximal: each place keeps the sum of its gradients and of their squares, and the weight follows from them."""
        size = 1 << features.bits
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        z0 = prior(y) if len(y) else 0.0

        def weight(at):
            return np.where(np.abs(z[at]) <= l1, 0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

        parts = [cls._rows(features, part) for part in chunks(texts, CHUNK)]
        held, weights, sizes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3
        del parts
        begins = np.cumsum(sizes) - sizes
        rng = np.random.default_rng(7)
        for _ in range(epochs if len(sizes) else 0):
            order = rng.permutation(len(sizes))
            for start in range(0, len(order), batch):
                some = order[start : start + batch]
                at = ranges(begins[some], sizes[some])
                places = np.concatenate([held[at], np.full(len(some), size)])
                values = np.concatenate([weights[at], np.ones(len(some))])
                who = np.concatenate([np.repeat(np.arange(len(some)), sizes[some]), np.arange(len(some))])
                at, back = np.unique(places, return_inverse=True)
                w = weight(at)
                error = sigmoid(z0 + np.bincount(who, w[back] * values, len(some))) - y[some]
                g = np.bincount(back, values * error[who], len(at))
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        w = weight(np.arange(size + 1))
        return cls(features, w[:-1].astype(np.float32), float(w[-1]) + z0)

    @staticmethod
    def _rows(features, texts):
        """Places and values of all texts, one after another, and the number of them in each text."""
        places, docs, _ = features.of(texts)
        key, count = np.unique(docs << features.bits | places, return_counts=True)
        doc = key >> features.bits
        totals = np.bincount(docs, minlength=len(texts))
        return (key & ((1 << features.bits) - 1)).astype(np.int32), (count / np.sqrt(totals[doc])).astype(np.float32), np.bincount(doc, minlength=len(texts))

    def score(self, texts: list[str]) -> np.ndarray:
        places, docs, _ = self.features.of(texts)
        total = np.bincount(docs, minlength=len(texts))
        return sigmoid(self.bias + np.bincount(docs, self.weights[places], len(texts)) / np.sqrt(np.maximum(total, 1)))


def _paired(place, doc, y, df, pair: float, most: int) -> np.ndarray:
    """Places of terms that have a partner: texts with both have another share of label 1 than those with either have.

    By a chi-square of more than ``pair`` given either one, so that a strong term doesn't choose all that stand beside it.
    Looked at are the ``most`` terms that tell texts apart most often; too rare ones can't reach that chi-square.
    """
    n = len(y)
    share = df / max(n, 1)
    some = np.sort(np.argsort(-share * (1 - share), kind="stable")[:most])
    some = some[df[some] * max(1, n) > pair]
    number = np.full(len(df), -1)
    number[some] = np.arange(len(some))
    keep = number[place] >= 0
    by_label = np.argsort(-y, kind="stable")
    text = np.argsort(by_label)[doc[keep]]
    has = np.zeros((n, len(some)), np.float32)
    has[text, number[place[keep]]] = 1
    positive = has[: int(y.sum())]
    rate = np.clip(positive.sum(0) / np.maximum(has.sum(0), 1), 0.02, 0.98)
    found = np.zeros(len(some), bool)
    for a in range(0, len(some), 512):
        both, ones = has[:, a : a + 512].T @ has, positive[:, a : a + 512].T @ positive
        chi = np.full(both.shape, np.inf, np.float32)
        for r in (rate[a : a + 512, None], rate[None, :]):
            np.minimum(chi, (ones - both * r) ** 2 / np.maximum(both * r * (1 - r), 1e-6), out=chi)
        chi[both < 5] = 0
        chi[np.arange(len(chi)), a + np.arange(len(chi))] = 0
        i, j = np.nonzero(chi > pair)
        found[a + i] = found[j] = True
    return some[found]


@dataclass
class FactorizationMachine:
    """Second-order factorization machine over the terms that a text has or has not.

    score = sigmoid(bias + sum of w_i + sum over pairs i < j of <v_i, v_j>), i and j over the text's terms.
    """

    features: Features
    places: np.ndarray = field(repr=False)
    w: np.ndarray = field(repr=False)
    v: np.ndarray = field(repr=False)
    bias: float = 0.0

    @classmethod
    def fit(cls, texts, y, features: Features, terms=4096, least=3, rank=8, epochs=20, steps=1000, rate=0.1, l1=2e-3, l2=1e-3, batch=64, sure=16.0, pair=32.0) -> FactorizationMachine:
        """Adagrad on log loss, with soft thresholds on w, for ``epochs`` or, of few texts, for ``steps`` batches.

        Over up to ``terms`` terms that go with the label by themselves, by a chi-square of more than ``sure``, and all
        those of which two go with it together, by one of more than ``pair``, whatever each says alone.
        """
        parts, first = [], 0
        for part in chunks(texts, CHUNK):
            places, docs, _ = features.of(part)
            parts.append(np.unique((docs + first) << features.bits | places))
            first += len(part)
        keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        place, doc = keys & ((1 << features.bits) - 1), keys >> features.bits
        size = 1 << features.bits
        df, positive = np.bincount(place, minlength=size), np.bincount(place, y[doc], size)
        share = y.mean() if len(y) else 0
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = np.where(df >= least, (positive - df * share) ** 2 / (df * share * (1 - share)), 0)
        chosen = np.sort(np.argsort(-np.nan_to_num(chi), kind="stable")[:terms])
        chosen = chosen[np.nan_to_num(chi[chosen]) > sure]
        chosen = np.union1d(chosen, _paired(place, doc, y, df, pair, terms))
        number = np.full(size, -1)
        number[chosen] = np.arange(len(chosen))
        term, keep = number[place], number[place] >= 0
        term, doc = term[keep], doc[keep]
        ends = np.searchsorted(doc, np.arange(1, max(len(y), 1)))
        rows = np.split(term, ends)
        rng = np.random.default_rng(11)
        w, v = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), rank))
        bias, gw, gv, gb = prior(y) if len(y) else 0.0, np.full(len(chosen), 1e-2), np.full((len(chosen), rank), 1e-2), 1.0
        for _ in range(max(epochs, -(-steps * batch // max(1, len(y)))) if len(chosen) else 0):
            order = rng.permutation(len(y))
            for start in range(0, len(order), batch):
                some = order[start : start + batch]
                who = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
                at = np.concatenate([rows[i] for i in some])
                sums = np.zeros((len(some), rank))
                np.add.at(sums, who, v[at])
                squares = np.bincount(who, (v[at] ** 2).sum(1), len(some))
                error = sigmoid(bias + np.bincount(who, w[at], len(some)) + 0.5 * ((sums**2).sum(1) - squares)) - y[some]
                error /= len(some)
                used, back = np.unique(at, return_inverse=True)
                d = np.bincount(back, error[who], len(used))
                dv = np.zeros((len(used), rank))
                np.add.at(dv, back, error[who, None] * (sums[who] - v[at]))
                dv += l2 * v[used]
                gw[used] += d * d
                gv[used] += dv * dv
                step = rate / np.sqrt(gw[used])
                new = w[used] - step * d
                w[used] = np.sign(new) * np.maximum(0, np.abs(new) - step * l1)
                v[used] -= rate / np.sqrt(gv[used]) * dv
                gb += (e := error.sum()) * e
                bias -= rate / np.sqrt(gb) * e
        return cls(features, chosen, w.astype(np.float32), v.astype(np.float32), float(bias))

    def score(self, texts: list[str]) -> np.ndarray:
        places, docs, _ = self.features.of(texts)
        if not len(self.places):
            return np.full(len(texts), sigmoid(self.bias))
        at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        keep = self.places[at] == places
        key = np.unique(docs[keep] * len(self.places) + at[keep])
        doc, term = key // len(self.places), key % len(self.places)
        total = np.bincount(doc, self.w[term], len(texts)) + self.bias
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            total += 0.5 * (np.bincount(doc, x, len(texts)) ** 2 - np.bincount(doc, x * x, len(texts)))
        return sigmoid(total)


def score_texts(docs: DataFrame, model, threshold: float) -> DataFrame:
    """doc_id, score and predicted of each row of docs; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            scores = np.concatenate([model.score(part) for part in chunks(texts, CHUNK)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accuracy(scored: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows, right predictions, and recall of either label, among labelled rows that were held out."""
    both = scored.where("held_out").join(labels.select("doc_id", F.col(label).alias("label")), "doc_id")
    hit = (F.col("predicted") == F.col("label")).cast("double")
    return both.agg(F.count("*").alias("rows"), F.avg(hit).alias("accuracy"), F.avg(F.when(F.col("label") == 1, hit)).alias("recall_1"), F.avg(F.when(F.col("label") == 0, hit)).alias("recall_0"))
