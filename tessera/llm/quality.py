"""Quality classifier: logistic regression over hashed n-grams of words and word shapes, by FTRL updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, trimmed
from .linear import CHUNK, SAMPLE_CHARS, SAMPLE_ROWS, Features, Logistic, sample, score_texts

#: A document is kept from this score on.
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Logistic:
    """A model of ``labels.quality``, fitted on at most ``rows`` labelled texts of at most ``chars`` characters.

    Without labels every score is a half.
    """
    texts, y, _ = sample(docs, labels, "quality", rows, chars)
    model = Logistic.fit(texts, y, Features(18, words=(1, 2), shapes=(1, 2, 3), repeats=True))
    texts.clear()
    model.features.forget()
    trimmed()
    return model


def score(docs: DataFrame, labels: DataFrame, model: Logistic | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better) and predicted of every row of docs.

    Whole texts are scored; a null or empty text gets the model's base rate. A row with a null id is scored and is
    not held out; repeated rows are scored each. Other columns of docs are passed over. Empty docs give no rows.
    """
    scored = score_texts(docs, model or fit(docs, labels), threshold)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, model: Logistic | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least ``threshold``."""
    model = model or fit(docs, labels)

    @F.arrow_udf("double")
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = [x or "" for x in part.to_pylist()]
            yield pa.array(np.concatenate([model.score(x) for x in chunks(texts, CHUNK)]) if texts else np.zeros(0))

    return docs.where(scores("text") >= threshold)
