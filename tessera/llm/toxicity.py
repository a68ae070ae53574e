"""Toxicity: a factorization machine over hashed terms, whose pairs catch what no term says alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import held_out, trimmed
from .linear import SAMPLE_CHARS, SAMPLE_ROWS, FactorizationMachine, Features, prior, sample, score_texts

THRESHOLD = 0.5


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> FactorizationMachine:
    """A model of ``labels.toxic``, fitted on at most ``rows`` labelled texts of at most ``chars`` characters.

    Either label gives up to half of the rows; the bias is then moved to the odds among all labels.
    """
    texts, y, odds = sample(docs, labels, "toxic", rows, chars, balanced=True)
    model = FactorizationMachine.fit(texts, y, Features(18, words=(1,), stems=True))
    texts.clear()
    model.features.forget()
    trimmed()
    model.bias += float(np.clip(odds - prior(y), -35, 35)) if len(y) else 0.0
    return model


def score(docs: DataFrame, labels: DataFrame, model: FactorizationMachine | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is likelier toxic) and predicted of every row of docs.

    Whole texts are scored; a null or empty text has no terms and gets the bias alone. A row with a null id is scored
    and is not held out; repeated rows are scored each. Other columns of docs are passed over. Without labels every
    score is a half. Empty docs give no rows.
    """
    scored = score_texts(docs, model or fit(docs, labels), threshold)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
