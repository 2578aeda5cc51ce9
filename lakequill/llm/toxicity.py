"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, alpha / (beta + sqrt(sum of squared gradients)), and the proximal step sets it
to exactly zero while its gradients stay within L1, so the weights that remain are few and are broadcast as (index, value).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, table
from .linear import fold, folded, grams, indices, scored, sigmoid, trained, training_rows
from .words import word_hashes

BITS = 20
ALPHA, BETA, L2 = 2.0, 1.0, 0.0
L1 = 8.0
EPOCHS = 5
THRESHOLD = 0.5
_BIAS = 1 << BITS


def features(text: bytes) -> np.ndarray:
    """Words, pairs of neighbours and pairs that skip one word, hashed; each counts once."""
    w = word_hashes(folded(text))
    return indices([grams(w, (0,), 1), grams(w, (0, 1), 2), grams(w, (0, 2), 3)], BITS)


def ftrl(xs: list[np.ndarray], ys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features with their weights, the last being the bias (and no norm shares); L1 does not hold the bias."""
    z, n = (np.zeros(_BIAS + 1) for _ in range(2))
    for _ in range(EPOCHS):
        for x, y in zip(xs, ys, strict=True):
            x = np.append(x, _BIAS)
            zx, nx = z[x], n[x]
            wx = np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            wx[-1] = -zx[-1] / ((BETA + np.sqrt(nx[-1])) / ALPHA)
            g = sigmoid(float(wx.sum())) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * wx
            n[x] = nx + g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    at = np.flatnonzero(w)
    return at, w[at], np.zeros(len(at))


def _learned(docs: DataFrame, labels: DataFrame) -> tuple[tuple[np.ndarray, ...], float]:
    """The weights and the bias, learned from the labels outside the held-out fold."""
    rows, shift = training_rows(docs, labels, "toxic", 5, 0)
    at, w, v = trained(rows, features, ftrl)
    keep = at != _BIAS
    return (at[keep], w[keep], v[keep]), float(w[~keep].sum()) + shift


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; learned from the labels outside the held-out fold.

    Null and empty texts get the bias alone; texts of any length are scored whole; without any label every score is 0.5; rows
    that repeat an id are scored one by one; a score equal to the threshold is predicted 1; an empty table gives an empty
    result; columns other than doc_id and text are ignored.
    """
    weights, bias = _learned(docs, labels)
    return scored(docs, fold("doc_id", 5, 0), THRESHOLD, features, 1 << BITS, weights, lambda s, _: sigmoid(s + bias))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic. They are filtered where they are read; nothing of them is shuffled.

    Null and empty texts are judged by the bias alone, as all texts are without any label (a score of 0.5 would drop them, so
    without labels every row stays); rows that repeat an id are judged by their own text; an empty table gives an empty
    result. All columns, of any name, stay as they are.
    """
    weights, bias = _learned(docs, labels)
    if not len(weights[0]) and bias == 0:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((weights[0].astype(np.int32), weights[1]))

    @F.arrow_udf("boolean")
    def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(1 << BITS)
        at, w = shared.value
        dense[at] = w
        for batch in texts:
            yield pa.array([sigmoid(float(dense[features(t)].sum()) + bias) < THRESHOLD for part in small([batch]) for t in part.to_pylist()], pa.bool_())

    return docs.filter(passes(F.coalesce("text", F.lit("")).cast("binary")))


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
