"""Bounded sample of labelled documents, and plain logistic regression for small dense features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
ROWS = 1024  # rows widened to doubles at once


def fold_of(doc_id="doc_id"):
    """crc32 of the id as text, modulo 5."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int = MAX_LABELLED,
                    held_out: int | None = None) -> DataFrame:
    """(doc_id, text, label, fold) of about ``max_labelled`` labelled documents at most.

    A classifier may be fitted on a bounded sample: beyond the bound, rows are taken by the hash of
    their id.  Null labels and ids are left out, a repeated id takes its largest label; rows of fold
    ``held_out`` are left out before sampling."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
             .withColumn("fold", fold_of()))
    if held_out is not None:
        known = known.filter(F.col("fold") != held_out)
    share = min(1.0, max_labelled / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(known, "doc_id")


def side_by_side(parts: Sequence[np.ndarray], rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The chosen rows of matrices that stand beside each other, ``ROWS`` at a time: (places in ``rows``, block of doubles)."""
    for i in range(0, len(rows), ROWS):
        at = slice(i, i + ROWS)
        yield at, np.column_stack([p[rows[at]] for p in parts]).astype(np.float64, copy=False)


class Logistic:
    """L2-regularised logistic regression by Newton steps; a constant when only one class is seen."""

    def __init__(self, penalty: float = 0.3):
        self.penalty = penalty

    def fit(self, parts: Sequence[np.ndarray], y: np.ndarray, rows: np.ndarray) -> "Logistic":
        """Fitted to the given rows of the matrices ``parts``, side by side, and of ``y``; the whole matrix is never made."""
        n, d, y = len(rows), sum(p.shape[1] for p in parts), y[rows]
        p = (y.sum() + 0.5) / (n + 1) if n else 0.0
        self.weights = np.zeros(d)
        self.bias = float(np.log(p / (1 - p))) if 0 < p < 1 else -30.0
        if n == 0 or y.min() == y.max():
            return self
        w = np.r_[self.weights, self.bias]
        reg = np.r_[np.full(d, self.penalty), 1e-6]
        for _ in range(25):
            grad, hess = reg * w, np.diag(reg)
            for at, x in side_by_side(parts, rows):
                a = np.column_stack([x, np.ones(len(x))])
                q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                grad += a.T @ (q - y[at])
                hess += (a * (q * (1 - q))[:, None]).T @ a
            step = np.linalg.solve(hess, grad)
            w = w - step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        self.weights, self.bias = w[:-1], float(w[-1])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))
