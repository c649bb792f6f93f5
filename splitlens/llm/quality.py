"""Document quality: random-indexing word vectors, pooled, and a small calibrated network.

Words get sparse random index vectors; a word's vector is the sum of the index vectors of the words
up to two places away, over the whole corpus.  Words are hashed into a fixed number of buckets, so
the table of vectors has one size at any corpus size.  Tokens are runs of letters and digits and
runs of other signs; a capitals-only word and an immediate repeat have buckets of their own.  A
document is the mean of its words' unit vectors.  A two-layer network in numpy is fitted on a
bounded labelled sample and its logits are divided by a temperature fitted on a part of that sample
that the network did not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import Shipped, unpack
from splitlens.llm.labelled import MAX_LABELLED, fold_of, labelled_sample
from splitlens.llm.textkernel import PIECE, lower_table, run_hashes, token_runs, utf8

BUCKETS = 1 << 14
DIM = 64
NONZERO = 4
WINDOW = 2
SLICES = 32
HIDDEN = 32
SEED = 7
THRESHOLD = 0.3
HELD_OUT = 0
CALIBRATION = 1
_CAPS, _REPEAT = 0, 1  # buckets of the two shape tokens


def token_classes() -> np.ndarray:
    """0 white space, 1 letters, digits and all non-ASCII bytes, 2 other signs."""
    t = np.full(256, 2, dtype=np.uint8)
    t[[32, 9, 10, 11, 12, 13]] = 0
    t[48:58] = t[65:91] = t[97:123] = t[128:] = 1
    return t


def token_buckets(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of rows: (first row, end row, token buckets, token bounds of each row)."""
    classes, lower = token_classes(), lower_table()
    upper_sign = np.zeros(256, dtype=np.int32)
    upper_sign[65:91] = 1
    lower_sign = np.zeros(256, dtype=np.int32)
    lower_sign[97:123] = lower_sign[128:] = 1
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1
        j = min(max(j, i + 1), n)
        part = buf[off[i]:off[j]]
        marks = off[i:j] - off[i]
        found = []
        # a long row is cut every PIECE bytes: at worst one word in a million bytes is cut in two
        cuts = [0, len(part)] if len(part) <= PIECE else [*range(0, len(part), PIECE), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            piece = part[a:b]
            starts, ends = token_runs(piece, classes, marks[marks < b - a] if a == 0 else np.zeros(1, np.int64))
            if not len(starts):
                continue
            h = run_hashes(piece, starts, ends, lower)
            upper = np.add.reduceat(upper_sign[piece], starts)  # up to the next token: only white space between
            small = np.add.reduceat(lower_sign[piece], starts)
            bucket = (h % np.uint64(BUCKETS - 2)).astype(np.int64) + 2
            word = classes[piece[starts]] == 1
            # repeats are judged between words, over the signs between them
            at = np.flatnonzero(word)
            again = at[1:][h[at[1:]] == h[at[:-1]]]
            bucket[word & (upper >= 2) & (small == 0)] = _CAPS
            bucket[again] = _REPEAT
            found.append((bucket, starts + a))
        tokens = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        places = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        yield i, j, tokens, np.searchsorted(places, off[i:j + 1] - off[i])
        i = j


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Axes and signs of the sparse random vector of each bucket."""
    rng = np.random.default_rng(SEED)
    axes = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return axes.astype(np.int64), rng.choice([-1.0, 1.0], size=(BUCKETS, NONZERO))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    axes, signs = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    seen = False
    for batch in batches:
        for _, _, tokens, bounds in token_buckets(*utf8(batch.column("text"))):
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for d in range(1, WINDOW + 1):
                same = row[d:] == row[:-d]
                a, b = tokens[:-d][same], tokens[d:][same]
                if len(a):
                    seen = True
                    for x, y in ((a, b), (b, a)):
                        total += np.bincount((x[:, None] * DIM + axes[y]).ravel(), signs[y].ravel(), BUCKETS * DIM)
    if seen:
        parts = total.astype("<f4").reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                         names=["slice", "part"])


def _add(rows: pa.Table) -> pa.Table:
    total = unpack(rows.column("part"), "<f4").reshape(rows.num_rows, -1).sum(axis=0, dtype=np.float64)
    return pa.table({"slice": rows.column("slice").slice(0, 1).cast(pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) unit vectors from all documents; the table has one size at any corpus size."""
    rows = (docs.select("text").mapInArrow(_contexts, "slice int, part binary").groupBy("slice")
            .applyInArrow(_add, "slice int, part binary").collect())
    v = np.zeros((SLICES, BUCKETS * DIM // SLICES))
    for r in rows:
        v[r["slice"]] = np.frombuffer(r["part"])
    v = v.reshape(BUCKETS, DIM)
    return (v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def pool(text: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each row; zeros for a text without words."""
    out = np.zeros((len(text), DIM))
    for i, j, tokens, bounds in token_buckets(*utf8(text)):
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        if len(full) == 1:  # a long row, in parts
            for a in range(0, len(tokens), 1 << 18):
                out[i + full[0]] += vectors[tokens[a:a + (1 << 18)]].sum(axis=0, dtype=np.float64)
        elif len(full):
            out[i + full] = np.add.reduceat(vectors[tokens], bounds[:-1][full], axis=0)
        out[i:j] /= np.maximum(size, 1)[:, None]
    return out


class Network:
    """tanh hidden layer, logistic output, Adam on the whole batch; temperature for calibration."""

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.01, decay: float = 1e-4) -> "Network":
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, steps + 1):
            h = np.tanh(z @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [z.T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()])]
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        self.params, self.temperature = p, 1.0
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.params
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Network":
        """The temperature of least log loss on rows the network did not see."""
        if len(y) and y.min() != y.max():
            z = self.logits(x)
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
            loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


class Constant:
    def __init__(self, p: float):
        self.p = p

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def _pooled(vectors_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column("text"), vectors_of.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("fold"), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["doc_id", "label", "fold", "x"])
    return run


def fit_quality(docs: DataFrame, labels: DataFrame, vectors_of, max_labelled: int = MAX_LABELLED) -> Network | Constant:
    sample = labelled_sample(docs, labels, "quality", max_labelled, HELD_OUT)
    rows = sample.mapInArrow(_pooled(vectors_of), "doc_id long, label int, fold int, x binary").orderBy("doc_id", "x", "label").collect()
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(len(rows), DIM)
    y = np.array([r["label"] > 0 for r in rows], dtype=np.float64)
    fold = np.array([r["fold"] for r in rows], dtype=np.int64)
    own = fold != CALIBRATION
    if own.sum() == 0 or y[own].min() == y[own].max():
        return Constant(float((y.sum() + 1) / (len(y) + 2)))
    return Network().fit(x[own], y[own]).calibrate(x[~own], y[~own])


def _score(vectors_of, model_of, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model_of.value.predict(pool(batch.column("text"), vectors_of.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels are learned only from rows with crc32(doc_id) mod 5 <> 0 (``held_out`` marks the others;
    a null id is not held out).  Null and empty texts are scored as documents without words.  With
    labels of one kind only, or none, the score is their smoothed share; empty ``docs`` give an
    empty result."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = Shipped(spark, word_vectors(docs))
    model = Shipped(spark, fit_quality(docs, labels, vectors, max_labelled))
    return (docs.withColumn("held_out", F.coalesce(fold_of() == HELD_OUT, F.lit(False)))
            .mapInArrow(_score(vectors, model, threshold), "doc_id long, held_out boolean, score double, predicted int"))
