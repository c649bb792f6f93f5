"""Toxicity by a classifier chain.

The labelled table marks toxic documents.  Terms that mark them (words, and stems of 4 to 6 letters) are mined from
the labelled sample by log-likelihood ratio, and three categories are predicted one after the other by
linear models over the presence of the mined terms, the number of hits and their density:

1. ``mention``: a mined term occurs,
2. ``repeated``: mined terms occur three times or more,
3. ``toxic``: the label.

Each model also gets the probabilities of the categories before it.  While training these are
out-of-fold: a row's probability comes from a model that did not see its fold, so a later model
learns from probabilities as honest as those it will meet.  Nothing but the text is an input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import Shipped
from splitlens.llm.labelled import MAX_LABELLED, ROWS, Logistic, labelled_sample, side_by_side
from splitlens.llm.textkernel import shingle_sets, utf8

CATEGORIES = ("mention", "repeated", "toxic")
MAX_TERMS = 256
MIN_SUPPORT = 3
MIN_GAIN = 15.0
MIN_SHARE = 0.05  # of the best term's gain: drops words that only a group of near copies shares
THRESHOLD = 0.5
STEMS = (4, 5, 6)
MEMO = 500_000
_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    """The word itself and its stems: beginnings of 4 to 6 letters, marked by a final ``~``."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


def _term_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted({x for w in set(_WORD.findall(t.lower())) for x in terms_of(w)}) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(terms, pa.list_(pa.string()))], names=["label", "terms"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least shingle hash of each text: the same for most pairs of near copies."""
    for batch in batches:
        low = [int(s[0]) >> 1 if len(s) else 0 for s in shingle_sets(*utf8(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("text"), pa.array(low, pa.int64())], names=["label", "text", "near"])


def mine_terms(sample: DataFrame, max_terms: int = MAX_TERMS) -> list[str]:
    """The terms that tell most of label 1, by log-likelihood ratio; of near copies one text counts."""
    texts = (sample.filter("text IS NOT NULL").select("label", "text").mapInArrow(_near, "label int, text string, near long")
             .groupBy("near").agg(F.max(F.struct("label", "text")).alias("one")).select("one.label", "one.text"))
    sides = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n1, n0 = sides.get(1, 0), sides.get(0, 0)
    if not n1:
        return []
    counts = (texts.mapInArrow(_term_sets, "label int, terms array<string>").select("label", F.explode("terms").alias("term"))
              .groupBy("term").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("a"),
                                   F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("b")))
    # log-likelihood ratio of the 2 x 2 table of term and label, for terms more common under label 1
    part = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * (n1 + n0) / (row * column))).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    rest = F.lit(n1 + n0) - a - b
    gain = 2 * (part(a, a + b, F.lit(n1)) + part(b, a + b, F.lit(n0)) + part(n1 - a, rest, F.lit(n1)) + part(n0 - b, rest, F.lit(n0)))
    best = (counts.filter((a >= MIN_SUPPORT) & (a * n0 > b * n1)).withColumn("gain", gain).filter(F.col("gain") >= MIN_GAIN)
            .orderBy(F.desc("gain"), "term").limit(max_terms)).collect()
    return sorted(r["term"] for r in best if r["gain"] >= MIN_SHARE * best[0]["gain"])


class Hits(dict):
    """Word to the indices of its mined terms, found on first sight; bounded."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.at = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.at[t] for t in terms_of(word) if t in self.at)
        if len(self) >= MEMO:
            self.clear()
        self[word] = found
        return found


def features(texts: Iterator[str | None], n: int, hits_of: Hits) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows, words hit): presence of every term, log(1 + words hit), their share of the words."""
    x = np.zeros((n, len(hits_of.at) + 2), dtype=np.float64)
    hits = np.zeros(n, dtype=np.int64)
    for r, text in enumerate(texts):
        words = _WORD.findall(text.lower()) if text else []
        found = list(filter(None, map(hits_of.__getitem__, words)))
        if found:
            hits[r] = len(found)
            x[r, list(chain.from_iterable(found))] = 1
            x[r, -2:] = np.log1p(len(found)), len(found) / len(words)
    return x, hits


def _strings(column: pa.Array) -> Iterator[str | None]:
    return (v.as_py() for v in column)


class Chain:
    def __init__(self, terms: list[str]):
        self.terms = terms

    def fit(self, x: np.ndarray, targets: np.ndarray, fold: np.ndarray, present: np.ndarray | None = None) -> "Chain":
        """``targets`` has a column for each category, in the order of the chain; ``present``, if given, stands before ``x``, in a byte each."""
        self.models, parts, every = [], [x] if present is None else [present, x], np.arange(len(x))
        for c in range(targets.shape[1]):
            y = targets[:, c].astype(np.float64)
            honest = np.zeros(len(x))
            for f in np.unique(fold):
                model, mine = Logistic().fit(parts, y, every[fold != f]), every[fold == f]
                for at, block in side_by_side(parts, mine):
                    honest[mine[at]] = model.predict(block)
            self.models.append(Logistic().fit(parts, y, every))
            parts.append(honest[:, None])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        for model in self.models:
            x = np.column_stack([x, model.predict(x)])
        return x[:, -len(self.models):]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, ``ROWS`` rows at a time: a row of features takes 2 KB."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sample_features(terms: list[str]):
    """The presence of the terms a bit each, then the two other features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits_of = Hits(terms)
        for batch in _pieces(batches):
            x, hits = features(_strings(batch.column("text")), batch.num_rows, hits_of)
            bits = np.packbits(x[:, :-2] > 0, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() + r.tobytes() for b, r in zip(bits, x[:, -2:])], pa.binary()),
                                              batch.column("label"), batch.column("fold"), pa.array(hits)], names=["x", "label", "fold", "hits"])
    return run


def fit_chain(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Chain:
    sample = labelled_sample(docs, labels, "toxic", max_labelled)
    terms = mine_terms(sample)
    # the sample is bounded and a row has some 50 bytes, so it is put in order here
    rows = sorted(map(tuple, sample.mapInArrow(_sample_features(terms), "x binary, label int, fold int, hits long").collect()))
    width = -(-len(terms) // 8)
    packed = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), width + 16)
    toxic, fold, hits = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))
    present = np.unpackbits(packed[:, :width], axis=1, count=len(terms))
    rest = np.ascontiguousarray(packed[:, width:]).view(np.float64)
    return Chain(terms).fit(rest, np.column_stack([hits > 0, hits >= 3, toxic > 0]), fold, present)


def _score(chain_of, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chain_of.value
        hits_of = Hits(model.terms)
        for batch in _pieces(batches):
            p = model.predict(features(_strings(batch.column("text")), batch.num_rows, hits_of)[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= threshold)],
                                             names=["doc_id", "p_mention", "p_repeated", "score", "toxic"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_mention, p_repeated, score, toxic) for every row of ``docs``.

    ``score`` is the probability of the label, ``toxic`` whether it reaches ``threshold``.  Null and
    empty texts have no terms; rows of null or repeated ids are scored one by one.  Without labelled
    documents (or without toxic ones) nothing is toxic; empty ``docs`` give an empty result."""
    model = Shipped(docs.sparkSession, fit_chain(docs, labels, max_labelled))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_score(model, threshold), "doc_id long, p_mention double, p_repeated double, score double, toxic boolean"))


def _keep(chain_of, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chain_of.value
        hits_of = Hits(model.terms)
        for batch in _pieces(batches):
            p = model.predict(features(_strings(batch.column("text")), batch.num_rows, hits_of)[0])[:, -1]
            yield batch.filter(pa.array(p < threshold))
    return run


def clean(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic; one pass, no shuffle."""
    model = Shipped(docs.sparkSession, fit_chain(docs, labels, max_labelled))
    return docs.mapInArrow(_keep(model, threshold), docs.schema)
