"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside documents of any length.  An item is contained when at
least ``percent`` of its distinct five-word shingles occur in the document (items of fewer words:
their whole word sequence).  Items are partitioned by the size of their shingle set into powers of
two.  An item's MinHash sketch is the ``n - ceil(t n) + 1`` smallest of its shingle hashes: a
document that holds t of the item must hold one of them.  Each partition's largest sketch hash
bounds the document's side, whose sketch for that partition is all its hashes up to the bound, so
the sketch of a long document is not cut to a fixed length and no containment is lost.  Documents
that share a sketch hash with an item are candidates, verified by exact shingle containment.

The items are a stated query set: they are searched in blocks of at most ``block_shingles``
shingles, each block broadcast and run over all documents, which are scanned without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import Shipped
from splitlens.llm.textkernel import SHINGLE, row_shingles, shingles, utf8, word_hashes

PERCENT = 80
BLOCK_SHINGLES = 2_000_000  # 16 MB of hashes in one broadcast
_FILTER_BITS = 20
_SCHEMA = "doc_id long, item_id long, n_item int, n_shared int, containment double, first_word long, last_word long"


def sketch_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


class ItemIndex:
    """One block of items: shingle sets and, per partition, sketch hashes with their items."""

    def __init__(self, ids: list[int], widths: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.widths, self.sets, self.percent = ids, widths, sets, percent
        self.parts = []
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (s, k) in enumerate(zip(sets, widths)):
            groups.setdefault((k, len(s).bit_length()), []).append(i)
        for (k, _), members in sorted(groups.items()):
            sketch = [sets[i][:sketch_size(len(sets[i]), percent)] for i in members]
            hashes = np.concatenate(sketch)
            items = np.repeat(np.array(members), [len(s) for s in sketch])
            order = np.argsort(hashes, kind="stable")
            quick = np.zeros(1 << _FILTER_BITS, dtype=bool)
            quick[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.parts.append((k, hashes.max(), quick, hashes[order], items[order]))

    def widths_used(self) -> list[int]:
        return sorted({k for k, *_ in self.parts})

    def candidates(self, grams: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shingle width, positions in the shingle stream, items) for every shared sketch hash, per partition."""
        for k, bound, quick, hashes, items in self.parts:
            stream = grams[k]
            at = np.flatnonzero(quick[(stream & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            at = at[stream[at] <= bound]
            lo = np.searchsorted(hashes, stream[at], side="left")
            n = np.searchsorted(hashes, stream[at], side="right") - lo
            if n.any():
                yield k, np.repeat(at, n), items[np.repeat(lo, n) + _within(n)]


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, .. n[0]-1, 0, 1, .. n[1]-1, .."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _search(index_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for i, j, words, bounds in word_hashes(*utf8(batch.column("text"))):
                grams = {k: shingles(words, k) for k in index.widths_used()}
                found: set[tuple[int, int]] = set()
                for k, at, items in index.candidates(grams):
                    row = np.searchsorted(bounds, at, side="right") - 1
                    inside = at + k <= bounds[row + 1]
                    if inside.any():
                        found.update(zip(row[inside].tolist(), items[inside].tolist()))
                for r, item in sorted(found):
                    want, k = index.sets[item], index.widths[item]
                    a, b = int(bounds[r]), int(bounds[r + 1]) - k + 1
                    have = grams[k][a:b]
                    at = np.minimum(np.searchsorted(want, have), len(want) - 1)
                    hit = want[at] == have
                    shared = len(np.unique(at[hit]))
                    if 100 * shared >= index.percent * len(want):
                        where = np.flatnonzero(hit)
                        rows.append((ids[i + r], index.ids[item], len(want), shared, shared / len(want),
                                     int(where[0]), int(where[-1]) + k - 1))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=[f.split()[0] for f in _SCHEMA.split(", ")])
    return run


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        width, data = [], []
        for i, j, words, bounds in word_hashes(*utf8(batch.column("text"))):
            every = shingles(words)
            for r in range(j - i):
                a, b = int(bounds[r]), int(bounds[r + 1])
                width.append(min(b - a, SHINGLE))
                data.append(row_shingles(words, every, a, b).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(width, pa.int32()), pa.array(data, pa.binary())],
                                         names=["item_id", "width", "data"])


def _item_blocks(items: DataFrame, percent: int, block_shingles: int) -> Iterator[ItemIndex]:
    """The query set in blocks, streamed to the driver one partition at a time."""
    sets = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .filter("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_item_sets, "item_id long, width int, data binary")
            .filter("width > 0").dropDuplicates())
    ids, widths, held, size = [], [], [], 0
    for row in sets.toLocalIterator():
        s = np.frombuffer(bytes(row["data"]), dtype="<u8")
        if ids and size + len(s) > block_shingles:
            yield ItemIndex(ids, widths, held, percent)
            ids, widths, held, size = [], [], [], 0
        ids.append(row["item_id"])
        widths.append(row["width"])
        held.append(s)
        size += len(s)
    if ids:
        yield ItemIndex(ids, widths, held, percent)


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per (document, contained item): sizes, containment and the range of words (from 0) that
    holds the item's shingles.  ``docs`` has doc_id and text, ``items`` item_id and text; other columns
    are ignored.  Null or wordless texts contain nothing and are contained in nothing, items without
    an id are skipped, repeated documents give repeated rows, repeated items one; empty tables give
    an empty result."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    out = spark.range(0).selectExpr(*(f"CAST(NULL AS {f.split()[1]}) AS {f.split()[0]}" for f in _SCHEMA.split(", ")))
    for index in _item_blocks(items, percent, block_shingles):
        out = out.union(texts.mapInArrow(_search(Shipped(spark, index)), _SCHEMA))
    return out


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows with a null doc_id are judged too, and items without an id count."""
    known = items.select(F.lit(0).alias("item_id"), "text")  # which item it is does not matter here
    found = contained_items(docs, known, percent).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_bad"]), "left_anti").select(docs.columns)
