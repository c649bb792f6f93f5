"""N-gram Jaccard self-join with count-vector R-trees.

A document's tokens are its distinct five-word shingles.  Tokens are hashed into ``GROUPS``
groups and the number of a document's tokens in each group makes it a point; the overlap of two
documents is at most the sum of the coordinate minima of their points.  Points that may meet are
brought together by a block for each rare token of a document's prefix (a document and a partner
at the threshold share one of their rarest ``n - ceil(t n) + 1`` tokens, whatever total order
"rare" means, as long as all documents use the same one).  In each block an R-tree over the points
prunes node pairs and point pairs by the bound, and survivors are verified on the whole sets.

Pairs that pass are bounded once more with ``bits``, a count vector of at least four groups per token with counts cut at
one: the tokens of one document in groups the other lacks are not shared.

Steps, all on Spark:

1. One row per document: set size, 128-bit set digest and count vector; and counts of hashed token
   cells, summed to a fixed-size table of commonness levels.
2. Prefix tokens, packed by hash slot and shuffled; blocks with two different sets remain, blocks
   of the same members once.
3. Star round: two members of each block are its pivots, the one with the most company and one by hash, and every
   other member of a possible size is paired with them.  These pairs, few for each member, are pruned by both bounds
   and verified; the links found give components.
4. Last round: in the blocks that still span several components, an R-tree over the points gives the pairs of
   different components within the bound; survivors of the second bound are verified.  A block of more than ``TILE`` members is dealt by hash into tiles, and each two tiles are a group of their own.

Sets in one component need no further comparison, so a group of near copies costs a few
verifications per member, and equal sets cost none.  Skew: equal sets collapse to one class
before verification, common tokens come last in every prefix, no group holds more than two tiles of a block, and the joins
are between plain exchanges of written tables, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import arrow_rows, materialise, pack_by_slot, runs, slots, unpack
from splitlens.llm.components import connected_components
from splitlens.llm.textkernel import mix, shingle_sets, utf8

PERCENT = 80           # similarity threshold
GROUPS = 256           # coordinates of a point
CELL_BITS = 20         # hashed cells of the commonness table (fixed size: one byte each)
SLICES = 64            # the cell counts travel in so many pieces
FANOUT = 16            # children of an R-tree node
TILE = 2048            # members of a block that meet in one group, twice
BATCH = 1000           # rows that a Python worker gets at once
PACKED = 1 << 18       # prefix tokens that it packs at once
NODES = 1024           # node pairs of a tree looked at at once
_MEMBER = np.dtype([("token", "<i8"), ("cls", "<i8"), ("n", "<i4")])


# ---------------------------------------------------------------- points

def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    a = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    b = int(mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def count_vector(s: np.ndarray) -> np.ndarray:
    """Tokens in each of GROUPS groups, a byte each; of a set with more than 255 in one, in half as many groups of four bytes."""
    counts = np.bincount(((s >> np.uint64(CELL_BITS)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return counts.astype("u1") if counts.max(initial=0) <= 255 else counts.reshape(2, -1).sum(axis=0).astype("<u4")


def points_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The count vectors of a column as rows of a matrix; next to a vector of fewer groups the others are folded."""
    values = [v.as_buffer() for v in column]
    if all(len(v) == GROUPS for v in values):
        return np.frombuffer(b"".join(values), dtype="u1").reshape(-1, GROUPS)
    rows = [np.frombuffer(v, "u1").reshape(2, -1).sum(axis=0, dtype="<u4") if len(v) == GROUPS else np.frombuffer(v, "<u4") for v in values]
    return np.stack(rows)


def group_bits(s: np.ndarray) -> np.ndarray:
    """Which of 4 n to 8 n groups hold a token, as 64-bit words; folding the halves together halves the groups."""
    size = 1 << max(6, (4 * len(s) - 1).bit_length())
    held = np.zeros(size, dtype=bool)
    held[((s >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view("<u8")


class BitRows:
    """Bits of several sets, to bound overlaps of pairs of them."""

    def __init__(self, words: list[np.ndarray], sizes: np.ndarray):
        self.sizes, self.length = sizes, np.array([len(w) for w in words], dtype=np.int64)
        self.place = np.zeros(len(words), dtype=np.int64)
        self.rows = {}
        for k in np.unique(self.length):
            at = np.flatnonzero(self.length == k)
            self.place[at] = np.arange(len(at))
            self.rows[int(k), int(k)] = np.stack([words[i] for i in at])

    def _folded(self, length: int, to: int) -> np.ndarray:
        if (length, to) not in self.rows:
            rows = self.rows[length, length]
            self.rows[length, to] = np.bitwise_or.reduce(rows.reshape(len(rows), -1, to), axis=1)
        return self.rows[length, to]

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair an upper bound of the overlap: the tokens of one whose group the other lacks are not shared."""
        out = np.zeros(len(i), dtype=np.int64)
        for x, y in np.unique(np.stack([self.length[i], self.length[j]], axis=1), axis=0).tolist():
            which = np.flatnonzero((self.length[i] == x) & (self.length[j] == y))
            k = min(x, y)
            left, right = self._folded(x, k), self._folded(y, k)
            step = max(1, (1 << 18) // k)
            for at in range(0, len(which), step):
                w = which[at:at + step]
                a, b = left[self.place[i[w]]], right[self.place[j[w]]]
                lack_a, lack_b = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (a & ~b, b & ~a))
                out[w] = np.minimum(self.sizes[i[w]] - lack_a, self.sizes[j[w]] - lack_b)
        return out


_POINTS = "doc_id long, n long, cls long, cls2 long, point binary, slice int, cells binary"


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(1 << CELL_BITS, dtype=np.int64)
    seen = False
    for batch in batches:
        n, d1, d2, points = [], [], [], []
        for s in shingle_sets(*utf8(batch.column("text"))):
            a, b = _digest(s)
            n.append(len(s))
            d1.append(a)
            d2.append(b)
            points.append(count_vector(s).tobytes() if len(s) else None)
            if len(s):
                seen = True
                if len(s) > 20_000:
                    cells += np.bincount((s & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64), minlength=1 << CELL_BITS)
                else:
                    np.add.at(cells, (s & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64), 1)
        m = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
             pa.array(points, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
            names=["doc_id", "n", "cls", "cls2", "point", "slice", "cells"])
    if seen:
        part = cells.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(SLICES, pa.int64())] * 4 + [pa.nulls(SLICES, pa.binary())]
            + [pa.array(range(SLICES), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in part], pa.binary())],
            names=["doc_id", "n", "cls", "cls2", "point", "slice", "cells"])


def _sum_cells(rows: pa.Table) -> pa.Table:
    total = np.zeros((1 << CELL_BITS) // SLICES, dtype=np.int64)
    for chunk in rows.column("cells").chunks:
        for value in chunk:
            total += np.frombuffer(value.as_buffer(), dtype="<i8")
    return pa.table({"slice": rows.column("slice").slice(0, 1).cast(pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})


def commonness_levels(points: DataFrame) -> np.ndarray:
    """For each hashed cell, 0 up to twice the mean count and one more for each doubling.

    The table has a fixed size (one byte for each of 2**CELL_BITS cells) at any input size."""
    rows = (points.filter("slice IS NOT NULL").select("slice", "cells").groupBy("slice")
            .applyInArrow(_sum_cells, "slice int, cells binary").collect())
    counts = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), dtype=np.int64)
    for r in rows:
        counts[r["slice"]] = np.frombuffer(r["cells"], dtype="<i8")
    counts = counts.reshape(-1)
    usual = 2 * max(1.0, counts.mean())
    return np.floor(np.log2(np.maximum(counts / usual, 1))).astype(np.uint8)


# ---------------------------------------------------------------- blocks

def prefix(s: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest n - ceil(t n) + 1 tokens of a sorted set, by (commonness level, hash)."""
    n = len(s)
    p = n - -(-percent * n // 100) + 1
    level = levels[(s & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)]
    if level.any():
        return s[np.argsort(level, kind="stable")[:p]]
    return s[:p]


def _prefixes(levels_of, n_slots: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(levels_of.value, dtype=np.uint8)
        seen: set[int] = set()  # digests of this task's sets: equal sets are sent once
        tokens, owners, sizes, held = [], [], [], 0

        def packed() -> pa.RecordBatch:
            counts = [len(t) for t in tokens]
            rows = np.empty(sum(counts), dtype=_MEMBER)
            rows["token"] = np.concatenate(tokens).view(np.int64)
            rows["cls"] = np.repeat(np.array(owners, dtype=np.int64), counts)
            rows["n"] = np.repeat(np.array(sizes, dtype=np.int32), counts)
            slot = (rows["token"].view(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(n_slots) >> np.uint64(32)
            names, data = pack_by_slot(rows, slot.astype(np.int32))
            return pa.RecordBatch.from_arrays([names, data], names=["slot", "data"])

        for batch in batches:
            for s in shingle_sets(*utf8(batch.column("text"))):
                if len(s):
                    d = _digest(s)[0]
                    if d not in seen:
                        seen.add(d)
                        tokens.append(prefix(s, levels, percent))
                        owners.append(d)
                        sizes.append(len(s))
                        held += len(tokens[-1])
                        if held >= PACKED:
                            yield packed()
                            tokens, owners, sizes, held = [], [], [], 0
        if tokens:
            yield packed()
    return run


def _blocks(rows: pa.Table) -> pa.Table:
    """Members of the blocks of one slot: (block, set, its size).  Blocks of one set are left out; a block is
    named by its member list, so that repeats of a list fall together."""
    m = unpack(rows.column("data"), _MEMBER)
    order = np.lexsort((m["cls"], m["token"]))
    token, cls, n = m["token"][order], m["cls"][order], m["n"][order].astype(np.int64)
    if not len(token):
        return pa.table({"block": token, "cls": cls, "n": n})
    new = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]
    token, cls, n = token[new], cls[new], n[new]
    bounds = runs(token)
    size = np.diff(bounds)
    name = mix(np.add.reduceat(mix(cls.view(np.uint64)), bounds[:-1]) + size.astype(np.uint64)).view(np.int64)
    keep = np.zeros(len(size), dtype=bool)
    keep[np.unique(name, return_index=True)[1]] = True
    live = np.repeat(keep & (size > 1), size)
    return pa.table({"block": np.repeat(name, size)[live], "cls": cls[live], "n": n[live]})


# ---------------------------------------------------------------- R-tree

def linked(inter, nx, ny, percent: int = PERCENT):
    """100 * intersection >= percent * union, from the intersection and the two sizes."""
    return (100 + percent) * inter >= percent * (nx + ny)


def str_order(points: np.ndarray, sizes: np.ndarray, leaf: int = FANOUT) -> np.ndarray:
    """Sort-tile order: slabs by total count, within a slab by its most varying group."""
    order = np.argsort(sizes, kind="stable")
    n = len(order)
    if n <= leaf:
        return order
    slab = leaf * max(1, int(np.ceil(np.sqrt(n / leaf))))
    out = []
    for i in range(0, n, slab):
        part = order[i:i + slab]
        axis = int(np.argmax(points[part].astype(np.float64).var(axis=0)))
        out.append(part[np.argsort(points[part, axis], kind="stable")])
    return np.concatenate(out)


class CountTree:
    """R-tree packed bottom-up: per node the coordinate maxima, least size and the range of labels."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, label: np.ndarray):
        self.order = str_order(points, sizes)
        self.top = [points[self.order]]
        self.small = [sizes[self.order].astype(np.int64)]
        self.lo, self.hi = [label[self.order]], [label[self.order]]
        while len(self.small[-1]) > 1:
            at = np.arange(0, len(self.small[-1]), FANOUT)
            self.top.append(np.maximum.reduceat(self.top[-1], at, axis=0))
            self.small.append(np.minimum.reduceat(self.small[-1], at))
            self.lo.append(np.minimum.reduceat(self.lo[-1], at))
            self.hi.append(np.maximum.reduceat(self.hi[-1], at))

    def pairs(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points of different labels whose summed coordinate minima reach the threshold."""
        root = len(self.small) - 1
        stack = [(root, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > NODES:
                for i in range(0, len(a), NODES):
                    stack.append((level, a[i:i + NODES], b[i:i + NODES]))
                continue
            lo, hi = self.lo[level], self.hi[level]
            one = (lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b])
            a, b = a[~one], b[~one]
            bound = np.minimum(self.top[level][a], self.top[level][b]).sum(axis=1, dtype=np.int64)
            good = linked(bound, self.small[level][a], self.small[level][b], percent)
            a, b = a[good], b[good]
            if not len(a):
                continue
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            below = len(self.small[level - 1])
            step = np.arange(FANOUT)
            ca = np.broadcast_to((a[:, None] * FANOUT + step)[:, :, None], (len(a), FANOUT, FANOUT))
            cb = np.broadcast_to((b[:, None] * FANOUT + step)[:, None, :], (len(a), FANOUT, FANOUT))
            ok = (ca < below) & (cb < below) & (ca < cb) if level == 1 else (ca < below) & (cb < below) & (ca <= cb)
            stack.append((level - 1, ca[ok], cb[ok]))


def _words(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype="<u8") for v in column]


def _candidates(percent: int):
    """Pairs of sets of different components in the groups of a slot, within the bound of their points."""
    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("group").to_numpy()
        order = np.argsort(group, kind="stable")
        bounds = runs(group[order])
        cls, n, comp = (rows.column(c).to_numpy()[order] for c in ("cls", "n", "component"))
        points = points_of(rows.column("point"))[order]
        found = [np.zeros((0, 2), dtype=np.int64)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            for i, j in CountTree(points[a:b], n[a:b], comp[a:b]).pairs(percent):
                apart = comp[a:b][i] != comp[a:b][j]
                found.append(np.sort(np.stack([cls[a:b][i[apart]], cls[a:b][j[apart]]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def _near_points(percent: int):
    """The pairs within the bound of their points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            both = points_of(pa.chunked_array([batch.column("point_a"), batch.column("point_b")]))
            keep = linked(np.minimum(both[:m], both[m:]).sum(axis=1, dtype=np.int64), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _near_bits(percent: int):
    """The pairs within the bound of their bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(f"n_{x}").to_numpy() for x in "ab"])
            words = [np.frombuffer(v.as_buffer(), dtype="<u8") for x in "ab" for v in batch.column(f"bits_{x}")]
            i = np.arange(m)
            keep = linked(BitRows(words, n).bounds(i, i + m), n[:m], n[m:], percent) if m else i
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _star_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Each member of a block with the block's two pivots: the member that meets the most others over all its blocks (of a
    group of edited copies that is the text they were made from), and one by hash."""
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    company = blocks.join(materialise(sizes, "jj-sizes"), "block").groupBy("cls").agg(F.sum(F.col("size") - 1).alias("company"))
    ranked = blocks.join(materialise(company, "jj-company"), "cls")
    most, hashed = F.max(F.struct("company", "cls", "n")), F.max(F.struct(F.xxhash64("cls"), "cls", "n"))
    chosen = [p.getField(c).alias(c) for p in (most, hashed) for c in ("cls", "n")]
    pivots = ranked.groupBy("block").agg(F.array_distinct(F.array(F.struct(*chosen[:2]), F.struct(*chosen[2:]))).alias("pivots"))
    pairs = blocks.join(materialise(pivots, "jj-pivots"), "block").select("cls", "n", F.explode("pivots").alias("p")).filter("cls <> p.cls")
    pairs = pairs.filter(100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n"))  # of other sizes none can link
    return pairs.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()


def _tiles(blocks: DataFrame) -> DataFrame:
    """(group, cls, n, component): blocks of at most ``TILE`` members are a group; larger ones are dealt into tiles by hash, and each
    two tiles are a group, so that every two members still meet."""
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit(5)), F.col("tiles")).cast("int")
    dealt = (blocks.join(materialise(sizes, "jj-mixed-sizes"), "block").withColumn("tiles", tiles).withColumn("tile", own)
             .withColumn("other", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))))
    one = F.when(F.col("tiles") == 1, F.col("block")).otherwise(F.xxhash64("block", F.least("tile", "other"), F.greatest("tile", "other")))
    return dealt.select(one.alias("group"), "cls", "n", "component")


# ---------------------------------------------------------------- verification

def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs = [pack.compress(t.as_buffer()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "body"])


def _open_set(blob: bytes) -> np.ndarray:
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return next(shingle_sets(text, np.array([0, len(text)], dtype=np.int64)))


def _own_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the rows whose text has the set they were asked for (ids may repeat); add its bits."""
    for batch in batches:
        rows = []
        for body, cls in zip(batch.column("body"), batch.column("cls").to_pylist()):
            s = _open_set(body.as_buffer())
            if _digest(s)[0] == cls:
                rows.append((cls, len(s), group_bits(s).tobytes(), body.as_py()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["cls", "n", "bits", "body"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            b = batch.column("b").to_pylist()
            left, right = batch.column("body_a"), batch.column("body_b")
            keep = []
            for i in range(batch.num_rows):
                if b[i] != held[0]:
                    held = b[i], _open_set(right[i].as_buffer())
                x, y = _open_set(left[i].as_buffer()), held[1]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(bool(linked(int((y[at] == x).sum()), len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _sides(bodies: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    return tuple(bodies.select(F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")


def _links(pairs: DataFrame, known: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that reach the threshold: bits first, then the whole sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = materialise(ids.join(classes.select("cls", "rep"), "cls").select("cls", F.col("rep").alias("doc_id")), "jj-wanted")
    bodies = materialise(known.mapInArrow(_squeeze, "doc_id long, body binary").join(wanted, "doc_id").select("cls", "body")
                         .mapInArrow(_own_digest, "cls long, n long, bits binary, body binary").dropDuplicates(["cls"]), "jj-bodies")
    bits_a, bits_b = _sides(bodies, "n", "bits")
    close = materialise(pairs.join(bits_a, "a").join(bits_b, "b").mapInArrow(_near_bits(percent), "a long, b long"), "jj-close")
    body_a, body_b = _sides(bodies, "body")
    return materialise(close.join(body_a, "a").join(body_b, "b").mapInArrow(_verify(percent), "a long, b long"), "jj-links")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (columns doc_id, text; others ignored).

    Null or wordless texts have no shingles and link with nothing.  Rows of a null doc_id get a
    null component and take no part; of rows that repeat a doc_id each is judged by its own text.
    An empty table gives an empty result.
    """
    with arrow_rows(docs.sparkSession, BATCH):  # no Python is left to run in the result
        return _components(docs, percent)


def _components(docs: DataFrame, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    n_slots = slots(spark)

    points = materialise(docs.mapInArrow(_points, _POINTS), "jj-points")
    members = points.filter("slice IS NULL").select("doc_id", "n", "cls", "cls2")
    levels = spark.sparkContext.broadcast(commonness_levels(points).tobytes())
    classes = materialise(points.filter("slice IS NULL AND n > 0 AND doc_id IS NOT NULL").groupBy("n", "cls", "cls2")
                          .agg(F.min("doc_id").alias("rep"), F.first("point").alias("point")), "jj-classes")

    known = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL")
    blocks = materialise(known.mapInArrow(_prefixes(levels, n_slots, percent), "slot int, data binary")
                         .groupBy("slot").applyInArrow(_blocks, "block long, cls long, n long").distinct(), "jj-blocks")

    a, b = _sides(classes, "n", "point")
    star = _star_pairs(blocks, percent).join(a, "a").join(b, "b").mapInArrow(_near_points(percent), "a long, b long")
    links = _links(materialise(star, "jj-star"), known, classes, percent)
    part = materialise(connected_components(links).withColumnRenamed("node", "cls"), "jj-part")

    labelled = materialise(blocks.join(part, "cls", "left").select("block", "cls", "n", F.coalesce("component", "cls").alias("component")), "jj-labelled")
    mixed = labelled.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("block")
    open_blocks = labelled.join(materialise(mixed, "jj-mixed"), "block")
    pairs = (_tiles(open_blocks).join(classes.select("cls", "point"), "cls").select("group", "cls", "component", "n", "point")
             .withColumn("slot", F.pmod(F.xxhash64("group"), F.lit(n_slots)).cast("int"))
             .groupBy("slot").applyInArrow(_candidates(percent), "a long, b long"))
    more = _links(materialise(pairs.distinct(), "jj-pairs"), known, classes, percent)
    part = materialise(connected_components(links.union(more)).withColumnRenamed("node", "cls"), "jj-part")

    named = materialise(classes.select("n", "cls", "cls2", "rep").join(part, "cls", "left")
                        .withColumn("component", F.coalesce("component", "cls")), "jj-named")
    least = materialise(named.groupBy("component").agg(F.min("rep").alias("component_id")), "jj-least")
    named = materialise(named.join(least, "component").select("n", "cls", "cls2", "component_id"), "jj-named")
    return (members.join(named, ["n", "cls", "cls2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id.  Rows of a
    null doc_id stay (nothing is known against them); of rows that repeat an id all stay or none."""
    comps = jaccard_components(docs, percent)
    drop = comps.filter("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti").select(docs.columns)
