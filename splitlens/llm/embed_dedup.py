"""Embedding near-duplicates by cross-polytope hashing.

Vectors are normalised in double precision, padded to a power of two and turned by three rounds of
random signs and a fast Hadamard transform; the hash is the signed axis nearest to the result, two
hashes with independent rotations make one bucket code of a table.  Multiprobe: in every table a
vector is also put in the buckets whose code changes one hash to its next nearest axes, so a vector
is a member of ``TABLES * (1 + PROBES)`` buckets.  Only ids go to all of these; vectors follow to the buckets that hold
more than one.  Every pair of a bucket is compared by its exact cosine.  A pair that meets in several buckets counts only in the least of its common bucket codes,
so links are counted where they are found and pairs are never written out.

Equal vectors collapse to one class with a weight first.  A bucket of more than ``TILE`` classes is
split into stripes and every pair of stripes is a group of its own, so no group is larger than
two stripes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import materialise, runs, slots, unpack
from splitlens.llm.components import connected_components

THRESHOLD = 0.9
TABLES = 6
PROBES = 4
TILE = 2000
SEED = 20240601
_ROWS = 256  # rows compared at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _nearest_axes(x: np.ndarray, signs: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest signed axes of the rotated rows, nearest first, and their coordinates' sizes."""
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    top = np.argsort(-size, axis=1, kind="stable")[:, :m]
    value = np.take_along_axis(x, top, axis=1)
    return top * 2 + (value < 0), np.abs(value)


def bucket_codes(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables * (1 + probes)) bucket codes of unit vectors, sorted in each row."""
    n, dim = unit.shape
    d = 1 << max(probes, dim - 1).bit_length()  # room for every probe, however short the vectors
    padded = np.zeros((n, d))
    padded[:, :dim] = unit
    rng = np.random.default_rng(seed)
    m = min(d, probes + 1)
    out = []
    for t in range(tables):
        hashes = [_nearest_axes(padded, rng.choice([-1.0, 1.0], size=(3, d)), m) for _ in range(2)]
        (a, va), (b, vb) = hashes
        code = [a[:, 0] * (2 * d) + b[:, 0]]
        # other probes: one hash moved to its next axes, the least loss first
        other = np.concatenate([a[:, 1:] * (2 * d) + b[:, :1], a[:, :1] * (2 * d) + b[:, 1:]], axis=1)
        loss = np.concatenate([va[:, :1] - va[:, 1:], vb[:, :1] - vb[:, 1:]], axis=1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        code += list(np.take_along_axis(other, pick, axis=1).T)
        out += [t * (4 * d * d) + c for c in code]
    return np.sort(np.stack(out, axis=1).astype(np.int64), axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _hash(tables: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = batch.column("embedding")
            dims = pa.compute.list_value_length(vec).to_numpy()
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                unit = _unit(flat[starts[rows][:, None] + np.arange(dim)])
                codes = bucket_codes(unit, tables, probes, seed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").take(pa.array(rows)), batch.column("weight").take(pa.array(rows)),
                     pa.array([u.tobytes() for u in unit], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["rep", "weight", "unit", "codes", "buckets"])
    return run


def _first_common(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least common bucket code of the pairs (rows of codes are sorted)."""
    out = np.full(len(i), np.iinfo(np.int64).max)
    for k in range(codes.shape[1]):
        mine = codes[i, k]
        both = (codes[j] == mine[:, None]).any(axis=1)
        out = np.where(both, np.minimum(out, mine), out)
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least vertex reachable by the local links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _group_links(unit, codes, weight, bucket: int, left: np.ndarray, right: np.ndarray, threshold: float):
    """Linked pairs of left x right (the same array: each pair once) that belong to this bucket."""
    same = left is right
    for a in range(0, len(left), _ROWS):
        rows = left[a:a + _ROWS]
        i, j = np.nonzero(unit[rows] @ unit[right].T >= threshold)
        if same:
            later = j > i + a
            i, j = i[later], j[later]
        i, j = rows[i], right[j]
        for b in range(0, len(i), 100_000):
            x, y = i[b:b + 100_000], j[b:b + 100_000]
            own = _first_common(codes, x, y) == bucket
            yield x, y, own


def _compare(width: int, threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        bucket, lo, hi, stripe = (rows.column(c).to_numpy() for c in ("bucket", "lo", "hi", "stripe"))
        order = np.lexsort((hi, lo, bucket))
        bucket, lo, hi, stripe = bucket[order], lo[order], hi[order], stripe[order]
        rep, weight = rows.column("rep").to_numpy()[order], rows.column("weight").to_numpy()[order]
        dims = pa.compute.binary_length(rows.column("unit").combine_chunks()).to_numpy()[order]
        units = rows.column("unit").take(pa.array(order)).combine_chunks()
        codes = unpack(rows.column("codes"), "<i8").reshape(-1, width)[order]
        new = (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        edges = np.r_[0, np.flatnonzero(new) + 1, len(bucket)]
        out_rep, out_links, out_root = [], [], []
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s < 2:
                continue
            for dim in np.unique(dims[s:e]):
                at = s + np.flatnonzero(dims[s:e] == dim)
                unit = unpack(units.take(pa.array(at)), "<f8").reshape(len(at), -1)
                side = np.arange(len(at))
                if lo[s] != hi[s]:
                    left, right = side[stripe[at] == lo[s]], side[stripe[at] == hi[s]]
                else:
                    left = right = side
                links = np.zeros(len(at), dtype=np.int64)
                ends: list[tuple[np.ndarray, np.ndarray]] = []
                root = side
                for x, y, own in _group_links(unit, codes[at], weight[at], int(bucket[s]), left, right, threshold):
                    links += np.bincount(x[own], weight[at][y[own]], len(at)).astype(np.int64)
                    links += np.bincount(y[own], weight[at][x[own]], len(at)).astype(np.int64)
                    x, y = root[x], root[y]
                    root = _roots(len(at), np.r_[side, x], np.r_[root, y])
                touched = np.flatnonzero((links > 0) | (root != side))
                out_rep.append(rep[at][touched])
                out_links.append(links[touched])
                out_root.append(rep[at][root[touched]])
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"rep": cat(out_rep), "links": cat(out_links), "root": cat(out_root)})
    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES,
                    probes: int = PROBES, tile: int = TILE, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding; others ignored).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    so do rows of a null vec_id (their component is null and they are kept).  Vectors of different
    lengths never link.  Rows that repeat a vec_id count as vectors of their own; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    n_slots = slots(spark)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = given.filter("vec_id IS NOT NULL AND size(embedding) > 0").filter(finite & F.exists("embedding", lambda x: x != 0))
    classes = materialise(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "ed-classes")

    members = materialise(classes.mapInArrow(_hash(tables, probes, seed),
                                             "rep long, weight long, unit binary, codes binary, buckets array<long>"), "ed-codes")
    # ids alone go to the buckets; vectors follow only to buckets where they meet another
    spread = members.select("rep", F.explode("buckets").alias("bucket"))
    shared = materialise(spread.groupBy("bucket").count().filter("count > 1")
                         .select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("stripes")), "ed-shared")
    tiles = (spread.join(shared, "bucket")
             .withColumn("stripe", F.pmod(F.xxhash64("rep"), F.col("stripes")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, stripes - 1)")))
             .select("rep", "bucket", "stripe", F.least("stripe", "other").alias("lo"), F.greatest("stripe", "other").alias("hi"))
             .join(members.select("rep", "weight", "unit", "codes"), "rep"))
    found = materialise(tiles.withColumn("slot", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(n_slots)).cast("int"))
                        .groupBy("slot").applyInArrow(_compare(tables * (1 + probes), threshold), "rep long, links long, root long"), "ed-found")
    part = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = materialise(classes.join(counted, "rep", "left").join(part, "rep", "left")
                        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
                                F.coalesce("component", "rep").alias("component")), "ed-named")
    valid = usable.join(named, "embedding").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    rest = given.filter(~F.coalesce(F.expr("vec_id IS NOT NULL AND size(embedding) > 0")
                                    & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
