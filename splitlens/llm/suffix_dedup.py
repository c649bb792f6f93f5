"""Removal of repeated 100-byte strings by distributed bucket-pointer refinement.

A byte is removed when a 100-byte string covers it that also starts earlier in the corpus (smaller
doc_id, or the same document at an earlier byte).  Suffixes are put into initial buckets by their
first q bytes and buckets are refined by what stands at other offsets, until 100 bytes agree:

1. Not every suffix needs a bucket: of the q-grams of a 100-byte window the one with the least
   hash is its anchor, so equal windows have equal anchors at equal offsets.  A run of windows
   with one anchor is one entry: the anchor's bucket identifier, and the identifier of its whole
   context (the bytes that its windows cover).
2. Entries meet by bucket.  Entries of one context are equal window by window: all but the first are
   covered.  Buckets of several contexts are refined: entries whose neighbours at the offsets
   before or behind the q-gram fall into no common bucket can share no window and drop out.
3. The windows of the entries that are left are refined to full depth.  Initial buckets are the ``START``-byte strings at
   every place; a bucket is refined by the identifier of the bucket as many bytes further on as it is deep, and the refined
   identifiers are used again for the next round, until 100 bytes agree.  Of windows in one bucket all but the first
   are covered.

Contexts and windows that make bytes go are identified by two 64-bit hashes, so that even among 1e14 windows no two
different ones are expected to be taken for equal; the hashes that only bring entries together are shorter.  Entries
travel packed by hash slot; an entry whose context was already seen in the same batch goes to a slot of its document
instead, so a passage that stands in a third of all documents does not flood one slot.  What is found goes back to the
documents as plain rows, as many as there are ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import binary_array, materialise, pack_by_slot, runs, slots, unpack
from splitlens.llm.textkernel import PIECE, mix, power_tables, utf8
from splitlens.session import drop_written

LENGTH = 100
Q = 24
SIDE = (LENGTH - Q) // 2  # every window agrees on so many bytes before or behind its anchor
_ENTRY = np.dtype([("gram", "<u4"), ("ctx", "<u8"), ("ctx2", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1"),
                   ("left", "<u2"), ("right", "<u2"), ("again", "u1")])
_WINDOW = np.dtype([("id", "<u8"), ("id2", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("again", "u1")])
_PAIR = np.dtype([("a", "<u4"), ("b", "<u4")])
_COVERED, _OPEN = 0, 1
START = 25  # depth of the initial buckets; doubled until LENGTH
_POS = np.uint64(PIECE - 1)


# the value of a byte in the first and in the second hash
_BYTES = (np.arange(1, 257, dtype=np.uint64), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def prefix_sums(part: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = power_tables(len(part) + 1)
    out = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[which][part] * up[:len(part)], out=out[1:])
    return out


def identifiers(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of a part."""
    _, down = power_tables(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def deep_identifiers(part: np.ndarray, which: int) -> np.ndarray:
    """Bucket identifiers of the LENGTH-byte strings at every place of a part: those of START bytes, refined by the ones that stand
    as far on as they are deep, again and again."""
    sums, depth = prefix_sums(part, which), START
    at = np.arange(max(0, len(part) - START + 1))
    ids = identifiers(sums, at, at + START)
    while depth < LENGTH:
        ids = mix(ids[:-depth] * np.uint64(0xA0761D6478BD642F) + ids[depth:]) if len(ids) > depth else ids[:0]
        depth *= 2
    return ids


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values (block prefix and suffix minima)."""
    n = len(values) - w + 1
    padded = np.full(-(-len(values) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def _part_entries(part: np.ndarray, row_start: np.ndarray, row_end: np.ndarray, window_end: np.ndarray,
                  base: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries of a part with rows at [row_start, row_end); windows start before window_end.  ``base`` is the
    part's byte 0 of each row minus its place in the part."""
    if len(part) < LENGTH:
        return np.zeros(0, dtype=_ENTRY)
    sums = prefix_sums(part)
    n = len(part) - Q + 1
    _, down = power_tables(len(sums))
    gram = mix((sums[Q:] - sums[:n]) * down[:n])
    least = sliding_least((gram & ~_POS) | np.arange(n, dtype=np.uint64), LENGTH - Q + 1)
    anchor = (least & _POS).astype(np.int64)
    mark = np.zeros(len(anchor) + 1, dtype=np.int32)
    last = np.minimum(np.maximum(np.minimum(row_end - LENGTH + 1, window_end), row_start), len(anchor))
    np.add.at(mark, np.minimum(row_start, len(anchor)), 1)
    np.add.at(mark, last, -1)
    valid = np.cumsum(mark[:-1]) > 0
    edge = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]
    edge[row_start[row_start < len(edge)]] = True
    first = np.flatnonzero(edge)
    end = np.r_[first[1:], len(anchor)]
    live = valid[first]
    first, end = first[live], end[live] - 1  # first and last window of each run
    at = anchor[first]
    row = np.searchsorted(row_start, first, side="right") - 1
    out = np.zeros(len(first), dtype=_ENTRY)
    out["gram"] = (gram[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out["lo"], out["hi"] = at - end, at - first
    place = (out["lo"].astype(np.uint64) << np.uint64(8)) + out["hi"]
    out["ctx"] = mix(identifiers(sums, first, end + LENGTH) + place)
    out["ctx2"] = mix(identifiers(prefix_sums(part, 1), first, end + LENGTH) + place)
    out["doc"], out["at"] = ids[row], at + base[row]
    before = at - SIDE >= row_start[row]
    behind = at + Q + SIDE <= row_end[row]
    for name, ok, a in (("left", before, at - SIDE), ("right", behind, at + Q)):
        a = np.where(ok, a, 0)
        out[name] = np.where(ok, 1 + identifiers(sums, a, a + SIDE) % np.uint64(65535), 0)
    return out


def entries(buf: np.ndarray, off: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Entries of rows in order; a row longer than a piece is taken in overlapping parts."""
    room = PIECE - LENGTH - SIDE
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + room, side="right")) - 1
        j = min(max(j, i + 1), n)
        length = int(off[j] - off[i])
        if length <= room:
            start, end = off[i:j] - off[i], off[i + 1:j + 1] - off[i]
            keep = end - start >= LENGTH
            if keep.any():
                yield _part_entries(buf[off[i]:off[j]], start[keep], end[keep], end[keep], -start[keep], ids[i:j][keep])
        else:
            step = room - LENGTH - 2 * SIDE
            for a in range(0, length, step):
                lo, hi = max(0, a - SIDE), min(length, a + step + LENGTH + SIDE)
                part = buf[off[i] + lo:off[i] + hi]
                found = _part_entries(part, np.array([0]), np.array([hi - lo]), np.array([a + step - lo]), np.array([lo]), ids[i:i + 1])
                first = found["at"].astype(np.int64) - found["hi"]
                # windows before `a` belong to the part before
                found = found[first + found["hi"] - found["lo"] >= a]
                if len(found) and a and first.size:
                    cut = found["at"].astype(np.int64) - found["hi"] < a
                    found["hi"][cut] = (found["at"][cut].astype(np.int64) - a).astype(np.uint8)
                    # a shortened run keeps no whole context in common with others
                    found["ctx"][cut] = mix(found["ctx"][cut] + np.uint64(1))
                yield found
        i = j


def _by_id(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column("doc_id").to_numpy()
    if len(ids) < 2 or (ids[1:] >= ids[:-1]).all():
        return batch
    return batch.take(pa.array(np.argsort(ids, kind="stable")))


def _same_runs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Boundaries of the runs of equal pairs."""
    if not len(one):
        return np.zeros(1, dtype=np.int64)
    return np.r_[0, np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1, len(one)]


def _again(one: np.ndarray, two: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (in document order) whose two identifiers were there before at another place."""
    order = np.lexsort((two, one))
    bounds = _same_runs(one[order], two[order])
    first = order[np.repeat(bounds[:-1], np.diff(bounds))]
    out = np.zeros(len(one), dtype=bool)
    out[order] = (doc[first] != doc[order]) | (at[first] != at[order])
    return out


def _route(rows: np.ndarray, one: str, two: str, slot: str, n_slots: int) -> tuple[pa.Array, pa.Array]:
    """Packed by the hash of field ``slot``; rows that repeat identifiers ``one`` and ``two`` of this batch by their document."""
    rows["again"] = _again(rows[one], rows[two], rows["doc"], rows["at"])
    by = np.where(rows["again"] > 0, mix(rows["doc"].astype(np.uint64)), mix(rows[slot].astype(np.uint64)))
    return pack_by_slot(rows, (by % np.uint64(n_slots)).astype(np.int32))


def _entries(n_slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _by_id(batch)
            found = list(entries(*utf8(batch.column("text")), batch.column("doc_id").to_numpy()))
            rows = np.concatenate(found) if found else np.zeros(0, dtype=_ENTRY)
            if len(rows):
                slot, data = _route(rows, "ctx", "ctx2", "gram", n_slots)
                yield pa.RecordBatch.from_arrays([slot, data], names=["slot", "data"])
    return run


_FOUND = "doc_id long, kind int, a long, b long"


def _by_document(doc: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": pa.array(doc.astype(np.int64)), "kind": pa.array(np.full(len(doc), kind), pa.int32()),
                     "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})


def _gather(rows: pa.Table) -> pa.Table:
    """One row per document of a slot: its pairs, those of covered ranges merged."""
    doc, a, b = (rows.column(c).to_numpy() for c in ("doc_id", "a", "b"))
    if rows.column("kind")[0].as_py() == _COVERED:
        doc, a, b = _merged(doc, a, b)
    else:
        order = np.argsort(doc, kind="stable")
        doc, a, b = doc[order], a[order], b[order]
    pairs = np.empty(len(doc), dtype=_PAIR)
    pairs["a"], pairs["b"] = a, b
    bounds = runs(doc)
    return pa.table({"doc_id": pa.array(doc[bounds[:-1]], pa.int64()), "parts": binary_array(pairs, bounds)})


def _by_slot(found: DataFrame, kind: int, n_slots: int) -> DataFrame:
    return (found.filter(F.col("kind") == kind).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(n_slots)))
            .groupBy("slot").applyInArrow(_gather, "doc_id long, parts binary"))


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of byte ranges per document; ranges that touch become one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    new = np.r_[True, doc[1:] != doc[:-1]]
    lift = (np.cumsum(new) - 1) << 33  # keeps documents apart in one running maximum
    reach = np.maximum.accumulate(hi + lift) - lift
    start = new.copy()
    start[1:] |= lo[1:] > reach[:-1]
    at = np.flatnonzero(start)
    return doc[at], lo[at], np.maximum.reduceat(hi, at)


def _refine(rows: pa.Table) -> pa.Table:
    """Buckets of one slot: byte ranges that are covered, and entries whose windows stay open."""
    e = unpack(rows.column("data"), _ENTRY)
    known = e[e["again"] > 0]
    e = e[e["again"] == 0]
    e = e[np.lexsort((e["at"], e["doc"], e["ctx2"], e["ctx"], e["gram"]))]
    same = np.zeros(len(e), bool)
    for c in ("gram", "ctx", "ctx2"):
        same[1:] = (same[1:] if c != "gram" else True) & (e[c][1:] == e[c][:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(e)))) if len(e) else np.zeros(0, np.int64)
    later = same & ((e["doc"] != e["doc"][first]) | (e["at"] != e["at"][first]))
    covered = np.concatenate([known, e[later]])
    start = covered["at"].astype(np.int64) - covered["hi"]
    stop = covered["at"].astype(np.int64) - covered["lo"] + LENGTH
    heads = e[~same]
    size = np.diff(runs(heads["gram"]))
    heads = heads[np.repeat(size > 1, size)] if len(heads) else heads
    near = {}
    for side in ("left", "right"):
        order = np.lexsort((heads[side], heads["gram"]))
        key = heads["gram"][order].astype(np.uint64) << np.uint64(16) | heads[side][order]
        size = np.diff(runs(key))
        near[side] = np.zeros(len(heads), dtype=bool)
        if len(heads):
            near[side][order] = np.repeat(size > 1, size) & (heads[side][order] > 0)
    lo = np.where(near["right"], heads["lo"], np.maximum(heads["lo"], SIDE)).astype(np.int64)
    hi = np.where(near["left"], heads["hi"], np.minimum(heads["hi"], SIDE)).astype(np.int64)
    live = (near["left"] | near["right"]) & (lo <= hi)
    heads, lo, hi = heads[live], lo[live], hi[live]
    first_window, last_window = heads["at"].astype(np.int64) - hi, heads["at"].astype(np.int64) - lo
    doc, start, stop = _merged(covered["doc"], start, stop)
    return pa.concat_tables([_by_document(doc, _COVERED, start, stop), _by_document(heads["doc"], _OPEN, first_window, last_window)])


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed UTF-8, smaller to move than Spark's rows of text."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs = [pack.compress(t.as_buffer()) if t.is_valid else None for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "body"])


def _plain(body) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8)


def _pairs(parts: bytes | None) -> np.ndarray:
    return np.frombuffer(parts or b"", dtype=_PAIR)


def _windows(n_slots: int):
    """Identifiers of the open windows, from the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _by_id(batch)
            found = []
            for doc, body, parts in zip(batch.column("doc_id").to_pylist(), batch.column("body"), batch.column("parts").to_pylist()):
                text, want = _plain(body.as_buffer()), _pairs(parts)
                size = want["b"].astype(np.int64) - want["a"] + 1
                at = np.repeat(want["a"].astype(np.int64), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.unique(at[at + LENGTH <= len(text)])
                for a in range(0, len(text), PIECE):
                    here = at[(at >= a) & (at < a + PIECE)]
                    if len(here):
                        rows = np.zeros(len(here), dtype=_WINDOW)
                        rows["doc"], rows["at"] = doc, here
                        for which, name in enumerate(("id", "id2")):
                            rows[name] = deep_identifiers(text[a:a + PIECE + LENGTH], which)[here - a]
                        found.append(rows)
            if found:
                rows = np.concatenate(found)
                slot, data = _route(rows, "id", "id2", "id", n_slots)
                yield pa.RecordBatch.from_arrays([slot, data], names=["slot", "data"])
    return run


def _first_windows(rows: pa.Table) -> pa.Table:
    w = unpack(rows.column("data"), _WINDOW)
    known, w = w[w["again"] > 0], w[w["again"] == 0]
    w = w[np.lexsort((w["at"], w["doc"], w["id2"], w["id"]))]
    if len(w):
        bounds = _same_runs(w["id"], w["id2"])
        first = np.repeat(bounds[:-1], np.diff(bounds))
        w = w[(w["doc"] != w["doc"][first]) | (w["at"] != w["at"][first])]
    covered = np.concatenate([known, w])
    at = covered["at"].astype(np.int64)
    doc, lo, hi = _merged(covered["doc"], at, at + LENGTH)
    return _by_document(doc, _COVERED, lo, hi)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, parts in zip(batch.column("body"), batch.column("parts").to_pylist()):
            text, r = _plain(body.as_buffer()) if body.is_valid else np.zeros(0, np.uint8), _pairs(parts)
            _, lo, hi = _merged(np.zeros(len(r), np.int64), r["a"], r["b"])
            keep, at = hashlib.sha256(), 0
            for a, b in zip(lo.tolist(), hi.tolist()):
                keep.update(text[at:a])
                at = b
            keep.update(text[at:])
            ranges = np.stack([lo, hi], axis=1).astype("<i8").tobytes() if len(lo) else b""
            out.append((len(text), int((hi.astype(np.int64) - lo).sum()) if len(lo) else 0, len(lo), keep.hexdigest(), ranges))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for every row of ``docs`` (doc_id, text).

    ``removed`` packs the removed byte ranges as little-endian pairs of 64-bit numbers (start, end).
    A null text is empty.  Rows of a null doc_id are neither judged nor compared.  Rows that repeat
    a doc_id count as one place: what stands at the same byte of another row of the same id is not earlier,
    and what is removed from one is removed from all.  An empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_slots = slots(docs.sparkSession)
    long_enough = docs.filter("doc_id IS NOT NULL").filter(F.octet_length("text") >= LENGTH)
    found = materialise(long_enough.mapInArrow(_entries(n_slots), "slot int, data binary").groupBy("slot").applyInArrow(_refine, _FOUND), "sd-entries")
    bodies = long_enough.mapInArrow(squeeze, "doc_id long, body binary")
    more = materialise(bodies.join(materialise(_by_slot(found, _OPEN, n_slots), "sd-open"), "doc_id").mapInArrow(_windows(n_slots), "slot int, data binary")
                       .groupBy("slot").applyInArrow(_first_windows, _FOUND), "sd-windows")
    ranges = materialise(_by_slot(found.unionByName(more), _COVERED, n_slots), "sd-ranges")
    drop_written(found.unionByName(more))
    return (docs.mapInArrow(squeeze, "doc_id long, body binary").join(ranges, "doc_id", "left")
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed binary"))
