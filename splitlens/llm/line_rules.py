"""Quality rules (operator 11): counts of each text, and lines that many documents of one host share.

The words are the runs ``[^\\x20\\x09-\\x0D]+``; lines are the pieces between ``\\n``.  A line's *normalised* form is
its sequence of words with A-Z lowered (white space does not matter); lines without a word are left alone.

1. One pass over the texts gives the base counts of every row and a 64-bit hash of each normalised line.
2. Per host (``source``; null is a host of its own) the distinct documents that hold a line are counted.  Exact copies
   of one text, and repeated rows, are one document.
3. A line of a host is over its limit when more than ``max(MIN_DOCUMENTS, SHARE_OF_HOST * documents of the host)`` of them hold it.
4. Lines over the limit are removed from every document of the host; a document of which less than ``LEAST_LEFT`` per cent
   of the words are left is depleted and rejected.

Every count is an aggregate with a map-side part (a line in a third of all documents is one key, one row a task), and the
lines over the limit go back to their documents by a join whose large side adaptive execution can split.

Defined cases: null text or no word: all counts 0 and ``base_failed``; null or repeated ``doc_id``: one result row per
input row; an empty table gives an empty result; columns other than ``doc_id``, ``text`` and ``source`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.llm import textkernel as K
from splitlens.llm.common import materialise

MIN_WORDS = 50          # fewer words fail the base rules
REPEAT_PERCENT = 50     # more words than this in repeated 3-word windows fail them
MIN_DOCUMENTS = 10
SHARE_OF_HOST = 0.005
LEAST_LEFT = 30         # per cent of the words
WINDOW = 3
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _classes() -> np.ndarray:
    """1 for word bytes, 2 for white space inside a line, 0 for the line break."""
    t = K.word_classes()
    t[[9, 11, 12, 13, 32]] = 2
    t[10] = 0
    return t


_CLASS, _LOWER, _RAW = _classes(), K.lower_table(), np.arange(256, dtype=np.uint8)
_SYMBOL = np.isin(_RAW, np.frombuffer(SYMBOLS, np.uint8))


def _pieces(part: np.ndarray) -> list[int]:
    """Cuts of one row, at most about PIECE apart and only where a word starts after white space, so no run is split."""
    cuts, at = [0], 0
    while len(part) - at > K.PIECE:
        end = at + K.PIECE
        while True:
            c = _CLASS[part[at:end + 1]]
            starts = np.flatnonzero((c[1:] == 1) & (c[:-1] != 1))
            if len(starts) or end >= len(part):
                break
            end += K.PIECE
        if not len(starts):
            break
        at += int(starts[-1]) + 1
        cuts.append(at)
    return [*cuts, len(part)]


def _runs(part: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of words and of white space: (start, is a word, hash, hash with A-Z lowered)."""
    cuts = _pieces(part) if len(row_starts) == 1 else [0, len(part)]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        piece = part[a:b]
        starts, ends = K.token_runs(piece, _CLASS, row_starts if len(cuts) == 2 else np.zeros(1, np.int64))
        found.append((starts + a, _CLASS[piece[starts]] == 1, K.run_hashes(piece, starts, ends, _RAW),
                      K.run_hashes(piece, starts, ends, _LOWER)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _sequence_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each of the sequences values[first[i]:last[i]]."""
    up, down = K.power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return K.mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def _equal_before(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Size of the group of equal (row, value) each entry belongs to."""
    key = K.mix(value + row.astype(np.uint64) * np.uint64(K.BASE))
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    return size[group]


def text_features(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, tuple[np.ndarray, ...]]]:
    """For groups of rows: the base counts, the number of lines with a word of each row, and of these lines the normalised
    hash, the number of words and the place among the row's lines."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + K.PIECE, side="right")) - 1, i + 1), n)
        part, bounds = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        start, word, raw, low = _runs(part, np.minimum(bounds[:-1], len(part)))
        row = np.searchsorted(bounds, start, side="right") - 1
        rows = j - i

        def per_row(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(flags)][bounds])

        counts = {"n_words": np.bincount(row[word], minlength=rows), "n_symbols": per_row(_SYMBOL[part]),
                  "word_chars": per_row((_CLASS[part] == 1) & ((part & 0xC0) != 0x80))}
        # lines: runs between line breaks, numbered over the group of rows
        line = np.searchsorted(np.flatnonzero(part == 10), start) + row
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(line)] if len(line) else first
        words_before = np.r_[0, np.cumsum(word)]
        words = words_before[last] - words_before[first]
        live = words > 0
        whole = _sequence_hashes(raw, first, last)[live]
        line_row = row[first][live]
        _, group = np.unique(K.mix(whole + line_row.astype(np.uint64) * np.uint64(K.BASE)), return_index=True)
        counts["n_dup_lines"] = np.bincount(line_row, minlength=rows) - np.bincount(line_row[group], minlength=rows)
        normal = _sequence_hashes(low[word], words_before[first], words_before[last])[live].view(np.int64)
        place = line[first][live] - (np.searchsorted(np.flatnonzero(part == 10), bounds[:-1]) + np.arange(rows))[line_row]
        lines = (normal, words[live].astype(np.int32), place.astype(np.int32))
        # repeated windows of three words
        w, w_row = raw[word], row[word]
        covered = np.zeros(len(w) + 1, np.int64)
        if len(w) >= WINDOW:
            same = np.flatnonzero(w_row[WINDOW - 1:] == w_row[:len(w) - WINDOW + 1])
            twice = same[_equal_before(w_row[same], K.shingles(w, WINDOW)[same]) > 1]
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + WINDOW, -1)
        counts["n_repeat_words"] = np.bincount(w_row[np.cumsum(covered)[:-1] > 0], minlength=rows)
        yield counts, np.bincount(line_row, minlength=rows), lines
        i = j


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, sizes, lines = {c: [] for c in COUNTS}, [np.zeros(1, np.int64)], []
        for some, n_lines, found in text_features(*K.utf8(batch.column("text"))):
            for c in COUNTS:
                counts[c].append(some[c])
            sizes.append(n_lines)
            lines.append(found)
        bounds = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
        columns = {c: batch.column(c) for c in ("rid", "doc_id", "host", "doc")}
        columns |= {c: pa.array(np.concatenate(counts[c]) if counts[c] else [], type=pa.int64()) for c in COUNTS}
        for k, (name, kind) in enumerate((("line", pa.int64()), ("line_words", pa.int32()), ("line_at", pa.int32()))):
            values = np.concatenate([found[k] for found in lines]) if lines else []
            columns[name] = pa.ListArray.from_arrays(bounds, pa.array(values, type=kind))
        yield pa.RecordBatch.from_pydict(columns)


def _per_row(docs: DataFrame) -> DataFrame:
    """Base counts and line hashes of every row of ``docs`` (rid, doc_id, source, text), written to the shared folder."""
    plain = docs.select("rid", "doc_id", F.xxhash64("source").alias("host"), F.xxhash64("text").alias("doc"), "text")
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = (f"rid long, doc_id {kind}, host long, doc long, " + ", ".join(f"{c} long" for c in COUNTS)
              + ", line array<long>, line_words array<int>, line_at array<int>")
    return materialise(plain.mapInArrow(_features, schema), "line-features")


def _lines(rows: DataFrame) -> DataFrame:
    return (rows.select("rid", "host", "doc", F.explode(F.arrays_zip("line", "line_words", "line_at")).alias("l"))
            .select("rid", "host", "doc", "l.line", F.col("l.line_words").alias("words"), F.col("l.line_at").alias("nth")))


def _over_limit(rows: DataFrame, min_documents: int, share_of_host: float) -> DataFrame:
    """(host, line) of the lines that more distinct documents of the host hold than its limit allows."""
    held = (_lines(rows).select("host", "line", "doc").distinct().groupBy("host", "line")
            .agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > min_documents))
    hosts = rows.select("host", "doc").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    over = held.join(hosts, "host").filter(F.col("documents") > F.lit(share_of_host) * F.col("size"))
    return materialise(over.select("host", "line", "documents"), "line-over")


def line_rules(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, share_of_host: float = SHARE_OF_HOST,
               least_left: int = LEAST_LEFT) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept, n_lines_removed, n_words_left and
    removed_lines (which of the ``\n``-split lines go, from 0; null where none)."""
    return _judged(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "text"),
                   min_documents, share_of_host, least_left).drop("rid")


def _judged(docs: DataFrame, min_documents: int, share_of_host: float, least_left: int) -> DataFrame:
    rows = _per_row(docs)
    hits = (_lines(rows).join(_over_limit(rows, min_documents, share_of_host), ["host", "line"]).groupBy("rid")
            .agg(F.sum("words").alias("gone"), F.sort_array(F.collect_list("nth")).alias("removed_lines")))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (rows.join(hits, "rid", "left")
            .select("rid", "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (100 * left >= least_left * F.col("n_words"))).alias("kept"),
                    F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_lines_removed"), left.alias("n_words_left"), "removed_lines"))


def clean(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, share_of_host: float = SHARE_OF_HOST,
          least_left: int = LEAST_LEFT) -> DataFrame:
    """The kept documents without their lines over the limit, with the columns of ``docs``."""
    held = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "line-docs")
    judged = _judged(held.select("rid", "row.doc_id", "row.source", "row.text"), min_documents, share_of_host, least_left)
    kept = held.join(judged.filter("kept").select("rid", "removed_lines"), "rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not gone else "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone)
                     for t, gone in zip(batch.column("text").to_pylist(), map(set, (g or () for g in batch.column("removed_lines").to_pylist())))]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "left": pa.array(texts, type=pa.string())})

    row_type = held.schema["row"].dataType.simpleString()
    texts = kept.select("row", F.col("row.text").alias("text"), "removed_lines").mapInArrow(cut, f"row {row_type}, left string")
    return texts.select(*[F.col("left" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])
