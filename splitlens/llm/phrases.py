"""Phrase collocation mining (operator 13): truncated suffix subtrees, built group by group (ERA-style).

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and 0x0A-0x0D and these into words ``[^\\x20\\x09]+``; every
language (null: ``und``) is a corpus of its own, which the 64-bit word ids carry.  The suffixes of all pieces, truncated
to DEPTH words, form one tree whose node totals are the phrase counts.  As in ERA it is never built as a whole:

1. *Vertical partitioning.* Words are counted (prefixes of length 1).  A prefix that occurs more often than the memory
   budget is extended by a word, and its extensions are counted in turn; full depth is a single leaf and needs no bound.
2. *Groups.*  Prefixes are dealt by their hash to so many groups that half a budget is expected in each.  A second pass
   sends every suffix to the group of its prefix, as leaves with counts already added up inside a task; the leaves of
   one task and group travel as one packed row.
3. *Subtrees.*  Each group alone sorts its leaves and reads node counts from leaf totals; nodes under MIN_COUNT are
   not passed on.
4. Scores, containment and ranks are joins and aggregates over these nodes, in exact decimal arithmetic.

The budget is at least N / MAX_HOT, so at most MAX_HOT prefixes of a length can be over it; their ids (8 bytes each) are
the only thing broadcast.

Defined cases: null or empty text: no words; ``doc_id`` is not read; repeated rows count each; equal scores rank by count, then by
phrase in UTF-8 byte order; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitlens.llm import textkernel as K
from splitlens.llm.common import Shipped, materialise, runs

MIN_COUNT, TOP = 10, 2000
COVERED_PERCENT = 50
DEPTH = 3
BUDGET = 1_000_000      # occurrences below one prefix, at least
MAX_HOT = 1 << 20       # prefixes of one length that may be over the budget
CHUNK = 1_000_000       # words whose leaves a task adds up at once; with a part's words under 2 ** 21
HELD_WORDS = 150_000    # distinct words a task holds before it passes counts on

_LOWER = K.lower_table()
_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_CLASS = np.where(_BREAK | np.isin(np.arange(256), [32, 9]), 0, 1).astype(np.uint8)
_MIX = np.uint64(0xA0761D6478BD642F)


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _extended(ids: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Id of a prefix extended by a word."""
    return K.mix(ids * _MIX + following)


def _cuts(part: np.ndarray) -> list[int]:
    """Cuts of one long row, about PIECE apart and never inside a word."""
    cuts, at = [0], 0
    while len(part) - at > K.PIECE:
        end = at + K.PIECE
        while end < len(part) and _CLASS[part[end]]:
            end += 1
        cuts.append(end)
        at = end
    return [*cuts, len(part)] if cuts[-1] < len(part) else cuts


def _word_runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For parts of the texts: bytes, word starts, ends, ids, piece numbers (from 1; equal only within a text) and the language
    of each word's text.  A long text comes in several parts, whose piece numbers go on."""
    langs = batch.column("lang").to_pylist()
    salts = {lang: _salt(lang) for lang in set(langs)}
    salt = np.array([salts[lang] for lang in langs], dtype=np.uint64)
    buf, off = K.utf8(batch.column("text"))
    i, n, piece = 0, len(langs), 0
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + K.PIECE, side="right")) - 1, i + 1), n)
        whole, bounds = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        cuts = _cuts(whole) if j == i + 1 else [0, len(whole)]
        for a, b in zip(cuts, cuts[1:]):
            part = whole[a:b]
            row_starts = np.minimum(bounds[:-1], len(part)) if len(cuts) == 2 else np.zeros(1, np.int64)
            starts, ends = K.token_runs(part, _CLASS, row_starts)
            row = np.searchsorted(bounds, starts + a, side="right") - 1
            breaks = np.flatnonzero(_BREAK[part])
            ids = np.maximum(K.mix(K.run_hashes(part, starts, ends, _LOWER) + salt[i:j][row]), np.uint64(1))
            yield part, starts, ends, ids, piece + 1 + np.searchsorted(breaks, starts) + row, [langs[i + r] for r in row] if len(salts) > 1 else langs[:1] * len(row)
            piece += len(breaks)
        piece += j - i
        i = j


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[dict[int, int], dict[int, str]]] = {}  # by language: counts and words by id

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (counts, names) in held.items():
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(np.fromiter(counts, np.uint64, len(counts)).view(np.int64)), "lang": pa.array([lang] * len(counts), type=pa.string()),
                "word": pa.array(names.values(), type=pa.string()), "n": pa.array(np.fromiter(counts.values(), np.int64, len(counts)))})
        held.clear()

    for batch in batches:
        for part, starts, ends, ids, _, langs in _word_runs(batch):
            some, at, n = np.unique(ids, return_index=True, return_counts=True)
            for key, k, c in zip(some.tolist(), at.tolist(), n.tolist()):
                counts, names = held.setdefault(langs[k], ({}, {}))
                if key in counts:
                    counts[key] += c
                else:
                    counts[key] = c
                    names[key] = part[starts[k]:ends[k]].tobytes().lower().decode()
            if sum(len(counts) for counts, _ in held.values()) > HELD_WORDS:
                yield from flush()
    yield from flush()


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(ids, piece numbers, number of suffixes) of about ``size`` words at a time; the last DEPTH - 1 words of a chunk only
    complete its suffixes and begin the next one."""
    ids, pieces, held, base = [], [], 0, 0
    for batch in batches:
        top = base
        for _, _, _, some, piece, _ in _word_runs(batch):
            ids.append(some)
            pieces.append(piece + base)
            top = max(top, int(piece[-1]) + base) if len(piece) else top
            held += len(some)
            if held >= size:
                whole, place = np.concatenate(ids), np.concatenate(pieces)
                yield whole, place, held + 1 - DEPTH
                ids, pieces, held = [whole[1 - DEPTH:]], [place[1 - DEPTH:]], DEPTH - 1
        base = top
    if held:
        yield np.concatenate(ids), np.concatenate(pieces), held


def _windows(ids: np.ndarray, pieces: np.ndarray, starts: int) -> tuple[np.ndarray, ...]:
    """The distinct truncated suffixes of at least two words beginning at the first ``starts`` words, with their counts:
    (first, second, third + 1 or 0 at a piece's end) as places in the sorted distinct ids, count, distinct ids."""
    names, code = np.unique(ids, return_inverse=True)
    code = code.astype(np.int32)
    two = np.flatnonzero(pieces[1:] == pieces[:-1])
    two = two[two < starts]
    v = len(names) + 1
    # v ** 3 < 2 ** 63 by the size of a chunk
    key = code[two].astype(np.int64)
    key *= v
    key += code[two + 1]
    key *= v
    more = two[two + 2 < len(ids)]
    more = more[pieces[more + 2] == pieces[more]]
    key[np.searchsorted(two, more)] += code[more + 2] + 1
    key, count = _counted(key)
    third = (key % v).astype(np.int32)
    key //= v
    return (key // v).astype(np.int32), (key % v).astype(np.int32), third, count, names


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``key``, ascending, and how often each occurs; ``key`` is sorted in place."""
    key.sort()
    bounds = runs(key)
    return key[bounds[:-1]], np.diff(bounds)


def _pack(first: np.ndarray, second: np.ndarray, third: np.ndarray, count: np.ndarray, names: np.ndarray) -> bytes:
    """One compressed value: its own table of ids, then three columns of places in it, then the counts."""
    used = np.unique(np.concatenate([first, second, third[third > 0] - 1]))
    kind = np.uint16 if len(used) < 65535 else np.uint32
    places = [np.searchsorted(used, c) for c in (first, second)] + [np.where(third > 0, np.searchsorted(used, third - 1) + 1, 0)]
    head = np.array([len(used), len(first), np.dtype(kind).itemsize], dtype=np.uint32)
    body = b"".join([head.tobytes(), names[used].tobytes(), *(p.astype(kind).tobytes() for p in places), count.astype(np.uint32).tobytes()])
    return len(body).to_bytes(4, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """(first, second, third or 0, count) with 64-bit ids."""
    body = pa.decompress(blob[4:], decompressed_size=int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
    n_names, n, width = np.frombuffer(body, np.uint32, 3).tolist()
    at = 12 + 8 * n_names
    names = np.frombuffer(body, np.uint64, n_names, 12)
    kind, out = np.uint16 if width == 2 else np.uint32, []
    for k in range(3):
        out.append(np.frombuffer(body, kind, n, at + k * n * width).astype(np.int64))
    ended = np.r_[np.uint64(0), names]
    return names[out[0]], names[out[1]], ended[out[2]], np.frombuffer(body, np.uint32, n, at + 3 * n * width).astype(np.int64)


def _pairs_below(hot: Shipped, chunk: int) -> Callable:
    """Counts of the two-word extensions of the prefixes over the budget."""
    def run(batches):
        hot_words = hot.value
        for ids, pieces, starts in _chunks(batches, chunk):
            first, second, _, count, names = _windows(ids, pieces, starts)
            live = np.isin(names, hot_words)[first]
            first, second, count = first[live], second[live], count[live]
            new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"w1": pa.array(names[first[new]].view(np.int64)), "w2": pa.array(names[second[new]].view(np.int64)),
                                              "n": pa.array(np.add.reduceat(count, new) if len(new) else count)})
    return run


def _to_groups(hot: Shipped, groups: int, chunk: int) -> Callable:
    """Packed leaves, one row for each group a chunk has suffixes of.  Groups from ``groups`` on hold full-depth prefixes."""
    def run(batches):
        hot_words, hot_pairs = hot.value
        for ids, pieces, starts in _chunks(batches, chunk):
            first, second, third, count, names = _windows(ids, pieces, starts)
            prefix = K.mix(names[first])
            deeper = np.isin(names, hot_words)[first]
            pair = _extended(names[first[deeper]], names[second[deeper]])
            prefix[deeper] = pair
            group = (prefix % np.uint64(groups)).astype(np.int64 if 2 * groups >= 1 << 31 else np.int32)
            deepest = np.flatnonzero(deeper)[np.isin(pair, hot_pairs)]
            last = np.r_[np.uint64(0), names][third[deepest]]
            group[deepest] = groups + (_extended(prefix[deepest], last) % np.uint64(groups)).astype(group.dtype)
            del prefix, deeper, pair
            order = np.argsort(group, kind="stable")
            group = group[order]
            bounds = runs(group)
            blobs = [_pack(first[rows], second[rows], third[rows], count[rows], names) for rows in np.split(order, bounds[1:-1])] if len(order) else []
            yield pa.RecordBatch.from_pydict({"slot": pa.array(group[bounds[:-1]] if len(order) else [], type=pa.int64()), "leaves": pa.array(blobs, type=pa.binary())})
    return run


def _subtree(groups: int, least: int) -> Callable:
    """Nodes of one group's subtrees with at least ``least`` occurrences: two words (``w3`` null), or three."""
    def run(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        parts = [_unpack(b) for b in table.column("leaves").to_pylist()]
        a, b, c, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((c, b, a))
        a, b, c, n = a[order], b[order], c[order], n[order]
        inner = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        leaf = np.flatnonzero(inner | np.r_[True, c[1:] != c[:-1]])
        inner = np.flatnonzero(inner)
        totals, sums = np.add.reduceat(n, leaf), np.add.reduceat(n, inner)
        leaf, totals = leaf[c[leaf] != 0], totals[c[leaf] != 0]
        leaf, totals = leaf[totals >= least], totals[totals >= least]
        whole = np.flatnonzero(sums >= least) if slot < groups else np.zeros(0, np.int64)  # full-depth groups hold parts of the node above
        at = np.r_[inner[whole], leaf]
        third = pa.array(c[at].view(np.int64), mask=np.r_[np.ones(len(whole), bool), np.zeros(len(leaf), bool)])
        return pa.table({"w1": pa.array(a[at].view(np.int64)), "w2": pa.array(b[at].view(np.int64)), "w3": third, "n": pa.array(np.r_[sums[whole], totals])})
    return run


def _ids(df: DataFrame, *columns: str) -> list[np.ndarray]:
    got = df.select(*columns).toArrow()
    return [np.asarray(got.column(c)).astype(np.int64).view(np.uint64) for c in columns]


def phrase_nodes(docs: DataFrame, least: int = MIN_COUNT, budget: int = BUDGET, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(words: ``id, lang, word, n``; nodes: ``w1, w2, w3, n`` of the phrases of two words (w3 null) and three with at least
    ``least`` occurrences, as ids)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")
    words = materialise(texts.mapInArrow(_count_words, "id long, lang string, word string, n long")
                        .groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n")), "phrase-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, total // MAX_HOT)
    groups = max(1, -(-2 * total // budget))
    hot_words = _ids(words.filter(F.col("n") > budget), "id")[0]
    pairs = None
    hot_pairs = np.zeros(0, np.uint64)
    if len(hot_words):
        pairs = materialise(texts.mapInArrow(_pairs_below(Shipped(spark, hot_words), chunk), "w1 long, w2 long, n long")
                            .groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter(F.col("n") > budget), "phrase-pairs")
        hot_pairs = _extended(*_ids(pairs, "w1", "w2"))
    leaves = texts.mapInArrow(_to_groups(Shipped(spark, (hot_words, hot_pairs)), groups, chunk), "slot long, leaves binary")
    nodes = leaves.groupBy("slot").applyInArrow(_subtree(groups, least), "w1 long, w2 long, w3 long, n long")
    if pairs is not None:
        nodes = nodes.unionByName(pairs.filter(F.col("n") >= least).select("w1", "w2", F.lit(None).cast("long").alias("w3"), "n"))
    return words, materialise(nodes, "phrase-nodes")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exact: the products are decimals of 38 digits."""
    return F.expr(f"(CAST({a} AS DECIMAL(18,0)) * CAST({a} AS DECIMAL(18,0)) * CAST(1000000 AS DECIMAL(7,0))) "
                  f"div (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0)))")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT,
                 budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by score."""
    words, nodes = phrase_nodes(docs, least, budget, chunk)
    single = words.select("id", "n").filter(F.col("n") >= least)
    double = nodes.filter("w3 IS NULL").select("w1", "w2", "n")
    triple = nodes.filter("w3 IS NOT NULL")

    def with_word(df: DataFrame, of: str, name: str) -> DataFrame:
        return df.join(single.select(F.col("id").alias(of), F.col("n").alias(name)), of)

    def with_pair(df: DataFrame, one: str, two: str, name: str) -> DataFrame:
        return df.join(double.select(F.col("w1").alias(one), F.col("w2").alias(two), F.col("n").alias(name)), [one, two])

    longer = (triple.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "n")
              .groupBy("p.w1", "p.w2").agg(F.max("n").alias("longer")))
    two = with_word(with_word(double.withColumnRenamed("n", "a"), "w1", "l"), "w2", "r").join(longer, ["w1", "w2"], "left")
    two = (two.filter(F.coalesce(100 * F.col("longer") < covered_percent * F.col("a"), F.lit(True)))
           .select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", _score("a", "l", "r").alias("score")))
    three = triple.withColumnRenamed("n", "a")
    three = with_word(with_word(with_pair(with_pair(three, "w2", "w3", "r1"), "w1", "w2", "l2"), "w1", "l1"), "w3", "r2")
    three = three.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    three = three.select("w1", "w2", "w3", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    found = two.unionByName(three).join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("p1")), "w1")
    found = materialise(found, "phrase-scores")
    # the score of each language's last place (a score is at most 1000000, so this is a table of a bounded size a language)
    places = Window.partitionBy("lang").orderBy(F.col("score").desc())
    reach = (found.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("k")).withColumn("k", F.sum("k").over(places.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("k") >= top, F.col("score"))), F.lit(0)).alias("lowest")))
    best = found.join(reach, "lang").filter(F.col("score") >= F.col("lowest"))
    for k in (2, 3):
        best = best.join(words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"p{k}")), f"w{k}", "left")
    best = best.withColumn("phrase", F.concat_ws(" ", "p1", "p2", "p3"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
