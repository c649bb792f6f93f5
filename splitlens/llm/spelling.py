"""Spelling variant grouping (operator 12): words one edit apart, by asymmetric chunks.

Words are counted first (one pass, counters combined inside each task before the shuffle); everything after that works
on the vocabulary.  To find the words within one inserted, deleted or replaced code point, each word ``u`` contributes two
disjoint *chunks*, its halves; a word ``v`` of the same length or one longer contributes its positional *grams* of the
chunks' lengths.  One edit spoils one half only, so the other half of ``u`` is a gram of ``v``, at the same place when
it is the first half, shifted by the difference in length (0 or 1) when it is the second.  Grams that no chunk can meet
within that shift are not sent.  Candidates share chunk and place and are verified by edit distance.

A chunk that many words share (a common beginning) would give the square of its words.  Such a group is *refined*: the
half left open is cut in two, and the chunk grows by one of the parts, on both sides, again without loss, until the
group is small or one code point is open, when its size is bounded by the alphabet.  So no group's pairs are all tried.

Then each word's *form* is its near word of largest count, if that is at least twice its own, and its *root* is reached by
pointer doubling along forms (counts double at each step, so chains are short and free of cycles).

Defined cases: null or empty text: no words; null ``doc_id``: the empty string in the key of the deletion rule; repeated
rows count each; ties of n: smallest form in code-point order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import materialise

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 5, 3
DAMAGED = 97            # one run in so many (by its hash) loses a code point
PAIRS_OF_A_GROUP = 4096  # candidates above which a chunk's group is refined
HELD_WORDS = 200_000    # distinct words a task holds before it passes counts on
PIECE = 1 << 22         # code points searched at once

_RUN, _GAP = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")


def _pieces(text: str) -> Iterator[str]:
    """``text`` in pieces that split no run."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:]


def _words_of(doc_id, text: bytes) -> Iterator[tuple[str, int]]:
    """The words of one text, damaged by the rule, with their occurrences."""
    key = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in _pieces(text.lower().decode()):
        for run, n in Counter(_RUN.findall(piece)).items():
            if len(run) < MIN_LENGTH:
                continue
            h = zlib.crc32(run.encode(), key)
            if h % DAMAGED == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1:]
            if len(run) >= MIN_LENGTH:
                yield run, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), type=pa.string()), "n": pa.array(held.values(), type=pa.int64())})
        held.clear()
        return out

    for batch in batches:
        # bytes.lower() lowers A-Z alone
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
            body = text.as_py()
            if body:
                for word, n in _words_of(doc_id, body):
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words with at least MIN_COUNT occurrences."""
    return (docs.select("doc_id", "text").filter("text IS NOT NULL").mapInArrow(_count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT))


def _key(length: Column, before: Column, after: Column) -> Column:
    """Identity of a chunk: length of the open part's word, its place, what precedes and what follows the open part."""
    return F.xxhash64(length, "start", "stop", "longer", before, after)


def _chunks(regions: DataFrame) -> DataFrame:
    """The chunk words of each open part [start, stop) (their own code points) with their keys."""
    word = F.col("word")
    return regions.withColumn("key", _key(F.length(word), F.substring(word, F.lit(1), F.col("start")),
                                          F.substring(word, F.col("stop") + 1, F.length(word))))


def _grams(regions: DataFrame) -> DataFrame:
    """The same for gram words, whose open part is ``longer`` code points longer."""
    word = F.col("word")
    return regions.withColumn("key", _key(F.length(word) - F.col("longer"), F.substring(word, F.lit(1), F.col("start")),
                                          F.substring(word, F.col("stop") + F.col("longer") + 1, F.length(word))))


def _halves(words: DataFrame, length: Column) -> DataFrame:
    """Each word with its halves as open parts, in turn; ``length`` is that of the chunk word."""
    middle = F.floor(length / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("start"), middle.alias("stop")), F.struct(middle.alias("start"), length.alias("stop")))
    return words.withColumn("part", F.explode(parts)).select("word", "n", "longer", "part.start", "part.stop")


def _refined(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
    parts = F.array(F.struct(F.col("start"), middle.alias("stop")), F.struct(middle.alias("start"), F.col("stop")))
    return rows.withColumn("part", F.explode(parts)).select("word", "n", "longer", "part.start", "part.stop")


def near_pairs(words: DataFrame, pairs_of_a_group: int = PAIRS_OF_A_GROUP) -> DataFrame:
    """``a, n_a, b, n_b``: every unordered pair of distinct words one edit apart, once; ``words`` holds word and n, each word once."""
    size = F.length("word")
    both = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1))))
    chunks = _chunks(_halves(both, size))
    grams = _grams(_halves(both, size - F.col("longer")))
    found, level = [], 0
    while True:
        chunks, grams = materialise(chunks, f"chunks-{level}"), materialise(grams, f"grams-{level}")
        sizes = (chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.col("stop") - F.col("start")).alias("open"))
                 .join(grams.groupBy("key").agg(F.count(F.lit(1)).alias("n_grams")), "key"))
        large = materialise(sizes.filter((F.col("n_chunks") * F.col("n_grams") > pairs_of_a_group) & (F.col("open") > 1)).select("key"), f"large-{level}")
        u = chunks.join(large, "key", "left_anti").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), "longer")
        v = grams.join(large, "key", "left_anti").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
        pairs = u.join(v, "key").filter(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(materialise(pairs.select("a", "n_a", "b", "n_b"), f"near-{level}"))
        if large.isEmpty():
            break
        chunks, grams = (make(_refined(rows.join(large, "key", "left_semi"))) for make, rows in ((_chunks, chunks), (_grams, grams)))
        level += 1
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: the last word reached by following forms."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, pairs_of_a_group: int = PAIRS_OF_A_GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    words = materialise(vocabulary(docs), "vocabulary")
    pairs = materialise(near_pairs(words, pairs_of_a_group), "near")
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("form"))).alias("best")
    near = ways.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left")
    enough = -F.col("best.minus") >= 2 * F.col("n")
    table = materialise(joined.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                      F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(table.filter("form IS NOT NULL").select("word", "form"))
    return (table.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
