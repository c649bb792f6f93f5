"""Token counts of a unigram tokenizer by count-only Viterbi.

The vocabulary is read from a SentencePiece file (pieces and scores).  Aho-Corasick enumerates the
vocabulary matches that end at each character; dynamic programming carries, for every character
position, the best score and the number of pieces on the best path, and nothing else: no
segmentation is built.

Tie rules, as in the unigram decoders of the public libraries: matches are tried by their start,
left to right, and a later one wins only with a strictly greater score, so of equal scores the
longest match stays.  A character that starts no one-character piece may be taken as unknown, at
the least score of the vocabulary minus 10.  With byte fallback an unknown character counts as its
UTF-8 bytes, else a run of neighbouring unknown characters counts as one piece.

Spaces are written as U+2581 and one is put in front.  No piece holds U+2581 after another
character, so the best path always breaks before a run of U+2581; with byte fallback it also breaks
on both sides of a character that no longer piece holds.  The text is cut there, and the count of
each distinct chunk is kept (a bounded memo).  The scores of the file are whole numbers,
so sums in doubles are exact and cutting changes no comparison.
"""

from __future__ import annotations

import re
import sys
from collections import deque
from collections.abc import Iterator
from itertools import chain, islice
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 800_000         # chunks kept per worker process
MEMO_CHARS = 48        # longer chunks are counted one by one and not kept
GROUP = 20_000         # chunks counted at once
PART_CHARS = 2_000_000  # characters cut into chunks at once
BREAK = "\0"           # between chunks that are counted at once; no piece holds it
_MATCH = np.dtype([("end", "i8"), ("piece", "i8")])


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(pieces with scores, byte fallback) of a SentencePiece model, without control and byte
    pieces; score placeholders of added space runs count as the least regular score."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    floor = min(s for _, s in plain if s > -1e8)
    return [(p, s if s > -1e8 else floor) for p, s in plain], any(sp.is_byte(i) for i in ids)


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces) or SPACE not in {p for p, _ in pieces}:
            raise ValueError("the space mark must be a piece, and in no piece after another character")
        self.matcher = ahocorasick.Automaton()
        for i, (piece, _) in enumerate(pieces):
            self.matcher.add_word(piece, i)
        self.matcher.make_automaton()
        self.length = np.array([len(p) for p, _ in pieces], dtype=np.int64)
        self.score = np.array([s for _, s in pieces], dtype=np.float64)
        self.unknown = float(self.score.min()) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.longest = int(self.length.max())
        self.memo: dict[str, int] = {}
        joined = sorted({c for p, _ in pieces if len(p) > 1 for c in p} - {SPACE})
        self.chunk = (re.compile(f"{SPACE}*[{re.escape(''.join(joined))}]+|{SPACE}+|.", re.DOTALL) if byte_fallback
                      else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+"))

    def count_long(self, chunk: str) -> int:
        """Pieces on the best path of one chunk of any length, with a window of the last positions."""
        best: deque[tuple[float, int, bool]] = deque([(0.0, 0, False)], maxlen=self.longest)
        matches = self.matcher.iter(chunk)
        pending = next(matches, None)
        for end, char in enumerate(chunk):
            found = []
            while pending is not None and pending[0] == end:
                found.append((int(self.length[pending[1]]), float(self.score[pending[1]])))
                pending = next(matches, None)
            found.sort(reverse=True)  # by start, left to right
            if not found or found[-1][0] != 1:
                found.append((1, None))
            top = None
            for length, score in found:
                before = best[-length]
                value = before[0] + (self.unknown if score is None else score)
                if top is None or value > top[0]:
                    if score is not None:
                        top = (value, before[1] + 1, False)
                    elif self.byte_fallback:
                        top = (value, before[1] + len(char.encode("utf-8", "surrogatepass")), True)
                    else:
                        top = (value, before[1] + (not before[2]), True)
            best.append(top)
        return best[-1][1]

    def count_many(self, chunks: list[str]) -> np.ndarray:
        """The same for many short chunks at once: one matching pass over their concatenation, then
        one vectorised step of the dynamic programme for each character position."""
        lengths = np.array([len(c) for c in chunks], dtype=np.int64)
        base = np.cumsum(lengths + 1) - lengths - 1          # node 0 of each chunk
        joined = BREAK.join(chunks)
        chunk_of = np.repeat(np.arange(len(chunks)), lengths + 1)
        found = np.fromiter(self.matcher.iter(joined), dtype=_MATCH)  # by end, longest first
        end, length, score = found["end"], self.length[found["piece"]], self.score[found["piece"]]
        char = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lone = np.ones(len(char), dtype=bool)
        lone[end[length == 1]] = False
        lone[base[1:] - 1] = False                           # the breaks
        lone = np.flatnonzero(lone)
        unknown = np.r_[np.zeros(len(end), dtype=bool), np.ones(len(lone), dtype=bool)]
        end = np.r_[end, lone]
        length = np.r_[length, np.ones(len(lone), dtype=np.int64)]
        score = np.r_[score, np.full(len(lone), self.unknown)]
        order = np.argsort(end, kind="stable")               # two sorted parts
        step = (np.arange(1, len(char) + 1) - base[chunk_of[:-1]])[end[order]].astype(np.int16)
        order = order[np.argsort(step, kind="stable")]       # by position in the chunk, then end, longest first
        end, length, score, unknown = end[order], length[order], score[order], unknown[order]
        step = np.sort(step, kind="stable")
        code = char[end]
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        best = np.zeros(len(char) + 2)
        pieces = np.zeros(len(char) + 2, dtype=np.int64)
        after_unknown = np.zeros(len(char) + 2, dtype=bool)
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True]) if len(step) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            node = end[a:b] + 1
            start = node - length[a:b]
            value = best[start] + score[a:b]
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[first, b - a])
            top = np.repeat(np.maximum.reduceat(value, first), size) == value
            pick = np.minimum.reduceat(np.where(top, np.arange(b - a), b - a), first)
            if self.byte_fallback:
                more = np.where(unknown[a:b], width[a:b], 1)[pick]
            else:
                more = 1 - (unknown[a:b] & after_unknown[start])[pick]
            at = node[first]
            best[at] = value[pick]
            pieces[at] = pieces[start[pick]] + more
            after_unknown[at] = unknown[a:b][pick]
        return pieces[base + lengths]

    def learn(self, chunks: set[str]) -> None:
        """Put the counts of new chunks into the memo."""
        short = [c for c in chunks if len(c) <= MEMO_CHARS and BREAK not in c]
        for i in range(0, len(short), GROUP):
            part = short[i:i + GROUP]
            self.memo.update(zip(part, self.count_many(part).tolist()))
        for c in chunks:
            if c not in self.memo:
                self.memo[c] = self.count_long(c)

    def texts(self, texts: list[str | None]) -> list[int]:
        """Counts of some texts: the chunks not yet known are counted together."""
        memo, out, missing = self.memo, [], []
        for t in texts:
            chunks = self.chunk.findall(SPACE + t.replace(" ", SPACE)) if t else []
            known = list(map(memo.get, chunks))
            out.append(sum(filter(None, known)))
            missing.append([c for c, n in zip(chunks, known) if n is None] if None in known else [])
        new = set(chain.from_iterable(missing))
        self.learn(new)
        out = [n + sum(map(memo.__getitem__, part)) for n, part in zip(out, missing)]
        for c in new:
            if len(c) > MEMO_CHARS:
                del memo[c]
        if len(memo) > MEMO:
            for old in list(islice(memo, len(memo) - MEMO // 2)):
                del memo[old]
        return out


def _counter(path: str) -> UnigramCounter:
    """One counter for all tasks of a worker process, so that its memo serves them all."""
    kept = sys.modules.setdefault("_unigram_counters", ModuleType("_unigram_counters")).__dict__
    if path not in kept:
        kept[path] = UnigramCounter(*vocabulary(path))
    return kept[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            n, held, size = [], [], 0
            for value in batch.column("text"):
                held.append(value.as_py())
                size += len(held[-1] or "")
                if size > PART_CHARS:
                    n += counter.texts(held)
                    held, size = [], 0
            n += counter.texts(held)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])
    return run


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``; null and empty texts have 0 tokens, rows with
    repeated or null ids are counted one by one.  ``model`` is a path every executor can open."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_count(model), "doc_id long, n_tokens long"))
