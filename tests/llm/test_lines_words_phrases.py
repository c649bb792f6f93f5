"""Quality rules, spelling variants and phrases (operators 11 to 13) against plain Python, and their SQL on the same tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from splitlens.llm import line_rules as L
from splitlens.llm import phrases as P
from splitlens.llm import spelling as W
from splitlens.llm.queries import ORACLE, QUERIES
from tests.harness import compare, duck_connection

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_queries_equal_their_sql(spark, key):
    got = compare(spark, duck_connection(SF), key, SF, QUERIES[key], ORACLE[key])
    assert got["ok"], got


# ------------------------------------------------------------------ lines
def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = words(text)
    seen, dup, covered = set(), 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), dup, len(covered)


def line_verdicts(rows, least, share, left):
    """(id, counts, base_failed, kept, removed line numbers) of rows (id, text, source)."""
    norm = lambda line: tuple(words(line.translate(LOWER)))
    held, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text)
        for line in (text or "").split("\n"):
            if words(line):
                held[host, norm(line)].add(text)
    over = {k for k, v in held.items() if len(v) > least and len(v) > share * len(hosts[k[0]])}
    out = []
    for i, text, host in rows:
        b = base(text)
        gone = [k for k, line in enumerate((text or "").split("\n")) if (host, norm(line)) in over]
        rest = b[0] - sum(len(words((text or "").split("\n")[k])) for k in gone)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((i, *b, failed, not failed and 100 * rest >= left * b[0], gone or None))
    return out


def random_pages(seed):
    rng = random.Random(seed)
    shared = ["Share this Page", "all rights * reserved", "é ü ß words", "  read   more  "]
    rows = []
    for i in range(120):
        lines = [rng.choice(shared).upper() if rng.random() < .2 else rng.choice(shared) if rng.random() < .5
                 else " ".join(rng.choice("abcdé#") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(0, 9))]
        rows.append((i, "\n".join(lines) if i % 17 else None, rng.choice(["h1", "h1", "h2", None])))
    return rows + rows[:9] + [(500 + i, rows[3][1], "h1") for i in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_rules_equal_brute_force(spark, docs, seed):
    rows = random_pages(seed) if seed == 1 else [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    least = 5 if seed == 1 else 1
    got = L.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), least, 0.02, 40)
    got = [(*r, None if g is None else list(g)) for *r, g in got.select("doc_id", *L.COUNTS, "base_failed", "kept", "removed_lines").collect()]
    want = line_verdicts(rows, least, 0.02, 40)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[-1] for w in want) and any(w[-2] for w in want)


def test_cleaned_texts_lose_their_shared_lines(spark):
    rows = random_pages(3)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, line string, nth int")
    got = L.clean(frame.repartition(3), 5, 0.02, 40)
    want = [(i, "\n".join(line for k, line in enumerate((t or "").split("\n")) if k not in (v[-1] or ())))
            for (i, t, _), v in zip(rows, line_verdicts(rows, 5, 0.02, 40)) if v[-2]]
    assert got.columns == frame.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(want) and want


def test_line_features_of_a_row_longer_than_a_piece():
    rng = random.Random(5)
    text = "\n".join(" ".join(rng.choice(["alpha", "βeta", "x" * 9]) + str(rng.randrange(900)) for _ in range(rng.randrange(1, 3000))) for _ in range(200))
    text += "\n" + "  ".join(["one long line"] * 100_000) + "\n" + "z" * 2_000_000
    buf, off = L.K.utf8(pa.array(["short text", text, None, text[:500_000]]))
    counts = defaultdict(list)
    for some, _, _ in L.text_features(buf, off):
        for c in L.COUNTS:
            counts[c] += some[c].tolist()
    assert len(text.encode()) > 2 * L.K.PIECE
    assert list(zip(*(counts[c] for c in L.COUNTS))) == [base(t) for t in ("short text", text, "", text[:500_000])]


def test_line_rules_odd_rows(odd_docs, no_docs):
    got = L.line_rules(odd_docs).collect()
    assert len(got) == odd_docs.count() and L.line_rules(no_docs).count() == 0 and L.clean(no_docs).count() == 0
    assert {r["n_words"] for r in got if r["doc_id"] in (3, 4, 5)} == {0} and not any(r["kept"] for r in got if r["n_words"] < 50)
    assert next(r for r in got if r["doc_id"] == 9)["n_repeat_words"] == 80_000
    assert L.clean(odd_docs).columns == odd_docs.columns


# ------------------------------------------------------------------ words
def vocabulary(rows):
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def variants(rows):
    v = vocabulary(rows)
    near, shared = {w: set() for w in v}, defaultdict(set)
    for w in v:
        for i in range(len(w)):
            shared[w[:i], w[i + 1:]].add(w)
            if (x := w[:i] + w[i + 1:]) in v:
                near[w].add(x)
                near[x].add(w)
    for group in shared.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in v:
        best = min(((-v[x], x) for x in near[w]), default=(0, None))
        form[w] = best[1] if best[1] and -best[0] >= 2 * v[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), v[w], len(near[w]), v[form[w]] if form[w] else None) for w in v)


def misspelt(seed):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["prefix" + a + b for a in "abcdef" for b in "abcdef"]
    rows = []
    for i in range(200):
        line = []
        for _ in range(60):
            w = known[min(int(rng.expovariate(.08)), len(known) - 1)]
            if rng.random() < .2:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "ab", w[k] * 2]) + w[k + 1:]
            line.append(w.upper() if rng.random() < .1 else w)
        rows.append((i if i % 7 else None, "-".join(line) if i % 13 else None))
    return rows + rows[:5]


@pytest.mark.parametrize("pairs", [1, 40, 4096])
def test_spelling_variants_equal_brute_force(spark, docs, pairs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] if pairs == 4096 else misspelt(pairs)
    got = W.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), pairs)
    want = variants(rows)
    assert sorted(map(tuple, got.collect())) == want and any(w[1] and w[1] != w[2] for w in want)


def test_a_common_beginning_is_refined(spark):
    # every word shares its first half: without refinement all pairs of words would be tried
    rng = random.Random(2)
    ends = {"".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(600)}
    found = spark.createDataFrame([("sharedbe" + e, 3) for e in ends], "word string, n long")
    got = {(r["a"], r["b"]) for r in W.near_pairs(found, 64).collect()}
    assert got == {(f"sharedbe{a}", f"sharedbe{b}") for a in ends for b in ends if a < b and sum(x != y for x, y in zip(a, b)) == 1}


def test_spelling_odd_rows(odd_docs, no_docs):
    assert W.spelling_variants(no_docs).count() == 0
    got = {r["word"]: r for r in W.spelling_variants(odd_docs).collect()}
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(got) == sorted(vocabulary(texts)) and all(r["root"] for r in got.values())


# ------------------------------------------------------------------ phrases
def ranked_phrases(rows, top=2000, least=10):
    by = defaultdict(lambda: (Counter(), Counter()))
    for lang, text in rows:
        single, counts = by[lang or "und"]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            single["n"] += len(w)
            for k in (1, 2, 3):
                counts.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, (single, f) in by.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * f[q]}
        scored = []
        for p, a in found.items():
            if p not in covered:
                s, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, single["n"], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def chatter(seed):
    rng = random.Random(seed)
    w = ["a", "B", "çe", "d\x1c", "the", "of", "and so", "x" * 40]
    rows = [(rng.choice(["en", "en", "fr", None]), "".join(rng.choice(w) + rng.choice([" ", " ", "\t", ". ", "\n", ",", "  "])
             for _ in range(rng.randrange(0, 90))) if i % 9 else None) for i in range(150)]
    return rows + rows[:20] + [("de", "la la " * 3000)]


@pytest.mark.parametrize("budget, chunk", [(1_000_000, 1_500_000), (60, 700), (1, 50)])
def test_phrases_equal_brute_force(spark, docs, budget, chunk):
    rows = [tuple(r) for r in docs.select("lang", "text").collect()] if budget > 1000 else chatter(budget)
    top = 2000 if budget != 60 else 15
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(map(tuple, P.collocations(texts, top=top, budget=budget, chunk=chunk).collect()))
    assert got == ranked_phrases(rows, top) and got


def test_chunks_lose_and_double_no_suffix(monkeypatch):
    monkeypatch.setattr(P.K, "PIECE", 40)
    rng = random.Random(9)
    rows = [" ".join(rng.choice(["a", "bb", "c.", "d"]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(rows), "text": pa.array(rows)})
    total = Counter()
    for ids, pieces, starts in P._chunks(iter([batch, batch]), 7):
        first, second, third, count, names = P._windows(ids, pieces, starts)
        ended = np.r_[np.uint64(0), names]
        for a, b, c, n in zip(names[first].tolist(), names[second].tolist(), ended[third].tolist(), count.tolist()):
            total[a, b, c] += n
    want = Counter()
    for text in rows * 2:
        for piece in re.split(r"[.]", text):
            w = piece.split()
            want.update((w[i], w[i + 1], w[i + 2] if i + 2 < len(w) else "") for i in range(len(w) - 1))
    assert sorted(total.values()) == sorted(want.values())


def test_scores_past_64_bits(spark):
    a, l, r = 3_000_000_019, 3_000_000_021, 4_000_000_007
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(P._score("a", "l", "r")).first()
    assert row[0] == 1_000_000 * a * a // (l * r)


def test_phrases_odd_rows(odd_docs, no_docs):
    assert P.collocations(no_docs).count() == 0
    rows = [(None, r["text"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, P.collocations(odd_docs).collect())) == ranked_phrases(rows)
