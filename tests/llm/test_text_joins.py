"""Jaccard join, benchmark decontamination and suffix de-duplication against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from splitlens.llm import jaccard_join as J
from splitlens.llm import suffix_dedup as S
from splitlens.llm import textkernel as K
from splitlens.llm.common import arrow_rows
from splitlens.llm.components import connected_components
from splitlens.llm.decontam import clean, contained_items
from splitlens.llm.jaccard_join import jaccard_components, keep_one
from splitlens.llm.suffix_dedup import repeated_strings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    both = Counter((a, b) for ids in where.values() for k, b in enumerate(sorted(ids)) for a in sorted(ids)[:k])
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def near_copies(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40))
    common = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randrange(3, 80))] if i % 3 else list(common)
        if i % 5 == 0:
            text = common[:30] + text
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    return rows


def test_jaccard_components_equal_brute_force(spark, docs):
    for rows in ([tuple(r) for r in docs.select("doc_id", "text").collect()], near_copies(1, 150)):
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert sorted(map(tuple, got.collect())) == components(rows)


def test_count_tree_bound_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(30)]
    sets += [np.unique(np.r_[s[:-3], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]) for s in sets]
    points, sizes = np.array([J.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    found = {tuple(sorted(p)) for i, j in J.CountTree(points, sizes, np.arange(len(sets))).pairs() for p in zip(i.tolist(), j.tolist())}
    for a in range(len(sets)):
        for b in range(a):
            inter = len(np.intersect1d(sets[a], sets[b]))
            if J.linked(inter, sizes[a], sizes[b]):
                assert (b, a) in found
    assert len(found) < 200  # most pairs are pruned


def test_bits_bound_the_overlap_of_sets_of_any_sizes():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 3, 9, 60, 64, 65, 200, 1500)]
    sets += [np.unique(np.r_[s[:-1], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]) for s in sets]
    rows = J.BitRows([J.group_bits(s) for s in sets], np.array([len(s) for s in sets]))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    real = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    bound = rows.bounds(i, j)
    assert (bound >= real).all() and (bound - real)[real == 0].max() < 400 and np.abs((bound - real)[i == j]).max() == 0


def test_points_of_huge_and_small_sets_bound_the_overlap():
    rng = np.random.default_rng(2)
    huge = np.unique(rng.integers(0, 1 << 63, 120_000, dtype=np.uint64))
    sets = [huge, huge[:-300], np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)), huge[::40]]
    column = pa.array([J.count_vector(s).tobytes() for s in sets], pa.binary())
    points = J.points_of(column)
    assert points.shape[1] == J.GROUPS // 2 and points.sum(axis=1).tolist() == [len(s) for s in sets]
    for a in range(4):
        for b in range(4):
            assert np.minimum(points[a], points[b]).sum() >= len(np.intersect1d(sets[a], sets[b]))
    small = J.points_of(column.take(pa.array([2, 3])))
    assert small.shape[1] == J.GROUPS and small.dtype == np.uint8 and small.sum(axis=1).tolist() == [len(sets[2]), len(sets[3])]


def template_group(seed, n, own):
    """Texts of one template with ``own`` words of 60 replaced at fixed places: alike, but none at the threshold."""
    rng = random.Random(seed)
    template = [f"t{k}" for k in range(60)]
    rows = []
    for i in range(n):
        text = list(template)
        for k in range(own):
            text[k * (60 // own)] = f"own{i}x{k}"
        rows.append((i, " ".join(text)))
    return rows + [(n + i, rng.choice(rows)[1] + (" tail" if i % 2 else "")) for i in range(n // 4)]


def test_a_template_group_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    rows = template_group(4, 300, 2)  # Jaccard of two originals about 0.7
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = []
    links = J._links
    monkeypatch.setattr(J, "_links", lambda close, *rest: made.append(close.count()) or links(close, *rest))
    assert sorted(map(tuple, jaccard_components(frame).collect())) == components(rows)
    assert sum(made) < 5 * len(rows)


@pytest.mark.parametrize("tile", [1, 7])
def test_blocks_dealt_into_tiles_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE", tile)
    rng = random.Random(tile)
    base = [f"w{k}" for k in range(50)]
    rows = []
    for i in range(80):  # a third of all documents: edited copies that do not all link with one another
        text = list(base)
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(50)] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    rows += near_copies(3, 160)[80:]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == components(rows)


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, jaccard_components(odd_docs).collect()), key=str)
    assert len(got) == odd_docs.count()
    by = defaultdict(set)
    for i, n, c in got:
        by[i].add((n, c))
    assert by[1] == {(8, 1)} and by[2] == {(8, 1), (5, 2)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[5] == {(0, 5)}
    assert by[7] == {(1, 6)} and {c for _, c in by[None]} == {None} and by[8] == {(1, 8)} and by[9] == {(2, 9)}
    assert jaccard_components(no_docs).count() == 0
    assert keep_one(odd_docs).columns == odd_docs.columns and keep_one(no_docs).count() == 0
    assert {r["doc_id"] for r in keep_one(odd_docs).collect()} == {1, 3, 4, 5, 6, 8, 9, 10, None}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 5), (200, 201)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 201: 200}


def test_contained_items_equal_brute_force(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = []
    sets = {r["item_id"]: shingles(r["text"]) for r in items.collect()}
    for r in docs.select("doc_id", "text").collect():
        s = shingles(r["text"])
        want += [(r["doc_id"], i, len(t), len(s & t)) for i, t in sets.items() if 100 * len(s & t) >= 80 * len(t)]
    for block in (2_000_000, 60):  # one block, and many
        got = contained_items(docs, items, block_shingles=block).select("doc_id", "item_id", "n_item", "n_shared")
        assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert clean(docs, items).count() == docs.count() - len({w[0] for w in want})


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "three four"), (2, None), (3, ""), (None, "one two three four five"), (4, "two three four five SIX seven"), (4, "two three four five SIX seven")],
                                  "item_id long, text string")
    got = sorted(map(tuple, contained_items(odd_docs, items).select("doc_id", "item_id").collect()), key=str)
    assert got == sorted([(i, k) for i in (1, 2, 2, 10, None) for k in (1, 4)], key=str)
    assert contained_items(no_docs, items).count() == 0 and contained_items(odd_docs, items.limit(0)).count() == 0
    assert clean(odd_docs, items).columns == odd_docs.columns and clean(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_items_without_an_id_are_cleaned(spark):
    docs = spark.createDataFrame([(1, "a b c one two three four five d"), (2, "nothing of that kind"), (None, "one two three four five")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three four five"), (None, None)], "item_id long, text string")
    assert [r["doc_id"] for r in clean(docs, items).collect()] == [2]


def removed(rows):
    seen, out = {}, []
    for i, text in sorted(rows):
        b = (text or "").encode()
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if seen.setdefault(b[p:p + 100], (i, p)) != (i, p):
                mask[p:p + 100] = True
        spans = int(np.diff(np.r_[False, mask].astype(int)).clip(0).sum())
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings_equal_brute_force(spark, docs, seed):
    rng = random.Random(seed)
    base = ["ab" * 80, "x" * 300, "".join(rng.choice("abcé") for _ in range(400))]
    rows = [(3 * i - 20, "".join(rng.choice([rng.choice(base)[rng.randrange(60):], "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 150)))])
                                 for _ in range(rng.randrange(8))) if i % 11 else None) for i in range(40)]
    if seed == 1:  # a text of several pieces, and its tail in another
        rows.append((500, "".join(rng.choice("abc") for _ in range(1_200_000)) + base[2]))
        rows.append((501, rows[-1][1][1_000_000:] + "zz"))
    else:
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).drop("removed")
    assert sorted(map(tuple, got.collect())) == removed(rows)


def test_repeated_strings_odd_rows(odd_docs, no_docs):
    got = repeated_strings(odd_docs).collect()
    assert len(got) == odd_docs.count() and repeated_strings(no_docs).count() == 0
    assert {(r["n_bytes"], r["n_removed"]) for r in got if r["doc_id"] in (3, 4, None)} >= {(0, 0)}
    long = next(r for r in got if r["doc_id"] == 8)
    assert (long["n_removed"], long["n_spans"]) == (299_999, 1)


def test_deep_identifiers_tell_windows_apart():
    rng = np.random.default_rng(4)
    part = np.concatenate([rng.integers(97, 100, 3000, dtype=np.uint8), np.full(500, 97, np.uint8)])
    part = np.r_[part, part[1000:2500], part[:130]]
    windows = [part[i:i + 100].tobytes() for i in range(len(part) - 99)]
    for which in (0, 1):
        ids = S.deep_identifiers(part, which)
        assert len(ids) == len(windows) and len(set(ids.tolist())) == len(set(windows)) == len(set(zip(ids.tolist(), windows)))
    assert len(S.deep_identifiers(part[:99], 0)) == 0 and len(S.deep_identifiers(part[:10], 0)) == 0 and len(S.deep_identifiers(part[:100], 0)) == 1


def test_found_ranges_follow_the_data_and_not_the_partitions(spark, docs):
    """As many rows go back to the documents with 8 shuffle partitions as with 200."""
    made = {}
    gather = S._by_slot
    for partitions in (8, 200):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        counts = made.setdefault(partitions, [])
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(S, "_by_slot", lambda found, kind, n: counts.append(found.filter(F.col("kind") == kind).count()) or gather(found, kind, n))  # noqa: B023
            repeated_strings(docs.limit(60).coalesce(1))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(x <= 1.3 * y + 20 for x, y in zip(made[200], made[8]))


def test_jaccard_hands_python_few_rows_at_once(spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], J.materialise
    monkeypatch.setattr(J, "materialise", lambda df, name: seen.append(int(spark.conf.get(key))) or write(df, name))
    was = spark.conf.get(key)
    rows = near_copies(5, 40)
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == components(rows)
    assert set(seen) == {J.BATCH} and spark.conf.get(key) == was

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    with arrow_rows(spark, 7):
        assert sorted(r["n"] for r in spark.range(0, 20, 1, 1).mapInArrow(sizes, "n long").collect()) == [6, 7, 7]
    assert spark.conf.get(key) == was


def test_word_hashes_take_little_memory_and_do_not_depend_on_the_pieces(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(2000)] + ["z" * 400_000 + " a b", "x y " * 100_000]
    buf, off = K.utf8(pa.array(texts))
    monkeypatch.setattr(K, "_POWERS", {})
    tracemalloc.start()
    for _ in K.shingle_sets(buf, off):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # over 60 MB with a megabyte at once
    some = [s.tolist() for s in K.shingle_sets(*K.utf8(pa.array(texts[-4:])))]
    for piece in (64, 1 << 20):
        monkeypatch.setattr(K, "HASHED", piece)
        assert [s.tolist() for s in K.shingle_sets(*K.utf8(pa.array(texts[-4:])))] == some


def test_prefixes_are_the_same_however_they_are_packed(monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array([t for _, t in near_copies(k, 60)])], names=["text"]) for k in range(3)]

    class levels_of:
        value = bytes(1 << J.CELL_BITS)

    def rows():
        out = list(J._prefixes(levels_of, 4, J.PERCENT)(iter(batches)))
        return len(out), sorted(J.unpack(pa.chunked_array([b.column("data") for b in out]), J._MEMBER).tolist())

    one, members = rows()
    monkeypatch.setattr(J, "PACKED", 50)
    many, again = rows()
    assert one == 1 and many > 3 and again == members
