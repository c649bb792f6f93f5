"""WARC archives, embedding links and the pipeline."""

import io
import struct
import zipfile

import numpy as np
import pytest

from splitlens.llm import warc_zip as W
from splitlens.llm.embed_dedup import bucket_codes, embedding_links, hadamard
from splitlens.session import shared_dir


def brute(pages, least=0):
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault((h or "").encode(), i)
    out = []
    for i, url, h in pages:
        b = (h or "").encode()
        again = i is not None and len(b) >= least and first[b] != i
        out.append((i, url, len(b), W.payload_digest(b), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    pages = [(1, "http://a/ü\r\nX: y", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://c", ""), (5, "u", "a\r\n\r\nb é"), (7, "u", "longer text"), (6, "u", "longer text"),
             (None, "n", "same"), (9, "z", "y" * 100_000), (10, "z", "y" * 100_000)]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, digest int")
    folder = shared_dir(spark, "warc-test")
    manifest = W.write_archives(df, folder, least, archive_bytes=200)
    got = W.read_archives(manifest, folder, range_bytes=300).collect()
    want = [(i, None if u is None else W._clean(u), *rest) for i, u, *rest in brute(pages, least)]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    text = {p[0]: (p[2] or "").encode() for p in pages}
    assert all(bytes(r["payload"]) == text[r["page_id"]] for r in got if r["record_type"] == "response")
    assert W.pages_through_archives(df.limit(0)).count() == 0


def test_zip64_directory():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open("data.warc.gz", "w", force_zip64=True) as f:
            f.write(b"hello")
        z.comment = b"PK\x05\x06 in a comment"
    plain = raw.getvalue()
    read = lambda data: lambda at, n: data[at:at + n]
    member = W.zip_members(read(plain), len(plain))["data.warc.gz"]
    assert plain[W.stored_offset(read(plain), member):][:5] == b"hello"
    # the same archive with its counts and offsets moved to ZIP64 records
    end = plain.rfind(b"PK\x05\x06", 0, plain.rfind(b"PK\x05\x06"))
    size, start = struct.unpack_from("<II", plain, end + 12)
    entry = bytearray(plain[start:start + size])
    name, extra = struct.unpack_from("<HH", entry, 28)
    packed, full, header = *struct.unpack_from("<II", entry, 20), struct.unpack_from("<I", entry, 42)[0]
    field = struct.pack("<HHQQQ", 1, 24, full, packed, header)
    struct.pack_into("<II", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<HH", entry, 28, name, len(field))
    struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
    entry = bytes(entry[:46 + name]) + field
    where = start + len(entry)
    big = (plain[:start] + entry + struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
           + struct.pack("<4sIQI", b"PK\x06\x07", 0, where, 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    member = W.zip_members(read(big), len(big))["data.warc.gz"]
    assert (member.size, big[W.stored_offset(read(big), member):][:5]) == (5, b"hello")


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(hadamard(hadamard(x)), x)
    assert (bucket_codes(x[:, :10] / np.linalg.norm(x[:, :10], axis=1, keepdims=True)) >= 0).all()


@pytest.mark.parametrize("tile", [2000, 20])
def test_links_equal_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 24))
    v = np.concatenate([centre, centre[:10] + rng.normal(size=(10, 24)) * 0.1, np.repeat(centre[:2], 30, axis=0) + rng.normal(size=(60, 24)) * 0.08, centre[3:5], centre[3:5] * 2]).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    got = sorted(map(tuple, embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tile=tile).collect()))
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.array([min([root[i], *root[near[i]]]) for i in range(len(v))])
    found, links = sum(g[1] for g in got), near.sum()
    assert found <= links and found >= 0.97 * links
    if found == links:
        assert got == [(i, int(near[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(v))]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 1.0], None), (8, [1.0, 1.0], 0), (8, [1.0, 1.0], 0),
            (None, [1.0, 1.0], 0), (9, [2.0, 2.0], 0), (10, [1e300, 1e300], 0), (11, [1.0, 1.0, 0.0], 0), (12, [-1.0, 1.0], 0)]
    got = [tuple(r) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, slot int")).collect()]
    assert len(got) == len(rows)
    for i in (1, 2, 3, 4, 5, 6, 11, 12):
        assert (i, 0, i, True) in got
    assert (7, 4, 7, True) in got and got.count((8, 4, 7, False)) == 2 and (9, 4, 7, False) in got and (10, 4, 7, False) in got and (None, 0, None, True) in got
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_pipeline(spark):
    """Each stage against brute force (the classifier against its own operator) on what it was given."""
    import corpus_pipeline as P
    from splitlens.llm.common import materialise
    from splitlens.llm.toxicity import toxicity
    from tests.llm.test_scores import base
    from tests.llm.test_text_joins import components, shingles

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    given, seen = docs, [texts(docs)]
    for name, stage in P.STAGES:
        given = stage(spark, given, sf)
        if name != P.STAGES[-1][0]:
            assert given.columns == docs.columns
            given = materialise(given, "pipeline-test")
            seen.append(texts(given))
    start, clean, single, fresh, safe = seen
    flagged = {r["doc_id"] for r in toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("toxic").collect()}
    assert flagged and set(clean) == set(start) - flagged
    assert set(single) == {i for i, _, c in components(list(clean.items())) if i == c} and len(single) < len(clean)
    held = {i for i, t in single.items() for s in items if s and 100 * len(s & shingles(t)) >= 80 * len(s)}
    assert set(fresh) == set(single) - held and held
    assert all(clean[i] == t == start[i] for i, t in fresh.items())
    assert set(safe) == set(fresh)
    named = {i for i, t in fresh.items() if base(t)}
    assert named and all((safe[i] != t) == (i in named) for i, t in fresh.items())
    assert all(t[a:b] not in safe[i] or base(t)[0][3] != "email" for i, t in fresh.items() for a, _, b, k in base(t)[:1] if k == "email")
    rated = given.collect()
    assert sorted(r["doc_id"] for r in rated) == sorted(safe) and all(r["rate"] is not None and r["rate"] >= 0 for r in rated)
    assert len(P.STAGES) == 5 and sorted(r["doc_id"] for r in P.run(spark, sf).select("doc_id").collect()) == sorted(safe)


def test_pipeline_stages_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    for name, stage in P.STAGES:
        got = stage(spark, odd_docs, sf)
        ids = [r["doc_id"] for r in got.select("doc_id").collect()]
        assert set(ids) <= {r["doc_id"] for r in odd_docs.collect()} and {3, 4, 5} <= set(ids), name
        if name in ("pii", "mixing"):
            assert len(ids) == odd_docs.count()
        if name != "mixing":
            assert got.columns == odd_docs.columns
        assert stage(spark, no_docs, sf).count() == 0
