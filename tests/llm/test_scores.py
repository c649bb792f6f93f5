"""Toxicity, quality, token counts, PII and mixing."""

import hashlib
import random
import re
import tracemalloc


import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitlens.llm import mixing, pii, quality, toxicity
from splitlens.llm import token_count as tc


def test_toxicity_finds_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id")
    caught, flagged = got.agg(F.avg(F.when(F.col("label") == 1, F.col("toxic").cast("int"))), F.avg(F.when(F.col("label") == 0, F.col("toxic").cast("int")))).first()
    assert caught >= 0.7 and flagged <= 0.01
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == toxicity.toxicity(docs, labels).filter("NOT toxic").count()


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    first = x[:, 0] > 0
    model = toxicity.Chain(["a"]).fit(x, np.column_stack([first, first ^ (x[:, 1] > 5)]), np.arange(400) % 5)
    assert [m.weights.shape[0] for m in model.models] == [3, 4]
    assert (model.predict(x)[:, 1].round() == first).mean() > 0.97


def test_chain_is_fitted_without_the_whole_matrix():
    rng = np.random.default_rng(1)
    present = (rng.random((6000, 200)) < 0.05).astype(np.uint8)
    x = rng.normal(size=(6000, 2))
    hits = present[:, :20].sum(axis=1)
    targets, fold = np.column_stack([hits > 0, hits + x[:, 0] > 2]), np.arange(6000) % 5
    tracemalloc.start()
    model = toxicity.Chain([]).fit(x, targets, fold, present)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 202 * 8  # several copies of the matrix before
    whole = toxicity.Chain([]).fit(np.column_stack([present, x]), targets, fold)
    for one, other in zip(model.models, whole.models):
        assert np.allclose(one.weights, other.weights) and np.isclose(one.bias, other.bias)


def test_sample_rows_of_the_chain_are_small(spark):
    terms = [f"t{k}" for k in range(11)]
    texts = ["t0 t10 t10 other", "nothing here", None, "t3 " * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0, 0, 1], pa.int32()), pa.array([0, 1, 2, 3], pa.int32())], names=["text", "label", "fold"])
    got = pa.Table.from_batches(toxicity._sample_features(terms)(iter([batch]))).to_pydict()
    x, hits = toxicity.features(texts, 4, toxicity.Hits(terms))
    assert got["hits"] == hits.tolist() == [3, 0, 0, 3000] and got["label"] == [1, 0, 0, 1] and got["fold"] == [0, 1, 2, 3]
    for row, want in zip(got["x"], x):
        assert len(row) == 2 + 16  # 8 for each term before
        assert np.unpackbits(np.frombuffer(row[:2], np.uint8), count=11).tolist() == want[:-2].tolist() and np.frombuffer(row[2:]).tolist() == want[-2:].tolist()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.fit_chain(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).terms == []


def test_scores_of_odd_rows(spark, odd_docs, no_docs, labels):
    for score in (toxicity.toxicity, quality.quality_scores):
        assert score(odd_docs, labels).count() == odd_docs.count() and score(no_docs, labels).count() == 0
        assert score(odd_docs, labels.limit(0)).agg(F.max("score")).first()[0] is not None
    held = {r["doc_id"]: r["held_out"] for r in quality.quality_scores(odd_docs, labels).collect()}
    import zlib
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    p = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert p >= 0.9


def test_temperature_is_fitted_on_other_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    net = quality.Network().fit(x[:150], y[:150])
    loss = lambda: -np.mean(y[150:] * np.log(net.predict(x[150:])) + (1 - y[150:]) * np.log(1 - net.predict(x[150:])))
    before = loss()
    assert net.calibrate(x[150:], y[150:]).temperature > 1 and loss() < before


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer, models

    pieces, _ = tc.vocabulary(tc.MODEL)
    texts = [r["text"] for r in docs.select("text").collect()] + ["日本 öß 🙂🙂 x", "a\n\n b  c   d", " ", "", None, "▁▁a ▁", "x\0y", "ab" * 3000 + " c"]
    for fallback in (True, False):
        vocab = [("<unk>", 0.0), *pieces] + ([(f"<0x{i:02X}>", min(s for _, s in pieces)) for i in range(256)] if fallback else [])
        library, own = Tokenizer(models.Unigram(vocab, 0, fallback)), tc.UnigramCounter(pieces, fallback)
        want = [len(library.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0 for t in texts]
        assert own.texts(texts) == want
        some = [c for c in list(own.memo)[:3000]]
        assert [own.count_long(c) for c in some] == [own.memo[c] for c in some]
    got = {r["doc_id"]: r["n_tokens"] for r in tc.token_counts(docs).collect()}
    assert sum(got.values()) == sum(tc.UnigramCounter(pieces, True).texts([r["text"] for r in docs.collect()]))


def test_ties_keep_the_longest_match():
    own = tc.UnigramCounter([("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0)], False)
    # ▁+a+b, ▁a+b and ▁+ab all score -5; the earliest start of the last piece wins
    assert own.texts(["ab"]) == [2] and own.count_long("▁ab") == 2


def test_token_counts_odd_rows(odd_docs, no_docs):
    assert tc.token_counts(odd_docs).count() == odd_docs.count() and tc.token_counts(no_docs).count() == 0


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_the_patterns(spark, docs):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("aB.1-@ +()9%0é\n4") for _ in range(rng.randrange(60)))) for i in range(1500)]
    rows += [(9001, None), (9002, ""), (9003, "1" * 50_000), (9004, "a.b" * 3000 + "@c" + ".d" * 3000), (9005, "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1"),
             (9006, "é 4111 1111 1111 1111 " * 20)] + [(10_000 + r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, text in rows:
        want = base(text)
        assert [got[i][f"n_{k}"] for k, _ in PATTERNS] == [sum(s[3] == k for s in want) for k, _ in PATTERNS]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(got[i]["spans"].split(",")) | {""}


def test_words_that_give_an_entity_away(spark):
    rows = [(i, "call the office about the usual things today") for i in range(40)]
    rows += [(100, "call zebulon at a@b.cd about the usual things"), (101, "the usual things today"), (102, "zebra crossing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "zebulon" not in out[100] and "a@b.cd" not in out[100] and "[EMAIL]" in out[100] and "the usual things" in out[100]
    assert all(out[i] == t for i, t in rows if i != 100)
    assert pii.personal_data(docs).filter("doc_id = 100").first()["n_term"] >= 1


def test_words_far_from_the_entity_count(spark):
    far = "usual things " * 60
    rows = [(i, "usual things today") for i in range(60)]
    rows += [(100, "Zebulon " + far + "mail a@b.cd " + far + "zebulon, mail"), (101, "mail a@b.cd " + far + "zebulon"), (102, far + "quagga mail a@b.cd"),
             (103, "x" * 500 + "mail c@d.ef"), (104, "mail c@d.ef zebu"), (105, "zebu"), (106, "zebu"), (107, "mail today"), (108, "mail c@d.ef\u00e9"), (109, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # brute force: the words of whole texts
    texts = {i: t or "" for i, t in rows}
    words = {i: set(re.findall(r"\w+", t.lower())) for i, t in texts.items()}
    named = {i: {t[a:b] for a, _, b, _ in base(t)} for i, t in texts.items()}
    want = {}
    for i, t in texts.items():
        spans = base(t)
        for m in re.finditer(r"\w+", t):
            term = m[0].lower()
            n = sum(term in w for w in words.values())
            best = max((np.log(len(rows) * sum(term in words[j] and e in named[j] for j in words) / (sum(e in x for x in named.values()) * n))
                        / np.log(len(rows) / sum(e in x for x in named.values())) for e in named[i]), default=-1)
            if best >= pii.GENERALISE_AT and not any(a < m.end() and b > m.start() for a, _, b, _ in spans):
                want.setdefault(i, []).append(f"term:{m.start()}:{m.end()}")
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("term")] for r in pii.personal_data(docs).collect()}
    assert {i: s for i, s in got.items() if s} == want
    assert len(want[100]) >= 2 and 101 in want and 102 in want and "term:0:504" in want[103]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("ebulon" not in out[i] for i in (100, 101)) and "quagga" not in out[102] and "usual things" in out[100] and out[109] is None


def test_overlapping_spans_are_replaced_whole(spark):
    rows = [(i, "mail or card") for i in range(30)] + [(100, "mail a@b.4111 1111 1111 1111 or card"), (101, "mail or card or mail")]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == "mail [EMAIL] or card" and out[101] == rows[-1][1]


def test_pii_odd_rows(odd_docs, no_docs):
    assert pii.personal_data(odd_docs).count() == odd_docs.count() and pii.personal_data(no_docs).count() == 0
    clean = pii.sanitise(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count() and pii.sanitise(no_docs).count() == 0


def least_residual(p, n, goal, rounds=20_000):
    """Squared residual of the shares by accelerated projected gradient in numpy, run far past convergence."""
    a = (p * n[:, None]).T / n.sum()
    reach = np.linalg.eigvalsh(a @ a.T)[-1]
    r = z = np.ones(len(n))
    t = 1.0
    for _ in range(rounds):
        new, later = np.maximum(0, z - a.T @ (a @ z - goal) / reach), (1 + np.sqrt(1 + 4 * t * t)) / 2
        r, z, t = new, new + (t - 1) / later * (new - r), later
    return np.square(a @ r - goal).sum()


@pytest.mark.parametrize("softness, goal", [(0.2, (0.6, 0.3, 0.1)), (2, (0.6, 0.3, 0.1)), (2, (0.9, 0.08, 0.02)), (2, (0.98, 0.01, 0.01))])
def test_mixing_is_least_squares_in_reach_and_out_of_it(spark, softness, goal):
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet([softness] * 3, size=500), rng.integers(1, 500, 500).astype(float)
    rows = [(int(k), *map(float, q)) for k, q in zip(n, p)]
    members = spark.createDataFrame(rows, "n_tokens long, p_a double, p_b double, p_c double").coalesce(1)
    fitted = mixing.fit_rates(members, ["a", "b", "c"], dict(zip("abc", goal)))
    got = members.withColumn("rate", fitted.column()).collect()
    rate = np.array([r["rate"] for r in got])
    share = (rate * n) @ p / n.sum()
    residual, least = np.square(share - goal).sum(), least_residual(p, n, np.array(goal))
    assert rate.min() >= 0 and residual <= 1.01 * least + 1e-12
    assert fitted.residual == pytest.approx(residual, rel=1e-6, abs=1e-14) and fitted.shares == pytest.approx(share, abs=1e-9)


def test_mixing_knows_domains_without_a_target(spark):
    kinds = {(1, 0): "plain good text here", (0, 0): "click buy now", (1, 1): "fine prose with slur", (0, 1): "junk rant filth"}
    rows = [(i, f"{kinds[k]} w{i} v{i % 7}", *k) for i, k in enumerate(list(kinds) * 50)]
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    got = mixing.mixing_rates(both.select("doc_id", "text"), both.select("doc_id", "quality", "toxic")).collect()
    domains = [c for c in got[0].asDict() if c.startswith("p_")]
    assert domains == ["p_q0t0", "p_q0t1", "p_q1t0", "p_q1t1"]
    assert all(max(domains, key=lambda c: r[c]) == f"p_q{q}t{t}" for r, (_, _, q, t) in zip(sorted(got), rows))
    n = np.array([r["rate"] * r["n_tokens"] for r in got])
    share = n @ np.array([[r[c] for c in domains] for r in got]) / sum(r["n_tokens"] for r in got)
    assert share == pytest.approx([0.08, 0.0, 0.90, 0.02], abs=1e-3)


def test_mixing_odd_rows(odd_docs, no_docs, docs, labels):
    got = mixing.mixing_rates(odd_docs, labels)
    assert got.count() == odd_docs.count() and got.filter("rate IS NULL OR rate < 0").count() == 0
    assert len(set(got.columns)) == len(got.columns) and mixing.mixing_rates(no_docs, labels).count() == 0
    none = mixing.mixing_rates(docs, labels.limit(0))
    assert none.filter("rate <> 1 OR copies <> 1 OR residual IS NOT NULL").count() == 0
