"""Registered queries of this subpackage, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from splitlens.llm.common import table
from splitlens.llm.decontam import contained_items
from splitlens.llm.embed_dedup import embedding_links
from splitlens.llm.jaccard_join import jaccard_components
from splitlens.llm.line_rules import line_rules
from splitlens.llm.mixing import mixing_rates
from splitlens.llm.phrases import collocations
from splitlens.llm.pii import personal_data
from splitlens.llm.quality import quality_scores
from splitlens.llm.spelling import spelling_variants
from splitlens.llm.suffix_dedup import repeated_strings
from splitlens.llm.token_count import token_counts
from splitlens.llm.toxicity import toxicity
from splitlens.llm.warc_zip import pages_through_archives


def _last(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a column beyond its contract behind the others."""
    return df.select(*[c for c in df.columns if c != column], column)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(personal_data(table(spark, sf_dir, "documents")), "n_term")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("removed")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(pages_through_archives(table(spark, sf_dir, "pages")), "url")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).drop("removed_lines")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_quality, op3_pii, op4_decontamination, op5_suffix_dedup, op6_mixing,
                            op7_token_counts, op8_warc_zip, op9_jaccard_join, op10_embedding_dedup,
                            op11_line_rules, op12_spelling, op13_phrases)}

# SQL over whole tables is given where DuckDB can say the same thing in one query
ORACLE: dict[str, str] = {
    "op4_decontamination": r"""
        WITH b_w AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        b AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
              FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b_w WHERE len(w) > 0)),
        n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
        d_w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        d AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
              FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d_w, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
        pair AS (SELECT doc_id, item_id, d.k, count(DISTINCT s) AS shared, min(i) AS lo, max(i) AS hi FROM d JOIN b USING (k, s) GROUP BY ALL)
        SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_item, CAST(shared AS INTEGER) AS n_shared, shared / n AS containment,
               lo - 1 AS first_word, hi + k - 2 AS last_word
        FROM pair JOIN n USING (item_id) WHERE 100 * shared >= 80 * n
    """,
    "op5_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
        win AS (SELECT doc_id, p, md5(b[p + 1:p + 100]) AS s FROM (SELECT doc_id, b, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
        later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
        mark AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER w + 100 THEN 1 ELSE 0 END AS new FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
        span AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM mark) GROUP BY doc_id, g),
        edge AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER w, 0) AS before FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY lo)),
        cut AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS front
                FROM edge JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(front || substr(h, 2 * last + 1), h))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE d_w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        d AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
               FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d_w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
        way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        walk AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT way.y, walk.root FROM walk JOIN way ON way.x = walk.node),
        low AS (SELECT node, min(root) AS root FROM walk GROUP BY node)
        SELECT d_w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.root, d_w.doc_id) AS component_id
        FROM d_w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.node = d_w.doc_id
    """,
    "op8_warc_zip": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
             h AS (SELECT page_id, url, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex,
                          min(page_id) OVER (PARTITION BY body) AS first_id FROM p),
             b AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                       (CAST('0x' || substr(hex || '0', CAST(1 + i * 5 // 4 AS INTEGER), 2) AS INTEGER)
                        >> CAST(3 - (i * 5) % 4 AS INTEGER)) & 31 AS INTEGER), 1)) AS letters FROM h)
        SELECT page_id, url, payload_bytes, array_to_string(letters, '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM b
    """,
    "op11_line_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM win) WHERE k > 1),
        cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
        ln AS (SELECT rid, source, body, raw, norm, len(norm) AS nw FROM (
                 SELECT rid, source, body, raw, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS norm
                 FROM (SELECT rid, source, body, unnest(string_split(body, chr(10))) AS raw FROM d)) WHERE len(norm) > 0),
        dup AS (SELECT rid, count(*) - count(DISTINCT raw) AS n FROM ln GROUP BY rid),
        hosts AS (SELECT source, count(DISTINCT body) AS size FROM d GROUP BY source),
        held AS (SELECT source, norm, count(DISTINCT body) AS k FROM ln GROUP BY ALL),
        over_limit AS (SELECT held.source, norm FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE k > 10 AND k > 0.005 * size),
        gone AS (SELECT rid, count(*) AS n_lines, sum(nw) AS n FROM ln JOIN over_limit o ON ln.source IS NOT DISTINCT FROM o.source AND ln.norm = o.norm GROUP BY rid),
        r AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                     length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                     coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines_removed, len(w) - coalesce(gone.n, 0) AS n_words_left
              FROM d LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT base_failed AND 100 * n_words_left >= 30 * n_words AS kept, CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(n_words_left AS BIGINT) AS n_words_left
        FROM f
    """,
    # crc32 by its table, one step a byte
    "op12_spelling": r"""
        WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
                               FROM range(256) r(i)),
        raw AS (SELECT doc_id, run, count(*) AS n FROM (
                  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
                WHERE length(run) >= 5 GROUP BY ALL),
        bytes AS (SELECT run, n, list_transform(range(1, strlen(hex(encode(k))) // 2 + 1), lambda i: CAST('0x' || substr(hex(encode(k)), 2 * i - 1, 2) AS BIGINT)) AS b
                  FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM raw)),
        crc AS (SELECT run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM bytes, tab),
        dmg AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM crc),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM dmg WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        pair AS (SELECT a.word, b.word AS near, b.n AS k FROM del a JOIN del b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
                 UNION SELECT a.word, v.word, v.n FROM del a JOIN v ON a.short = v.word
                 UNION SELECT v.word, a.word, a.n FROM del a JOIN v ON a.short = v.word),
        best AS (SELECT word, count(*) AS n_near, first(near ORDER BY k DESC, encode(near)) AS near, max(k) AS k FROM pair GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN k >= 2 * v.n THEN near END AS form, CASE WHEN k >= 2 * v.n THEN k END AS form_n
              FROM v LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS at, form AS ahead FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.ahead)
        SELECT f.word, f.form, walk.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
        FROM f JOIN walk ON walk.word = f.word AND walk.ahead IS NULL
    """,
    "op13_phrases": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS ws
              FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) t(k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, phrase, any_value(ws) AS ws, count(*) AS a FROM g GROUP BY lang, k, phrase),
        c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
        cut AS (SELECT c.lang, c.k, c.phrase, c.ws, c.a, j, array_to_string(c.ws[1:j], ' ') AS head, array_to_string(c.ws[j + 1:], ' ') AS tail
                FROM c, range(1, 3) t(j) WHERE j < c.k),
        s AS (SELECT cut.*, l.a AS l, r.a AS r, CAST(CAST(1000000 AS HUGEINT) * cut.a * cut.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
              FROM cut JOIN f l ON l.lang = cut.lang AND l.k = cut.j AND l.phrase = cut.head
                       JOIN f r ON r.lang = cut.lang AND r.k = cut.k - cut.j AND r.phrase = cut.tail),
        low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inner_ AS (SELECT lang, phrase, max(a) AS big FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3
                   UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
        kept AS (SELECT low.* FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE NOT coalesce(100 * big >= 50 * low.a, false)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        SELECT ranked.lang, rank, phrase, a, l, r, tot.n, score FROM ranked JOIN tot USING (lang) WHERE rank <= 2000
    """,
}
