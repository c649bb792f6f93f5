"""Personal data: pattern spans, and information-theoretic sanitisation of the words in the same texts.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.  Each value found is
a protected entity.  Words of a text that holds an entity may reveal it, wherever they stand: with document counts over the
whole corpus, a word t and an entity e that occur in n(t) and n(e) of N documents, and together in
n(e, t), the disclosure of t is

    PMI(e, t) / IC(e) = log(N n(e, t) / (n(e) n(t))) / log(N / n(e)),

1 for a word that occurs only with the entity, 0 for one that has nothing to do with it.  Words that reach
``REMOVE_AT`` are removed, those that reach ``GENERALISE_AT`` are generalised to their kind.

Everything is DataFrame and SQL functions.  The patterns are written with possessive repetition and
a look-behind that admits a match only where a run begins, which changes no leftmost match but
keeps long runs linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
REMOVE_AT = 0.95
GENERALISE_AT = 0.8
WORD = r"[\p{L}\p{N}_]++"

# pattern, necessary condition that is cheap to test, check of a match
_START = {"email": r"(?:\G|(?<![A-Za-z0-9._%+-]))", "ip": r"(?:\G|(?<![0-9]))", "card": r"(?:\G|(?<![0-9]))", "phone": ""}
_PATTERN = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_BYTE_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
_SPAN = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(_BYTE_PARTS)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def _located(text: Column, start: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places: each find takes the gap and the match."""
    find = rf"\G(?s:(.*?))({start}{pattern})"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(find), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(find), F.lit(2)).alias("hit"))
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,value:string>>))")

    def step(acc, m):
        begin = acc["at"] + F.length(m["gap"])
        end = begin + F.length(m["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), m["hit"].alias("value")))).alias("out"))
    return F.aggregate(both, empty, step)["out"]


def _kind_spans(text: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    found = F.filter(_located(text, _START[kind], _PATTERN[kind]), lambda s: _holds(kind, s["value"]))
    spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["value"].alias("value")))
    return F.when(text.rlike(_HINT[kind]), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base spans of a text, ordered by start, then kind; none for null."""
    spans = F.concat(*(_kind_spans(text, k) for k in KINDS))
    return F.coalesce(F.array_sort(spans), F.array().cast(_SPAN))


def _entity() -> Column:
    """What a span's value stands for: addresses in lower case, numbers by their digits."""
    value = F.when(F.col("span.kind").isin("card", "phone"), F.regexp_replace("span.value", "[^0-9]", "")).otherwise(F.lower("span.value"))
    return F.concat_ws(":", F.col("span.kind"), value)


def _keys(text: Column) -> Column:
    """The distinct words of a text in lower case, by their 64-bit hash."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(F.lower(w))))


def _document_counts(docs: DataFrame) -> DataFrame:
    """(key, n): in how many documents each word occurs, over all documents."""
    return docs.filter("text IS NOT NULL").select(F.explode(_keys(F.col("text"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def _disclosure(n_both: Column, n_entity: Column, n: Column, total: float) -> Column:
    return F.log(n_both * total / (n_entity * n)) / F.log(total / n_entity)


def _places(text: Column, gone: Column, vague: Column) -> Column:
    """(start, end, action) of every word of a text whose hash is in ``gone`` or ``vague``."""
    find = r"\G([^\p{L}\p{N}_]*+)(" + WORD + ")"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(find), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(find), F.lit(2)).alias("hit"))
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,action:string>>))")

    def step(acc, m):
        begin = acc["at"] + F.length(m["gap"])
        end = begin + F.length(m["hit"])
        key = F.xxhash64(F.lower(m["hit"]))
        action = F.when(F.array_contains(gone, key), "remove").otherwise("generalise")
        longer = F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), action.alias("action"))))
        return F.struct(end.alias("at"), F.when(F.array_contains(gone, key) | F.array_contains(vague, key), longer).otherwise(acc["out"]).alias("out"))
    return F.aggregate(both, empty, step)["out"]


def disclosing_words(rows: DataFrame, docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(rid, extra): the spans of disclosing words of each row of ``rows`` (rid, text, spans), ordered.

    Every word of a text that holds an entity counts, wherever it stands, and every occurrence outside the
    base spans is listed.  Pairs of one row count once.  With n(e, t) at most the lesser of n(e) and n(t),
    pairs that cannot reach ``generalise_at`` are left out before they are counted, which loses none.  The joins
    are between written tables or plain exchanges, so an entity that a third of all documents name can be split."""
    total = float(docs.count())
    named = rows.select("rid", F.explode("spans").alias("span")).select("rid", _entity().alias("entity")).distinct()
    single = named.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") < total)
    named = materialise(named.join(single, "entity"), "pii-named")
    most = named.agg(F.max("n_entity")).first()[0] or 1
    reach = lambda n_entity: _disclosure(F.least(n_entity, F.col("n")), n_entity, F.col("n"), total) >= generalise_at
    # the bound grows with n(e), so words that fail it with the most frequent entity fail with all
    counts = _document_counts(docs).filter(reach(F.lit(most)))
    words = materialise(rows.select("rid", F.explode(_keys(F.col("text"))).alias("key")).join(counts, "key"), "pii-words")
    pairs = materialise(words.join(named, "rid").filter(reach(F.col("n_entity"))).select("rid", "entity", "key", "n_entity", "n"), "pii-pairs")
    told = pairs.groupBy("entity", "key").agg(_disclosure(F.count("*"), F.first("n_entity"), F.first("n"), total).alias("disclosure"))
    told = materialise(told.filter(F.col("disclosure") >= generalise_at), "pii-told")
    hits = pairs.join(told, ["entity", "key"]).groupBy("rid", "key").agg(F.max("disclosure").alias("disclosure"))
    remove = F.col("disclosure") >= remove_at
    hits = materialise(hits.groupBy("rid").agg(F.collect_list(F.when(remove, F.col("key"))).alias("gone"), F.collect_list(F.when(~remove, F.col("key"))).alias("vague")), "pii-hits")
    found = rows.join(hits, "rid").select("rid", "spans", _places(F.col("text"), F.col("gone"), F.col("vague")).alias("places"))
    apart = F.filter("places", lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    extra = F.transform(apart, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lit(len(KINDS)).alias("rank"), w["action"].alias("action")))
    return materialise(found.select("rid", extra.alias("extra")).filter(F.size("extra") > 0), "pii-extra")


def _joined(spans: Column, kind) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def personal_data(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind (the base kinds as
    listed, then ``term`` for disclosing words).  A null text is empty.  Rows of null or repeated ids
    are judged one by one.  An empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.withColumn("spans", base_spans(F.col("text")))
    rows = materialise(rows.select("doc_id", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"),
                                   F.monotonically_increasing_id().alias("rid")), "pii-rows")
    found = rows.filter(F.size("spans") > 0)
    extra = disclosing_words(found.select("rid", "text", "spans"), docs, generalise_at, remove_at)
    all_spans = F.array_sort(F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"))),
        F.transform("extra", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), F.lit(TERM).alias("kind")))))
    # order by start, then rank
    by_place = F.transform(F.array_sort(F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
                           lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    base = F.transform(F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,action:string>>")
    counts = [_count(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return (rows.select("rid", "doc_id", "spans").join(extra, "rid", "left").withColumn("extra", F.coalesce("extra", none))
            .select("doc_id", *counts, F.size("extra").cast("long").alias("n_term"),
                    F.sha2(_joined(base, lambda s: s["kind"]).cast("binary"), 256).alias("base_sha256"),
                    _joined(by_place, lambda s: s["kind"]).alias("spans")))


def sanitise(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """All rows and columns of ``docs`` with personal data replaced in ``text``: base spans by [KIND], generalised
    words by [word] or [number], removed words by nothing.  Overlapping spans are replaced as one, by the kind of the first.
    Rows without personal data pass unchanged and are not shuffled."""
    rid, spans = "_pii_rid", "_pii_spans"
    marked = docs.withColumn(spans, base_spans(F.col("text").cast("string")))
    found = materialise(marked.filter(F.size(spans) > 0).withColumn(rid, F.monotonically_increasing_id()), "pii-found")
    extra = disclosing_words(found.select(F.col(rid).alias("rid"), F.col("text").cast("string").alias("text"), F.col(spans).alias("spans")),
                             docs.select(F.col("text").cast("string").alias("text")), generalise_at, remove_at)
    extra = extra.select(F.col("rid").alias(rid), F.col("extra").alias("_pii_extra"))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,action:string>>")
    edits = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform(F.coalesce("_pii_extra", none), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.when(s["action"] == "remove", F.lit("")).alias("put")))))

    def union(acc, e):
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], e["end"]).alias("end"), last["put"].alias("put"))
        return F.when(e["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(e)))

    def put(acc, e):
        old = F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"])
        new = F.coalesce(e["put"], F.when(old.rlike("^[0-9]+$"), F.lit("[number]")).otherwise(F.lit("[word]")))
        return F.struct(e["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, e["start"] - acc["at"]), new).alias("out"))
    done = F.aggregate("_pii_edits", F.expr("named_struct('at', 0, 'out', '')"), put,
                       lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    cleaned = found.join(extra, rid, "left").withColumn("_pii_edits", F.aggregate(edits, F.array().cast("array<struct<start:int,rank:int,end:int,put:string>>"), union)).withColumn("text", done)
    return marked.filter(F.size(spans) == 0).select(docs.columns).union(cleaned.select(docs.columns))
