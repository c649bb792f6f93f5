"""Mixing to target weights with soft membership.

Domains are the kinds of documents that the labelled table knows (here ``quality`` and ``toxic``).  A
classifier fitted on it gives every document a posterior over the domains, and a document counts
toward a domain by its posterior times its number of tokens.  Nonnegative rates r(d), how often a
document is to be read, are fitted by projected gradient least squares so that the expected tokens
of the domains meet their targets:

    minimise  sum_k (E(k) - T(k))^2,  E(k) = sum_d r(d) n(d) p(k|d),  r >= 0.

The gradient of a document is n(d) times its posterior dotted with the K residuals E - T, so a step is
K numbers, however many documents there are, and is taken where the document is:
r(d) <- max(0, r(d) - p(.|d) . s).  A document at rate 0 whose gradient would lower it stays there (it is *bound*).  The
step s is the residual scaled by the K x K curvature of the documents that are not bound, or the residual itself, each
at several lengths; one pass over the documents sums the expected tokens after every trial and the best is
taken.  The rates are the accumulated projected steps: a list of K-vectors, replayed on each document, and
written out as a column every ``REPLAYED`` steps.  Only DataFrame and SQL functions.

When targets are out of reach the least residual may need few documents at high rates; ``MAX_STEPS`` bounds the
search, and the residual that was reached is part of the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import materialise
from splitlens.llm.labelled import MAX_LABELLED

TARGETS = {"q1t0": 0.90, "q0t0": 0.08, "q1t1": 0.02}
MAX_TERMS = 64
MIN_GAIN = 15.0
MAX_STEPS = 120
TOLERANCE = 1e-7
REPLAYED = 16
SCALED = (1.0, 0.5, 0.25, 1 / 16, 1 / 64, 1 / 256)   # lengths tried of the curvature-scaled step
PLAIN = (1.0, 4.0, 16.0, 64.0)                       # and of the gradient, in units of 1 / the largest curvature
_WORDS = r"[^\p{L}\p{N}_]+"


def _terms_of(sample: DataFrame, domain: str, max_terms: int) -> list[str]:
    """Words that mark one domain among labelled texts, by log-likelihood ratio over distinct texts."""
    texts = sample.groupBy("text").agg(F.max(F.col("domain") == domain).alias("own"))
    sides = {r["own"]: r["count"] for r in texts.groupBy("own").count().collect()}
    n1, n0 = sides.get(True, 0), sides.get(False, 0)
    if not n1 or not n0:
        return []
    counts = (texts.select("own", F.explode(F.array_distinct(F.split(F.lower("text"), _WORDS))).alias("term")).groupBy("term")
              .agg(F.sum(F.col("own").cast("long")).alias("a"), F.sum((~F.col("own")).cast("long")).alias("b")))
    a, b = F.col("a"), F.col("b")
    rest = F.lit(n1 + n0) - a - b
    part = lambda seen, row, col: F.when(seen > 0, seen * F.log(seen * float(n1 + n0) / (row * col))).otherwise(0.0)
    gain = 2 * (part(a, a + b, F.lit(n1)) + part(b, a + b, F.lit(n0)) + part(n1 - a, rest, F.lit(n1)) + part(n0 - b, rest, F.lit(n0)))
    rows = (counts.filter((a * n0 > b * n1) & (F.col("term") != "")).withColumn("gain", gain).filter(F.col("gain") >= MIN_GAIN)
            .orderBy(F.desc("gain"), "term").limit(max_terms).collect())
    return sorted(r["term"] for r in rows)


def _numbers(docs: DataFrame, marks: dict[str, list[str]]) -> DataFrame:
    """Adds n_tokens and the features: share of capitals, of signs, of distinct words, and words of each mark list."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lower = F.split(F.lower(text), _WORDS)
    out = (docs.withColumn("_words", words)
           .withColumn("n_tokens", F.size("_words").cast("long"))
           .withColumn("upper", (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / size)
           .withColumn("sign", (F.length(text) - F.length(F.translate(text, "*$%&#|!=<>{}[]~^", ""))) / size)
           .withColumn("variety", F.when(F.size("_words") > 0, F.size(F.array_distinct("_words")) / F.size("_words")).otherwise(1.0)))
    for name, terms in marks.items():
        hits = F.size(F.array_intersect(lower, F.array(*map(F.lit, terms)))) if terms else F.lit(0)
        out = out.withColumn(name, F.log1p(hits.cast("double")))
    return out.drop("_words")


class Posterior:
    """Gaussian discriminant with one variance per feature: log posteriors are linear in the features."""

    def __init__(self, domains: list[str], features: list[str], marks: dict[str, list[str]], share: dict, mean: dict, var: dict):
        self.domains, self.features, self.marks, self.share, self.mean, self.var = domains, features, marks, share, mean, var

    def columns(self) -> list[Column]:
        """One posterior column per domain, p_<domain>."""
        logit = {k: sum(((F.col(f) * self.mean[k][f] - self.mean[k][f] ** 2 / 2) / self.var[f] for f in self.features), F.lit(math.log(self.share[k]))) for k in self.domains}
        top = F.greatest(*logit.values()) if len(logit) > 1 else logit[self.domains[0]]
        total = sum((F.exp(v - top) for v in logit.values()), F.lit(0.0))
        return [(F.exp(logit[k] - top) / total).alias(f"p_{k}") for k in self.domains]


def fit_posterior(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> Posterior | None:
    """Fitted on about ``max_labelled`` labelled documents at most, chosen by the hash of their id; None without any.
    Every domain of the labels is fitted, with or without a target."""
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("quality").alias("q"), F.max("toxic").alias("t")))
    share = min(1.0, max_labelled / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
              .join(known, "doc_id").select("text", F.format_string("q%dt%d", "q", "t").alias("domain")))
    sample = materialise(sample, "mix-sample")
    domains = sorted(r["domain"] for r in sample.select("domain").distinct().collect())
    if not domains:
        return None
    marks = {f"mark_{k}": _terms_of(sample, k, max_terms) for k in domains} if len(domains) > 1 else {}
    features = ["upper", "sign", "variety", *marks]
    numbers = _numbers(sample, marks)
    aggs = [F.count("*").alias("n"), *(F.avg(f).alias(f"m_{f}") for f in features), *(F.avg(F.col(f) * F.col(f)).alias(f"s_{f}") for f in features)]
    rows = {r["domain"]: r for r in numbers.groupBy("domain").agg(*aggs).collect()}
    total = sum(r["n"] for r in rows.values())
    mean = {k: {f: rows[k][f"m_{f}"] for f in features} for k in domains}
    var = {f: 1e-4 + sum(rows[k]["n"] * max(0.0, rows[k][f"s_{f}"] - mean[k][f] ** 2) for k in domains) / total for f in features}
    return Posterior(domains, features, marks, {k: (rows[k]["n"] + 1) / (total + len(domains)) for k in domains}, mean, var)


@dataclass
class Rates:
    """Fitted rates: the projected steps ``(s, residual)`` from rate 1, the expected share of each domain after them, and the
    squared distance of the shares from the targets (None without domains or targets)."""

    domains: list[str]
    steps: list[tuple[list[float], list[float]]] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)
    residual: float | None = None

    def column(self) -> Column:
        return _stepped(F.lit(1.0), self.steps, self.domains)


def _dot(values, domains: list[str]) -> Column:
    return sum((F.col(f"p_{k}") * v for k, v in zip(domains, values)), F.lit(0.0))


def _step(rate: Column, move: Column, gradient: Column) -> Column:
    return F.when((rate > 0) | (gradient < 0), F.greatest(F.lit(0.0), rate - move)).otherwise(rate)


def _stepped(rate: Column, steps: list[tuple[list[float], list[float]]], domains: list[str]) -> Column:
    """``rate`` after the steps, one after the other."""
    if not steps:
        return rate
    every = F.array(*[F.struct(F.array(*map(F.lit, move)).alias("move"), F.array(*map(F.lit, residual)).alias("residual")) for move, residual in steps])
    each = range(len(domains))
    return F.aggregate(every, rate, lambda r, s: _step(r, _dot([s["move"][i] for i in each], domains), _dot([s["residual"][i] for i in each], domains)))


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], max_steps: int = MAX_STEPS,
              tolerance: float = TOLERANCE) -> Rates:
    """Projected gradient least squares over ``members`` (n_tokens, p_<domain>), from rate 1.

    The search ends when every share is within ``tolerance`` of its target, when no trial lowers the squared residual, or when
    five steps in a row lower it by less than a ten thousandth."""
    out, size = Rates(domains), len(domains)
    if not size:
        return out
    n, p = F.col("n_tokens"), [F.col(f"p_{k}") for k in domains]
    held, pending = members.select("n_tokens", *p, F.lit(1.0).alias("_rate")), []

    def now() -> DataFrame:
        return held.withColumn("_now", _stepped(F.col("_rate"), pending, domains))

    def sums(frame: DataFrame, columns: list[Column]) -> np.ndarray:
        return np.array([float(x or 0.0) for x in frame.agg(*map(F.sum, columns)).first()])

    reached = sums(held, [n * x for x in p])
    total, wanted = reached.sum(), sum(targets.get(k, 0.0) for k in domains)
    if not total or not wanted:
        return out
    goal = np.array([targets.get(k, 0.0) / wanted for k in domains])
    shares, idle = reached / total, 0
    for _ in range(max_steps):
        residual = shares - goal
        if np.abs(residual).max() <= tolerance or idle == 5:
            break
        loose = (F.col("_now") > 0) | (_dot(residual.tolist(), domains) < 0)
        curvature = sums(now().filter(loose), [n * x * y for x in p for y in p]).reshape(size, size) / total
        largest = np.linalg.eigvalsh(curvature)[-1]
        if largest <= 0:
            break
        scaled = np.linalg.lstsq(curvature, residual, rcond=1e-10)[0]
        moves = [scaled * a for a in SCALED] + [residual / largest * a for a in PLAIN]
        tried = [_step(F.col("_now"), _dot(m.tolist(), domains), _dot(residual.tolist(), domains)) for m in moves]
        ends = sums(now(), [n * x * rate for rate in tried for x in p]).reshape(len(moves), size) / total
        errors = np.square(ends - goal).sum(axis=1)
        best, error = int(errors.argmin()), np.square(residual).sum()
        if errors[best] >= error * (1 - 1e-9):
            break
        idle = idle + 1 if errors[best] > error * (1 - 1e-4) else 0
        shares = ends[best]
        out.steps.append((moves[best].tolist(), residual.tolist()))
        pending.append(out.steps[-1])
        if len(pending) == REPLAYED:
            held, pending = materialise(now().select("n_tokens", *p, F.col("_now").alias("_rate")), "mix-rates"), []
    out.shares, out.residual = shares.tolist(), float(np.square(shares - goal).sum())
    return out


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_labelled: int = MAX_LABELLED,
                 max_steps: int = MAX_STEPS) -> DataFrame:
    """Every row of ``docs`` (columns kept but text and those of the names below) with n_tokens, a posterior p_<domain> per domain, ``rate`` (how often to
    read the document), ``copies`` (whole copies with that expectation, by the hash of the id) and ``residual`` (the squared distance of
    the expected domain shares from the targets, the same in every row; null when nothing was fitted).

    Targets of domains that no label shows are left out and the rest scaled up; a domain of the labels
    without a target has the target 0, unless all are (then every rate is 1).  Targets out of
    reach are met as nearly as least squares allow.  Null and empty texts have no tokens; null ids and
    repeated rows are rated like others.  Without labels every rate is 1; empty ``docs`` give an
    empty result."""
    targets = targets or TARGETS
    posterior = fit_posterior(docs, labels, max_labelled)
    given = docs.select([F.col(c).alias(f"d_{c}") if c != "text" else F.col(c) for c in docs.columns])
    numbered = _numbers(given, posterior.marks if posterior else {})
    domains = posterior.domains if posterior else []
    own = {"text", "n_tokens", "rate", "copies", "residual", *(f"p_{k}" for k in domains)}
    kept = [c for c in docs.columns if c not in own]
    members = materialise(numbered.select(*(f"d_{c}" for c in kept), "n_tokens", *(posterior.columns() if posterior else [])), "mix-members")
    fitted = fit_rates(members, domains, targets, max_steps)
    # the hash puts a document's fraction of a copy at random but once for all
    chance = F.pmod(F.xxhash64("d_doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return (members.withColumn("rate", fitted.column()).withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))
            .select(*(F.col(f"d_{c}").alias(c) for c in kept), "n_tokens", *(f"p_{k}" for k in domains), "rate", "copies",
                    F.lit(fitted.residual).cast("double").alias("residual")))
