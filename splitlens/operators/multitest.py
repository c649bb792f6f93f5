"""Multiple-test correction (T5) over a family of p-values.

A family is one set of hypotheses tested together (e.g. the segments of one experiment);
it is a window partition by definition, a handful to a few thousand rows.  Step-down
methods are running maxima in ascending p order, step-up methods running minima from the
largest p down.  Ranks break ties on ``tiebreak`` columns so results are deterministic.
``reject`` is ``p_adj <= alpha``, which equals the step-wise decision rule of every method.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitlens.functions.numeric import harmonic
from splitlens.operators import ranking as R
from splitlens.operators.selection import settled
from splitlens.pinned import ALPHA, STAT_DP

METHODS = ("bonferroni", "sidak", "holm", "holm_sidak", "simes_hochberg", "hommel",
           "fdr_bh", "fdr_by", "fdr_tsbh", "fdr_tsbky")
ALIASES = {"b": "bonferroni", "s": "sidak", "h": "holm", "hs": "holm_sidak",
           "sh": "simes_hochberg", "ho": "hommel", "fdr_i": "fdr_bh", "fdr_n": "fdr_by"}

# level of the first stage of the two-stage methods: Benjamini and Hochberg (2000); Benjamini, Krieger and Yekutieli (2006)
FIRST_STAGE = {"fdr_tsbh": lambda alpha: alpha, "fdr_tsbky": lambda alpha: alpha / (1 + alpha)}
HULL_RUN, HULL_FAN = 100_000, 64   # ranks of one part of Hommel's hull, parts merged at once


def _fam(family: Sequence[str]):
    return Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))


def corrected_alphas(df: DataFrame, family: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Per family the Sidak- and Bonferroni-corrected significance levels:
    ``1 - (1 - alpha)^(1/m)`` and ``alpha / m``; NULL for a family without tests."""
    g = df.groupBy(*family).agg(F.count(F.lit(1)).alias("m"))
    m = F.col("m").cast("double")
    return g.select(*family, "m", (1 - F.pow(F.lit(1 - alpha), F.try_divide(F.lit(1.0), m))).alias("alpha_sidak"),
                    F.try_divide(F.lit(alpha), m).alias("alpha_bonferroni"))


def adjust(df: DataFrame, p_col: str, method: str = "holm_sidak",
           family: Sequence[str] = (), tiebreak: Sequence[str] = (),
           alpha: float = ALPHA, round_dp: int | None = STAT_DP,
           distributed: bool = False) -> DataFrame:
    """Add ``p_adj`` and ``reject`` to every row of ``df``.

    Rows without a p-value (a test that could not be computed) are not part of the family:
    they get NULL ``p_adj`` / ``reject`` and do not count towards ``m``.

    ``distributed=True`` is for families too large for one task (millions of hypotheses):
    ranks and running extremes come from range partitions (``operators.ranking``) instead
    of a window over the family."""
    method = ALIASES.get(method, method)
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    tested = df.filter(F.col(p_col).isNotNull())
    untested = (df.filter(F.col(p_col).isNull())
                .withColumn("p_adj", F.lit(None).cast("double"))
                .withColumn("reject", F.lit(None).cast("boolean")))
    scan = _RangeScan if distributed else _WindowScan
    out = (_hommel if method == "hommel" else _stepwise)(tested, p_col, method, family, tiebreak, alpha, scan)
    if round_dp is not None:
        out = out.withColumn("p_adj", F.round("p_adj", round_dp))
    return out.unionByName(untested)


class _WindowScan:
    """Ranks and running extremes of a family by windows: the whole family in one task."""

    def __init__(self, df: DataFrame, order: Sequence, family: Sequence[str]):
        self.family, self.order = list(family), list(order)
        fam = _fam(family)
        self.frame = (df.withColumn("_rn", F.row_number().over(fam.orderBy(*order)).cast("long"))
                      .withColumn("_n", F.count(F.lit(1)).over(fam)))

    def running(self, frame: DataFrame, raw, out: str, how: str, reverse: bool = False) -> DataFrame:
        ends = (Window.currentRow, Window.unboundedFollowing) if reverse else (Window.unboundedPreceding, Window.currentRow)
        span = _fam(self.family).orderBy("_rn").rowsBetween(*ends)
        return frame.withColumn(out, (F.max if how == "max" else F.min)(raw).over(span))

    @staticmethod
    def hull_parts(points: DataFrame) -> DataFrame:
        return points.withColumn("_part", F.lit(0))


class _RangeScan(_WindowScan):
    """The same by range partitions: no task holds a family."""

    def __init__(self, df: DataFrame, order: Sequence, family: Sequence[str]):
        self.family = list(family)
        self.frame = R.with_row_numbers(R.numbered_partitions(df, order, self.family), self.family)

    def running(self, frame: DataFrame, raw, out: str, how: str, reverse: bool = False) -> DataFrame:
        return R.running(frame.withColumn("_raw", raw), "_raw", out, how, self.family, reverse).drop("_raw")

    @staticmethod
    def hull_parts(points: DataFrame) -> DataFrame:
        return points.withColumn("_part", F.floor((F.col("_rn") - 1) / HULL_RUN))


def _stepwise(df, p_col, method, family, tiebreak, alpha, scan):
    """Every method but Hommel's: a value of each hypothesis alone, then its running maximum from the smallest p-value up
    (step-down) or running minimum from the largest down (step-up)."""
    base, fam = _with_family(df, family)
    run = scan(base, [F.col(p_col).asc(), *tiebreak], fam)
    p, m, k = F.col(p_col).cast("double"), F.col("_n").cast("double"), F.col("_rn").cast("double")
    left = m - k + 1
    step_up = {"simes_hochberg": p * left, "fdr_by": p * m * harmonic("_n") / k}
    step_down = {"holm": p * left, "holm_sidak": -F.expm1(left * F.log1p(-p))}
    single = {"bonferroni": p * m, "sidak": -F.expm1(m * F.log1p(-p))}
    x = run.frame
    if method in single:
        x = x.withColumn("p_adj", F.least(F.lit(1.0), single[method]))
    elif method in step_down:
        x = run.running(x, step_down[method], "_s", "max").withColumn("p_adj", F.least(F.lit(1.0), F.col("_s")))
    else:
        x = run.running(x, step_up.get(method, p * m / k), "_s", "min", True).withColumn("p_adj", F.least(F.lit(1.0), F.col("_s")))
        if method in FIRST_STAGE:
            x = _second_stage(x, fam, alpha, FIRST_STAGE[method](alpha))
    return _judged(x, base, family, alpha)


def _second_stage(x: DataFrame, fam: list[str], alpha: float, first: float) -> DataFrame:
    """The adaptive linear step-up procedures from their definition.  Stage one is BH at level ``first``; it rejects r
    hypotheses and so leaves m - r as the estimate of the true nulls.  Stage two is BH at level first * m / (m - r), so the BH
    value a hypothesis is compared with shrinks by (m - r) / m; in units of ``alpha`` instead of ``first`` it is that
    times alpha / first.  When stage one rejects everything, nothing is left to estimate and its values stand."""
    own = {c: f"_own{i}" for i, c in enumerate(fam)}
    nulls = x.groupBy(*[F.col(c).alias(o) for c, o in own.items()]).agg(F.count_if(F.col("p_adj") > first).alias("_nulls"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()])   # a NULL family is a family
    share = F.when(F.col("_nulls") > 0, F.col("_nulls") / F.col("_n")).otherwise(1.0)
    return x.join(nulls, same).withColumn("p_adj", F.least(F.lit(1.0), F.col("p_adj") * share * (alpha / first)))


def _with_family(df: DataFrame, family: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(family)) if family else (df.withColumn("_family", F.lit(0)), ["_family"])


def _judged(x: DataFrame, base: DataFrame, family: Sequence[str], alpha: float) -> DataFrame:
    out = x.withColumn("reject", F.col("p_adj") <= F.lit(alpha)).select(*base.columns, "p_adj", "reject")
    return out if family else out.drop("_family")


def _below_chain(points: np.ndarray) -> list[int]:
    """Places of the vertices of the lower convex hull of points (x ascending, y), by one scan."""
    chain: list[int] = []
    for k, (x, y) in enumerate(points):
        while len(chain) > 1:
            (x0, y0), (x1, y1) = points[chain[-2]], points[chain[-1]]
            if (y1 - y0) * (x - x0) < (y - y0) * (x1 - x0):
                break
            chain.pop()
        chain.append(k)
    return chain


def _hull(points: DataFrame, keys: list[str]) -> DataFrame:
    """The vertices of the lower convex hull of (x, y) of each group of ``keys``; x is unique in a group."""
    def of_group(table: pa.Table) -> pa.Table:
        table = table.sort_by("x")
        xy = np.column_stack([table.column("x").to_numpy().astype(float), table.column("y").to_numpy()])
        return table.take(_below_chain(xy))
    return points.groupBy(*keys).applyInArrow(of_group, points.schema)


def _hommel(df, p_col, method, family, tiebreak, alpha, scan):
    """Hommel's procedure as closed testing with Simes' test, in O(m log m).

    Of all intersections of j hypotheses the j largest p-values give the greatest Simes value,
    S(j) = min over ranks r > m - j of j p(r) / (r - (m - j)).  Let h(a) be the largest j with S(j) > a: closed testing at
    level a rejects a hypothesis when h(a) p <= a.  S never rises with j, so its adjusted p-value is
    min over j = 1 .. m + 1 of max(S(j), (j - 1) p), with S(m + 1) = 0.

    * The minimum in S(j) is the slope of the tangent from (m - j, 0) to the points (r, p(r)), so only vertices of their
      lower convex hull count, each for a run of consecutive j (a *piece*).  The hull is built in parts of ``HULL_RUN``
      ranks and merged ``HULL_FAN`` parts at a time; of p-values of any smooth distribution it has about the cube root of m vertices.
    * (j - 1) p rises and S(j) falls with j, so the best j is where they cross: in the piece with the largest
      S(hi) / (hi - 1) that is not above p, found by one scan over pieces and hypotheses in that order, and inside it
      from a quadratic."""
    base, fam = _with_family(df, family)
    p = F.col(p_col).cast("double")
    ranked = scan(base.withColumn("_p", p), [F.col("_p").asc(), *tiebreak], fam).frame.select(*base.columns, "_p", "_rn", "_n")
    ranked, _ = settled(ranked)  # read three times
    pieces = _tangent_pieces(ranked, fam, scan)
    mark = F.struct("t", (-F.col("hi")).alias("minus_hi"), "lo", "y", "c", "s_before").alias("piece")
    none = F.lit(None)
    both = (ranked.select(*base.columns, F.col("_p").alias("_at"), F.lit(1).alias("_kind"), none.cast(_kind_of(pieces, mark)).alias("piece"))
            .unionByName(pieces.select(*fam, F.col("t").alias("_at"), F.lit(0).alias("_kind"), mark), allowMissingColumns=True))
    along = scan(both, ["_at", "_kind", F.col("piece.minus_hi").asc_nulls_last(), *tiebreak], fam)
    x = along.running(along.frame, F.col("piece"), "_piece", "max").filter("_kind = 1")
    q = {name: F.col(f"_piece.{name}") for name in ("minus_hi", "lo", "y", "c", "s_before")}
    hi, lo = -q["minus_hi"], q["lo"]
    at = F.col("_at")
    b = (q["c"] + 1) * at + q["y"]
    cross = (b + F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * q["c"] * at * at))) / (2 * at)
    j = F.when((q["y"] == 0) | (at == 0), lo).otherwise(F.least(hi, F.greatest(lo, F.ceil(cross))))
    x = x.withColumn("_j", j.cast("double"))

    def simes(j):
        return F.when(q["y"] == 0, 0.0).otherwise(j * q["y"] / (j - q["c"]))

    # every j bounds the adjusted value from above, so a crossing off by rounding costs nothing: its neighbours are tried too
    tries = [F.greatest(simes(F.col("_j")), (F.col("_j") - 1) * at),
             F.when(F.col("_j") > lo, F.greatest(simes(F.col("_j") - 1), (F.col("_j") - 2) * at)).otherwise(F.greatest(q["s_before"], (lo - 2) * at)),
             F.when(F.col("_j") < hi, F.greatest(simes(F.col("_j") + 1), F.col("_j") * at))]
    return _judged(x.withColumn("p_adj", F.least(F.lit(1.0), *tries)), base, family, alpha)


def _kind_of(df: DataFrame, column):
    return df.select(column).schema[0].dataType


def _tangent_pieces(ranked: DataFrame, fam: list[str], scan) -> DataFrame:
    """``lo, hi, y, c, t, s_before`` per run of j that shares a hull vertex (c = m - its rank, y its p-value): t = S(hi) / (hi - 1),
    s_before = S(lo - 1) or NULL for lo = 1.  The last piece is j = m + 1 with S = 0."""
    points = scan.hull_parts(ranked.select(*fam, F.col("_n").alias("m"), F.col("_rn").alias("x"), F.col("_p").alias("y"), "_rn")).drop("_rn")
    if scan is _RangeScan:
        points = _hull(points, [*fam, "_part"])
        points = _hull(points.withColumn("_part", F.floor(F.col("_part") / HULL_FAN)), [*fam, "_part"])
    hull = _hull(points.drop("_part"), fam)
    w = Window.partitionBy(*fam).orderBy("x")
    rise = F.lead("y").over(w) - F.col("y")
    # where the line through a vertex and the next one meets y = 0
    meets = F.when(rise > 0, F.col("x") - F.col("y") * (F.lead("x").over(w) - F.col("x")) / rise).when(rise <= 0, F.lit(-1.0))
    last = F.least(F.col("m") - 1, F.coalesce(F.ceil("meets") - 1, F.col("m") - 1))
    hull = hull.withColumn("meets", meets).withColumn("last", last)
    first = F.greatest(F.lit(0), F.coalesce(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(0)))
    runs = (hull.withColumn("first", first).filter("first <= last")
            .select(*fam, "m", "y", (F.col("m") - F.col("x")).alias("c"), (F.col("m") - F.col("last")).alias("lo"), (F.col("m") - F.col("first")).alias("hi")))
    top = (runs.groupBy(*fam).agg(F.max("m").alias("m"))
           .select(*fam, "m", F.lit(0.0).alias("y"), F.lit(0).cast("long").alias("c"), (F.col("m") + 1).alias("lo"), (F.col("m") + 1).alias("hi")))
    runs = runs.unionByName(top)
    s_hi = F.when(F.col("y") == 0, 0.0).otherwise(F.col("hi") * F.col("y") / (F.col("hi") - F.col("c")))
    runs = runs.withColumn("s_hi", s_hi).withColumn("t", F.when(F.col("s_hi") == 0, 0.0).when(F.col("hi") == 1, F.lit(float("inf")))
                                                    .otherwise(F.col("s_hi") / (F.col("hi") - 1)))
    before = F.lag("s_hi").over(Window.partitionBy(*fam).orderBy("lo"))
    return runs.select(*fam, "lo", "hi", "y", "c", "t", before.alias("s_before"))
