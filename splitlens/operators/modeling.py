"""Models: churn classifier (N4) and price regression (N18), with their evaluation.

``churn_model`` and ``price_model`` are ``pyspark.ml`` pipelines, so fitting and scoring are distributed
Spark jobs.  A boosted-tree library is not available here, so the churn model is Spark's GBTClassifier.
``price_regression`` is a closed-form fit from one aggregate, checked value by value against SQL.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from splitlens.operators.selection import rank_auc
from splitlens.pinned import RATE_DP, STAT_DP

SEED = 42
CHURN_FEATURES = ("recency_days", "frequency", "monetary")


def held_out(key: str) -> Column:
    """Whether a row is kept out of the fit: one fifth of the rows, by the md5 of their key."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 7), 16, 10).cast("bigint") % 5 == 0


def churn_model(features: DataFrame, max_iter: int = 10, max_depth: int = 3) -> DataFrame:
    """Fit a GBT on four fifths of ``churn_features`` and score all customers:
    ``c_custkey, churned, prediction, held_out``; rows with ``held_out`` took no part in the fit, so
    their confusion counts are an honest evaluation (``churn_confusion``).  Features end before the
    label window (see ``cohorts.churn_features``), so the label cannot leak into them.  A NULL
    feature counts as 0; a NULL label is scored but not learned from.  With no row, or only one
    class, to learn from the prediction is that class (NULL without any)."""
    return _churn_scored(features, max_iter, max_depth).drop("probability")


def _churn_scored(features: DataFrame, max_iter: int, max_depth: int) -> DataFrame:
    x = (features.select("c_custkey", "churned", held_out("c_custkey").alias("held_out"),
                         *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CHURN_FEATURES])
         .persist(StorageLevel.DISK_ONLY))
    try:
        train = x.filter("churned IS NOT NULL AND NOT coalesce(held_out, false)")
        seen = train.agg(F.min("churned").alias("lo"), F.max("churned").alias("hi")).first()
        if seen["lo"] == seen["hi"]:
            return features.select("c_custkey", "churned", F.lit(seen["lo"]).cast("int").alias("prediction"),
                                   held_out("c_custkey").alias("held_out"), F.lit(None).cast("double").alias("probability"))
        pipe = Pipeline(stages=[
            VectorAssembler(inputCols=list(CHURN_FEATURES), outputCol="features"),
            GBTClassifier(labelCol="churned", featuresCol="features", maxIter=max_iter,
                          maxDepth=max_depth, seed=SEED),
        ])
        model = pipe.fit(train)
    finally:
        x.unpersist()
    # not the persisted frame: the result is lazy and outlives it
    return model.transform(x).select("c_custkey", "churned", F.col("prediction").cast("int").alias("prediction"), "held_out",
                                     vector_to_array("probability")[1].alias("probability"))


def churn_confusion(scored: DataFrame) -> DataFrame:
    """``churned, prediction, n`` over the held-out rows of ``churn_model``."""
    return scored.filter("held_out AND churned IS NOT NULL").groupBy("churned", "prediction").agg(F.count(F.lit(1)).alias("n"))


def churn_scores(features: DataFrame, max_iter: int = 10, max_depth: int = 3) -> DataFrame:
    """``churn_model`` with the model's ``probability`` of churn beside the prediction (NULL where nothing could be learned)."""
    return _churn_scored(features, max_iter, max_depth)


def churn_evaluation(scored: DataFrame, score: str = "probability") -> DataFrame:
    """One row on the held-out customers: ``customers, churned, true_pos, false_pos, false_neg, true_neg, accuracy, auc``.  The AUC
    is the tie-aware rank sum of ``score`` (``selection.rank_auc``)."""
    rows = scored.filter("held_out AND churned IS NOT NULL")
    hit = lambda y, p: F.count_if((F.col("churned") == y) & (F.col("prediction") == p))
    counts = rows.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("churned") == 1).alias("churned"), hit(1, 1).alias("true_pos"),
                      hit(0, 1).alias("false_pos"), hit(1, 0).alias("false_neg"), hit(0, 0).alias("true_neg"))
    auc = rank_auc(rows, "churned", [score]).select(F.round("auc", STAT_DP)).scalar()
    right = F.round(F.try_divide(F.col("true_pos") + F.col("true_neg"), F.col("customers")), RATE_DP)
    return counts.select("*", right.alias("accuracy"), auc.alias("auc"))


def price_statistics(part: DataFrame) -> DataFrame:
    """Sufficient statistics of the price regression, one aggregate over the learned rows: per brand
    ``n, sx, sy, sxx, sxy`` of size x and price y (exact decimals)."""
    x, y = F.col("x"), F.col("y")
    return part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                                       F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))


def price_regression(part: DataFrame) -> DataFrame:
    """Least squares of ``p_retailprice`` on a level per brand and one slope in ``p_size``:
    ``p_partkey, p_brand, p_retailprice, prediction, held_out``.

    The fit is closed in the statistics of each brand: slope = sum of (sxy - sx sy / n) over sum of
    (sxx - sx sx / n), level of a brand = (sy - slope sx) / n; a brand the fit has not seen gets the level of
    all rows.  One pass gathers them, one scores; nothing but a row per brand is shuffled.  One fifth of the parts
    (by the md5 of the key) is held out of the fit, as are rows without a price; a NULL size counts as 0, a NULL brand is a
    brand.  Without any row to learn from the prediction is NULL."""
    rows = part.select("p_partkey", "p_brand", "p_retailprice", F.coalesce(F.col("p_size").cast("decimal(10,0)"), F.lit(0)).alias("x"),
                       F.col("p_retailprice").cast("decimal(12,2)").alias("y"), F.coalesce(held_out("p_partkey"), F.lit(False)).alias("held_out"))
    stats = price_statistics(rows.filter("NOT held_out AND y IS NOT NULL"))
    n, sx, sy, sxx, sxy = (F.col(c).cast("double") for c in ("n", "sx", "sy", "sxx", "sxy"))
    slope = stats.select(F.coalesce(F.try_divide(F.sum(sxy - sx * sy / n), F.sum(sxx - sx * sx / n)), F.lit(0.0))).scalar()
    level = (F.sum(sy) - slope * F.sum(sx)) / F.sum(n)
    brands = stats.groupBy(F.col("p_brand").alias("_brand")).agg(level.alias("level"))
    scored = rows.join(brands, F.col("p_brand").eqNullSafe(F.col("_brand")), "left")
    overall = stats.select(level).scalar()
    return scored.select("p_partkey", "p_brand", "p_retailprice",
                         F.round(F.coalesce(F.col("level"), overall) + slope * F.col("x").cast("double"), 4).alias("prediction"), "held_out")


def price_evaluation(scored: DataFrame) -> DataFrame:
    """``held_out, parts, mae, rmse, r2`` of the learned and the held-out priced rows of ``price_regression``."""
    y = F.col("p_retailprice").cast("double")
    error = F.col("prediction") - y
    return (scored.filter("p_retailprice IS NOT NULL AND prediction IS NOT NULL").groupBy("held_out")
            .agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg(F.abs(error)), RATE_DP).alias("mae"), F.round(F.sqrt(F.avg(error * error)), RATE_DP).alias("rmse"),
                 F.round(1 - F.try_divide(F.avg(error * error), F.var_pop(y)), RATE_DP).alias("r2")))


def price_model(part: DataFrame) -> DataFrame:
    """Linear regression of ``p_retailprice`` on brand, type (one-hot) and size:
    ``p_partkey, prediction``.  A NULL brand or type is a level of its own, a NULL size counts as 0;
    rows without a price are predicted but not learned from."""
    cats = ["p_brand", "p_type"]
    pipe = Pipeline(stages=[
        StringIndexer(inputCols=cats, outputCols=[f"{c}_ix" for c in cats],
                      handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}_ix" for c in cats], outputCols=[f"{c}_oh" for c in cats]),
        VectorAssembler(inputCols=[f"{c}_oh" for c in cats] + ["p_size"], outputCol="features"),
        LinearRegression(labelCol="p_retailprice", featuresCol="features", regParam=0.0),
    ])
    x = part.select("p_partkey", "p_brand", "p_type", F.coalesce(F.col("p_size").cast("double"), F.lit(0.0)).alias("p_size"),
                    F.col("p_retailprice").cast("double").alias("p_retailprice"))
    priced = x.filter("p_retailprice IS NOT NULL")
    if priced.isEmpty():                       # nothing to learn from: no predictions
        return x.select("p_partkey", F.lit(None).cast("double").alias("prediction"))
    model = pipe.fit(priced)
    return model.transform(x).select("p_partkey", F.round("prediction", 4).alias("prediction"))
