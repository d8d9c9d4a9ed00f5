"""Trials of models: preparation of mixed columns, weights, leaks, horizons and mixtures by criterion."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import Imputer, OneHotEncoder, RobustScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import ratio
from tidewheel.operators import evaluation, ml, splits


FITS_AT_ONCE = 4


def rare_folded(df: DataFrame, column: str, least: float, name: str = "other") -> DataFrame:
    """The column with levels of less than the least share of rows folded into one; null is a level of its own."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    share = ratio(F.col("_n"), F.sum("_n").over(W.partitionBy()))
    rare = counts.withColumn("_share", share).where((F.col("_share") < least) & F.col(column).isNotNull()).select(column, F.lit(True).alias("_rare"))
    return df.join(rare, column, "left").withColumn(column, F.when(F.col("_rare"), name).otherwise(F.col(column))).drop("_rare")


def mixed_stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Stages: median imputation, scaling by the quartiles' distance, one column a level; unseen levels and null have a level."""
    filled, indexed, coded = ([f"{c}_{s}" for c in columns] for columns, s in ((numeric, "filled"), (categorical, "index"), (categorical, "coded")))
    return [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        RobustScaler(inputCol="raw_features", outputCol="scaled", withCentering=True),
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="keep"),
        VectorAssembler(inputCols=["scaled", *coded], outputCol="features"),
    ]


def blind_scores(df: DataFrame, key: str, y: str, numeric: Sequence[str], categorical: Sequence[str], test: float, seed: int) -> DataFrame:
    """Held-out rows of df with the probability of a logistic model that sees only the named columns."""
    rows = splits.stratified(df, key, y, test, seed)
    stages = Pipeline(stages=[*mixed_stages(numeric, categorical), LogisticRegression(labelCol=y, maxIter=50)])
    found = splits.require_pipeline(stages).fit(rows.where("split = 'train'")).transform(rows.where("split = 'test'"))
    return found.select(*df.columns, ml.vector_to_array("probability")[1].alias("probability"))


def reweighting(df: DataFrame, key: str, y: str, columns: Sequence[str], test: float, seed: int) -> DataFrame:
    """variant, weight of a positive row, average_precision, roc_auc and brier on held-out rows of boosted trees: unweighted, tenfold, by the classes' ratio, classes alike."""
    rows = splits.stratified(df, key, y, test, seed)
    counts = {r[0]: r[1] for r in rows.where("split = 'train'").groupBy(y).count().collect()}  # two classes
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        raise ValueError("training rows hold one class only")
    out = None
    for name, up, down in (("none", 1.0, 1.0), ("tenfold", 10.0, 1.0), ("ratio", neg / pos, 1.0), ("alike", (pos + neg) / (2 * pos), (pos + neg) / (2 * neg))):
        weighted = rows.withColumn("_w", F.when(F.col(y) == 1, up).otherwise(down))
        model = Pipeline(stages=[*ml.prepared(columns), GBTClassifier(labelCol=y, weightCol="_w", maxIter=10, maxDepth=3, seed=seed)])
        held = model.fit(weighted.where("split = 'train'")).transform(rows.where("split = 'test'")).select(y, ml.vector_to_array("probability")[1].alias("p"))
        brier = held.agg(F.avg((F.col("p") - F.col(y)) ** 2).alias("brier"))
        one = evaluation.average_precision(held, y, "p").select("average_precision").join(evaluation.roc_auc(held, y, "p").select("roc_auc")).join(brier)  # a row each
        one = one.select(F.lit(name).alias("variant"), F.lit(up / down).alias("weight"), "average_precision", "roc_auc", "brier")
        out = one if out is None else out.union(one)
    return out


def leak_inflation(df: DataFrame, key: str, y: str, columns: Sequence[str], leaks: Sequence[str], k: int, seed: int, names: Sequence[str] = ml.FAMILIES) -> DataFrame:
    """Per model the average precision without and with the leaking columns, how much they add, and its place in either order."""
    clean = ml.tournament(df.drop(*leaks), key, y, columns, k, seed, names).withColumnsRenamed({"average_precision": "clean", "place": "clean_place"})
    leaked = ml.tournament(df, key, y, [*columns, *leaks], k, seed, names).withColumnsRenamed({"average_precision": "leaked", "place": "leaked_place"})
    gain = F.col("leaked") - F.col("clean")
    return clean.join(leaked, "model", "left").select("model", "clean", "leaked", gain.alias("gain"), ratio(F.col("leaked"), F.col("clean")).alias("times"), "clean_place", "leaked_place")


def direct_steps(series: DataFrame, group: str, time: str, y: str, lags: Sequence[int], steps: Sequence[int], last: float, seed: int) -> DataFrame:
    """step, mae, naive_mae, n: for each step ahead its own boosted regression on lags, never fed its own predictions, on the last part of time.

    Rows train only if the value they aim at lies before the cut. The naive
    forecast is the last known value.
    """
    order = W.partitionBy(group).orderBy(time)
    wide = series.withColumns({f"lag_{i}": F.lag(y, i - 1).over(order).cast("double") for i in lags})
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    ends = series.agg(F.min(seconds).alias("_a"), F.max(seconds).alias("_b")).select((F.col("_a") + (F.col("_b") - F.col("_a")) * (1 - last)).alias("_cut"))

    def one_step(step: int) -> DataFrame:
        aims = wide.withColumns({"aim": F.lead(y, step).over(order).cast("double"), "aim_at": F.lead(seconds, step).over(order)})
        rows = aims.dropna(subset=["aim", *[f"lag_{i}" for i in lags]]).join(F.broadcast(ends))
        model = Pipeline(stages=[VectorAssembler(inputCols=[f"lag_{i}" for i in lags], outputCol="features"), GBTRegressor(labelCol="aim", maxIter=5, maxDepth=3, seed=seed)])
        found = model.fit(rows.where("aim_at < _cut")).transform(rows.where(seconds >= F.col("_cut")))
        one = found.agg(F.avg(F.abs(F.col("prediction") - F.col("aim"))).alias("mae"), F.avg(F.abs(F.col(y) - F.col("aim"))).alias("naive_mae"), F.count(F.lit(1)).alias("n"))
        return one.select(F.lit(step).cast("long").alias("step"), "mae", "naive_mae", "n")

    with ThreadPool(FITS_AT_ONCE) as pool:  # the driver only waits; the fits share the cluster
        return reduce(DataFrame.unionByName, pool.map(one_step, steps))


def mixture_criteria(df: DataFrame, column: str, ks: Sequence[int], seed: int) -> DataFrame:
    """k, log_likelihood, bic, aic of Gaussian mixtures with full covariances, and whether bic is least."""
    rows = ml.vectors(df, column).select("features")
    n, found = rows.count(), []
    for k in ks:
        model = GaussianMixture(k=k, seed=seed).fit(rows)
        d, fit = model.gaussians[0].mean.size, model.summary.logLikelihood
        free = k - 1 + k * d + k * d * (d + 1) / 2
        found.append((k, float(fit), free * math.log(n) - 2 * fit, 2 * free - 2 * fit))
    out = df.sparkSession.createDataFrame(found, "k long, log_likelihood double, bic double, aic double")
    return out.withColumn("chosen", F.col("bic") == F.min("bic").over(W.partitionBy()))


def chosen_k(quality: DataFrame, stability: DataFrame) -> DataFrame:
    """The k to use: of those that are stable the one of the greatest silhouette (ties: the smaller); if none is stable, of all, flagged as fallback."""
    rows = quality.join(stability.select("k", "stable"), "k")
    order = F.struct(F.coalesce("stable", F.lit(False)).alias("s"), "silhouette", (-F.col("k")).alias("k"))
    best = rows.agg(F.max(order).alias("b"), F.max(F.coalesce("stable", F.lit(False))).alias("any"))
    return best.select((-F.col("b.k")).cast("long").alias("k"), F.col("b.silhouette").alias("silhouette"), (~F.col("any")).alias("fallback"))
