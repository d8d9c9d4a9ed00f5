"""Random search over families of models by cross-validation, and models as tables of numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.operators import ml, splits, trials
from tidewheel.operators.evaluation import average_precision

#: Rows of a task at least; smaller tasks take longer to start than to run, in each of thousands of jobs.
FITTED_TOGETHER = 20_000


def drawn(y: str, draws: int, seed: int) -> dict[str, tuple[object, list[dict[object, object]]]]:
    """Per family its model and so many settings, from a seeded generator: rates and penalties by their logarithm."""
    rng = np.random.default_rng(seed)
    logistic, forest = LogisticRegression(labelCol=y, maxIter=20), RandomForestClassifier(labelCol=y, seed=seed)
    boosted, bayes = GBTClassifier(labelCol=y, seed=seed), NaiveBayes(labelCol=y, modelType="gaussian")
    return {
        "logistic": (logistic, [{logistic.regParam: float(10 ** rng.uniform(-4, 0)), logistic.elasticNetParam: float(rng.uniform())} for _ in range(draws)]),
        "forest": (forest, [{forest.numTrees: int(rng.integers(5, 21)), forest.maxDepth: int(rng.integers(2, 6))} for _ in range(draws)]),
        "boosted": (boosted, [{boosted.maxIter: int(rng.integers(3, 8)), boosted.maxDepth: int(rng.integers(2, 4)), boosted.stepSize: float(10 ** rng.uniform(-1.5, -0.3))} for _ in range(draws)]),
        "bayes": (bayes, [{}]),  # without settings that matter here
    }


def _fold_scores(train: DataFrame, held: DataFrame, y: str, models: Sequence[Estimator], parallelism: int) -> list[float]:
    """Average precision on held of each model, fitted to train side by side; all are scored in one pass."""

    def fit(at: int) -> Model:
        return models[at].fit(train).setProbabilityCol(f"p{at}").setRawPredictionCol("").setPredictionCol("")

    with ThreadPool(parallelism) as pool:
        scored = reduce(lambda rows, m: m.transform(rows), pool.map(fit, range(len(models)), 1), held)
    chances = F.posexplode(F.array(*[vector_to_array(f"p{i}")[1] for i in range(len(models))])).alias("at", "p")
    rows = scored.select(F.col(y).cast("int").alias("y"), chances)
    found = {r["at"]: r["average_precision"] for r in average_precision(rows, "y", "p", ["at"]).collect()}
    return [found.get(i) or 0.0 for i in range(len(models))]


def search(df: DataFrame, key: str, y: str, numeric: Sequence[str], categorical: Sequence[str], draws: int = 12, k: int = 4, seed: int = 0, parallelism: int = 4, families: Sequence[str] = ml.FAMILIES) -> tuple[DataFrame, Model]:
    """family, setting, average_precision (mean over k folds), deviation and place of every setting; and the winner, fitted again to all rows.

    All stages, imputation and scaling too, are fitted within each fold, once
    for all settings. Settings are fitted side by side.
    """
    settings = [(name, model, setting) for name in families for model, grid in [drawn(y, draws, seed)[name]] for setting in grid]
    models = [model.copy(setting) for _, model, setting in settings]
    stages = trials.mixed_stages(numeric, categorical)
    rows = splits.folds(df, key, y, k, seed).cache()
    try:
        parts = max(1, math.ceil(rows.count() / FITTED_TOGETHER))
        scores = []
        for fold in range(k):
            fitted = splits.require_pipeline(Pipeline(stages=stages)).fit(rows.where(F.col("fold") != fold))
            prepared = fitted.transform(rows).select(y, "fold", "features").coalesce(parts).cache()
            train, held = prepared.where(F.col("fold") != fold).cache(), prepared.where(F.col("fold") == fold)
            try:
                scores.append(_fold_scores(train, held, y, models, parallelism))
            finally:
                train.unpersist()
                prepared.unpersist()
        means, spreads = np.mean(scores, axis=0), np.std(scores, axis=0)
        best = Pipeline(stages=[*stages, models[int(np.argmax(means))]]).fit(rows)
    finally:
        rows.unpersist()
    found = []
    for (name, _, setting), mean, spread in zip(settings, means, spreads, strict=True):
        told = ", ".join(f"{p.name} {v:.4g}" for p, v in sorted(setting.items(), key=lambda x: x[0].name))
        found.append((name, told, float(mean), float(spread)))
    table = df.sparkSession.createDataFrame(found, "family string, setting string, average_precision double, deviation double")
    place = F.row_number().over(W.orderBy(F.desc("average_precision"), "family", "setting")).cast("long")
    return table.withColumn("place", place), best


def logistic_table(df: DataFrame, y: str, columns: Sequence[str]) -> tuple[DataFrame, Model]:
    """A fitted logistic model as rows: feature, filled (for null), mean, deviation, coefficient; and the intercept, whose feature is null."""
    fitted = Pipeline(stages=[*ml.prepared(columns), LogisticRegression(labelCol=y, maxIter=50)]).fit(df)
    imputer, _, scaler, model = fitted.stages
    filled = imputer.surrogateDF.first().asDict()
    rows = [(c, float(filled[c]), float(m), float(s), float(w)) for c, m, s, w in zip(columns, scaler.mean.toArray(), scaler.std.toArray(), model.coefficients.toArray(), strict=True)]
    rows.append((None, None, None, None, float(model.intercept)))
    return df.sparkSession.createDataFrame(rows, "feature string, filled double, mean double, deviation double, coefficient double"), fitted


def table_scores(df: DataFrame, key: str, columns: Sequence[str], table: DataFrame) -> DataFrame:
    """key, probability: the model's table joined to the rows' values (keys are distinct)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    long = df.select(F.col(key).alias("key"), pairs).select("key", "x.feature", "x.v")
    v = F.coalesce(F.nanvl("v", F.lit(None).cast("double")), "filled")
    term = F.when(F.col("deviation") > 0, (v - F.col("mean")) / F.col("deviation") * F.col("coefficient")).otherwise(0.0)
    total = long.join(F.broadcast(table.where("feature is not null")), "feature").groupBy("key").agg(F.sum(term).alias("z"))
    start = table.where("feature is null").select(F.col("coefficient").alias("start"))
    return total.join(F.broadcast(start)).select(F.col("key").alias(key), (1 / (1 + F.exp(-(F.col("z") + F.col("start"))))).alias("probability"))
