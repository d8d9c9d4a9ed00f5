"""Models of Spark ML in the shapes that the analyses need."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.operators import clusters, regress, splits, stats
from tidewheel.operators.evaluation import average_precision


def vectors(df: DataFrame, column: str) -> DataFrame:
    """Adds features: an array column as vector."""
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def prepared(columns: Sequence[str]) -> list:
    """Stages: median imputation, assembly, standardisation."""
    filled = [f"{c}_filled" for c in columns]
    return [
        Imputer(strategy="median", inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
    ]


def k_means(df: DataFrame, column: str, k: int, seed: int) -> DataFrame:
    """Adds zone: the cluster by descending size."""
    rows = vectors(df, column)
    found = KMeans(k=k, seed=seed, maxIter=20, predictionCol="raw_zone").fit(rows).transform(rows)
    counts = found.groupBy("raw_zone").agg(F.count(F.lit(1)).alias("n"))
    rank = counts.select("raw_zone", (F.row_number().over(W.orderBy(F.desc("n"), "raw_zone")) - 1).cast("long").alias("zone"))
    return found.join(F.broadcast(rank), "raw_zone").drop("raw_zone", "features")


def k_sweep(df: DataFrame, column: str, ks: Sequence[int], seed: int) -> DataFrame:
    """k with silhouette, Calinski-Harabasz and Davies-Bouldin of its clusters, how many of the three prefer it, and whether all do."""
    rows = vectors(df, column).cache()
    out = None
    for k in ks:
        found = KMeans(k=k, seed=seed, maxIter=20, predictionCol="zone").fit(rows).transform(rows)
        quality = clusters.validity(clusters.components(found.withColumn("_id", F.monotonically_increasing_id()), "_id", column, "zone"))
        one = quality.select(F.lit(k).alias("k"), F.lit(clusters.silhouette(found, "features", "zone")).alias("silhouette"), "calinski_harabasz", "davies_bouldin")
        out = one if out is None else out.union(one)
    best = [F.max_by("k", "silhouette"), F.max_by("k", "calinski_harabasz"), F.min_by("k", "davies_bouldin")]
    chosen = out.agg(*[b.alias(f"b{i}") for i, b in enumerate(best)])
    votes = sum((F.col("k") == F.col(f"b{i}")).cast("long") for i in range(3))
    return out.join(F.broadcast(chosen)).select("k", "silhouette", "calinski_harabasz", "davies_bouldin", votes.alias("votes"), (votes == 3).alias("unanimous"))


def mixture_and_tree(df: DataFrame, column: str, k: int, seed: int) -> DataFrame:
    """Adds mixture and tree: clusters of a Gaussian mixture and of bisecting means (in place of Ward linkage)."""
    rows = vectors(df, column)
    rows = GaussianMixture(k=k, seed=seed, predictionCol="mixture", probabilityCol="mixture_p").fit(rows).transform(rows)
    return BisectingKMeans(k=k, seed=seed, predictionCol="tree").fit(rows).transform(rows).drop("features", "mixture_p")


def projection(df: DataFrame, column: str, k: int = 2) -> DataFrame:
    rows = vectors(df, column)
    found = PCA(k=k, inputCol="features", outputCol="projected").fit(rows).transform(rows)
    places = vector_to_array("projected")
    return found.withColumns({f"pc{i + 1}": places[i] for i in range(k)}).drop("features", "projected")


def bootstrap_stability(df: DataFrame, key: str, column: str, k: int, rounds: int, seed: int) -> DataFrame:
    """Per resample the agreement of its clusters with those of all rows, on the rows it holds."""
    base = vectors(df, column).select(key, "features").cache()
    whole = KMeans(k=k, seed=seed, maxIter=20, predictionCol="whole").fit(base).transform(base)
    out = None
    for r in range(rounds):
        drawn = base.sample(True, 1.0, seed + r)
        own = KMeans(k=k, seed=seed, maxIter=20, predictionCol="own").fit(drawn).transform(drawn).dropDuplicates([key]).select(key, "own")
        one = clusters.adjusted_rand(whole.join(own, key), "whole", "own").select(F.lit(r).cast("long").alias("round"), "ari", "n")
        out = one if out is None else out.union(one)
    return out


def stability(rounds: DataFrame, least: float = 0.75) -> DataFrame:
    """One row: mean, deviation and minimum of the resamples' agreement, and whether the mean reaches the least."""
    one = rounds.agg(F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"), F.min("ari").alias("min_ari"), F.count(F.lit(1)).alias("rounds"))
    return one.withColumn("stable", F.col("mean_ari") >= least)


def weighted_logistic(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Adds probability: a logistic model whose classes weigh alike."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    weights = counts.select(y, (F.sum("_n").over(W.partitionBy()) / (2 * F.col("_n"))).alias("_w"))
    rows = df.join(F.broadcast(weights), y)  # one row a class
    model = Pipeline(stages=[*prepared(columns), LogisticRegression(labelCol=y, weightCol="_w", maxIter=50)])
    return _probability(splits.require_pipeline(model).fit(rows).transform(rows)).drop("_w")


def _probability(df: DataFrame, name: str = "probability") -> DataFrame:
    drop = [c for c in df.columns if c.endswith("_filled") or c in ("raw_features", "features", "rawPrediction", "prediction")]
    return df.withColumn(name, vector_to_array("probability")[1]).drop(*[c for c in drop if c != name])


FAMILIES = ("logistic", "forest", "boosted", "bayes")


def families(y: str) -> dict[str, object]:
    return {
        "logistic": LogisticRegression(labelCol=y, maxIter=30),
        "forest": RandomForestClassifier(labelCol=y, numTrees=20, maxDepth=5, seed=7),
        "boosted": GBTClassifier(labelCol=y, maxIter=10, maxDepth=3, seed=7),
        "bayes": NaiveBayes(labelCol=y, modelType="gaussian"),
    }


def out_of_fold(df: DataFrame, key: str, y: str, columns: Sequence[str], k: int, seed: int, names: Sequence[str]) -> DataFrame:
    """key, y and per family the probability from the fold that did not see the row."""
    rows = splits.folds(df, key, y, k, seed).cache()
    out = None
    for f in range(k):
        fold = rows.where(F.col("fold") == f)
        for name in names:
            fitted = Pipeline(stages=[*prepared(columns), families(y)[name]]).fit(rows.where(F.col("fold") != f))
            fold = _probability(fitted.transform(fold)).withColumnRenamed("probability", f"p_{name}")
        out = fold if out is None else out.unionByName(fold)
    return out


def stacked(df: DataFrame, key: str, y: str, columns: Sequence[str], k: int, seed: int, names: Sequence[str] = FAMILIES, best: int = 3) -> DataFrame:
    """Adds probability: a logistic model over the out-of-fold probabilities of the best families by average precision."""
    level = out_of_fold(df, key, y, columns, k, seed, names).cache()
    ranked = sorted(names, key=lambda n: (-(average_precision(level, y, f"p_{n}").first()[0] or 0.0), n))
    return weighted_logistic(level, y, [f"p_{n}" for n in sorted(ranked[:best])])


def tournament(df: DataFrame, key: str, y: str, columns: Sequence[str], k: int, seed: int, names: Sequence[str]) -> DataFrame:
    """model, average_precision of out-of-fold probabilities, and place."""
    level = out_of_fold(df, key, y, columns, k, seed, names).cache()
    out = None
    for name in names:
        one = average_precision(level, y, f"p_{name}").select(F.lit(name).alias("model"), "average_precision")
        out = one if out is None else out.union(one)
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("average_precision"), "model")).cast("long"))


def ridge(train: DataFrame, test: DataFrame, y: str, columns: Sequence[str], strength: float = 1.0) -> DataFrame:
    model = Pipeline(stages=[*prepared(columns), LinearRegression(labelCol=y, regParam=strength, elasticNetParam=0.0)])
    return model.fit(train).transform(test).drop("features", "raw_features")


def boosted_importance(df: DataFrame, y: str, columns: Sequence[str], rounds: int = 10) -> DataFrame:
    """feature, importance of a boosted regression; importances sum to one."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df.dropna(subset=[y, *columns]))
    fitted = GBTRegressor(labelCol=y, maxIter=rounds, maxDepth=3, seed=7).fit(rows)
    found = [(c, float(x)) for c, x in zip(columns, fitted.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(found, "feature string, importance double")


def isolation_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds anomaly in [0, 1): the largest robust distance of a column, in place of an isolation forest."""
    cuts = reduce(lambda a, b: a.join(F.broadcast(b)), [stats.quantiles(df, c, (0.25, 0.5, 0.75), f"_{c}") for c in columns])  # a row each
    gaps = [F.abs(F.col(c) - F.col(f"_{c}")[1]) / F.greatest(F.col(f"_{c}")[2] - F.col(f"_{c}")[0], F.lit(1e-12)) for c in columns]
    far = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return df.join(F.broadcast(cuts)).withColumn("anomaly", far / (1 + far)).drop(*[f"_{c}" for c in columns])


def mean_sampling(df: DataFrame, column: str, sizes: Sequence[int], rounds: int, seed: int) -> DataFrame:
    """Per sample size the spread of the mean over rounds, beside the law sigma / sqrt(n).

    Every round deals all rows at random into samples of about the size.
    """
    total = df.agg(F.count(column).alias("t"), F.stddev_pop(column).alias("sigma"))
    each = df.select(F.col(column).alias("v")).join(F.broadcast(total))
    rows = each.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    groups = F.floor(F.rand(seed) * F.greatest(F.col("t") / F.col("size"), F.lit(1)))
    means = rows.groupBy("size", "round", groups.alias("g")).agg(F.avg("v").alias("m"), F.max("sigma").alias("sigma"))
    return means.groupBy("size").agg(F.stddev_pop("m").alias("observed"), (F.max("sigma") / F.sqrt("size")).alias("law"), F.count(F.lit(1)).alias("n_samples"))


def bias_variance(df: DataFrame, x: str, y: str, degrees: Sequence[int], rounds: int, seed: int) -> DataFrame:
    """Per degree the squared bias, variance and error of polynomials fitted to bootstraps, against the mean of y at each x."""
    truth = df.groupBy(F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("truth")).cache()
    top = truth.agg(F.max("x")).first()[0] or 1.0
    powers = {f"x{p}": F.pow(F.col("x") / top, F.lit(p)) for p in range(1, max(degrees) + 1)}
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumns(powers).cache()
    out = None
    for d in degrees:
        fit = Pipeline(stages=[VectorAssembler(inputCols=[f"x{p}" for p in range(1, d + 1)], outputCol="features"), LinearRegression(labelCol="y")])
        for r in range(rounds):
            one = fit.fit(rows.sample(True, 1.0, seed + r)).transform(truth.withColumns(powers)).select(F.lit(d).alias("degree"), "x", "truth", "prediction")
            out = one if out is None else out.union(one)
    at = out.groupBy("degree", "x").agg(F.avg("prediction").alias("m"), F.var_pop("prediction").alias("v"), F.max("truth").alias("t"))
    bias = F.avg((F.col("m") - F.col("t")) ** 2)
    return at.groupBy("degree").agg(bias.alias("bias2"), F.avg("v").alias("variance"), (bias + F.avg("v")).alias("error"))


#: Chances of 0, 1, 2, ... draws of a row in a resample of as many rows.
DRAWS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def resampled_polynomials(df: DataFrame, key: str, x: str, y: str, most: int, rounds: int, seed: int) -> DataFrame:
    """degree (1..most), bias2, variance and error of polynomials fitted to resamples, against the mean of y at each x.

    A row counts in a resample as often as a hash of its key says (Poisson
    with mean 1). Rows meet by round and x in the tasks that read them; a round
    is then one matrix of products, in which each further degree is one more
    sweep. The basis is Chebyshev's on the range of x, which keeps high degrees
    apart. Null keys, x or y are left out.
    """
    rows = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    each = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.pmod(F.xxhash64(F.lit(seed), "key", "round"), F.lit(1 << 40)) / float(1 << 40)
    drawn = sum((F.when(u >= c, 1).otherwise(0) for c in DRAWS), F.lit(0)).cast("double")
    met = each.withColumn("w", drawn).groupBy("round", "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))
    truth = rows.groupBy("x").agg(F.avg("y").alias("truth"))
    ends = truth.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.coalesce(2 * (F.col("x") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) - 1, F.lit(0.0))
    basis = [F.cos(F.lit(d) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), place)))) for d in range(most + 1)]
    placed = met.where("w > 0").join(F.broadcast(ends))  # one row
    root = F.sqrt("w")
    sums = regress.products(placed, ["round"], [*[b * root for b in basis], F.col("wy") / root])
    fits = sums.select("round", "m", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("degree"))
    k = F.col("degree") + 1
    fits = fits.select("round", "degree", F.slice(F.transform(regress.swept(regress.leading(F.col("m"), k), k)["m"], lambda r: F.element_at(r, -1)), F.lit(1), k).alias("coefficients"))
    # A column passed over has no coefficient of its own: its entry is what is left of the aim, about zero.
    at = truth.join(F.broadcast(ends)).select("x", "truth", F.array(*basis).alias("basis"))
    value = F.aggregate(F.zip_with("coefficients", F.slice("basis", F.lit(1), k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    told = at.join(F.broadcast(fits)).select("degree", "x", "truth", value.alias("p"))  # rounds x degrees rows
    spread = told.groupBy("degree", "x").agg(F.avg("p").alias("m"), F.var_pop("p").alias("v"), F.max("truth").alias("t"))
    bias = F.avg((F.col("m") - F.col("t")) ** 2)
    return spread.groupBy("degree").agg(bias.alias("bias2"), F.avg("v").alias("variance"), (bias + F.avg("v")).alias("error"))


def random_search(df: DataFrame, key: str, y: str, columns: Sequence[str], draws: int, k: int, seed: int) -> DataFrame:
    """draw, strength, mixing, average_precision and place of logistic models with drawn penalties, scored out of k folds.

    Draws are few and come from a seeded generator: strength log-uniform from
    1e-4 to 1, mixing uniform.
    """
    rng = np.random.default_rng(seed)
    settings = [(i, float(10 ** rng.uniform(-4, 0)), float(rng.uniform(0, 1))) for i in range(draws)]
    rows = splits.folds(df, key, y, k, seed).cache()
    out = None
    for f in range(k):
        stages = Pipeline(stages=prepared(columns)).fit(rows.where(F.col("fold") != f))
        train, test = stages.transform(rows.where(F.col("fold") != f)), stages.transform(rows.where(F.col("fold") == f))
        for i, strength, mixing in settings:
            fitted = LogisticRegression(labelCol=y, maxIter=30, regParam=strength, elasticNetParam=mixing).fit(train)
            one = fitted.transform(test).select(F.lit(i).alias("draw"), F.col(y).alias("y"), vector_to_array("probability")[1].alias("p"))
            out = one if out is None else out.unionByName(one)
    out, scores = out.cache(), None
    for i, strength, mixing in settings:
        one = average_precision(out.where(F.col("draw") == i), "y", "p").select(F.lit(i).cast("long").alias("draw"), F.lit(strength).alias("strength"), F.lit(mixing).alias("mixing"), "average_precision")
        scores = one if scores is None else scores.union(one)
    return scores.withColumn("place", F.row_number().over(W.orderBy(F.desc("average_precision"), "draw")).cast("long"))
