"""Clusters of numeric vectors: nearest centres and validity from aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def components(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label, i, x: one row per component."""
    return df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def centres(parts: DataFrame) -> DataFrame:
    return parts.groupBy("label", "i").agg(F.avg("x").alias("c"), F.count(F.lit(1)).alias("n"))


def nearest_centre(parts: DataFrame, centre: DataFrame) -> DataFrame:
    """key, nearest, distance2: each vector's nearest centre (ties: the smaller label). There are few centres, joined by component."""
    pairs = parts.select("key", "i", "x").join(centre.select(F.col("label").alias("of"), "i", "c"), "i")
    sums = pairs.groupBy("key", "of").agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("d"))
    best = F.min(F.struct(F.round("d", 9).alias("d"), "of"))
    return sums.groupBy("key").agg(best.alias("b")).select("key", F.col("b.of").cast("long").alias("nearest"), F.col("b.d").alias("distance2"))


def validity(parts: DataFrame) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin of the labels; null with fewer than two clusters."""
    centre = centres(parts)
    whole = parts.groupBy("i").agg(F.avg("x").alias("g"))
    within = parts.join(centre.select("label", "i", "c"), ["label", "i"]).groupBy("key", "label").agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("d2"))
    spread = within.groupBy("label").agg(F.sum("d2").alias("ss"), F.avg(F.sqrt("d2")).alias("s"), F.count(F.lit(1)).alias("n"))
    between = centre.join(whole, "i").groupBy("label").agg(F.sum(F.col("n") * (F.col("c") - F.col("g")) ** 2).alias("bs"))
    totals = spread.join(between, "label").agg(F.sum("ss").alias("w"), F.sum("bs").alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    ch = F.when(F.col("k") >= 2, F.col("b") / (F.col("k") - 1) / F.nullif(F.col("w") / (F.col("n") - F.col("k")), F.lit(0.0)))
    other = centre.select(F.col("label").alias("o"), "i", F.col("c").alias("co"))
    far = centre.join(other, "i").where("label != o").groupBy("label", "o").agg(F.sqrt(F.sum((F.col("c") - F.col("co")) ** 2)).alias("m"))
    ratios = far.join(spread.select("label", "s"), "label").join(spread.select(F.col("label").alias("o"), F.col("s").alias("so")), "o")
    worst = ratios.groupBy("label").agg(F.max((F.col("s") + F.col("so")) / F.nullif("m", F.lit(0.0))).alias("r"))
    return totals.join(F.broadcast(worst.agg(F.avg("r").alias("davies_bouldin")))).select("k", "n", ch.alias("calinski_harabasz"), "davies_bouldin")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings beyond chance, from pair counts."""

    def pairs(n: str):
        return F.col(n) * (F.col(n) - 1) / 2

    joint = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("total"))
    one = df.groupBy(a).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(pairs("n")).alias("pa"))
    two = df.groupBy(b).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(pairs("n")).alias("pb"))
    rows = joint.join(F.broadcast(one)).join(F.broadcast(two))
    expected = F.col("pa") * F.col("pb") / F.nullif(pairs("total"), F.lit(0.0))
    room = (F.col("pa") + F.col("pb")) / 2 - expected
    return rows.select(F.coalesce((F.col("both") - expected) / F.nullif(room, F.lit(0.0)), F.lit(1.0)).alias("ari"), F.col("total").alias("n"))


def silhouette(df: DataFrame, features: str, label: str) -> float:
    return ClusteringEvaluator(featuresCol=features, predictionCol=label).evaluate(df)


def sizes(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


#: Micro-clusters that are merged on the driver.
MICRO = 512


def ward(df: DataFrame, key: str, vector: str, k: int, most: int = MICRO, seed: int = 0) -> DataFrame:
    """key and ward: k clusters by Ward linkage, numbered by falling size (ties: the cluster of the smallest key).

    Up to most distinct vectors are merged exactly, equal ones as one. More are
    first gathered into most micro-clusters by means; a cluster is known by its
    number of rows and its mean, so what is merged is bounded at any size.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("key"), v.alias("v"))
    distinct = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    few = distinct.orderBy("first").limit(most + 1).collect()
    if not few:
        return rows.select(F.col("key").alias(key), F.lit(None).cast("long").alias("ward"))
    if len(few) <= most:
        found = [(r["first"], r["n"], r["v"]) for r in few]
        micro = rows.join(distinct.select("v", F.col("first").alias("micro")), "v")
    else:
        points = rows.withColumn("features", array_to_vector("v"))
        micro = KMeans(k=most, seed=seed, maxIter=10, predictionCol="m").fit(points).transform(points).drop("features")
        width = len(few[0]["v"])
        sums = micro.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(width)]).alias("mean"))
        found = sorted((r["first"], r["n"], r["mean"], r["m"]) for r in sums.collect())
        micro = micro.withColumnRenamed("m", "micro")
        found = [(m, n, mean) for _, n, mean, m in found]
    label = merged([n for _, n, _ in found], np.array([mean for _, _, mean in found], dtype=float), k)
    names = df.sparkSession.createDataFrame([(int(m), int(c)) for (m, _, _), c in zip(found, label, strict=True)], "micro long, ward long")
    return micro.join(F.broadcast(names), "micro").select(F.col("key").alias(key), "ward")


def merged(sizes: list[int], means: np.ndarray, k: int) -> list[int]:
    """The cluster of each of some clusters after Ward merges down to k, by chains of nearest neighbours."""
    n = len(sizes)
    size, mean = np.array(sizes, dtype=float), means.copy()
    alive, chain, joins = np.ones(n, dtype=bool), [], []

    def rise(i: int) -> np.ndarray:
        gap = ((mean - mean[i]) ** 2).sum(axis=1) * size * size[i] / (size + size[i])
        return np.where(alive & (np.arange(n) != i), gap, np.inf)

    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            far = rise(chain[-1])
            near = int(np.argmin(far))
            if len(chain) > 1 and far[chain[-2]] <= far[near]:
                break
            chain.append(near)
        b, a = chain.pop(), chain.pop()
        joins.append((float(rise(a)[b]), a, b))
        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
        size[a], alive[b] = size[a] + size[b], False
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in sorted(joins)[: max(n - k, 0)]:
        root[top(b)] = top(a)
    tops = [top(i) for i in range(n)]
    total = {t: sum(s for s, r in zip(sizes, tops, strict=True) if r == t) for t in set(tops)}
    order = {t: i for i, t in enumerate(sorted(total, key=lambda t: (-total[t], tops.index(t))))}
    return [order[t] for t in tops]
