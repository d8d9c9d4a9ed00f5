"""Frequent itemsets, association rules and their significance."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import ratio
from tidewheel.operators.stats import false_discovery, fisher_tail


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """basket, items: the distinct items of each basket, sorted."""
    return rows.where(F.col(item).isNotNull()).groupBy(F.col(basket).alias("basket")).agg(F.array_sort(F.collect_set(item)).alias("items"))


def least_count(n: int, support: float) -> int:
    return max(1, math.ceil(support * n - 1e-9))


def apriori(sets: DataFrame, support: float, most: int = 4) -> DataFrame:
    """items, size, cnt of all frequent itemsets of up to most items, level by level.

    A level extends each basket's frequent sets by a later item of the same
    basket, drops sets with an infrequent subset (closure), and counts. Joins
    are on the basket, so their output is bounded by the baskets' own subsets.
    """
    floor = least_count(sets.count(), support)
    single = sets.select("basket", F.explode("items").alias("item"))
    frequent = single.groupBy("item").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= floor)
    single = single.join(frequent.select("item"), "item")
    held = single.select("basket", F.array("item").alias("items"))
    found = frequent.select(F.array("item").alias("items"), F.lit(1).alias("size"), "cnt")
    last = found
    for size in range(2, most + 1):
        wider = held.join(single, "basket").where(F.col("item") > F.element_at("items", -1))
        wider = wider.select("basket", F.array_append("items", F.col("item")).alias("items"))
        counts = wider.groupBy("items").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= floor)
        subset = F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), _without))
        closed = counts.select("items", subset.alias("part")).join(last.select(F.col("items").alias("part")), "part", "left_semi")
        closed = closed.groupBy("items").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") == size).select("items")
        last = counts.join(closed, "items").select("items", F.lit(size).alias("size"), "cnt")
        held = wider.join(last.select("items"), "items", "left_semi").select("basket", "items")
        found = found.union(last)
    return found


def _without(i: Column) -> Column:
    items = F.col("items")
    return F.concat(F.slice(items, F.lit(1), i - 1), F.slice(items, i + 1, F.size(items)))


def fp_growth(sets: DataFrame, support: float, most: int = 4) -> DataFrame:
    """The same itemsets by pattern growth."""
    n = sets.count()
    model = FPGrowth(itemsCol="items", minSupport=max(least_count(n, support) - 0.5, 0.5) / max(n, 1)).fit(sets)
    return model.freqItemsets.where(F.size("items") <= most).select(F.array_sort("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("cnt"))


def rules(itemsets: DataFrame, n_baskets: int, least_confidence: float) -> DataFrame:
    """Rules of every proper antecedent of every frequent itemset, with their measures.

    Conviction is null at confidence 1. Zhang's measure is the gain of the
    confidence over the consequent's share, over the larger of what either
    could be: (conf - c) / max(conf (1 - c), c (1 - conf)); 0 where that is.
    It is one division of whole numbers, so that no rounding comes before it.
    """
    n = F.lit(float(n_baskets))
    items, k = F.col("items"), F.col("size")
    wide = itemsets.where("size >= 2").select("items", "size", "cnt", F.explode(F.expr("sequence(1, shiftleft(1, size) - 2)")).alias("mask"))

    def part(on: int) -> Column:
        return F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1) = {on})")

    pairs = wide.select("items", "size", F.col("cnt").alias("n_both"), part(1).alias("antecedent"), part(0).alias("consequent"))
    one = itemsets.select(F.col("items").alias("antecedent"), F.col("cnt").alias("n_a"))
    two = itemsets.select(F.col("items").alias("consequent"), F.col("cnt").alias("n_c"))
    rows = pairs.join(one, "antecedent").join(two, "consequent").withColumn("n_all", F.lit(n_baskets).cast("long"))
    s, a, c = F.col("n_both") / n, F.col("n_a") / n, F.col("n_c") / n
    confidence = F.col("n_both") / F.col("n_a")
    nb, na, nc, nn = (F.col(x).cast("decimal(19,0)") for x in ("n_both", "n_a", "n_c", "n_all"))
    gain, room = (nb * nn - na * nc).cast("double"), F.greatest(nb * (nn - nc), nc * (na - nb)).cast("double")
    return rows.where(confidence >= least_confidence).select(
        F.array_join("antecedent", "|").alias("antecedent"),
        F.array_join("consequent", "|").alias("consequent"),
        "n_both",
        "n_a",
        "n_c",
        F.col("n_all").alias("n"),
        s.alias("support"),
        confidence.alias("confidence"),
        (confidence / c).alias("lift"),
        (s - a * c).alias("leverage"),
        F.when(F.col("n_both") < F.col("n_a"), (1 - c) / (1 - confidence)).alias("conviction"),
        F.coalesce(gain / F.nullif(room, F.lit(0.0)), F.lit(0.0)).alias("zhang"),
    )


def significant_rules(found: DataFrame, alpha: float) -> DataFrame:
    """Rules with Fisher's one-sided p, its false-discovery rate q, and significance. Rules of like margins are priced once."""
    cells = ["n_both", "n_a", "n_c", "n"]
    priced = found.select(*cells).distinct().withColumn("p", fisher_tail(*map(F.col, cells)))
    return false_discovery(found.join(priced, cells), "p", alpha)


def top_rules(found: DataFrame, measure: str, n: int, least_count: int = 0, only_significant: bool = True) -> DataFrame:
    """The n rules of the highest measure, of those that are significant (if asked) and hold in so many baskets; with their rank."""
    kept = found.where(F.col("n_both") >= least_count).where(F.col(measure).isNotNull())
    kept = kept.where("significant") if only_significant else kept
    best = kept.withColumn("by", F.round(measure, 9)).orderBy(F.desc("by"), "antecedent", "consequent").limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("by"), "antecedent", "consequent"))).drop("by")


def dissociations(found: DataFrame, n: int, least_count: int = 20, below: float = -0.2) -> DataFrame:
    """The n rules of the lowest Zhang measure under the bound, in so many baskets at least."""
    kept = found.where((F.col("n_both") >= least_count) & (F.col("zhang") < below))
    return kept.orderBy(F.round("zhang", 9), "antecedent", "consequent").limit(n)


def cooccurrence(itemsets: DataFrame, top: int, edges: int) -> DataFrame:
    """Pairs of the most frequent items by joint count: the heaviest edges of their graph."""
    items = itemsets.where("size = 1").select(F.col("items")[0].alias("item"), "cnt")
    heavy = items.orderBy(F.desc("cnt"), "item").limit(top).select("item")
    pairs = itemsets.where("size = 2").select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "cnt")
    kept = pairs.join(heavy.withColumnRenamed("item", "a"), "a", "left_semi").join(heavy.withColumnRenamed("item", "b"), "b", "left_semi")
    return kept.orderBy(F.desc("cnt"), "a", "b").limit(edges)


def top_by_size(itemsets: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("size").orderBy(F.desc("cnt"), F.array_join("items", "|")))
    return itemsets.withColumn("rank", rank).where(F.col("rank") <= n).select("size", "rank", F.array_join("items", "|").alias("items"), "cnt")


def size_table(sets: DataFrame) -> DataFrame:
    """Baskets by size from 1 to the largest, and each size's share."""
    counts = sets.groupBy(F.size("items").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.agg(F.max("size").alias("m")).where("m is not null").select(F.explode(F.expr("sequence(1L, m)")).alias("size"))
    return grid.join(counts, "size", "left").select("size", F.coalesce("n", F.lit(0)).alias("n")).withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy())))
