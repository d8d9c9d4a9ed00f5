"""Isolation forests: a table of nodes, grown level by level from bounded samples, and walked in expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.special import let
from tidewheel.sources.scratch import remove, written_at

EULER = 0.5772156649015329
TREES, SAMPLE = 100, 256


def usual_depth(n: Column) -> Column:
    """The mean depth at which a search among n values ends."""
    n = n.cast("double")
    return F.when(n > 2, 2 * (F.ln(n - 1) + EULER) - 2 * (n - 1) / n).when(n == 2, 1.0).otherwise(0.0)


def _values(columns: Sequence[str]) -> Column:
    """The columns as an array; what is not finite counts as null, and null goes to the lower side of every cut."""

    def finite(c: Column) -> Column:
        return F.when(F.abs(c) < float("inf"), c)

    return F.array(*[finite(F.col(c).cast("double")) for c in columns]).alias("x")


def _uniform(*parts: Column | str) -> Column:
    """A number from 0 up to 1, by a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def samples(df: DataFrame, key: str, columns: Sequence[str], trees: int, size: int, seed: int) -> DataFrame:
    """tree, x: about size rows for each tree, drawn by hashes of the key; where rows are scarce one is drawn for several trees, once for each."""
    n = df.count()
    draws = max(1, math.ceil(trees * size / n)) if n else 1
    share = min(1.0, trees * size / (n * draws)) if n else 1.0
    rows = df.select(F.col(key).alias("key"), _values(columns), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    rows = rows.where(_uniform(F.lit(seed), "key", "draw") < share)
    return rows.select(F.pmod(F.xxhash64(F.lit(seed + 1), "key", "draw"), F.lit(trees)).cast("int").alias("tree"), "x", "key").dropDuplicates(["tree", "key"]).drop("key")


def grow(sampled: DataFrame, n_features: int, size: int = SAMPLE, seed: int = 0) -> DataFrame:
    """tree, node, feature, cut, n: the nodes of all trees; node k has the nodes 2k (less than the cut, or null) and 2k + 1, leaves have no feature.

    A node takes one of the features that vary in it, and a cut between its
    least and its largest value, both by hashes of the node. Trees end at the
    depth log2(size). Each level is a written table of at most the sample.
    """
    spark = sampled.sparkSession
    depth = max(1, math.ceil(math.log2(size)))
    now, path = written_at(sampled.withColumn("node", F.lit(1).cast("long")), "forest-level")
    nodes, of_levels = None, []
    for level in range(depth + 1):
        ends = [F.struct(F.lit(i).alias("feature"), F.min(F.get("x", F.lit(i))).alias("low"), F.max(F.get("x", F.lit(i))).alias("high")) for i in range(n_features)]
        found = now.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends"))
        vary = F.filter("ends", lambda e: e["high"] > e["low"]) if level < depth else F.filter("ends", lambda e: F.lit(False))
        found = found.withColumn("vary", vary)
        chosen = F.get("vary", F.floor(_uniform(F.lit(seed), "tree", "node") * F.size("vary")).cast("int"))
        cut = chosen["low"] + (chosen["high"] - chosen["low"]) * _uniform(F.lit(seed + 1), "tree", "node")
        # A cut at the least value itself would leave nothing on its side.
        cut = F.when(cut > chosen["low"], cut).otherwise(chosen["high"])
        splits, at = written_at(found.select("tree", "node", chosen["feature"].alias("feature"), cut.alias("cut"), "n"), "forest-nodes")
        of_levels.append(at)
        nodes = splits if nodes is None else nodes.unionByName(splits)
        if level < depth:
            inner = F.broadcast(splits.where("feature is not null").drop("n"))  # at most as many as sampled rows
            side = F.coalesce((F.get("x", F.col("feature")) >= F.col("cut")).cast("long"), F.lit(0))
            (now, path), old = written_at(now.join(inner, ["tree", "node"]).select("tree", "x", (F.col("node") * 2 + side).alias("node")), "forest-level"), path
            remove(spark, old)
    out, _ = written_at(nodes, "forest")
    for at in (path, *of_levels):
        remove(spark, at)
    return out


def packed(forest: DataFrame) -> DataFrame:
    """One row: trees, an array of arrays in which a node stands at its number, as feature, cut and (of leaves) the depth it tells; and usual, the depth to compare with.

    Its size is bounded by the trees and their depth.
    """
    level = F.floor(F.log2(F.col("node").cast("double")) + 1e-9)
    rows = forest.withColumn("depth", F.when(F.col("feature").isNull(), level + usual_depth(F.col("n"))))
    items = F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "cut", "depth"))))
    trees = rows.groupBy("tree").agg(items.alias("m"), F.max("node").alias("last"), F.max(F.when(F.col("node") == 1, F.col("n"))).alias("of"))
    array = F.transform(F.sequence(F.lit(1).cast("long"), F.col("last")), lambda i: F.try_element_at("m", i))
    return trees.select(array.alias("t"), "of").agg(F.collect_list("t").alias("trees"), usual_depth(F.avg("of")).alias("usual"))


def path_lengths(df: DataFrame, columns: Sequence[str], forest: DataFrame, name: str = "path_length") -> DataFrame:
    """Adds the mean depth at which the trees isolate a row, and usual, the depth to compare with."""
    def walk(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            def go(node: Column) -> Column:
                side = F.coalesce((F.get("_x", node["feature"]) >= node["cut"]).cast("long"), F.lit(0))
                return F.when(node["feature"].isNull(), at).otherwise(at * 2 + side)

            return let(F.get(tree, (at - 1).cast("int")), go)

        levels = F.sequence(F.lit(1), F.ceil(F.log2(F.size(tree) + 1)).cast("int"))
        return F.get(tree, (F.aggregate(levels, F.lit(1).cast("long"), step) - 1).cast("int"))["depth"]

    rows = df.withColumn("_x", _values(columns)).join(F.broadcast(packed(forest)))  # one row
    mean = F.aggregate(F.transform("trees", walk), F.lit(0.0), lambda s, v: s + v) / F.size("trees")
    return rows.withColumn(name, mean).drop("_x", "trees")


def isolation_scores(df: DataFrame, key: str, columns: Sequence[str], fit_on: Column | None = None, trees: int = TREES, size: int = SAMPLE, seed: int = 0) -> DataFrame:
    """Adds anomaly, from 0 to 1 (a half is usual): 2 to the minus mean depth over the usual one, of a forest grown on the rows that fit_on holds.

    Without rows to grow on the score is null. Keys need not be distinct.
    """
    base = df if fit_on is None else df.where(fit_on)
    forest = grow(samples(base, key, columns, trees, size, seed), len(columns), size, seed)
    found = path_lengths(df, columns, forest)
    return found.withColumn("anomaly", F.pow(F.lit(2.0), -F.col("path_length") / F.nullif("usual", F.lit(0.0)))).drop("path_length", "usual")
