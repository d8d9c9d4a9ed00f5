"""Dependency graphs as tables of nodes (name, seconds) and edges (child, parent).

Walks go in rounds: a front holds one row a node (or pair), the edges carry it
on, and each front is written, so neither plans nor paths pile up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.sources.scratch import written


def _rounds(first: DataFrame, step: Callable[[DataFrame], DataFrame], most: int) -> list[DataFrame]:
    """The fronts from first on until one is empty; more than most of them mean a cycle, which is an error."""
    fronts = [written(first, "front")]
    while not fronts[-1].isEmpty():
        if len(fronts) > most:
            raise ValueError("the graph has a cycle")
        fronts.append(written(step(fronts[-1]), "front"))
    return fronts


def undeclared(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to a parent that is no node."""
    return edges.join(nodes.select(F.col("name").alias("parent")), "parent", "left_anti").select("child", "parent")


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("child").alias("name")), "name", "left_anti")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, level: the longest chain of parents above each node of an acyclic graph (a cycle raises ValueError)."""

    def step(front: DataFrame) -> DataFrame:
        return edges.join(front, F.col("parent") == F.col("name")).select(F.col("child").alias("name"), (F.col("level") + 1).alias("level")).distinct()

    fronts = _rounds(_roots(nodes, edges).select("name", F.lit(0).cast("long").alias("level")).distinct(), step, nodes.count() + 1)
    return reduce(DataFrame.union, fronts).groupBy("name").agg(F.max("level").alias("level"))


def invalidated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """changed, n_invalid: how many nodes are invalid once one changes, itself included."""
    known = written(edges.select(F.col("parent").alias("root"), F.col("child").alias("name")).distinct(), "front")
    fronts = [known]
    while not fronts[-1].isEmpty():
        onward = fronts[-1].join(edges, F.col("name") == F.col("parent")).select("root", F.col("child").alias("name")).distinct()
        fronts.append(written(onward.join(known, ["root", "name"], "left_anti"), "front"))
        known = reduce(DataFrame.union, fronts)
    below = known.where("root != name").groupBy(F.col("root").alias("changed")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select(F.col("name").alias("changed")).join(below, "changed", "left").select("changed", (F.coalesce("n", F.lit(0)) + 1).alias("n_invalid"))


def critical_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, path, seconds: the dearest path that ends at each node (ties: the first by names). A round keeps the best of its length for each node."""
    best = F.min(F.struct((-F.col("seconds")).alias("least"), "path")).alias("b")

    def kept(df: DataFrame) -> DataFrame:
        return df.groupBy("name").agg(best).select("name", (-F.col("b.least")).alias("seconds"), F.col("b.path").alias("path"))

    def step(front: DataFrame) -> DataFrame:
        onward = edges.join(front.select(F.col("name").alias("parent"), F.col("seconds").alias("upto"), "path"), "parent")
        joined = onward.join(nodes, F.col("child") == F.col("name"))
        return kept(joined.select("name", (F.col("upto") + F.col("seconds")).alias("seconds"), F.array_append("path", F.col("name")).alias("path")))

    first = _roots(nodes, edges).select("name", "seconds", F.array("name").alias("path"))
    fronts = _rounds(kept(first), step, nodes.count() + 1)
    return kept(reduce(DataFrame.union, fronts)).select("name", F.array_join("path", ">").alias("path"), "seconds")


def _core(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: those into sources and out of sinks are taken off until none is left to take."""
    edges = written(edges.select("child", "parent").distinct(), "core")
    left = edges.count()
    while left:
        inner = edges.join(edges.select(F.col("child").alias("parent")), "parent", "left_semi").join(edges.select(F.col("parent").alias("child")), "child", "left_semi")
        edges, before = written(inner.select("child", "parent"), "core"), left
        left = edges.count()
        if left == before:
            break
    return edges


def cycles(edges: DataFrame, most: int = 64) -> DataFrame:
    """path: each cycle once, from its smallest node; paths are followed as far as they do not repeat, only among edges that may lie on a cycle.

    A path of more than most tasks that is still open is an error when the
    result is computed, so no cycle goes missing.
    """
    walk = (
        "WITH RECURSIVE walk(start, name, path, closed) AS (SELECT parent, child, array(parent, child), parent = child FROM {edges} "
        "UNION ALL SELECT w.start, e.child, array_append(w.path, e.child), e.child = w.start FROM walk w JOIN {edges} e ON e.parent = w.name "
        f"WHERE NOT w.closed AND size(w.path) <= {most} AND e.child >= w.start AND (e.child = w.start OR NOT array_contains(w.path, e.child)))"
    )
    told = f"if(closed, path, raise_error('a path among cycles has more than {most} tasks'))"
    found = edges.sparkSession.sql(walk + f" SELECT {told} AS path FROM walk WHERE closed AND start = array_min(path) OR NOT closed AND size(path) > {most}", edges=_core(edges))
    return found.select(F.array_join("path", ">").alias("path")).distinct()


def fingerprints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, level, digest: a digest of the node's name and the sorted digests of its parents, level by level."""
    known = written(levels(nodes, edges), "levels")
    depth = known.agg(F.max("level")).first()[0]
    done = known.where("level = 0").select("name", "level", F.sha2("name", 256).alias("digest"))
    for level in range(1, (depth or 0) + 1):
        ups = edges.join(done.select(F.col("name").alias("parent"), "digest"), "parent")
        joined = ups.groupBy(F.col("child").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("up"))
        here = known.where(F.col("level") == level).join(joined, "name")
        done = done.union(written(here.select("name", "level", F.sha2(F.concat_ws("|", "name", "up"), 256).alias("digest")), "digests"))
    return done


def least_makespan(nodes: DataFrame, edges: DataFrame, workers: list[int]) -> DataFrame:
    """workers, makespan, idle, speedup, efficiency if levels are barriers: a level takes its longest task or an even share of its work, whichever is more, at least."""
    loads = nodes.join(levels(nodes, edges), "name").groupBy("level").agg(F.max("seconds").alias("longest"), F.sum("seconds").alias("work"))
    many = loads.withColumn("workers", F.explode(F.array(*[F.lit(w).cast("long") for w in workers])))
    total = many.groupBy("workers").agg(F.sum(F.greatest("longest", F.col("work") / F.col("workers"))).alias("makespan"), F.sum("work").alias("work"))
    one = F.col("work") / F.col("makespan")
    return total.select("workers", "makespan", (F.col("makespan") * F.col("workers") - F.col("work")).alias("idle"), one.alias("speedup"), (one / F.col("workers")).alias("efficiency"))


def level_widths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return levels(nodes, edges).groupBy("level").agg(F.count(F.lit(1)).alias("width"))


def dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_dependents"), F.rank().over(W.orderBy(F.desc(F.coalesce("n", F.lit(0))))).cast("long").alias("rank"))
