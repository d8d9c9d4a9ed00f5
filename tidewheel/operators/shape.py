"""Small reshaping steps: bands, thinning, heads and tails, filling and clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.operators import stats


def quantile_bands(df: DataFrame, column: str, n: int) -> DataFrame:
    """Adds band from 1: right-closed intervals between the column's quantiles; edges that coincide are one."""
    cuts = stats.quantiles(df, column, [i / n for i in range(1, n)], "_cuts")
    edges = cuts.select(F.array_sort(F.array_distinct("_cuts")).alias("_edges"))
    band = F.size(F.filter("_edges", lambda e: e < F.col(column))) + 1
    return df.join(F.broadcast(edges)).withColumn("band", F.when(F.col(column).isNotNull(), band).cast("long")).drop("_edges")


def fixed_bands(column: Column, edges: Sequence[float]) -> Column:
    """Index from 1 of the right-closed interval between edges; null outside."""
    out = None
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False), start=1):
        inside = (column > low) & (column <= high)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out.cast("long")


def thinned(series: DataFrame, order: str, most: int) -> DataFrame:
    """At most so many rows of a small series, evenly spaced by position; both ends stay."""
    rows = series.withColumns({"_i": F.row_number().over(W.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy())})
    step = (F.col("_n") - 1) / (most - 1)
    nearest = F.floor(F.floor(F.col("_i") / step + 0.5) * step + 0.5)
    return rows.where((F.col("_n") <= most) | (nearest == F.col("_i"))).drop("_i", "_n")


def decimated(series: DataFrame, order: str, stride: int) -> DataFrame:
    return series.withColumn("_i", F.row_number().over(W.orderBy(order)) - 1).where(F.col("_i") % stride == 0).drop("_i")


def head_per_class(df: DataFrame, label: str, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def filled(df: DataFrame, medians: Sequence[str], constants: dict[str, object]) -> DataFrame:
    """Nulls replaced by the column's median or a constant."""
    middles = [(c, stats.quantiles(df, c, (0.5,), "_middle")) for c in medians]
    for c, one in middles:
        df = df.join(F.broadcast(one)).withColumn(c, F.coalesce(F.col(c), F.col("_middle")[0])).drop("_middle")
    return df.fillna(constants) if constants else df


def clipped(column: Column, low: float | None = None, high: float | None = None) -> Column:
    out = column if low is None else F.greatest(column, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))
