"""Profiles: nulls, duplicates, sentinels, frequencies, histograms and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import bucket_of, ratio
from tidewheel.operators import stats


def null_counts(df: DataFrame) -> DataFrame:
    """column_name, n_null, n_rows for every column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"c_{i}") for i, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c_{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    return one.select("n_rows", F.explode(pairs).alias("p")).select("p.column_name", "p.n_null", "n_rows")


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, extra copies (all but one of each), rows in groups of more than one."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - 1).alias("n_extra"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_in_groups"),
    )


def duplicate_share(df: DataFrame, keys: Sequence[str], by: Column, name: str) -> DataFrame:
    """Per value of by: rows and the share of them that another row repeats."""
    groups = df.groupBy(*keys, by.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    whole = groups.withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    return whole.groupBy(name).agg(F.sum("n").alias("n_rows"), ratio(F.sum(F.when(F.col("all") > 1, F.col("n")).otherwise(0)), F.sum("n")).alias("share"))


def sentinel_counts(df: DataFrame, sentinel: str) -> DataFrame:
    """Rows that hold the sentinel, by string column."""
    names = [c for c, t in df.dtypes if t == "string"]
    one = df.agg(*[F.count_if(F.col(c) == sentinel).alias(c) for c in names])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("column_name", "n_sentinel"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), column).limit(n)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Every bin with its edges and count; values that are not finite are left out and the last edge is closed."""
    v = F.col(column).cast("double")
    rows = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low is not null")
    counts = rows.join(F.broadcast(ends)).groupBy(bucket_of(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select("low", "high", F.explode(F.expr(f"sequence(0L, {bins - 1}L)")).alias("bin"))
    width = (F.col("high") - F.col("low")) / bins
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("low") + F.col("bin") * width).alias("edge_low"), (F.col("low") + (F.col("bin") + 1) * width).alias("edge_high"), F.coalesce("n", F.lit(0)).alias("n")
    )


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, mean, median, deviations by both conventions, population skewness and excess kurtosis, percentiles, ends."""
    c = F.col(column)
    one = df.agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std_pop"),
        F.stddev_samp(c).alias("std_samp"),
        F.skewness(c).alias("skew"),
        F.kurtosis(c).alias("kurtosis"),
        F.min(c).alias("least"),
        F.max(c).alias("most"),
    ).join(F.broadcast(stats.quantiles(df, column, (0.01, 0.25, 0.5, 0.75, 0.99), "cuts")))  # a row each
    named = [F.col("cuts")[i].alias(k) for i, k in enumerate(("p01", "p25", "median", "p75", "p99"))]
    return one.select("n", "mean", "std_pop", "std_samp", "skew", "kurtosis", *named, "least", "most")


def inside_box(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> Column:
    """Whether every bounded column lies within its bounds, ends included."""
    out = F.lit(True)
    for name, (low, high) in bounds.items():
        out = out & F.col(name).between(low, high)
    return out


def segment_profile(df: DataFrame, segment: str, value: str, category: str, flag: Column) -> DataFrame:
    """Per segment: rows, median and mean of value, most frequent category (ties: the first), rate of flag and its lift."""
    base = df.select(segment, value, category, flag.cast("double").alias("flag"))
    modes = base.groupBy(segment, category).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy(segment).orderBy(F.desc("n"), category))
    modes = modes.withColumn("r", first).where("r = 1").select(segment, F.col(category).alias("mode"))
    rates = base.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean_value"), F.avg("flag").alias("rate"), F.sum("flag").alias("hits")
    )
    whole = F.sum("hits").over(W.partitionBy()) / F.sum("n_rows").over(W.partitionBy())
    middle = stats.quantiles(base, value, (0.5,), "q", [segment]).select(segment, F.col("q")[0].alias("median_value"))
    found = rates.withColumn("lift", ratio(F.col("rate"), whole)).drop("hits").join(modes, segment).join(middle, segment, "left")
    return found.select(segment, "n_rows", "median_value", "mean_value", "rate", "lift", "mode")
