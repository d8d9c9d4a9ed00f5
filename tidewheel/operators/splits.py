"""Splits that keep the future, groups and classes apart."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one position bucket; positions are counted in two levels.
BUCKETS = 256


def seeded(column: Column, seed: int) -> Column:
    """A reproducible order of keys, the same in any SQL engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def positions(df: DataFrame, time: str, tie: str) -> DataFrame:
    """Adds pos (from 0 by time and tie) and total; counted by day first, so no task holds all rows."""
    day = F.to_date(F.col(time))
    sums = df.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select("_day", (F.sum("_n").over(W.orderBy("_day")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("total"))
    rows = df.withColumn("_day", day).join(sums, "_day")
    inside = F.row_number().over(W.partitionBy("_day").orderBy(time, tie))
    return rows.withColumn("pos", (F.col("_before") + inside - 1).cast("long")).drop("_day", "_before")


def temporal(df: DataFrame, time: str, tie: str, test: float, embargo: int) -> DataFrame:
    """Adds split by position: train up to the embargo before the cut, test from the cut on. Fewer than two rows give none."""
    rows = positions(df, time, tie)
    cut = F.floor(F.col("total") * (1 - test))
    train = F.greatest(F.lit(1), cut - embargo)
    split = F.when(F.col("pos") >= cut, "test").when(F.col("pos") < train, "train").otherwise("embargo")
    return rows.where("total >= 2").withColumn("split", split)


def dealt(df: DataFrame, key: str, seed: int, label: str | None = None) -> DataFrame:
    """Adds place (from 1, in the seeded order, within the label if there is one) and of (rows of that label).

    The order is that of hexadecimal digests. Rows are counted by the digests'
    first three digits, then placed within those, so no task holds a class.
    """
    rows = df.withColumn("_digest", seeded(F.col(key), seed)).withColumn("_head", F.substring("_digest", 1, 3)).withColumn("_label", F.col(label) if label else F.lit(0))
    sums = rows.groupBy("_label", "_head").agg(F.count(F.lit(1)).alias("_n"))
    of = W.partitionBy("_label")
    sums = sums.select(F.col("_label").alias("_l"), F.col("_head").alias("_h"), (F.sum("_n").over(of.orderBy("_head")) - F.col("_n")).alias("_before"), F.sum("_n").over(of).alias("of"))
    joined = rows.join(sums, rows["_label"].eqNullSafe(sums["_l"]) & (rows["_head"] == sums["_h"]))
    inside = F.row_number().over(W.partitionBy("_label", "_head").orderBy("_digest", key))
    return joined.withColumn("place", F.col("_before") + inside).drop("_digest", "_head", "_label", "_l", "_h", "_before")


def stratified(df: DataFrame, key: str, label: str, test: float, seed: int) -> DataFrame:
    """Adds split: of each class the first share of rows in the seeded order is the test part."""
    rows = dealt(df, key, seed, label)
    return rows.withColumn("split", F.when(F.col("place") <= F.round(F.col("of") * test), "test").otherwise("train")).drop("place", "of")


def folds(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """Adds fold from 0 to k - 1, dealt within each class in the seeded order."""
    return dealt(df, key, seed, label).withColumn("fold", F.pmod(F.col("place") - 1, F.lit(k)).cast("long")).drop("place", "of")


def grouped(df: DataFrame, group: str, test: float, seed: int) -> DataFrame:
    """Adds split; whole groups go to one side."""
    groups = dealt(df.select(group).distinct(), group, seed)
    marked = groups.withColumn("split", F.when(F.col("place") <= F.greatest(F.lit(1), F.round(F.col("of") * test)), "test").otherwise("train"))
    return df.join(marked.drop("place", "of"), group)


def walk_forward(df: DataFrame, time: str, tie: str, n_folds: int, embargo: int, trim: str = "train") -> DataFrame:
    """Rows by fold with their split; fold f tests block f + 1 of n_folds + 1 equal blocks.

    trim tells whose rows the embargo takes. "train": the tail of train, which
    keeps one row at least; rows beyond equal blocks belong to the first train
    part. "test": the head of test; rows beyond equal blocks belong to no fold,
    and a fold that the embargo leaves without test rows is left out whole.
    Fewer rows than blocks give no folds.
    """
    rows = positions(df, time, tie)
    block = F.floor(F.col("total") / (n_folds + 1))
    rows = rows.withColumn("block", block).where("block > 0").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    if trim == "train":
        start = F.col("total") - (n_folds - F.col("fold")) * F.col("block")
        keep_to, test_from = F.greatest(F.lit(1), start - embargo), start
    else:
        start = (F.col("fold") + 1) * F.col("block")
        keep_to, test_from = F.when(F.lit(embargo) < F.col("block"), start), start + embargo
    stop = start + F.col("block")
    split = F.when(F.col("pos") < keep_to, "train").when((F.col("pos") >= test_from) & (F.col("pos") < stop), "test")
    return rows.withColumn("split", split).where("split is not null").drop("block")


def rolling_origins(n: int, origins: int, horizon: int, period: int) -> list[int]:
    """Lengths of the training part: up to so many origins, one horizon apart, the last leaving one horizon."""
    start = max(3 * period, n - origins * horizon)
    found = list(range(start, n - horizon + 1, horizon))
    return found or [n - horizon]


def report(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def require_pipeline(model: object) -> Pipeline:
    """Only a Pipeline may be cross-validated, so that its preparation is fitted within folds."""
    if not isinstance(model, Pipeline):
        raise TypeError("wrap preparation and model in one pyspark.ml.Pipeline")
    return model
