"""Dense panels of entities by hour, with lags and frames that look backward only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import cyclic


def counts_by_hour(events: DataFrame, entity: str, time: str) -> DataFrame:
    return events.groupBy(F.col(entity).alias("zone"), F.date_trunc("HOUR", F.col(time)).cast("timestamp_ntz").alias("hour_ts")).agg(F.count(F.lit(1)).alias("n"))


def dense(counts: DataFrame) -> DataFrame:
    """Every zone at every hour between the first and the last; hours without events count zero.

    The hours come as one array to every zone, so no pair of large tables is crossed.
    """
    ends = counts.agg(F.min("hour_ts").alias("low"), F.max("hour_ts").alias("high"))
    hours = ends.select(F.sequence("low", "high", F.expr("interval 1 hour")).alias("hours"))
    grid = counts.select("zone").distinct().join(F.broadcast(hours)).select("zone", F.explode("hours").alias("hour_ts"))
    return grid.join(counts, ["zone", "hour_ts"], "left").select("zone", "hour_ts", F.coalesce("n", F.lit(0)).alias("n"))


def by_zone() -> W:
    return W.partitionBy("zone").orderBy("hour_ts")


def lags(panel: DataFrame, steps: Sequence[int]) -> DataFrame:
    return panel.withColumns({f"lag_{k}": F.lag("n", k).over(by_zone()) for k in steps})


def back_means(panel: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Means of up to w rows before the current one; null where there is none."""
    return panel.withColumns({f"mean_{w}": F.avg("n").over(by_zone().rowsBetween(-w, -1)) for w in widths})


def back_deviations(panel: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Sample deviations of up to w rows before the current one; null where there are fewer than two."""
    out = {}
    for w in widths:
        frame = by_zone().rowsBetween(-w, -1)
        out[f"std_{w}"] = F.when(F.count("n").over(frame) >= 2, F.stddev_samp("n").over(frame))
    return panel.withColumns(out)


def calendar(time: Column) -> dict[str, Column]:
    """Hour, weekday (Monday is 0), month, day, weekend, hour of week, and cyclic codes of the first two."""
    hour, day = F.hour(time), F.weekday(time)
    hour_sin, hour_cos = cyclic(hour, 24)
    day_sin, day_cos = cyclic(day, 7)
    return {
        "hour": hour.cast("long"),
        "dow": day.cast("long"),
        "month": F.month(time).cast("long"),
        "day": F.dayofmonth(time).cast("long"),
        "is_weekend": day.isin(5, 6).cast("long"),
        "hour_of_week": (day * 24 + hour).cast("long"),
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "dow_sin": day_sin,
        "dow_cos": day_cos,
    }


def features(events: DataFrame, entity: str, time: str) -> DataFrame:
    """The dense panel with lags, backward frames and calendar; one partitioning serves all windows."""
    panel = dense(counts_by_hour(events, entity, time))
    panel = back_deviations(back_means(lags(panel, (1, 2, 3, 24, 168)), (3, 24, 168)), (24, 168))
    return panel.withColumns(calendar(F.col("hour_ts")))


def temporal_split(panel: DataFrame, days: int, embargo_hours: int) -> DataFrame:
    """Adds split: test for the last days, embargo for the hours before them, else train."""
    last = panel.agg(F.max("hour_ts").alias("last"))
    cut = F.col("last") - F.expr(f"interval {days} days")
    gap = cut - F.expr(f"interval {embargo_hours} hours")
    split = F.when(F.col("hour_ts") > cut, "test").when(F.col("hour_ts") > gap, "embargo").otherwise("train")
    return panel.join(F.broadcast(last)).withColumn("split", split).drop("last")


def autocorrelation(series: DataFrame, time: str, value: str, most: int) -> DataFrame:
    """Autocorrelation of a regular series at lags 1..most, by the biased estimate.

    series is an aggregate with one row per time, so its window over all rows is small.
    """
    order = W.orderBy(time)
    mean = F.avg(value).over(W.partitionBy())
    rows = series.select((F.col(value) - mean).alias("c"), F.row_number().over(order).alias("i"))
    pairs = rows.select("c", "i", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    later = rows.select(F.col("c").alias("d"), F.col("i").alias("j"))
    total = rows.agg(F.sum(F.col("c") * F.col("c")).alias("total"))
    sums = pairs.join(later, "j").groupBy("lag").agg(F.sum(F.col("c") * F.col("d")).alias("s"))
    return sums.join(F.broadcast(total)).select(F.col("lag").cast("long").alias("lag"), (F.col("s") / F.nullif("total", F.lit(0.0))).alias("acf"))
