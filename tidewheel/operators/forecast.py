"""Baseline forecasts of a short regular series, scored from rolling origins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def monthly(df: DataFrame, time: str, value: str) -> DataFrame:
    """pos, month, value: monthly sums in order."""
    rows = df.groupBy(F.trunc(F.to_date(time), "MONTH").alias("month")).agg(F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("value"))
    return rows.withColumn("pos", (F.row_number().over(W.orderBy("month")) - 1).cast("long"))


def baselines(series: DataFrame, origins: Sequence[int], horizon: int, period: int) -> DataFrame:
    """origin, step, model, forecast, actual of the naive, seasonal-naive and drift forecasts."""
    at = F.explode(F.array(*map(F.lit, origins))).alias("origin")
    grid = series.select(F.col("pos"), F.col("value").alias("actual"), at).where((F.col("pos") >= F.col("origin")) & (F.col("pos") < F.col("origin") + horizon))
    grid = grid.withColumn("step", F.col("pos") - F.col("origin") + 1)

    def look(place: Column, name: str) -> DataFrame:
        keys = grid.select("origin", "step", place.cast("long").alias("pos"))
        return keys.join(series.select("pos", F.col("value").alias(name)), "pos", "left").drop("pos")

    last = look(F.col("origin") - 1, "last")
    season = look(F.col("origin") - period + F.pmod(F.col("step") - 1, F.lit(period)), "season")
    first = series.where("pos = 0").select(F.col("value").alias("first"))
    rows = grid.join(last, ["origin", "step"]).join(season, ["origin", "step"]).join(F.broadcast(first))
    drift = F.col("last") + (F.col("last") - F.col("first")) / (F.col("origin") - 1) * F.col("step")
    models = [("naive", F.col("last")), ("seasonal_naive", F.coalesce("season", "last")), ("drift", drift)]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), c.alias("forecast")) for m, c in models])).alias("m")
    return rows.select(F.col("origin").cast("long").alias("origin"), F.col("step").cast("long").alias("step"), each, "actual").select("origin", "step", "m.model", "m.forecast", "actual")


def mase(forecasts: DataFrame, series: DataFrame, period: int) -> DataFrame:
    """Per origin and model: mean error over the training part's seasonal-naive error; null where that is zero.

    A training part of one period or less is scaled by its naive error instead.
    """

    def gap(back: int) -> Column:
        return F.abs(F.col("value") - F.lag("value", back).over(W.orderBy("pos")))

    gaps = series.select("pos", gap(period).alias("season_gap"), gap(1).alias("step_gap"))
    origins = forecasts.select("origin").distinct()
    scale = origins.join(gaps, F.col("pos") < F.col("origin")).groupBy("origin").agg(F.avg(F.when(F.col("origin") <= period, F.col("step_gap")).otherwise(F.col("season_gap"))).alias("scale"))
    errors = forecasts.groupBy("origin", "model").agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"))
    return errors.join(scale, "origin").select("origin", "model", "mae", (F.col("mae") / F.nullif("scale", F.lit(0.0))).alias("mase"))


def summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(
        F.avg("mase").alias("mean_mase"), F.stddev_pop("mase").alias("std_mase"), F.max("mase").alias("worst_mase"), F.count(F.lit(1)).alias("n_origins")
    )


def rank_synthesis(scores: DataFrame) -> DataFrame:
    """Over origins: each model's mean, best and worst rank, and how often it is first."""
    ranked = scores.withColumn("rank", F.rank().over(W.partitionBy("origin").orderBy(F.round("mase", 9))))
    return ranked.groupBy("model").agg(
        F.avg("rank").alias("mean_rank"), F.min("rank").cast("long").alias("best_rank"), F.max("rank").cast("long").alias("worst_rank"), F.count_if(F.col("rank") == 1).alias("wins")
    )


def smoothed(series: DataFrame, key: str, time: str, value: str, period: int, horizon: int) -> DataFrame:
    """Additive Holt-Winters by key; series shorter than two periods repeat their last period.

    A series is one entity's history and is fitted in one task; entities are
    spread over tasks. Smoothing weights come from a small grid by squared error.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(time)[value].to_numpy(dtype=float)
        n = len(y)
        if n < 2 * period:
            future = np.array([y[n - min(period, n) + h % min(period, n)] for h in range(horizon)]) if n else np.full(horizon, np.nan)
        else:
            future = min((_holt_winters(y, period, horizon, a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.01, 0.1) for g in (0.05, 0.3)), key=lambda r: r[0])[1]
        return pd.DataFrame({key: pdf[key].iloc[0], "step": np.arange(1, horizon + 1), "forecast": future})

    kind = dict(series.dtypes)[key]
    return series.groupBy(key).applyInPandas(fit, f"{key} {kind}, step long, forecast double")


def _holt_winters(y: np.ndarray, period: int, horizon: int, a: float, b: float, g: float) -> tuple[float, np.ndarray]:
    level, trend = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period
    season, error = list(y[:period] - level), 0.0
    for t in range(period, len(y)):
        s = season[t % period]
        error += (y[t] - level - trend - s) ** 2
        new = a * (y[t] - s) + (1 - a) * (level + trend)
        trend, season[t % period], level = b * (new - level) + (1 - b) * trend, g * (y[t] - new) + (1 - g) * s, new
    return error, np.array([level + h * trend + season[(len(y) + h - 1) % period] for h in range(1, horizon + 1)])
