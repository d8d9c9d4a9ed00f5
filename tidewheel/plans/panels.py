"""Queries over the hourly panel of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import evaluation, panel
from tidewheel.plans.common import tidy
from tidewheel.sources.tables import table


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.dense(panel.counts_by_hour(table(spark, sf_dir, "events"), "event_type", "ts"))


def panel_counts(spark, sf_dir):
    return panel.counts_by_hour(table(spark, sf_dir, "events"), "event_type", "ts")


def panel_dense(spark, sf_dir):
    return _dense(spark, sf_dir)


def panel_lags(spark, sf_dir):
    return panel.lags(_dense(spark, sf_dir), (1, 2, 3, 24, 168))


def panel_backward_mean(spark, sf_dir):
    return tidy(panel.back_means(_dense(spark, sf_dir), (3, 24, 168)))


def panel_backward_std(spark, sf_dir):
    return tidy(panel.back_deviations(_dense(spark, sf_dir), (24, 168)))


def panel_features(spark, sf_dir):
    """Rows whose widest lag is known."""
    return tidy(panel.features(table(spark, sf_dir, "events"), "event_type", "ts").where("lag_168 is not null"))


def calendar_cyclic(spark, sf_dir):
    hours = table(spark, sf_dir, "events").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour_ts")).distinct()
    return tidy(hours.withColumns(panel.calendar(F.col("hour_ts"))))


def heatmap_dow_hour(spark, sf_dir):
    rows = _dense(spark, sf_dir).groupBy(F.weekday("hour_ts").alias("dow"), F.hour("hour_ts").alias("hour"))
    return tidy(rows.agg(F.avg("n").alias("mean_n"), F.sum("n").alias("total")))


def daily_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def acf_hourly(spark, sf_dir):
    city = _dense(spark, sf_dir).groupBy("hour_ts").agg(F.sum("n").alias("n"))
    return tidy(panel.autocorrelation(city, "hour_ts", "n", 180))


def _split(spark, sf_dir):
    rows = panel.back_means(panel.lags(_dense(spark, sf_dir), (168,)), (168,)).where("lag_168 is not null")
    return panel.temporal_split(rows, days=7, embargo_hours=168)


def seasonal_naive_skill(spark, sf_dir):
    test = _split(spark, sf_dir).where("split = 'test'")
    return tidy(evaluation.regression_report(test, "n", "mean_168", "lag_168"))


def panel_split_report(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("hour_ts").alias("first_hour"), F.max("hour_ts").alias("last_hour"))


def interval_coverage(spark, sf_dir):
    rows = _split(spark, sf_dir)
    return tidy(evaluation.conformal(rows.where("split = 'train'"), rows.where("split = 'test'"), "n", "mean_168", (0.8, 0.9, 0.95)))


def hour_of_week_surrogate(spark, sf_dir):
    """The lookup table of ratios of a zone's hour of the week to its mean, and how well it follows the backward mean."""
    rows = _split(spark, sf_dir).withColumn("how", (F.weekday("hour_ts") * 24 + F.hour("hour_ts")).cast("long"))
    train = rows.where("split != 'test'")
    base = train.groupBy("zone").agg(F.avg("n").alias("base"))
    profile = train.groupBy("zone", "how").agg(F.avg("n").alias("m")).join(base, "zone").select("zone", "how", (F.col("m") / F.nullif("base", F.lit(0.0))).alias("factor"))
    used = rows.where("split = 'test'").join(profile, ["zone", "how"], "left").join(base, "zone")
    used = used.withColumn("prediction", F.coalesce("factor", F.lit(1.0)) * F.col("base"))
    return tidy(evaluation.regression_report(used, "n", "prediction", "lag_168"))


def error_by_hour(spark, sf_dir):
    test = _split(spark, sf_dir).where("split = 'test'")
    gap = F.abs(F.col("n") - F.col("lag_168"))
    return tidy(test.groupBy(F.hour("hour_ts").alias("hour")).agg(F.avg(gap).alias("mean_error"), F.avg("n").alias("mean_n"), F.count(F.lit(1)).alias("n_rows")))


NAMES = (
    "panel_counts panel_dense panel_lags panel_backward_mean panel_backward_std panel_features calendar_cyclic heatmap_dow_hour daily_totals acf_hourly "
    "seasonal_naive_skill panel_split_report interval_coverage hour_of_week_surrogate error_by_hour"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

COUNTS = "SELECT event_type AS zone, date_trunc('hour', ts)::TIMESTAMP AS hour_ts, count(*) AS n FROM events GROUP BY ALL"
DENSE = f"""WITH c AS ({COUNTS}), h AS (SELECT unnest(generate_series(min(hour_ts), max(hour_ts), INTERVAL 1 HOUR)) AS hour_ts FROM c), z AS (SELECT DISTINCT zone FROM c)
SELECT z.zone, h.hour_ts, coalesce(c.n, 0) AS n FROM z CROSS JOIN h LEFT JOIN c USING (zone, hour_ts)"""
LAGS = ", ".join(f"lag(n, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 24, 168))
PART = "PARTITION BY zone ORDER BY hour_ts"


def _mean(w):
    return f"round(avg(n) OVER ({PART} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) AS mean_{w}"


def _std(w):
    return f"round(stddev_samp(n) OVER ({PART} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) AS std_{w}"


MEANS, STDS = ", ".join(map(_mean, (3, 24, 168))), ", ".join(map(_std, (24, 168)))
HOW = "((isodow(hour_ts) - 1) * 24 + hour(hour_ts))"
CALENDAR = f"""hour(hour_ts) AS hour, isodow(hour_ts) - 1 AS dow, month(hour_ts) AS month, day(hour_ts) AS day, (isodow(hour_ts) >= 6)::BIGINT AS is_weekend, {HOW} AS hour_of_week,
round(sin(2 * pi() * hour(hour_ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(hour_ts) / 24), 6) + 0.0 AS hour_cos,
round(sin(2 * pi() * (isodow(hour_ts) - 1) / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(hour_ts) - 1) / 7), 6) + 0.0 AS dow_cos"""
SPLIT = f"""SELECT *, CASE WHEN hour_ts > last - INTERVAL 7 DAY THEN 'test' WHEN hour_ts > last - INTERVAL 7 DAY - INTERVAL 168 HOUR THEN 'embargo' ELSE 'train' END AS split
FROM (SELECT *, max(hour_ts) OVER () AS last FROM (SELECT *, lag(n, 168) OVER ({PART}) AS lag_168, avg(n) OVER ({PART} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS mean_168 FROM ({DENSE})) WHERE lag_168 IS NOT NULL)"""


def _report(rows: str, p: str, b: str) -> str:
    return f"""SELECT count(*) AS n, round(avg(abs(n - {p})), 6) AS mae, round(sqrt(avg((n - {p}) * (n - {p}))), 6) AS rmse,
round(1 - sum((n - {p}) * (n - {p})) / nullif(var_pop(n) * count(n), 0), 6) AS r2,
round(CASE WHEN avg((abs(n) < 1e-9)::INT) <= 0.05 THEN avg(CASE WHEN abs(n) >= 1e-9 THEN abs((n - {p}) / n) END) END, 6) AS mape,
round(avg(abs(n - {b})), 6) AS baseline_mae, round(sqrt(avg((n - {b}) * (n - {b}))), 6) AS baseline_rmse, round(1 - avg(abs(n - {p})) / nullif(avg(abs(n - {b})), 0), 6) AS skill FROM ({rows})"""


ORACLES = {
    "panel_counts": COUNTS,
    "panel_dense": DENSE,
    "panel_lags": f"SELECT *, {LAGS} FROM ({DENSE}) WINDOW w AS ({PART})",
    "panel_backward_mean": f"SELECT *, {MEANS} FROM ({DENSE})",
    "panel_backward_std": f"SELECT *, {STDS} FROM ({DENSE})",
    "panel_features": f"SELECT * FROM (SELECT *, {LAGS}, {MEANS}, {STDS}, {CALENDAR} FROM ({DENSE}) WINDOW w AS ({PART})) WHERE lag_168 IS NOT NULL",
    "calendar_cyclic": f"SELECT hour_ts, {CALENDAR} FROM (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS hour_ts FROM events)",
    "heatmap_dow_hour": f"SELECT isodow(hour_ts) - 1 AS dow, hour(hour_ts) AS hour, round(avg(n), 6) AS mean_n, sum(n)::BIGINT AS total FROM ({DENSE}) GROUP BY ALL",
    "daily_totals": "SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "acf_hourly": f"""WITH s AS (SELECT row_number() OVER (ORDER BY hour_ts) AS i, n - avg(n) OVER () AS c FROM (SELECT hour_ts, sum(n) AS n FROM ({DENSE}) GROUP BY 1)), t AS (SELECT sum(c * c) AS t FROM s)
SELECT b.i - a.i AS lag, round(sum(a.c * b.c) / (SELECT t FROM t), 6) AS acf FROM s a JOIN s b ON b.i - a.i BETWEEN 1 AND 180 GROUP BY 1""",
    "seasonal_naive_skill": _report(f"SELECT * FROM ({SPLIT}) WHERE split = 'test'", "mean_168", "lag_168"),
    "panel_split_report": f"SELECT split, count(*) AS n_rows, min(hour_ts) AS first_hour, max(hour_ts) AS last_hour FROM ({SPLIT}) GROUP BY 1",
    "interval_coverage": f"""WITH s AS ({SPLIT}), l AS (SELECT unnest([0.8, 0.9, 0.95]::DOUBLE[]) AS level), h AS (SELECT level, (SELECT quantile_cont(abs(n - mean_168), [0.8, 0.9, 0.95]) FROM s WHERE split = 'train')[CASE level WHEN 0.8 THEN 1 WHEN 0.9 THEN 2 ELSE 3 END] AS half FROM l),
r AS (SELECT level, half, avg((n BETWEEN greatest(mean_168 - half, 0) AND mean_168 + half)::INT) AS coverage, avg(mean_168 + half - greatest(mean_168 - half, 0)) AS mean_width FROM s CROSS JOIN h WHERE split = 'test' GROUP BY 1, 2)
SELECT level, round(half, 6) AS half, round(coverage, 6) AS coverage, round(coverage - level, 6) AS gap, round(mean_width, 6) AS mean_width, abs(coverage - level) <= 0.05 AS calibrated FROM r""",
    "hour_of_week_surrogate": _report(
        f"""WITH s AS (SELECT *, {HOW} AS how FROM ({SPLIT})), b AS (SELECT zone, avg(n) AS base FROM s WHERE split <> 'test' GROUP BY 1), f AS (SELECT zone, how, avg(n) AS m FROM s WHERE split <> 'test' GROUP BY 1, 2)
SELECT s.*, coalesce(f.m / nullif(b.base, 0), 1) * b.base AS prediction FROM s JOIN b USING (zone) LEFT JOIN f USING (zone, how) WHERE split = 'test'""",
        "prediction",
        "lag_168",
    ),
    "error_by_hour": f"SELECT hour(hour_ts) AS hour, round(avg(abs(n - lag_168)), 6) AS mean_error, round(avg(n), 6) AS mean_n, count(*) AS n_rows FROM ({SPLIT}) WHERE split = 'test' GROUP BY 1",
}
