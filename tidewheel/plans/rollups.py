"""Small roll-ups: rates, totals, gaps, shares, matches, and splits by place."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import ratio
from tidewheel.operators import evaluation, fairness, forecast, stats
from tidewheel.plans import markets, panels
from tidewheel.plans.common import SCORED, scored, tidy
from tidewheel.plans.evaluations import LEAST_GROUP
from tidewheel.sources.tables import table

THRESHOLDS = (0.2, 0.5, 0.8)
TABLES = ("customer", "documents", "events", "lineitem", "orders")


def rate_by_hour(spark, sf_dir):
    """Events, errors and their share by hour of the day."""
    rows = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour"))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return tidy(one.withColumn("rate", ratio(F.col("errors"), F.col("n"))))


def base_rate_gap(spark, sf_dir):
    """How far the groups' base rates lie apart."""
    groups = fairness.by_group(scored(spark, sf_dir), "lang", "toxic", "score", 0.5, LEAST_GROUP).where("eligible")
    return tidy(groups.agg(F.min("base_rate").alias("least"), F.max("base_rate").alias("most"), (F.max("base_rate") - F.min("base_rate")).alias("gap"), F.count(F.lit(1)).alias("n_groups")))


def basket_totals(spark, sf_dir):
    """Lines, baskets, mean basket and baskets a day."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_baskets"))
    days = table(spark, sf_dir, "orders").agg(F.countDistinct(F.to_date("o_orderdate")).alias("n_days"), F.count(F.lit(1)).alias("n_orders"))
    rows = lines.join(F.broadcast(days))
    return tidy(rows.select("n_lines", "n_baskets", ratio(F.col("n_lines"), F.col("n_baskets")).alias("mean_basket"), "n_days", ratio(F.col("n_orders"), F.col("n_days")).alias("orders_per_day")))


def fixed_thresholds(spark, sf_dir):
    """Cells and rates at given thresholds."""
    rows = scored(spark, sf_dir).select("toxic", "score", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"))
    return tidy(evaluation.rates(rows.groupBy("threshold").agg(*evaluation.cells(F.col("toxic"), F.col("score") >= F.col("threshold")))))


def late_calibration(spark, sf_dir):
    """Bands calibrated on the last 15 per cent of the training hours only."""
    rows = panels._split(spark, sf_dir)
    hours = rows.where("split = 'train'").select("hour_ts").distinct()
    place = F.row_number().over(W.orderBy("hour_ts")) - 1
    late = hours.withColumn("place", place).withColumn("of", F.count(F.lit(1)).over(W.partitionBy())).where(F.col("place") >= F.floor(F.col("of") * 0.85)).select("hour_ts")
    calibration = rows.where("split = 'train'").join(F.broadcast(late), "hour_ts")  # hours of some years
    return tidy(evaluation.conformal(calibration, rows.where("split = 'test'"), "n", "mean_168", (0.8, 0.9, 0.95)))


def error_by_zone(spark, sf_dir):
    rows = panels._split(spark, sf_dir).where("split = 'test'").groupBy("zone")
    return tidy(rows.agg(F.avg(F.abs(F.col("n") - F.col("lag_168"))).alias("mean_error"), F.avg("n").alias("mean_n"), F.count(F.lit(1)).alias("n_rows")))


def leaderboard_match(spark, sf_dir):
    """The models' ranks over all origins, beside those of the models that lead on late ones; null where one does not."""
    series, found = markets._forecasts(spark, sf_dir)
    scores = forecast.mase(found, series, markets.PERIOD)
    late = scores.join(F.broadcast(scores.agg(F.max("origin").alias("last"))), F.col("origin") == F.col("last")).where("model != 'drift'")
    left, right = scores.groupBy("model").agg(F.avg("mase").alias("mase")), late.groupBy("model").agg(F.avg("mase").alias("late_mase"))
    return tidy(left.join(right, "model", "left").withColumn("gain", F.col("mase") - F.col("late_mase")))


def dominance_share(spark, sf_dir):
    """How much of all orders' worth the largest status holds, and how often the smallest goes into it."""
    worth = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    return tidy(worth.agg(F.max_by("o_orderstatus", "v").alias("largest"), (F.max("v") / F.sum("v")).alias("share"), (F.max("v") / F.min("v")).alias("times"), F.count(F.lit(1)).alias("n")))


def top_effects(spark, sf_dir):
    """Features by the size of their effect on the outcome, whatever its sign."""
    found = stats.cohens_d(scored(spark, sf_dir), "toxic", ["quality", "n_chars", "score"])
    return tidy(found.orderBy(F.desc(F.round(F.abs("d"), 9)), "feature").limit(2).select("feature", "d"), 5)


def contiguous_split(spark, sf_dir):
    """Documents in order of their ids: those that begin within the first nine tenths of all characters train."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    placed = stats.running_total(rows, "doc_id", "n_chars", "upto").withColumn("start", F.col("upto") - F.col("n_chars"))
    total = F.broadcast(rows.agg(F.sum("n_chars").alias("total")))
    return placed.join(total).select("doc_id", "start", F.when(F.col("start") * 10 < F.col("total") * 9, "train").otherwise("test").alias("split"))


def repeated_rows(spark, sf_dir):
    """Rows of which no copy would be kept, and rows that a first copy would leave out, by kind of event."""
    groups = table(spark, sf_dir, "events").groupBy("event_type", "user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    one = groups.groupBy("event_type").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("none_kept"), F.sum(F.col("n") - 1).alias("first_kept"))
    return one


def provenance(spark, sf_dir):
    """A line on each source: its name, rows and columns."""
    out = None
    for name in TABLES:
        rows = table(spark, sf_dir, name)
        one = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(rows.columns)).cast("long").alias("n_columns"))
        out = one if out is None else out.union(one)
    return out.withColumn("line", F.format_string("| %s | %d rows | %d columns |", "name", "n_rows", "n_columns"))


NAMES = "rate_by_hour base_rate_gap basket_totals fixed_thresholds late_calibration error_by_zone leaderboard_match dominance_share top_effects contiguous_split repeated_rows provenance".split()
QUERIES = {n: globals()[n] for n in NAMES}

CELLS = ", ".join(f"count(*) FILTER (toxic = {y} AND score {s} threshold) AS {n}" for n, y, s in (("tp", 1, ">="), ("fp", 0, ">="), ("fn", 1, "<"), ("tn", 0, "<")))
RATES = {
    "base_rate": ("tp + fn", "n"), "selection_rate": ("tp + fp", "n"), "fpr": ("fp", "fp + tn"), "fnr": ("fn", "fn + tp"), "tpr": ("tp", "fn + tp"), "tnr": ("tn", "fp + tn"),
    "ppv": ("tp", "tp + fp"), "npv": ("tn", "tn + fn"), "accuracy": ("tp + tn", "n"),
}
EFFECT = "SELECT '{c}' AS feature, avg({c}) FILTER (toxic = 1) - avg({c}) FILTER (toxic = 0) AS m, var_samp({c}) FILTER (toxic = 1) AS v1, var_samp({c}) FILTER (toxic = 0) AS v0, count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0 FROM s"
ORACLES = {
    "rate_by_hour": "SELECT hour(ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1",
    "base_rate_gap": f"SELECT round(min(b), 6) AS least, round(max(b), 6) AS most, round(max(b) - min(b), 6) AS gap, count(*) AS n_groups FROM (SELECT avg(toxic) AS b FROM ({SCORED}) GROUP BY lang HAVING count(*) >= {LEAST_GROUP})",
    "basket_totals": """SELECT n_lines, n_baskets, round(n_lines / n_baskets, 6) AS mean_basket, n_days, round(n_orders / n_days, 6) AS orders_per_day
FROM (SELECT count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_baskets FROM lineitem), (SELECT count(DISTINCT o_orderdate::DATE) AS n_days, count(*) AS n_orders FROM orders)""",
    "fixed_thresholds": f"""SELECT threshold, tp, fp, fn, tn, n, {", ".join(f"round(({a}) / nullif({b}, 0), 6) AS {k}" for k, (a, b) in RATES.items())}
FROM (SELECT threshold, {CELLS}, count(*) AS n FROM ({SCORED}), (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS threshold) GROUP BY 1)""",
    "late_calibration": panels.ORACLES["interval_coverage"]
    .replace("WITH s AS (", "WITH s AS MATERIALIZED (", 1)
    .replace(", l AS (", ", o AS (SELECT hour_ts, row_number() OVER (ORDER BY hour_ts) - 1 AS place, count(*) OVER () AS n_hours FROM (SELECT DISTINCT hour_ts FROM s WHERE split = 'train')), l AS (", 1)
    .replace("FROM s WHERE split = 'train')[", "FROM s WHERE split = 'train' AND hour_ts IN (SELECT hour_ts FROM o WHERE place >= floor(n_hours * 0.85::DOUBLE)))[", 1),
    "error_by_zone": panels.ORACLES["error_by_hour"].replace("hour(hour_ts) AS hour", "zone"),
    "leaderboard_match": markets.MASE
    + """ SELECT model, round(avg(mase), 6) AS mase, round(avg(mase) FILTER (origin = last AND model <> 'drift'), 6) AS late_mase, round(avg(mase) - avg(mase) FILTER (origin = last AND model <> 'drift'), 6) AS gain
FROM s, (SELECT max(origin) AS last FROM s) GROUP BY 1""",
    "dominance_share": "SELECT arg_max(o_orderstatus, v) AS largest, round(max(v) / sum(v), 6) AS share, round(max(v) / min(v), 6) AS times, count(*) AS n FROM (SELECT o_orderstatus, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS v FROM orders GROUP BY 1)",
    "top_effects": f"""WITH s AS ({SCORED}), f AS ({" UNION ALL ".join(EFFECT.format(c=c) for c in ("quality", "n_chars", "score"))}), d AS (SELECT feature, m / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / nullif(n1 + n0 - 2, 0)), 0) AS d FROM f)
SELECT feature, round(d, 5) AS d FROM d ORDER BY round(abs(d), 9) DESC, feature LIMIT 2""",
    "contiguous_split": "SELECT doc_id, start::BIGINT AS start, CASE WHEN start * 10 < total * 9 THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS start, sum(n_chars) OVER () AS total FROM documents)",
    "repeated_rows": """SELECT event_type, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS none_kept, sum(n - 1)::BIGINT AS first_kept
FROM (SELECT event_type, user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""",
    "provenance": "SELECT *, '| ' || name || ' | ' || n_rows || ' rows | ' || n_columns || ' columns |' AS line FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns" for t in TABLES)
    + ")",
}
