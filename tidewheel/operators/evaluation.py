"""Evaluation of scores, thresholds, predictions and intervals.

Rows are aggregated by distinct score first. Running totals over scores are
taken in two levels, within buckets of the score range and over buckets, so
that no task holds all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import ratio
from tidewheel.operators import stats

BUCKETS = 1024


def by_score(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """score, pos, neg for each distinct score, with the totals p and q and running totals tp and fp from the highest down; all of these within the values of by, which are not null."""
    rows = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(y)).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))
    rows = rows.withColumn("bucket", F.floor(F.col("score") * BUCKETS))
    sums = rows.groupBy(*by, "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    every = W.partitionBy(*by)
    above = every.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        *by,
        "bucket",
        F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"),
        F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"),
        F.sum("bp").over(every).alias("p"),
        F.sum("bn").over(every).alias("q"),
    )
    inside = W.partitionBy(*by, "bucket").orderBy(F.desc("score"))
    joined = rows.join(sums, [*by, "bucket"])
    return joined.select(
        *by,
        "score",
        "pos",
        "neg",
        "p",
        "q",
        (F.col("ap") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("an") + F.sum("neg").over(inside)).alias("fp"),
    )


def average_precision(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """average_precision, prevalence, lift over it; a row for each of the values of by, if given."""
    rows = by_score(df, y, score, by)
    step = F.col("pos") / F.nullif(F.col("p"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))
    one = rows.groupBy(*by).agg(F.sum(step).alias("average_precision"), F.max(ratio(F.col("p"), F.col("p") + F.col("q"))).alias("prevalence"))
    return one.withColumn("lift", F.col("average_precision") / F.nullif(F.col("prevalence"), F.lit(0.0)))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Share of pairs of either class that the score orders; ties count one half."""
    rows = by_score(df, y, score)
    won = F.col("pos") * (F.col("q") - F.col("fp") + F.col("neg") / 2)
    return rows.agg(ratio(F.sum(won), F.max("p") * F.max("q")).alias("roc_auc"), F.max("p").alias("n_pos"), F.max("q").alias("n_neg"))


def cells(y: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if((y == 1) & predicted).alias("tp"),
        F.count_if((y == 0) & predicted).alias("fp"),
        F.count_if((y == 1) & ~predicted).alias("fn"),
        F.count_if((y == 0) & ~predicted).alias("tn"),
    ]


def rates(counts: DataFrame) -> DataFrame:
    """Adds the rates that tp, fp, fn and tn give; null where a denominator is zero."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return counts.withColumns(
        {
            "n": n,
            "base_rate": ratio(tp + fn, n),
            "selection_rate": ratio(tp + fp, n),
            "fpr": ratio(fp, fp + tn),
            "fnr": ratio(fn, fn + tp),
            "tpr": ratio(tp, fn + tp),
            "tnr": ratio(tn, fp + tn),
            "ppv": ratio(tp, tp + fp),
            "npv": ratio(tn, tn + fn),
            "accuracy": ratio(tp + tn, n),
        }
    )


def brier_and_f1(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    """Brier score; precision, recall and F1 at a threshold (zero where undefined); accuracy beside that of never."""
    one = df.agg(F.avg((F.col(score) - F.col(y)) ** 2).alias("brier"), *cells(F.col(y), F.col(score) >= threshold))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return one.withColumns(
        {
            "precision": F.coalesce(ratio(tp, tp + fp), zero),
            "recall": F.coalesce(ratio(tp, tp + fn), zero),
            "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "never_accuracy": ratio(fp + tn, tp + fp + fn + tn),
        }
    )


def best_f1(df: DataFrame, y: str, score: str) -> DataFrame:
    """The score at which alerting gives the best F1 (ties: the highest score)."""
    rows = by_score(df, y, score)
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))
    best = F.max(F.struct(f1.alias("f1"), "score", "tp", "fp"))
    return rows.agg(best.alias("b")).select("b.f1", F.col("b.score").alias("threshold"), "b.tp", "b.fp")


def cost_curve(df: DataFrame, y: str, score: str, cost_fn: float, cost_fp: float, points: int) -> DataFrame:
    """Cells, alerts and cost at evenly spaced thresholds from 0 to 1.

    Each row counts once, at the highest threshold that it reaches; running
    totals over the thresholds give the cells.
    """
    place = F.greatest(F.lit(-1), F.least(F.lit(points - 1), F.floor(F.col(score) * (points - 1) + 1e-9)))
    counts = df.groupBy(place.alias("i")).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    grid = df.sparkSession.range(-1, points).withColumnRenamed("id", "i")
    from_here = W.orderBy("i").rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    rows = grid.join(counts, "i", "left").na.fill(0, ["pos", "neg"])
    rows = rows.select(
        "i",
        F.sum("pos").over(from_here).cast("long").alias("tp"),
        F.sum("neg").over(from_here).cast("long").alias("fp"),
        F.sum("pos").over(every).cast("long").alias("p"),
        F.sum("neg").over(every).cast("long").alias("q"),
    ).where("i >= 0")
    fn, tn = F.col("p") - F.col("tp"), F.col("q") - F.col("fp")
    return rows.select(
        (F.col("i") / (points - 1)).alias("threshold"),
        "tp",
        "fp",
        fn.alias("fn"),
        tn.alias("tn"),
        (fn * cost_fn + F.col("fp") * cost_fp).alias("expected_cost"),
        (F.col("tp") + F.col("fp")).alias("alerts"),
    )


def alert_budgets(df: DataFrame, y: str, score: str, budgets: Sequence[int]) -> DataFrame:
    """For each number of alerts that can be handled: the score's quantile that leaves so many, what it catches, recall and precision.

    The quantile of 1 - budget / rows lies between two neighbours in the order
    of scores. Each distinct score knows the places that its rows fill, so both
    are looked up in the table of distinct scores.
    """
    rows = by_score(df, y, score)
    n = F.col("p") + F.col("q")
    place = (n - 1) * F.greatest(F.lit(0.0), 1 - F.col("alerts") / n.cast("double"))
    first = n - F.col("tp") - F.col("fp")
    held = rows.select("*", F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])).alias("alerts")).withColumns({"place": place, "first": first})

    def at(where: Column) -> Column:
        return F.max(F.when((F.col("first") <= where) & (where < F.col("first") + F.col("pos") + F.col("neg")), F.col("score")))

    low, high = F.floor("place"), F.least(F.floor("place") + 1, n - 1)
    cuts = held.groupBy("alerts").agg(at(low).alias("low"), at(high).alias("high"), F.max(F.col("place") - low).alias("part"))
    cuts = cuts.select("alerts", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("threshold"))
    kept = held.join(F.broadcast(cuts), "alerts").where("score >= threshold")
    one = kept.groupBy("alerts", "threshold").agg(F.max("tp").alias("caught"), F.max(F.col("tp") + F.col("fp")).alias("flagged"), F.max("p").alias("p"))
    return one.select(
        "alerts", "threshold", "caught", "flagged",
        ratio(F.col("caught"), F.greatest(F.col("p"), F.lit(1))).alias("recall"), ratio(F.col("caught"), F.greatest(F.col("flagged"), F.lit(1))).alias("precision"),
    )


def regression_report(df: DataFrame, actual: str, predicted: str, baseline: str, zero: float = 1e-9, most_zero: float = 0.05) -> DataFrame:
    """MAE, RMSE, R2, MAPE (null if over most_zero of the actuals are near zero), and skill over a baseline."""
    a, p, b = F.col(actual), F.col(predicted), F.col(baseline)
    near = F.abs(a) < zero
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.sqrt(F.avg((a - p) ** 2)).alias("rmse"),
        F.avg(F.abs(a - b)).alias("baseline_mae"),
        F.sqrt(F.avg((a - b) ** 2)).alias("baseline_rmse"),
        F.sum((a - p) ** 2).alias("sse"),
        (F.var_pop(a) * F.count(a)).alias("sst"),
        F.when(F.avg(near.cast("double")) <= most_zero, F.avg(F.when(~near, F.abs((a - p) / F.nullif(a, F.lit(0.0)))))).alias("mape"),
    )
    return one.select(
        "n", "mae", "rmse", (1 - F.col("sse") / F.nullif("sst", F.lit(0.0))).alias("r2"), "mape", "baseline_mae", "baseline_rmse",
        (1 - F.col("mae") / F.nullif("baseline_mae", F.lit(0.0))).alias("skill"),
    )


def conformal(calibration: DataFrame, test: DataFrame, actual: str, predicted: str, levels: Sequence[float], corrected: bool = False) -> DataFrame:
    """Bands of the calibration residuals' quantiles around predictions, never below zero, and their coverage on test."""
    residual = F.abs(F.col(actual) - F.col(predicted))
    if corrected:
        n = calibration.count()
        levels_used = [min(1.0, x * (n + 1) / max(n, 1)) for x in levels]
    else:
        levels_used = list(levels)
    cut = stats.quantiles(calibration.select(residual.alias("_residual")), "_residual", levels_used, "q")
    bands = cut.select(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("q").alias("half")).alias("bands"))
    rows = test.join(F.broadcast(bands)).select("*", F.explode("bands").alias("z")).withColumns({"level": F.col("z.level"), "half": F.col("z.half")})
    low, high = F.greatest(F.col(predicted) - F.col("half"), F.lit(0.0)), F.col(predicted) + F.col("half")
    inside = F.col(actual).between(low, high).cast("double")
    one = rows.groupBy("level", "half").agg(F.avg(inside).alias("coverage"), F.avg(high - low).alias("mean_width"))
    gap = F.col("coverage") - F.col("level")
    return one.select("level", "half", "coverage", gap.alias("gap"), "mean_width", (F.abs(gap) <= 0.05).alias("calibrated"))
