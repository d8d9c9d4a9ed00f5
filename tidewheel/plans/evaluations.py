"""Queries that evaluate scores, audit groups and split rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import evaluation, fairness, splits
from tidewheel.plans.common import BY_SCORE, SCORED, scored, tidy
from tidewheel.sources.tables import table

LEAST_GROUP = 30


def average_precision(spark, sf_dir):
    return tidy(evaluation.average_precision(scored(spark, sf_dir), "toxic", "score"))


def roc_auc(spark, sf_dir):
    return tidy(evaluation.roc_auc(scored(spark, sf_dir), "toxic", "score"))


def roc_pr_points(spark, sf_dir):
    rows = evaluation.by_score(scored(spark, sf_dir), "toxic", "score")
    tp, fp = F.col("tp"), F.col("fp")
    return tidy(rows.select("score", (tp / F.col("p")).alias("recall"), (fp / F.col("q")).alias("fpr"), (tp / (tp + fp)).alias("precision")))


def brier_f1(spark, sf_dir):
    return tidy(evaluation.brier_and_f1(scored(spark, sf_dir), "toxic", "score", 0.5))


def best_f1_threshold(spark, sf_dir):
    return tidy(evaluation.best_f1(scored(spark, sf_dir), "toxic", "score"))


def cost_curve(spark, sf_dir):
    return tidy(evaluation.cost_curve(scored(spark, sf_dir), "toxic", "score", 500.0, 10.0, 101))


def alert_budget(spark, sf_dir):
    return tidy(evaluation.alert_budgets(scored(spark, sf_dir), "toxic", "score", (50, 100, 250, 500, 1000)))


def confusion_by_group(spark, sf_dir):
    return tidy(fairness.by_group(scored(spark, sf_dir), "lang", "toxic", "score", 0.5, LEAST_GROUP))


def fairness_criteria(spark, sf_dir):
    return tidy(fairness.criteria(fairness.by_group(scored(spark, sf_dir), "lang", "toxic", "score", 0.5, LEAST_GROUP)))


def calibration_by_decile(spark, sf_dir):
    return tidy(fairness.calibration(scored(spark, sf_dir), "lang", "toxic", "score"))


def identity_check(spark, sf_dir):
    return tidy(fairness.identity(fairness.by_group(scored(spark, sf_dir), "lang", "quality", "score", 0.5, LEAST_GROUP)))


def split_temporal(spark, sf_dir):
    rows = splits.temporal(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 0.2, 300)
    return rows.select("o_orderkey", "pos", "split")


def split_report(spark, sf_dir):
    return splits.report(split_temporal(spark, sf_dir))


def split_stratified(spark, sf_dir):
    return tidy(splits.stratified(table(spark, sf_dir, "labels"), "doc_id", "toxic", 0.25, 42))


def split_grouped(spark, sf_dir):
    return splits.grouped(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.25, 42)


def kfold_stratified(spark, sf_dir):
    return tidy(splits.folds(table(spark, sf_dir, "labels"), "doc_id", "toxic", 5, 42))


def _walk(spark, sf_dir, trim):
    rows = splits.walk_forward(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 5, 200, trim)
    return tidy(rows.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")))


def walk_forward_a(spark, sf_dir):
    return _walk(spark, sf_dir, "train")


def walk_forward_b(spark, sf_dir):
    return _walk(spark, sf_dir, "test")


NAMES = (
    "average_precision roc_auc roc_pr_points brier_f1 best_f1_threshold cost_curve alert_budget confusion_by_group fairness_criteria calibration_by_decile identity_check split_temporal split_report "
    "split_stratified split_grouped kfold_stratified walk_forward_a walk_forward_b"
).split()
QUERIES = {n: globals()[n] for n in NAMES}


def _groups(y: str) -> str:
    cells = ", ".join(f"count(*) FILTER ({y} = {a} AND score {s} 0.5) AS {n}" for n, a, s in (("tp", 1, ">="), ("fp", 0, ">="), ("fn", 1, "<"), ("tn", 0, "<")))
    rates = {
        "base_rate": ("tp + fn", "n"), "selection_rate": ("tp + fp", "n"), "fpr": ("fp", "fp + tn"), "fnr": ("fn", "fn + tp"), "tpr": ("tp", "fn + tp"), "tnr": ("tn", "fp + tn"),
        "ppv": ("tp", "tp + fp"), "npv": ("tn", "tn + fn"), "accuracy": ("tp + tn", "n"),
    }
    listed = ", ".join(f"({a}) / nullif({b}, 0)::DOUBLE AS {k}" for k, (a, b) in rates.items())
    return f"SELECT *, {listed}, n >= {LEAST_GROUP} AS eligible FROM (SELECT lang AS \"group\", {cells}, count(*) AS n FROM ({SCORED}) GROUP BY 1)"


RATES = "base_rate selection_rate fpr fnr tpr tnr ppv npv accuracy".split()
POS = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS total FROM orders"
TEMPORAL = f"SELECT o_orderkey, pos, CASE WHEN pos >= floor(total * 0.8) THEN 'test' WHEN pos < greatest(1, floor(total * 0.8) - 300) THEN 'train' ELSE 'embargo' END AS split FROM ({POS})"
SEEDED = "md5('42:' || {}::VARCHAR)"


def _walked(start: str, keep_to: str, test_from: str) -> str:
    return f"""SELECT fold, split, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT fold, pos, CASE WHEN pos < {keep_to} THEN 'train' WHEN pos >= {test_from} AND pos < start + block THEN 'test' END AS split
FROM (SELECT *, {start} AS start FROM (SELECT *, total // 6 AS block, unnest(range(5)) AS fold FROM ({POS}))) WHERE block > 0) WHERE split IS NOT NULL GROUP BY 1, 2"""


def _criterion(name: str, rate: str) -> str:
    return f"SELECT '{name}' AS criterion, {rate} AS rate, \"group\" FROM ({_groups('toxic')}) WHERE eligible AND {rate} IS NOT NULL"


ORACLES = {
    "average_precision": f"""SELECT round(ap, 6) AS average_precision, round(pr, 6) AS prevalence, round(ap / nullif(pr, 0), 6) AS lift
FROM (SELECT sum(pos / p::DOUBLE * tp / (tp + fp)) AS ap, max(p / (p + q)::DOUBLE) AS pr FROM ({BY_SCORE}))""",
    "roc_auc": f"SELECT round(sum(pos * (q - fp + neg / 2.0)) / (max(p) * max(q)), 6) AS roc_auc, max(p)::BIGINT AS n_pos, max(q)::BIGINT AS n_neg FROM ({BY_SCORE})",
    "roc_pr_points": f"SELECT score, round(tp / p, 6) AS recall, round(fp / q, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM ({BY_SCORE})",
    "brier_f1": f"""SELECT round(b, 6) AS brier, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((fp + tn) / (tp + fp + fn + tn), 6) AS never_accuracy
FROM (SELECT avg((score - toxic) * (score - toxic)) AS b, count(*) FILTER (toxic = 1 AND score >= 0.5) AS tp, count(*) FILTER (toxic = 0 AND score >= 0.5) AS fp, count(*) FILTER (toxic = 1 AND score < 0.5) AS fn, count(*) FILTER (toxic = 0 AND score < 0.5) AS tn FROM ({SCORED}))""",
    "best_f1_threshold": f"SELECT round(2 * tp / (tp + fp + p), 6) AS f1, score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM ({BY_SCORE}) ORDER BY 2 * tp / (tp + fp + p) DESC, score DESC LIMIT 1",
    "cost_curve": f"""WITH t AS (SELECT i, i / 100.0::DOUBLE AS threshold FROM range(101) r(i)), s AS ({SCORED})
SELECT round(threshold, 6) AS threshold, count(*) FILTER (toxic = 1 AND score >= threshold - 1e-9) AS tp, count(*) FILTER (toxic = 0 AND score >= threshold - 1e-9) AS fp, count(*) FILTER (toxic = 1 AND score < threshold - 1e-9) AS fn,
count(*) FILTER (toxic = 0 AND score < threshold - 1e-9) AS tn, count(*) FILTER (toxic = 1 AND score < threshold - 1e-9) * 500.0::DOUBLE + count(*) FILTER (toxic = 0 AND score >= threshold - 1e-9) * 10.0::DOUBLE AS expected_cost, count(*) FILTER (score >= threshold - 1e-9) AS alerts FROM t, s GROUP BY threshold""",
    "alert_budget": f"""WITH s AS ({SCORED}), l AS (SELECT list(score ORDER BY score) AS l, count(*) AS n FROM s), h AS (SELECT alerts, l, n, (n - 1) * greatest(0, 1 - alerts / n::DOUBLE) AS h FROM l, (SELECT unnest([50, 100, 250, 500, 1000]) AS alerts)),
b AS (SELECT alerts, l[floor(h)::BIGINT + 1] + (h - floor(h)) * (l[least(floor(h)::BIGINT + 2, n)] - l[floor(h)::BIGINT + 1]) AS threshold FROM h)
SELECT alerts::BIGINT AS alerts, round(threshold, 6) AS threshold, count(*) FILTER (toxic = 1) AS caught, count(*) AS flagged, round(count(*) FILTER (toxic = 1) / greatest((SELECT sum(toxic) FROM s), 1), 6) AS recall, round(count(*) FILTER (toxic = 1) / count(*), 6) AS precision
FROM b JOIN s ON score >= threshold GROUP BY 1, threshold""",
    "confusion_by_group": f'SELECT "group", tp, fp, fn, tn, n, {", ".join(f"round({r}, 6) AS {r}" for r in RATES)}, eligible FROM ({_groups("toxic")})',
    "fairness_criteria": f"""WITH c AS ({' UNION ALL '.join(_criterion(k, v) for k, v in (("demographic_parity", "selection_rate"), ("equal_fnr", "fnr"), ("equal_fpr", "fpr"), ("predictive_parity", "ppv")))}),
g AS (SELECT criterion, min(rate) AS least, (array_agg("group" ORDER BY rate, "group"))[1] AS least_group, max(rate) AS most, (array_agg("group" ORDER BY rate DESC, "group"))[1] AS most_group FROM c GROUP BY 1)
SELECT criterion, round(least, 6) AS least, least_group, round(most, 6) AS most, most_group, round(most - least, 6) AS gap, round(least / nullif(most, 0), 6) AS share, most - least < 0.05 AS satisfied,
row_number() OVER (ORDER BY round(most - least, 9) DESC, criterion) AS rank FROM g""",
    "calibration_by_decile": f"""SELECT lang AS "group", least(10, floor(score * 10) + 1)::BIGINT AS decile, count(*) AS n, round(avg(toxic), 6) AS outcome_rate, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM ({SCORED}) GROUP BY 1, 2""",
    "identity_check": f"""SELECT "group", round(fpr, 6) AS fpr, round(i, 6) AS implied_fpr, round(abs(fpr - i), 6) AS gap FROM (SELECT *, base_rate / nullif(1 - base_rate, 0) * (1 - ppv) / nullif(ppv, 0) * (1 - fnr) AS i FROM ({_groups("quality")}) WHERE eligible)""",
    "split_temporal": TEMPORAL,
    "split_report": f"SELECT split, count(*) AS n_rows FROM ({TEMPORAL}) GROUP BY 1",
    "split_stratified": f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY {SEEDED.format('doc_id')}, doc_id) <= round(count(*) OVER (PARTITION BY toxic) * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM labels",
    "split_grouped": f"""WITH g AS (SELECT o_custkey, CASE WHEN row_number() OVER (ORDER BY {SEEDED.format('o_custkey')}, o_custkey) <= greatest(1, round(count(*) OVER () * 0.25::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, o_custkey, split FROM orders JOIN g USING (o_custkey)""",
    "kfold_stratified": f"SELECT *, (row_number() OVER (PARTITION BY toxic ORDER BY {SEEDED.format('doc_id')}, doc_id) - 1) % 5 AS fold FROM labels",
    "walk_forward_a": _walked("total - (5 - fold) * block", "greatest(1, start - 200)", "start"),
    "walk_forward_b": _walked("(fold + 1) * block", "CASE WHEN block > 200 THEN start END", "start + 200"),
}
