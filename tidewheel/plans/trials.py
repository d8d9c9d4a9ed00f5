"""Queries that try models and roll up findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import fairness, ml, profile, search, stats, trials
from tidewheel.plans.common import SCORED, scored, tidy
from tidewheel.plans.evaluations import LEAST_GROUP
from tidewheel.plans.panels import panel_dense
from tidewheel.plans.profiles import _chi, _rounded
from tidewheel.plans.rollups import TABLES
from tidewheel.sources.tables import SCHEMAS, table

# Severities by the least share of nulls, gravest first.
SEVERITIES = (("high", 0.05), ("medium", 0.01), ("low", 0.0))


def rare_levels(spark, sf_dir):
    """Brands with those under a twenty-fifth of the parts folded into one."""
    return trials.rare_folded(table(spark, sf_dir, "part").select("p_brand"), "p_brand", 0.04).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def false_positive_gap(spark, sf_dir):
    """Whether false positives among the negatives depend on which of the two largest groups a row is in."""
    rows = scored(spark, sf_dir)
    two = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(2).select("lang")
    negatives = rows.where("toxic = 0").join(F.broadcast(two), "lang").select("lang", (F.col("score") >= 0.5).alias("flagged"))
    return tidy(stats.chi_square(stats.contingency(negatives, "lang", "flagged"), yates=True))


def findings_rollup(spark, sf_dir):
    """Columns with nulls by severity, gravest first, with a line on each severity; those without any are clean."""
    out = None
    for name in TABLES:
        one = profile.null_counts(table(spark, sf_dir, name)).withColumn("table_name", F.lit(name))
        out = one if out is None else out.union(one)
    share = F.col("n_null") / F.nullif("n_rows", F.lit(0))
    place = F.when(share >= SEVERITIES[0][1], 0).when(share >= SEVERITIES[1][1], 1).when(share > SEVERITIES[2][1], 2).otherwise(3)
    rows = out.groupBy(place.cast("long").alias("place")).agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n_null").alias("n_null"))
    names = F.array(*[F.lit(s) for s, _ in SEVERITIES], F.lit("clean"))
    rows = rows.withColumn("severity", F.element_at(names, (F.col("place") + 1).cast("int")))
    return rows.withColumn("line", F.format_string("| %s | %d columns | %d nulls |", "severity", "n_columns", "n_null")).orderBy("place")


def blind_audit(spark, sf_dir):
    """A model that never sees the language, audited by language on held-out rows."""
    rows = scored(spark, sf_dir).select("doc_id", "toxic", "lang", "source", "quality", "n_chars")
    found = trials.blind_scores(rows, "doc_id", "toxic", ["quality", "n_chars"], ["source"], 0.3, 42)
    base = found.agg(F.avg(F.col("toxic").cast("double")).alias("rate"))
    flagged = found.join(F.broadcast(base)).withColumn("over", (F.col("probability") >= F.col("rate")).cast("double"))
    return tidy(fairness.by_group(flagged, "lang", "toxic", "over", 0.5, LEAST_GROUP))


def reweighting_ablation(spark, sf_dir):
    rows = scored(spark, sf_dir).select("doc_id", "toxic", "quality", "n_chars")
    return tidy(trials.reweighting(rows, "doc_id", "toxic", ["quality", "n_chars"], 0.3, 42))


def leak_inflation(spark, sf_dir):
    """What a column made from the outcome, wrong for one id in ten, adds to each model."""
    rows = scored(spark, sf_dir).select("doc_id", "toxic", "quality", "n_chars")
    leak = F.when(F.col("doc_id") % 10 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    return tidy(trials.leak_inflation(rows.withColumn("leak", leak), "doc_id", "toxic", ["quality", "n_chars"], ["leak"], 3, 42))


def direct_steps(spark, sf_dir):
    return tidy(trials.direct_steps(panel_dense(spark, sf_dir), "zone", "hour_ts", "n", (1, 2, 3, 24), range(1, 13), 0.2, 42))


def mixture_criteria(spark, sf_dir):
    """Mixtures on eight principal components of whole embeddings."""
    rows = ml.projection(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    return tidy(trials.mixture_criteria(rows.select(F.array(*[f"pc{i + 1}" for i in range(8)]).alias("embedding")), "embedding", range(2, 7), 42), 3)


BAYES = ["lang", "source", "quality"]


def _bayes_parts(spark, sf_dir):
    """Three in sixteen rows, by a digest of the id, are held out."""
    rows = scored(spark, sf_dir).select("doc_id", "toxic", *BAYES)
    held = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2")
    return rows.where(~held), rows.where(held)


def bayes_model(spark, sf_dir):
    return tidy(stats.bayes_table(_bayes_parts(spark, sf_dir)[0], "toxic", BAYES))


def categorical_bayes(spark, sf_dir):
    """Held-out documents with the chance of either class."""
    train, test = _bayes_parts(spark, sf_dir)
    found = stats.bayes_scores(test, "doc_id", stats.bayes_table(train, "toxic", BAYES), BAYES)
    return tidy(found.select(F.col("key").alias("doc_id"), F.col("y").alias("toxic"), "probability"))


def family_search(spark, sf_dir):
    """Twelve settings of each of four families over four folds, on numbers and categories."""
    rows = scored(spark, sf_dir).select("doc_id", "toxic", "quality", "n_chars", "lang", "source")
    return tidy(search.search(rows, "doc_id", "toxic", ["quality", "n_chars"], ["lang", "source"], 12, 4, 42, parallelism=8)[0])


def table_scores(spark, sf_dir):
    """A logistic model's chances by a join with its exported coefficients."""
    rows = scored(spark, sf_dir).select("doc_id", "toxic", "quality", "n_chars", "score")
    columns = ["quality", "n_chars", "score"]
    return tidy(search.table_scores(rows, "doc_id", columns, search.logistic_table(rows, "toxic", columns)[0]))


NAMES = "family_search table_scores bayes_model categorical_bayes rare_levels false_positive_gap findings_rollup blind_audit reweighting_ablation leak_inflation direct_steps mixture_criteria".split()
QUERIES = {n: globals()[n] for n in NAMES}

NULLS = " UNION ALL ".join(f"SELECT count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows FROM {t}" for t in TABLES for c in SCHEMAS[t].names)
BAYES_SQL = f"""WITH r AS (SELECT doc_id, toxic, lang, source, quality::VARCHAR AS quality, md5(doc_id::VARCHAR)[1] IN ('0', '1', '2') AS held FROM ({SCORED})),
x AS (SELECT doc_id, toxic, held, unnest(['lang', 'source', 'quality']) AS feature, unnest([coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(quality, chr(0))]) AS level FROM r),
k AS (SELECT feature, count(DISTINCT level) + 1 AS kinds FROM x WHERE NOT held GROUP BY 1), y AS (SELECT toxic AS y, count(*) AS c FROM r WHERE NOT held GROUP BY 1),
l AS (SELECT DISTINCT feature, level FROM x WHERE NOT held UNION ALL SELECT feature, NULL FROM k),
n AS (SELECT toxic AS y, feature, level, count(*) AS n FROM x WHERE NOT held GROUP BY ALL),
m AS MATERIALIZED (SELECT y.y, l.feature, l.level, coalesce(n.n, 0) AS n, ln((coalesce(n.n, 0) + 1) / (c + kinds)) AS score FROM l CROSS JOIN y JOIN k USING (feature) LEFT JOIN n ON n.y = y.y AND n.feature = l.feature AND n.level = l.level
UNION ALL SELECT y, NULL, NULL, c, ln(c / sum(c) OVER ()) FROM y)"""
ORACLES = {
    "bayes_model": f"{BAYES_SQL} SELECT y::BIGINT AS y, feature, level, n, round(score, 6) AS score FROM m",
    "categorical_bayes": f"""{BAYES_SQL}, j AS (SELECT doc_id, a.y, any_value(p.score) + sum(coalesce(s.score, u.score)) AS joint FROM x CROSS JOIN (SELECT y FROM y) a JOIN m p ON p.feature IS NULL AND p.y = a.y
LEFT JOIN m s ON s.feature = x.feature AND s.level = x.level AND s.y = a.y JOIN m u ON u.feature = x.feature AND u.level IS NULL AND u.y = a.y WHERE held GROUP BY 1, 2)
SELECT doc_id, y::BIGINT AS toxic, round(exp(joint - max(joint) OVER w) / sum(exp(joint)) OVER w * exp(max(joint) OVER w), 6) AS probability FROM j WINDOW w AS (PARTITION BY doc_id)""",
    "rare_levels": """WITH c AS (SELECT p_brand, count(*) AS n, sum(count(*)) OVER () AS t FROM part GROUP BY 1)
SELECT CASE WHEN p_brand IS NOT NULL AND n / t < 0.04::DOUBLE THEN 'other' ELSE p_brand END AS p_brand, sum(n)::BIGINT AS n FROM c GROUP BY 1""",
    "false_positive_gap": _rounded(
        _chi(
            f"""WITH s AS ({SCORED}), two AS (SELECT lang FROM s GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 2), c AS (SELECT lang AS a, score >= 0.5 AS b, count(*) AS n FROM s WHERE toxic = 0 AND lang IN (SELECT lang FROM two) GROUP BY 1, 2)
SELECT a, b, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM c) CROSS JOIN (SELECT DISTINCT b FROM c) LEFT JOIN c USING (a, b)""",
            yates=True,
        )
    ),
    "findings_rollup": f"""SELECT *, '| ' || severity || ' | ' || n_columns || ' columns | ' || n_null || ' nulls |' AS line FROM (
SELECT place::BIGINT AS place, count(*) AS n_columns, sum(n_null)::BIGINT AS n_null, ['high', 'medium', 'low', 'clean'][place + 1] AS severity
FROM (SELECT *, CASE WHEN n_null / n_rows >= 0.05::DOUBLE THEN 0 WHEN n_null / n_rows >= 0.01::DOUBLE THEN 1 WHEN n_null > 0 THEN 2 ELSE 3 END AS place FROM ({NULLS})) GROUP BY place)""",
}
