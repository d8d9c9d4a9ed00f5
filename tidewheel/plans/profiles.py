"""Queries that profile tables and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import profile, stats
from tidewheel.plans.common import SCORED, gamma_tail_sql, scored, tidy
from tidewheel.sources.tables import table

LINE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey")
BOX = {"l_quantity": (5.0, 40.0), "l_discount": (0.02, 0.08)}


def null_profile(spark, sf_dir):
    out = None
    for name in ("events", "lineitem", "documents", "labels"):
        one = profile.null_counts(table(spark, sf_dir, name)).withColumn("table_name", F.lit(name))
        out = one if out is None else out.union(one)
    return out


def duplicate_profile(spark, sf_dir):
    return profile.duplicate_counts(table(spark, sf_dir, "lineitem"), LINE_KEYS)


def duplicate_share_by_month(spark, sf_dir):
    return tidy(profile.duplicate_share(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], F.month("l_shipdate").cast("long"), "month"))


def sentinel_counts(spark, sf_dir):
    return profile.sentinel_counts(table(spark, sf_dir, "orders"), "4-NOT SPECIFIED")


def value_counts_topn(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), "p_brand", 10)


def histogram_stats(spark, sf_dir):
    return tidy(profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20))


def moments(spark, sf_dir):
    return tidy(profile.moments(table(spark, sf_dir, "lineitem"), "l_extendedprice"), 4)


def box_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    inside = profile.inside_box(rows, BOX)
    return rows.agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"), F.count(F.lit(1)).alias("n_rows"))


def segment_profile(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey")
    return tidy(profile.segment_profile(rows, "c_mktsegment", "o_totalprice", "o_orderpriority", F.col("o_orderstatus") == "F"), 4)


def rfm_segments(spark, sf_dir):
    """Customers by quartile of spending: recency, frequency and money of each."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max(F.to_date("o_orderdate")).alias("last"))
    per = orders.groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("d"), F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("money"))
    cuts = stats.quantiles(per, "money", (0.25, 0.5, 0.75), "q")
    band = F.when(F.col("money") <= F.col("q")[0], 1).when(F.col("money") <= F.col("q")[1], 2).when(F.col("money") <= F.col("q")[2], 3).otherwise(4)
    rows = per.join(F.broadcast(cuts)).join(F.broadcast(last)).select(band.cast("long").alias("band"), F.datediff("last", "d").alias("days"), "n", "money")
    return tidy(rows.groupBy("band").agg(F.count(F.lit(1)).alias("customers"), F.avg("days").alias("mean_days"), F.avg("n").alias("mean_orders"), F.avg("money").alias("mean_money")), 3)


def contingency(spark, sf_dir):
    return stats.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def chi2_stat(spark, sf_dir):
    return tidy(stats.chi_square(contingency(spark, sf_dir)))


def chi2_yates(spark, sf_dir):
    return tidy(stats.chi_square(stats.contingency(table(spark, sf_dir, "labels"), "toxic", "quality"), yates=True))


def cramers_v(spark, sf_dir):
    """Within each order status: how far segment and priority depend on each other, flagged over 0.2."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey")
    cells = rows.groupBy("o_orderstatus", F.col("c_mktsegment").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return tidy(stats.chi_square(cells, by=["o_orderstatus"]).select("o_orderstatus", "n", "cramers_v", (F.col("cramers_v") > 0.2).alias("dependent")))


def cohens_d(spark, sf_dir):
    rows = scored(spark, sf_dir).select("toxic", "n_chars", "quality", "score")
    return tidy(stats.cohens_d(rows, "toxic", ["n_chars", "quality", "score"]))


def likelihood_tables(spark, sf_dir):
    return tidy(stats.posterior(stats.likelihoods(scored(spark, sf_dir), "toxic", "lang")))


def leak_screen(spark, sf_dir):
    """Columns against returned goods: rank AUC by distinct values, correlation, class means."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("long").alias("y"), "l_quantity", "l_discount", "l_tax")
    out = None
    for c in ("l_quantity", "l_discount", "l_tax"):
        ranked = stats.mid_rank(rows.select("y", F.col(c).alias("v")), "v", "rank")
        p, n = F.sum("y"), F.count(F.lit(1))
        auc = (F.sum(F.when(F.col("y") == 1, F.col("rank"))) - p * (p + 1) / 2) / (p * (n - p))
        one = ranked.agg(auc.alias("auc"), F.corr("y", "v").alias("correlation"), F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("mean_1"), F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("mean_0"))
        one = one.withColumn("feature", F.lit(c))
        out = one if out is None else out.union(one)
    return tidy(out)


def char_entropy(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return tidy(stats.entropy(chars, "c", "n"))


def word_validity(spark, sf_dir):
    """Share of the conversations' distinct words that some document has too."""

    def words(df):
        return df.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).where("w != ''").distinct()

    mine, known = words(table(spark, sf_dir, "conversations")), words(table(spark, sf_dir, "documents"))
    both = mine.join(known, "w", "left_semi").agg(F.count(F.lit(1)).alias("n_known"))
    return tidy(mine.agg(F.count(F.lit(1)).alias("n_words")).join(F.broadcast(both)).withColumn("share", F.col("n_known") / F.nullif("n_words", F.lit(0))))


NAMES = (
    "null_profile duplicate_profile duplicate_share_by_month sentinel_counts value_counts_topn histogram_stats moments box_filter segment_profile rfm_segments contingency chi2_stat chi2_yates "
    "cramers_v cohens_d likelihood_tables leak_screen char_entropy word_validity"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

COLUMNS = {
    "events": "event_id ts user_id event_type value props",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "documents": "doc_id text lang source n_chars",
    "labels": "doc_id quality toxic",
}


def _chi(cells: str, by: str = "", yates: bool = False) -> str:
    p = f"PARTITION BY {by}, " if by else "PARTITION BY "
    every = f"PARTITION BY {by}" if by else ""
    gap = "(abs(n - e) - least(0.5, abs(n - e)))" if yates else "(n - e)"
    return f"""SELECT {by + ',' if by else ''} sum({gap} * {gap} / nullif(e, 0)) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, max(total)::BIGINT AS n,
sqrt(sum({gap} * {gap} / nullif(e, 0)) / nullif(max(total) * (least(count(DISTINCT a), count(DISTINCT b)) - 1), 0)) AS cramers_v
FROM (SELECT *, sum(n) OVER ({p} a) * sum(n) OVER ({p} b) / nullif(sum(n) OVER ({every}), 0)::DOUBLE AS e, sum(n) OVER ({every}) AS total FROM ({cells})) {'GROUP BY ' + by if by else ''}"""


def _cells(t: str, a: str, b: str) -> str:
    return f"""SELECT x.a, y.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT {a} AS a FROM {t}) x CROSS JOIN (SELECT DISTINCT {b} AS b FROM {t}) y
LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY ALL) c ON c.a = x.a AND c.b = y.b"""


def _rounded(sql: str) -> str:
    return f"SELECT round(chi2, 6) AS chi2, dof, n, round(cramers_v, 6) AS cramers_v, round({gamma_tail_sql('(dof / 2.0::DOUBLE)', '(chi2 / 2)')}, 6) AS p FROM ({sql})"


def _leak(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, round(corr(y, v), 6) AS correlation,
round(avg(v) FILTER (y = 1), 6) AS mean_1, round(avg(v) FILTER (y = 0), 6) AS mean_0
FROM (SELECT (l_returnflag = 'R')::BIGINT AS y, {c} AS v, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r FROM lineitem)"""


def _d(c: str) -> str:
    return f"""SELECT '{c}' AS feature, avg({c}) FILTER (toxic = 1) AS m1, avg({c}) FILTER (toxic = 0) AS m0, var_samp({c}) FILTER (toxic = 1) AS v1, var_samp({c}) FILTER (toxic = 0) AS v0,
count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0 FROM ({SCORED})"""


X = "l_extendedprice"
ORACLES = {
    "null_profile": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS n_null, count(*) AS n_rows FROM {t}" for t, cs in COLUMNS.items() for c in cs.split()
    ),
    "duplicate_profile": """SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_extra, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_in_groups
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey)""",
    "duplicate_share_by_month": """SELECT month, count(*) AS n_rows, round(avg((c > 1)::INT), 6) AS share
FROM (SELECT month(l_shipdate) AS month, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS c FROM lineitem) GROUP BY 1""",
    "sentinel_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} = '4-NOT SPECIFIED') AS n_sentinel FROM orders" for c in ("o_orderstatus", "o_orderpriority")
    ),
    "value_counts_topn": "SELECT p_brand, count(*) AS n_rows FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "histogram_stats": f"""WITH e AS (SELECT min({X}) AS low, max({X}) AS high FROM lineitem), b AS (SELECT unnest(range(20)) AS bin),
c AS (SELECT greatest(0, least(floor(({X} - low) / (high - low) * 20), 19))::BIGINT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT bin, round(low + bin * ((high - low) / 20), 6) AS edge_low, round(low + (bin + 1) * ((high - low) / 20), 6) AS edge_high, coalesce(n, 0) AS n FROM b CROSS JOIN e LEFT JOIN c USING (bin)""",
    "moments": f"""WITH m AS (SELECT avg({X}) AS mu FROM lineitem)
SELECT count({X}) AS n, round(avg({X}), 4) AS mean, round(stddev_pop({X}), 4) AS std_pop, round(stddev_samp({X}), 4) AS std_samp,
round(avg(pow({X} - mu, 3)) / pow(var_pop({X}), 1.5), 4) AS skew, round(avg(pow({X} - mu, 4)) / pow(var_pop({X}), 2) - 3, 4) AS kurtosis,
round(quantile_cont({X}, 0.01), 4) AS p01, round(quantile_cont({X}, 0.25), 4) AS p25, round(quantile_cont({X}, 0.5), 4) AS median, round(quantile_cont({X}, 0.75), 4) AS p75,
round(quantile_cont({X}, 0.99), 4) AS p99, round(min({X}), 4) AS least, round(max({X}), 4) AS most FROM lineitem, m""",
    "box_filter": """SELECT count(*) FILTER (i) AS n_inside, count(*) FILTER (NOT i) AS n_outside, count(*) AS n_rows
FROM (SELECT l_quantity BETWEEN 5 AND 40 AND l_discount BETWEEN 0.02 AND 0.08 AS i FROM lineitem)""",
    "segment_profile": """WITH j AS (SELECT c_mktsegment, o_totalprice, o_orderpriority, (o_orderstatus = 'F')::INT AS f FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT c_mktsegment, o_orderpriority AS mode FROM (SELECT c_mktsegment, o_orderpriority, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, o_orderpriority) AS r FROM j GROUP BY 1, 2) WHERE r = 1)
SELECT c_mktsegment, count(*) AS n_rows, round(median(o_totalprice), 4) AS median_value, round(avg(o_totalprice), 4) AS mean_value, round(avg(f), 4) AS rate, round(avg(f) / (SELECT avg(f) FROM j), 4) AS lift, any_value(mode) AS mode
FROM j JOIN m USING (c_mktsegment) GROUP BY 1""",
    "rfm_segments": """WITH p AS (SELECT o_custkey, max(o_orderdate::DATE) AS d, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS money FROM orders GROUP BY 1), q AS (SELECT quantile_cont(money, [0.25, 0.5, 0.75]) AS q FROM p), l AS (SELECT max(d) AS last FROM p)
SELECT CASE WHEN money <= q[1] THEN 1 WHEN money <= q[2] THEN 2 WHEN money <= q[3] THEN 3 ELSE 4 END::BIGINT AS band, count(*) AS customers, round(avg(last - d), 3) AS mean_days, round(avg(n), 3) AS mean_orders, round(avg(money), 3) AS mean_money FROM p, q, l GROUP BY 1""",
    "contingency": _cells("orders", "o_orderstatus", "o_orderpriority"),
    "chi2_stat": _rounded(_chi(_cells("orders", "o_orderstatus", "o_orderpriority"))),
    "chi2_yates": _rounded(_chi(_cells("labels", "toxic", "quality"), yates=True)),
    "cramers_v": "SELECT o_orderstatus, n, round(cramers_v, 6) AS cramers_v, cramers_v > 0.2 AS dependent FROM ("
    + _chi("SELECT o_orderstatus, c_mktsegment AS a, o_orderpriority AS b, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL", "o_orderstatus")
    + ")",
    "cohens_d": "SELECT feature, round(m1, 6) AS m1, round(m0, 6) AS m0, round((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0), 6) AS d FROM ("
    + " UNION ALL ".join(map(_d, ("n_chars", "quality", "score")))
    + ")",
    "likelihood_tables": f"""WITH c AS (SELECT toxic AS y, lang AS value, count(*) AS n FROM ({SCORED}) GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY y) AS likelihood, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS prior FROM c)
SELECT y::BIGINT AS y, value, n, round(likelihood, 6) AS likelihood, round(prior, 6) AS prior, round(likelihood * prior / sum(likelihood * prior) OVER (PARTITION BY value), 6) AS posterior FROM t""",
    "leak_screen": " UNION ALL ".join(map(_leak, ("l_quantity", "l_discount", "l_tax"))),
    "char_entropy": """WITH c AS (SELECT unnest(string_split(lower(text), '')) AS c FROM documents), n AS (SELECT c, count(*) / sum(count(*)) OVER () AS p FROM c GROUP BY 1)
SELECT count(*) AS symbols, round(-sum(p * ln(p)), 6) AS entropy, round(exp(-sum(p * ln(p))), 6) AS perplexity FROM n""",
    "word_validity": """WITH a AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM conversations) WHERE w <> ''),
b AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '')
SELECT count(*) AS n_words, count(b.w) AS n_known, round(count(b.w) / count(*), 6) AS share FROM a LEFT JOIN b USING (w)""",
}
