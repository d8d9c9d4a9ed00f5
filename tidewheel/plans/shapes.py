"""Queries that reshape tables: bands, thinning, heads, filling, calendar months."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import market, shape
from tidewheel.plans.common import tidy
from tidewheel.plans.markets import BARS, bars
from tidewheel.sources.tables import table


def quantile_bands(spark, sf_dir):
    rows = shape.quantile_bands(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 4)
    return tidy(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high")))


def fixed_bands(spark, sf_dir):
    band = shape.fixed_bands(F.col("p_size").cast("double"), (0.0, 10.0, 25.0, 40.0))
    return table(spark, sf_dir, "part").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def thinned_bars(spark, sf_dir):
    return tidy(shape.thinned(bars(spark, sf_dir).select("day", "close"), "day", 100))


def decimated_bars(spark, sf_dir):
    return tidy(shape.decimated(bars(spark, sf_dir).select("day", "close"), "day", 7))


def head_per_class(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return tidy(shape.head_per_class(rows, "o_orderstatus", [F.desc("o_totalprice"), "o_orderkey"], 5))


def month_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("month"))
    return tidy(rows.agg(F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("n")), 4)


def filled_and_clipped(spark, sf_dir):
    """Segments of customers after negative balances are taken as unknown, filled by the median and clipped."""
    rows = table(spark, sf_dir, "customer").withColumn("balance", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    rows = shape.filled(rows, ["balance"], {"c_mktsegment": "unknown"}).withColumn("balance", shape.clipped(F.col("balance"), 500.0, 9000.0))
    return tidy(rows.groupBy("c_mktsegment").agg(F.sum("balance").alias("total_balance"), F.count(F.lit(1)).alias("n")), 3)


def worst_days(spark, sf_dir):
    """The ten days of the lowest returns."""
    return tidy(market.returns(bars(spark, sf_dir)).where("ret is not null").orderBy("ret", "day").limit(10).select("day", "ret"))


NAMES = "quantile_bands fixed_bands thinned_bars decimated_bars head_per_class month_profile filled_and_clipped worst_days".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {
    "quantile_bands": """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(p_retailprice, [0.25, 0.5, 0.75]))) AS e FROM part)
SELECT len(list_filter(e, lambda x: x < p_retailprice)) + 1 AS band, count(*) AS n, round(min(p_retailprice), 6) AS low, round(max(p_retailprice), 6) AS high FROM part, e GROUP BY 1""",
    "fixed_bands": "SELECT CASE WHEN p_size > 0 AND p_size <= 10 THEN 1 WHEN p_size > 10 AND p_size <= 25 THEN 2 WHEN p_size > 25 AND p_size <= 40 THEN 3 END::BIGINT AS band, count(*) AS n FROM part GROUP BY 1",
    "thinned_bars": f"""SELECT day, round(close, 6) AS close FROM (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM ({BARS}))
WHERE n <= 100 OR floor(floor(i / ((n - 1) / 99.0::DOUBLE) + 0.5) * ((n - 1) / 99.0::DOUBLE) + 0.5) = i""",
    "decimated_bars": f"SELECT day, round(close, 6) AS close FROM (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM ({BARS})) WHERE i % 7 = 0",
    "head_per_class": "SELECT o_orderstatus, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 5",
    "month_profile": "SELECT month(o_orderdate) AS month, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n FROM orders GROUP BY 1",
    "filled_and_clipped": """SELECT c_mktsegment, round(sum(least(greatest(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, (SELECT median(c_acctbal) FROM customer WHERE c_acctbal >= 0)), 500), 9000)), 3) AS total_balance, count(*) AS n
FROM customer GROUP BY 1""",
    "worst_days": f"SELECT day, round(ret, 6) AS ret FROM (SELECT day, ln(close) - lag(ln(close)) OVER (ORDER BY day) AS ret FROM ({BARS})) WHERE ret IS NOT NULL ORDER BY ret, day LIMIT 10",
}
