"""Queries that check tables, read what was written, and put a result into words."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewheel.operators import checks, market, mining, profile
from tidewheel.plans import markets, mines
from tidewheel.plans.common import tidy
from tidewheel.sources import files
from tidewheel.sources.scratch import shared_dir
from tidewheel.sources.tables import SCHEMAS, table


def findings(spark, sf_dir):
    """Nulls, repeated rows, stand-ins for unknown, and values out of range, gravest first, each as a line of a table."""
    lines, orders, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    found = [
        checks.share_where(lines, "lineitem", "l_discount", "out of range", ~F.col("l_discount").between(0.0, 0.1)),
        checks.share_where(lines, "lineitem", "l_quantity", "not positive", F.col("l_quantity") <= 0),
        checks.share_where(orders, "orders", "o_orderpriority", "stand-in for unknown", F.col("o_orderpriority") == "4-NOT SPECIFIED"),
        checks.share_where(table(spark, sf_dir, "customer"), "customer", "c_acctbal", "negative", F.col("c_acctbal") < 0),
        checks.share_where(parts, "part", "p_size", "null", F.col("p_size").isNull()),
        checks.repeated(lines, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]),
        checks.repeated(parts, "part", ["p_name", "p_brand", "p_type", "p_size"]),
    ]
    return tidy(checks.report(found))


def duplicate_share_by_hour(spark, sf_dir):
    return tidy(profile.duplicate_share(table(spark, sf_dir, "events"), ["user_id", "event_type", "props"], F.hour("ts"), "hour"))


def null_totals(spark, sf_dir):
    """Null cells by table and over all of them (table_name null)."""
    out = None
    for name in ("customer", "documents", "events", "lineitem", "orders", "part"):
        one = profile.null_counts(table(spark, sf_dir, name)).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.rollup("table_name").agg(F.sum("n_null").alias("n_null"), F.sum("n_rows").alias("n_cells"))


def histogram_record(spark, sf_dir):
    """Prices of orders as one record: edges, centres and counts of 20 bins beside the moments."""
    prices = table(spark, sf_dir, "orders").select("o_totalprice")
    bins = F.array_sort(F.collect_list(F.struct("bin", "edge_low", "edge_high", "n")))

    def joined(value):
        return F.array_join(F.transform("b", value), ",")

    one = profile.histogram(prices, "o_totalprice", 20).groupBy().agg(bins.alias("b"))
    text = one.select(
        joined(lambda x: F.format_string("%.6f", x["edge_low"])).alias("edges"), joined(lambda x: F.format_string("%.6f", (x["edge_low"] + x["edge_high"]) / 2)).alias("centres"), joined(lambda x: x["n"].cast("string")).alias("counts")
    )
    stats = prices.agg(F.count("o_totalprice").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return tidy(text.join(F.broadcast(stats)), 4)


def basket_sparsity(spark, sf_dir):
    """How empty the table of baskets by items is, and the share of baskets of one item."""
    sets = mines.sets(spark, sf_dir)
    one = sets.agg(F.count(F.lit(1)).alias("n_baskets"), F.sum(F.size("items")).alias("n_held"), F.avg((F.size("items") == 1).cast("double")).alias("single_share"))
    items = sets.select(F.explode("items").alias("item")).agg(F.countDistinct("item").alias("n_items"))
    cells = F.col("n_baskets") * F.col("n_items")
    return tidy(one.join(F.broadcast(items)).select("n_baskets", "n_items", "n_held", "single_share", (1 - F.col("n_held") / F.nullif(cells, F.lit(0))).alias("sparsity")))


def monthly_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "MONTH").alias("month"))
    return tidy(rows.agg(F.avg("o_totalprice").alias("mean_price")), 4)


def impossible_cells(spark, sf_dir):
    """Rows by return flag and line status that contradict their dates: open lines shipped before the last return."""
    lines = table(spark, sf_dir, "lineitem")
    last = lines.where("l_returnflag = 'R'").agg(F.max("l_shipdate").alias("last"))
    rows = lines.join(F.broadcast(last)).withColumn("odd", (F.col("l_linestatus") == "O") & (F.col("l_shipdate") <= F.col("last")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("odd").alias("n_odd"))


def strategy_verdict(spark, sf_dir):
    """The strategy against holding, and what that says."""
    rows = markets._signal(spark, sf_dir)
    first = F.row_number().over(market.order()) == 1
    hold = rows.withColumn("net", F.col("next_ret") - F.when(first, 0.001).otherwise(0.0))
    names = ("annual_return", "sharpe", "max_drawdown")
    both = market.performance(rows, "net").select(*names).join(F.broadcast(market.performance(hold, "net").select(*[F.col(c).alias(f"hold_{c}") for c in names])))
    return tidy(both.withColumn("verdict", market.verdict()), 4)


def rule_choices(spark, sf_dir):
    """The rules that either ranking names, once each."""
    found = mining.significant_rules(mines._rules(spark, sf_dir)[0], mines.ALPHA)
    lists = [mining.top_rules(found, m, n).select("antecedent", "consequent") for m, n in (("lift", 60), ("leverage", 40))]
    return lists[0].union(lists[1]).dropDuplicates()


def _file(spark, kind):
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def delimited_customers(spark, sf_dir):
    """Balances by segment from a file with ; between fields, odd headers and texts for numbers, where 'n/a' stands for less than zero."""
    path = _file(spark, "csv")
    text = F.when(F.col("c_acctbal") < 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("decimal(18,2)").cast("string")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias(" segment "), text.alias("balance in units"))
    rows.write.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = files.tidy_header(files.read_delimited(spark, path, sep=";"))
    read = read.withColumn("v", files.parse_number(F.col(files.value_column(read, "balance"))))
    return tidy(read.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_numbers"), F.avg("v").alias("mean_balance")), 4)


def text_baskets(spark, sf_dir):
    """Sizes of baskets read from ragged lines."""
    path = _file(spark, "baskets")
    sets = mines.sets(spark, sf_dir)
    sets.select(F.concat(F.array_join("items", " , "), F.lit(", ,"), F.col("items")[0])).write.text(path)
    return files.read_baskets(spark, path).groupBy(F.size("items").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def tagged_people(spark, sf_dir):
    """Customers and suppliers as one table, each row with its source."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    rows = files.union_tagged({"customer": c, "supplier": s}, "kind")
    return tidy(rows.groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"), F.avg("balance").alias("mean_balance")), 4)


def json_lines(spark, sf_dir):
    """Sums from JSON that holds a stamp of its run and null where a number was not finite."""
    path = _file(spark, "json")
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > 50, float("inf")).otherwise(F.col("value")).alias("value"))
    files.write_json(rows, path, {"seed": "42"})
    read = spark.read.schema("event_type string, value double, _run struct<seed:string>").json(path)
    return tidy(read.groupBy("event_type", F.col("_run.seed").alias("seed")).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.avg("value").alias("mean_value")), 4)


NAMES = (
    "findings duplicate_share_by_hour null_totals histogram_record basket_sparsity monthly_mean impossible_cells strategy_verdict rule_choices delimited_customers text_baskets tagged_people json_lines"
).split()
QUERIES = {n: globals()[n] for n in NAMES}


def _share(t: str, c: str, what: str, where: str) -> str:
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{what}' AS finding, count(*) FILTER ({where}) AS n_found, count(*) AS n_rows FROM {t}"


def _repeated(t: str, keys: str) -> str:
    return f"SELECT '{t}' AS table_name, '{keys}' AS column_name, 'repeated' AS finding, coalesce(sum(n - 1), 0)::BIGINT AS n_found, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY {keys})"


FINDINGS = " UNION ALL ".join(
    [
        _share("lineitem", "l_discount", "out of range", "NOT l_discount BETWEEN 0.0 AND 0.1"),
        _share("lineitem", "l_quantity", "not positive", "l_quantity <= 0"),
        _share("orders", "o_orderpriority", "stand-in for unknown", "o_orderpriority = '4-NOT SPECIFIED'"),
        _share("customer", "c_acctbal", "negative", "c_acctbal < 0"),
        _share("part", "p_size", "null", "p_size IS NULL"),
        _repeated("lineitem", "l_orderkey, l_partkey, l_suppkey"),
        _repeated("part", "p_name, p_brand, p_type, p_size"),
    ]
)
NULLS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows FROM {t}"
    for t in ("customer", "documents", "events", "lineitem", "orders", "part")
    for c in SCHEMAS[t].names
)
HOLD = f"SELECT day, next_ret - CASE WHEN row_number() OVER (ORDER BY day) = 1 THEN 0.001 ELSE 0 END AS r FROM ({markets.SIGNAL})"
REVERSAL = f"SELECT day, position * next_ret - turnover * 0.001 AS r FROM ({markets.SIGNAL})"
ORACLES = {
    "findings": f"""SELECT row_number() OVER (ORDER BY place, n_found DESC, table_name, column_name, finding) AS rank, ['high', 'medium', 'low', 'clean'][place + 1] AS severity, table_name, column_name, finding, n_found, n_rows, round(share, 6) AS share,
'| ' || ['high', 'medium', 'low', 'clean'][place + 1] || ' | ' || table_name || ' | ' || column_name || ' | ' || finding || ' | ' || n_found || ' |' AS line
FROM (SELECT *, CASE WHEN share >= 0.05::DOUBLE THEN 0 WHEN share >= 0.01::DOUBLE THEN 1 WHEN n_found > 0 THEN 2 ELSE 3 END AS place FROM (SELECT *, n_found / nullif(n_rows, 0) AS share FROM ({FINDINGS})))""",
    "duplicate_share_by_hour": """SELECT hour, count(*) AS n_rows, round(avg((c > 1)::INT), 6) AS share FROM (SELECT hour(ts) AS hour, count(*) OVER (PARTITION BY user_id, event_type, props) AS c FROM events) GROUP BY 1""",
    "null_totals": f"SELECT table_name, sum(n_null)::BIGINT AS n_null, sum(n_rows)::BIGINT AS n_cells FROM ({NULLS}) GROUP BY ROLLUP (table_name)",
    "histogram_record": """WITH e AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders), b AS (SELECT unnest(range(20)) AS bin),
c AS (SELECT greatest(0, least(floor((o_totalprice - low) / (high - low) * 20), 19))::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1),
h AS (SELECT bin, low + bin * ((high - low) / 20) AS a, low + (bin + 1) * ((high - low) / 20) AS z, coalesce(n, 0) AS n FROM b CROSS JOIN e LEFT JOIN c USING (bin))
SELECT (SELECT string_agg(printf('%.6f', a), ',' ORDER BY bin) FROM h) AS edges, (SELECT string_agg(printf('%.6f', (a + z) / 2), ',' ORDER BY bin) FROM h) AS centres, (SELECT string_agg(n::VARCHAR, ',' ORDER BY bin) FROM h) AS counts,
count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high FROM orders""",
    "basket_sparsity": f"WITH {mines.ROWS}, z AS (SELECT basket, count(*) AS n FROM b GROUP BY 1) SELECT count(*) AS n_baskets, (SELECT count(DISTINCT item) FROM b) AS n_items, sum(n)::BIGINT AS n_held, round(avg((n = 1)::INT), 6) AS single_share, round(1 - sum(n) / (count(*) * (SELECT count(DISTINCT item) FROM b)), 6) AS sparsity FROM z",
    "monthly_mean": "SELECT date_trunc('month', o_orderdate)::DATE AS month, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1",
    "impossible_cells": "SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(*) FILTER (l_linestatus = 'O' AND l_shipdate <= (SELECT max(l_shipdate) FROM lineitem WHERE l_returnflag = 'R')) AS n_odd FROM lineitem GROUP BY 1, 2",
    "strategy_verdict": f"""WITH p AS ({markets._performance(REVERSAL, 'reversal')}), h AS ({markets._performance(HOLD, 'hold')})
SELECT p.annual_return, p.sharpe, p.max_drawdown, h.annual_return AS hold_annual_return, h.sharpe AS hold_sharpe, h.max_drawdown AS hold_max_drawdown,
CASE WHEN p.sharpe IS NULL OR h.sharpe IS NULL THEN 'undecided' WHEN p.annual_return > h.annual_return AND p.sharpe > h.sharpe THEN 'better than holding' WHEN p.sharpe > h.sharpe THEN 'less return for less risk' WHEN p.annual_return > h.annual_return THEN 'more return for more risk' ELSE 'worse than holding' END AS verdict FROM p, h""",
    "rule_choices": f"SELECT antecedent, consequent FROM ({mines.ORACLES['rules_top_lift']}) UNION SELECT antecedent, consequent FROM ({mines.ORACLES['rules_top_leverage']})",
    "delimited_customers": "SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_acctbal >= 0) AS n_numbers, round(avg(c_acctbal::DECIMAL(18, 2)::DOUBLE) FILTER (c_acctbal >= 0), 4) AS mean_balance FROM customer GROUP BY 1",
    "text_baskets": f"WITH {mines.ROWS} SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM b GROUP BY basket) GROUP BY 1",
    "tagged_people": "SELECT kind, nation::BIGINT AS nation, count(*) AS n, round(avg(balance), 4) AS mean_balance FROM (SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier) GROUP BY 1, 2",
    "json_lines": "SELECT event_type, '42' AS seed, count(*) AS n, count(*) FILTER (value <= 50) AS n_values, round(avg(value) FILTER (value <= 50), 4) AS mean_value FROM events GROUP BY 1",
}
