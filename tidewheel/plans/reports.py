"""Queries over a JSON report for each nation, written from its customers' orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewheel.operators import reports
from tidewheel.sources.scratch import shared_dir
from tidewheel.sources.tables import table

#: The canonical order of phases, and the share of a nation's orders from which a priority is recorded.
ORDER, LEAST, MOST_BYTES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), 0.2, 2000


def _written(spark, sf_dir):
    """The folder of reports, a file for each nation in a folder named for its region; nations that record all phases have a note."""
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "n_regionkey")
    counts = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "n_regionkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("n_name", "n_regionkey").agg(F.sum("n").alias("total"), F.collect_list(F.struct("n", "o_orderpriority")).alias("x"))
    kept = F.reverse(F.array_sort(F.filter("x", lambda x: x["n"] >= F.col("total") * LEAST)))  # out of order, as records are
    told = F.transform(kept, lambda x: F.struct(x["o_orderpriority"].alias("name"), F.format_string("%d orders", x["n"]).alias("summary")))
    note = F.when(F.size(kept) >= 3, "three phases or more")
    best = F.when(F.size(kept) > 0, F.struct(kept[0]["o_orderpriority"].alias("name"), kept[0]["n"].alias("n")))
    body = F.to_json(F.struct(F.col("n_name").alias("project"), "total", told.alias("phases"), best.alias("best"), note.alias("note")))
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    whole.select(body.alias("value"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation")).write.partitionBy("nation", "region").text(path)
    return path


def _reports(spark, sf_dir):
    return reports.read_reports(spark, _written(spark, sf_dir))


def report_sizes(spark, sf_dir):
    return reports.sizes(_reports(spark, sf_dir), MOST_BYTES)


def report_fields(spark, sf_dir):
    return reports.fields(_reports(spark, sf_dir)).where("key != 'best' and key != 'phases'")


def report_headlines(spark, sf_dir):
    paths = {"project": ("$.project", "string"), "total": ("$.total", "bigint"), "best": ("$.best.name", "string"), "best_n": ("$.best.n", "bigint"), "note": ("$.note", "string"), "absent": ("$.nothing.here", "string")}
    return reports.headlines(_reports(spark, sf_dir), paths).drop("name", "folder")


def report_phases(spark, sf_dir):
    rows = reports.phases(_reports(spark, sf_dir), "$.project", "$.phases", ORDER)
    told = F.array_join(F.transform("phases", lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["summary"])), ",")
    return rows.select("project", told.alias("phases"), "recorded", F.array_join("missing", ",").alias("missing"), "complete")


NAMES = "report_sizes report_fields report_headlines report_phases".split()
QUERIES = {n: globals()[n] for n in NAMES}

BASE = f"""c AS (SELECT n_name, n_regionkey, o_orderpriority AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY n_name) AS total FROM c),
r AS (SELECT n_name AS project, any_value(n_regionkey) AS region, any_value(total)::BIGINT AS total, coalesce(list({{'n': n, 'p': p}} ORDER BY n DESC, p DESC) FILTER (n >= total * {LEAST}::DOUBLE), []) AS k FROM t GROUP BY 1)"""
PLACES = ", ".join(f"'{p}'" for p in ORDER)
ORACLES = {
    "report_sizes": f"""WITH {BASE}, s AS (SELECT 'region=' || region AS folder, 1 + strlen('{{"project":"' || project || '","total":' || total || ',"phases":[' || array_to_string([('{{"name":"' || x.p || '","summary":"' || x.n || ' orders"}}') FOR x IN k], ',') || ']'
|| CASE WHEN len(k) > 0 THEN ',"best":{{"name":"' || k[1].p || '","n":' || k[1].n || '}}' ELSE '' END || CASE WHEN len(k) >= 3 THEN ',"note":"three phases or more"' ELSE '' END || '}}') AS bytes FROM r)
SELECT folder, count(*) AS n_files, 0::BIGINT AS n_invalid, sum(bytes)::BIGINT AS bytes, sum(bytes) > {MOST_BYTES} AS too_large FROM s GROUP BY ROLLUP (folder)""",
    "report_fields": f"""WITH {BASE} SELECT 'project' AS key, 'STRING' AS kind, count(*) AS n_reports FROM r UNION ALL SELECT 'total', 'BIGINT', count(*) FROM r UNION ALL SELECT 'note', 'STRING', count(*) FROM r WHERE len(k) >= 3""",
    "report_headlines": f"""WITH {BASE} SELECT project, total, k[1].p AS best, k[1].n AS best_n, CASE WHEN len(k) >= 3 THEN 'three phases or more' END AS note, NULL::VARCHAR AS absent FROM r""",
    "report_phases": f"""WITH {BASE} SELECT project, array_to_string([i || ':' || x.n || ' orders' FOR x, i IN [list_filter(k, lambda y: y.p = o)[1] FOR o IN [{PLACES}]] IF x IS NOT NULL], ',') AS phases, len(k)::BIGINT AS recorded,
array_to_string(list_filter([{PLACES}], lambda o: NOT list_contains([x.p FOR x IN k], o)), ',') AS missing, len(k) = {len(ORDER)} AS complete FROM r""",
}
