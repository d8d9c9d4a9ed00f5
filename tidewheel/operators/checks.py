"""Checks of tables whose findings are ranked by how grave they are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import ratio

#: Severities by the least share of rows, gravest first; a finding of any row at all is the last of them.
SEVERITIES = (("high", 0.05), ("medium", 0.01), ("low", 0.0))


def share_where(df: DataFrame, name: str, column: str, what: str, condition: Column) -> DataFrame:
    """One finding: table_name, column_name, finding, n_found, n_rows."""
    return df.agg(F.count_if(condition).alias("n_found"), F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit(what).alias("finding"), "n_found", "n_rows")


def repeated(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """The finding of rows that repeat another one in all keys, the first of each not counted."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    one = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return one.select(F.lit(name).alias("table_name"), F.lit(", ".join(keys)).alias("column_name"), F.lit("repeated").alias("finding"), "n_found", "n_rows")


def report(findings: Sequence[DataFrame]) -> DataFrame:
    """Findings with share, severity, rank (gravest and most frequent first) and a line of a table of text."""
    rows = reduce(DataFrame.unionByName, findings).withColumn("share", ratio(F.col("n_found"), F.col("n_rows")))
    place = F.when(F.col("share") >= SEVERITIES[0][1], 0).when(F.col("share") >= SEVERITIES[1][1], 1).when(F.col("n_found") > 0, 2).otherwise(3)
    names = F.array(*[F.lit(s) for s, _ in SEVERITIES], F.lit("clean"))
    rows = rows.withColumn("place", place).withColumn("severity", F.element_at(names, F.col("place") + 1))
    rank = F.row_number().over(W.orderBy("place", F.desc("n_found"), "table_name", "column_name", "finding")).cast("long")
    line = F.format_string("| %s | %s | %s | %s | %d |", "severity", "table_name", "column_name", "finding", "n_found")
    return rows.select(rank.alias("rank"), "severity", "table_name", "column_name", "finding", "n_found", "n_rows", "share", line.alias("line"))
