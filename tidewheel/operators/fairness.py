"""Group audits of a decision: cells and rates by group, criteria, identity, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import ratio
from tidewheel.operators.evaluation import cells, rates


def by_group(df: DataFrame, group: str, y: str, score: str, threshold: float, least: int) -> DataFrame:
    """Cells and rates of each group; eligible tells whether it has the least number of rows."""
    counts = df.groupBy(F.col(group).alias("group")).agg(*cells(F.col(y), F.col(score) >= threshold))
    return rates(counts).withColumn("eligible", F.col("n") >= least)


def criteria(groups: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Each criterion's least and greatest rate with the groups that have them, their gap and ratio, and rank by gap."""
    names = {"demographic_parity": "selection_rate", "equal_fnr": "fnr", "equal_fpr": "fpr", "predictive_parity": "ppv"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(v).alias("rate")) for k, v in names.items()])).alias("c")
    rows = groups.where("eligible").select("group", each).select("group", "c.criterion", "c.rate").where("rate is not null")
    low, high = F.min(F.struct("rate", "group")), F.max(F.struct("rate", (-F.ascii("group")).alias("t"), "group"))
    one = rows.groupBy("criterion").agg(low.alias("l"), high.alias("h"))
    gap = F.col("h.rate") - F.col("l.rate")
    out = one.select(
        "criterion", F.col("l.rate").alias("least"), F.col("l.group").alias("least_group"), F.col("h.rate").alias("most"), F.col("h.group").alias("most_group"),
        gap.alias("gap"), ratio(F.col("l.rate"), F.col("h.rate")).alias("share"), (gap < tolerance).alias("satisfied"),
    )
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("gap", 9)), "criterion")).cast("long"))


def identity(groups: DataFrame) -> DataFrame:
    """FPR beside what base rate, PPV and FNR imply: p / (1 - p) * (1 - PPV) / PPV * (1 - FNR)."""
    p, v = F.col("base_rate"), F.col("ppv")
    implied = p / F.nullif(1 - p, F.lit(0.0)) * (1 - v) / F.nullif(v, F.lit(0.0)) * (1 - F.col("fnr"))
    return groups.where("eligible").select("group", "fpr", implied.alias("implied_fpr"), F.abs(F.col("fpr") - implied).alias("gap"))


def calibration(df: DataFrame, group: str, y: str, score: str, bins: int = 10) -> DataFrame:
    """Rows, outcome rate and share of the group in each tenth of the score range."""
    decile = F.least(F.lit(bins), F.floor(F.col(score) * bins) + 1).cast("long")
    rows = df.groupBy(F.col(group).alias("group"), decile.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("outcome_rate"))
    return rows.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy("group"))))
