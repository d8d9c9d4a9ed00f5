"""Contingency statistics, exact tests, rates of false discovery, effect sizes and rank correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import ratio
from tidewheel.functions.special import chi_square_p, t_p


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """All cells of two columns' values: a, b, n; pairs that do not occur have zero."""
    counts = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    values = counts.agg(F.collect_set("a").alias("x"), F.collect_set("b").alias("y"))  # of two categories, not rows
    grid = values.select(F.explode("x").alias("a"), "y").select("a", F.explode("y").alias("b"))
    return grid.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def chi_square(cells: DataFrame, by: Sequence[str] = (), yates: bool = False) -> DataFrame:
    """Statistic, degrees of freedom, its chance p and Cramer's V of cells (a, b, n), per value of by.

    yates takes one half from each difference where there is one degree of freedom.
    """
    every = W.partitionBy(*by)
    rows = cells.withColumns(
        {"ra": F.sum("n").over(W.partitionBy(*by, "a")), "cb": F.sum("n").over(W.partitionBy(*by, "b")), "total": F.sum("n").over(every)}
    )
    expected = F.col("ra") * F.col("cb") / F.nullif(F.col("total"), F.lit(0))
    gap = F.abs(F.col("n") - expected)
    plain, less = gap * gap / F.nullif(expected, F.lit(0.0)), (gap - F.least(F.lit(0.5), gap)) ** 2 / F.nullif(expected, F.lit(0.0))
    one = rows.groupBy(*by).agg(
        F.sum(plain).alias("plain"), F.sum(less).alias("less"), F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"), F.max("total").alias("n")
    )
    dof = (F.col("na") - 1) * (F.col("nb") - 1)
    stat = F.when(F.lit(yates) & (dof == 1), F.col("less")).otherwise(F.col("plain"))
    room = F.col("n") * (F.least("na", "nb") - 1)
    return one.select(*by, stat.alias("chi2"), dof.cast("long").alias("dof"), "n", F.sqrt(stat / F.nullif(room, F.lit(0))).alias("cramers_v")).withColumn("p", chi_square_p(F.col("chi2"), F.col("dof")))


def normality(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, skew, kurtosis (excess), the statistic of Jarque and Bera and its chance p, per value of by; null where the values do not vary."""
    v = F.col(column).cast("double")
    one = df.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"))
    skew, kurtosis = F.nanvl("skew", F.lit(None).cast("double")), F.nanvl("kurtosis", F.lit(None).cast("double"))
    stat = F.col("n") / 6 * (skew * skew + kurtosis * kurtosis / 4)
    return one.select(*by, "n", skew.alias("skew"), kurtosis.alias("kurtosis"), stat.alias("statistic")).withColumn("p", F.exp(-F.col("statistic") / 2))


def fisher_tail(both: Column, a: Column, b: Column, n: Column) -> Column:
    """The chance of as many joint rows or more, given the margins a and b among n rows (Fisher's exact test, one-sided).

    The first term comes from log-gammas, each next one from a ratio; the sum
    stops where terms fall below 1e-17 of it.
    """

    def tails(both: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_tail(*map(int, cells)) for cells in zip(both, a, b, n, strict=True)], dtype=float)

    return F.pandas_udf(tails, "double")(both, a, b, n)


def _tail(k: int, a: int, b: int, n: int, chunk: int = 4096) -> float:
    lowest, highest = max(0, a + b - n), min(a, b)
    if k <= lowest:
        return 1.0
    lg = math.lgamma
    top = lg(a + 1) + lg(n - a + 1) + lg(b + 1) + lg(n - b + 1) - lg(n + 1)
    log_term = top - lg(k + 1) - lg(a - k + 1) - lg(b - k + 1) - lg(n - a - b + k + 1)
    total, mode = 0.0, (a + 1) * (b + 1) // (n + 2)
    while k <= highest:
        i = np.arange(k, min(k + chunk, highest + 1), dtype=float)
        steps = np.log(a - i) + np.log(b - i) - np.log(i + 1) - np.log(n - a - b + i + 1) if i[-1] < highest else None
        if steps is None:
            inner = i[:-1]
            steps = np.append(np.log(a - inner) + np.log(b - inner) - np.log(inner + 1) - np.log(n - a - b + inner + 1), 0.0)
        terms = log_term + np.concatenate([[0.0], np.cumsum(steps[:-1])])
        total += float(np.exp(terms).sum())
        k, log_term = k + len(i), float(terms[-1] + steps[-1])
        if k > mode and math.exp(log_term) < 1e-17 * total:
            break
    return min(1.0, total)


def false_discovery(df: DataFrame, p: str, alpha: float) -> DataFrame:
    """Adds q (step-up, by distinct p) and significant."""
    counts = df.groupBy(F.col(p).alias("p_")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.orderBy("p_"))
    rows = counts.select("p_", (F.col("p_") * F.sum("c").over(W.partitionBy()) / upto).alias("raw"))
    q = F.least(F.lit(1.0), F.min("raw").over(W.orderBy(F.desc("p_")).rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.select("p_", q.alias("q"))
    return df.join(rows, F.col(p) == F.col("p_")).drop("p_").withColumn("significant", F.col("q") <= alpha)


def cohens_d(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Difference of class means over the pooled sample deviation, by column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    rows = df.select(F.col(y).alias("y"), pairs).select("y", "x.feature", "x.v")
    pos, neg = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
    one = rows.groupBy("feature").agg(
        F.avg(pos).alias("m1"), F.avg(neg).alias("m0"), F.var_samp(pos).alias("v1"), F.var_samp(neg).alias("v0"), F.count(pos).alias("n1"), F.count(neg).alias("n0")
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0)))
    return one.select("feature", "m1", "m0", ((F.col("m1") - F.col("m0")) / F.nullif(pooled, F.lit(0.0))).alias("d"))


def mid_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the mean rank of the row's value among all rows; ranks are taken over distinct values."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = running_total(counts, "_v", "_c", "_upto")
    ranks = upto.select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


#: Cells of a value range over which running totals are taken first.
CELLS = 1024


def running_total(counts: DataFrame, value: str, n: str, name: str, by: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Adds the sum of n over all values (of the row's group by) up to the row's, null being the least; and the sum of all n as total, if named.

    Totals are taken over equal cells of the value range and within them, so no
    task holds all distinct values.
    """
    span = counts.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    cell = F.least(F.floor((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0)) * CELLS), F.lit(CELLS - 1))
    rows = _beside(counts, span, by).withColumn("_cell", F.when(F.col(value).isNull(), -1).otherwise(F.coalesce(cell, F.lit(0)))).drop("_low", "_high")
    sums = rows.groupBy(*by, "_cell").agg(F.sum(n).alias("_n"))
    before = sums.select(*by, "_cell", (F.sum("_n").over(W.partitionBy(*by).orderBy("_cell")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("_total"))
    inside = F.sum(n).over(W.partitionBy(*by, "_cell").orderBy(value))
    out = _beside(rows, before, [*by, "_cell"]).withColumn(name, F.col("_before") + inside).drop("_cell", "_before")
    return out.withColumnRenamed("_total", total) if total else out.drop("_total")


def _beside(rows: DataFrame, sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the sums of their group; nulls are a group."""
    if not by:
        return rows.join(F.broadcast(sums))  # one row
    named = sums.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return rows.join(named, same).drop(*[f"_of_{c}" for c in by])


def quantiles(df: DataFrame, column: str, shares: Sequence[float], name: str, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each value of by: name, the column's quantiles at the shares, linear between neighbours; nulls and NaN are left out.

    Without values there is one row of null, or none for that group. Values are
    counted first; each distinct one knows the places that its rows fill.
    """
    v = F.col(column).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    rows = running_total(counts, "_v", "_c", "_upto", by, "_all").withColumn("_first", F.col("_upto") - F.col("_c"))
    ends = []
    for i, share in enumerate(shares):
        place = (F.col("_all") - 1) * F.lit(float(share))
        for side, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            ends.append(F.max(F.when((F.col("_first") <= at) & (at < F.col("_upto")), F.col("_v"))).alias(f"_{side}{i}"))
    one = rows.groupBy(*by).agg(F.max("_all").alias("_all"), *ends)

    def between(i: int, share: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(float(share))
        return F.col(f"_low{i}") + (place - F.floor(place)) * (F.col(f"_high{i}") - F.col(f"_low{i}"))

    found = F.array(*[between(i, share) for i, share in enumerate(shares)])
    return one.select(*by, F.when(F.col("_all").isNotNull(), found).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, number of rows, and the two-sided chance p by Student's t (0 at a correlation of one)."""
    rows = mid_rank(mid_rank(df.select(a, b).dropna(), a, "ra"), b, "rb")
    one = rows.agg(F.corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n"))
    r, dof = F.col("spearman"), F.col("n") - 2
    apart = F.nullif(F.greatest(1 - r * r, F.lit(0.0)), F.lit(0.0))
    return one.withColumn("p", F.when(r.isNotNull() & apart.isNull(), 0.0).otherwise(t_p(r * F.sqrt(dof / apart), dof)))


def likelihoods(df: DataFrame, y: str, column: str) -> DataFrame:
    """P(value | class) with the class's prior, for each value and class that occur."""
    rows = df.groupBy(F.col(y).alias("y"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    of_class, every = F.sum("n").over(W.partitionBy("y")), F.sum("n").over(W.partitionBy())
    return rows.select("y", "value", "n", ratio(F.col("n"), of_class).alias("likelihood"), ratio(of_class, every).alias("prior"))


def posterior(tables: DataFrame) -> DataFrame:
    """P(class | value) from likelihoods."""
    joint = F.col("likelihood") * F.col("prior")
    return tables.withColumn("posterior", joint / F.sum(joint).over(W.partitionBy("value")))


def bayes_table(df: DataFrame, y: str, columns: Sequence[str], smoothing: float = 1.0) -> DataFrame:
    """The model of a categorical naive Bayes classifier as rows: y, feature, level, n, score.

    score is the smoothed log-likelihood of the level within the class. The row
    of a null feature holds the log-prior; rows of a null level, with n = 0,
    hold what a level unseen in training counts. Null values are a level of
    their own, written as the empty string with a zero byte.
    """
    long = df.select(F.col(y).alias("y"), F.explode(_levels(columns)).alias("x")).select("y", "x.feature", "x.level")
    counts = long.groupBy("y", "feature", "level").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy("feature").agg((F.countDistinct("level") + 1).alias("kinds"))  # and one for the unseen
    classes = df.groupBy(F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("of"))
    grid = counts.select("feature", "level").distinct().unionByName(kinds.select("feature", F.lit(None).cast("string").alias("level")))
    every = classes.agg(F.collect_list(F.struct("y", "of")).alias("classes"))  # one row; classes are few
    cells = grid.join(F.broadcast(every)).select("feature", "level", F.explode("classes").alias("c")).select("feature", "level", "c.y", "c.of").join(kinds, "feature")
    same = (F.col("y") == F.col("cy")) & (F.col("feature") == F.col("cf")) & (F.col("level") == F.col("cl"))
    named = counts.withColumnsRenamed({"y": "cy", "feature": "cf", "level": "cl"})
    found = cells.join(named, same, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = F.ln((F.col("n") + smoothing) / (F.col("of") + smoothing * F.col("kinds")))
    prior = classes.select("y", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("level"), F.col("of").alias("n"), F.ln(F.col("of") / F.sum("of").over(W.partitionBy())).alias("score"))
    return found.select("y", "feature", "level", "n", score.alias("score")).unionByName(prior)


def _levels(columns: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias("level")) for c in columns])


def bayes_scores(df: DataFrame, key: str, model: DataFrame, columns: Sequence[str]) -> DataFrame:
    """key, y, probability: each class's posterior for each row (keys are distinct), by joining the row's levels with the model."""
    long = df.select(F.col(key).alias("key"), F.explode(_levels(columns)).alias("x")).select("key", "x.feature", "x.level")
    levels, unseen = model.where("level is not null"), model.where("feature is not null and level is null")
    seen = levels.groupBy("feature", "level").agg(F.collect_list(F.struct("y", "score")).alias("scores"))  # one entry a class
    other = unseen.groupBy("feature").agg(F.collect_list(F.struct("y", "score")).alias("other"))
    met = long.join(seen, ["feature", "level"], "left").join(F.broadcast(other), "feature")
    each = met.select("key", F.explode(F.coalesce("scores", "other")).alias("s")).select("key", "s.y", "s.score")
    total = each.groupBy("key", "y").agg(F.sum("score").alias("score"))
    prior = F.broadcast(model.where("feature is null").select("y", F.col("score").alias("prior")))
    joint = total.join(prior, "y").withColumn("joint", F.col("score") + F.col("prior"))
    of = W.partitionBy("key")
    share = F.exp(F.col("joint") - F.max("joint").over(of))
    return joint.withColumn("share", share).select("key", "y", (F.col("share") / F.sum("share").over(of)).alias("probability"))


def entropy(df: DataFrame, symbol: str, n: str) -> DataFrame:
    """Entropy in nats, perplexity and number of symbols of a table of counts."""
    share = F.col(n) / F.sum(n).over(W.partitionBy())
    one = df.select(share.alias("p")).agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), F.count(F.lit(1)).alias("symbols"))
    return one.select("symbols", "entropy", F.exp("entropy").alias("perplexity"))
