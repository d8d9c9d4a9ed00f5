"""Many regular series at once: partial autocorrelation, unit roots and stationarity, robust decomposition.

A series is one value of a key with one row a time step, so its length is the
number of steps, however many rows were aggregated into them; windows and
arrays hold a series. All is in expressions: no Python worker.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions.special import interpolated, let, normal_share, polynomial
from tidewheel.operators.regress import leading, products, swept
from tidewheel.sources.scratch import written

# Response surface for the chance of the unit-root statistic with a constant (MacKinnon 1994), and critical values of the stationarity statistic.
UNIT_ROOT = {"least": -18.83, "most": 2.74, "small_up_to": -1.61, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)}
STATIONARITY = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def centred(series: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """key, pos (from 1), n, c: each series in order, less its mean; null values are left out."""
    rows = series.where(F.col(value).isNotNull())
    of = W.partitionBy(key)
    c = F.col(value).cast("double") - F.avg(F.col(value).cast("double")).over(of)
    return rows.select(key, F.row_number().over(of.orderBy(time)).alias("pos"), F.count(F.lit(1)).over(of).alias("n"), c.alias("c"))


def lagged_products(rows: DataFrame, key: str, most: int) -> DataFrame:
    """key, lag (0..most), n, s: sums of products of centred values so many steps apart; lags that a series is too short for are left out."""
    back = F.collect_list("c").over(W.partitionBy(key).orderBy("pos").rowsBetween(-most, 0))
    pairs = rows.withColumn("back", back).select(key, "n", "c", F.posexplode(F.reverse("back")).alias("lag", "d"))
    return pairs.groupBy(key, "lag").agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col("d")).alias("s"))


def partial_autocorrelation(series: DataFrame, key: str, time: str, value: str, most: int = 60) -> DataFrame:
    """key, lag, acf, pacf for lags from 1 to least(most, n / 3): by Durbin and Levinson from covariances over the number of their pairs.

    acf has the usual denominator. Series without variation have none.
    """
    sums = lagged_products(centred(series, key, time, value), key, most).where(F.col("lag") <= F.floor(F.col("n") / 3))
    ordered = F.array_sort(F.collect_list(F.struct("lag", "s")))
    arrays = sums.groupBy(key).agg(F.max("n").alias("n"), ordered.alias("x")).where((F.size("x") > 1) & (F.col("x")[0]["s"] > 0))
    rho = F.transform("x", lambda x: x["s"] / F.col("x")[0]["s"] * F.col("n") / (F.col("n") - x["lag"]))
    arrays = arrays.withColumn("rho", rho)

    def step(s: Column, k: Column) -> Column:
        earlier = F.reverse(F.slice("rho", F.lit(2), F.greatest(k - 1, F.lit(0))))
        told = F.aggregate(F.zip_with(s["phi"], earlier, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        return let(
            (F.get(F.col("rho"), k) - told) / s["left"],
            lambda a: F.struct(
                F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda p, r: p - a * r), F.array(a)).alias("phi"),
                (s["left"] * (1 - a * a)).alias("left"),
                F.concat(s["out"], F.array(a)).alias("out"),
            ),
        )

    none = F.array().cast("array<double>")
    begin = F.struct(none.alias("phi"), F.lit(1.0).alias("left"), none.alias("out"))
    found = F.aggregate(F.sequence(F.lit(1), F.size("rho") - 1), begin, step, lambda s: s["out"])
    rows = arrays.select(key, "x", F.posexplode(found).alias("i", "pacf"))
    return rows.select(key, (F.col("i") + 1).cast("long").alias("lag"), (F.get("x", F.col("i") + 1)["s"] / F.col("x")[0]["s"]).alias("acf"), "pacf")


def _most_lags(n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2)).cast("int")


def unit_root(rows: DataFrame, key: str) -> DataFrame:
    """key, n, lags, adf, adf_p: the augmented Dickey-Fuller statistic with a constant, lags by Akaike's criterion, and its chance.

    All numbers of lags are compared on the rows that the largest leaves; one
    matrix of products serves them, as each further lag is one more sweep. The
    statistic comes from a second matrix over all rows that the chosen number
    leaves. Series of fewer than 8 steps or without variation have nulls. rows
    are centred ones.
    """
    ends = rows.groupBy(key).agg(F.max("n").alias("n"), F.max(F.abs("c")).alias("size"))
    longest = ends.agg(F.max("n")).first()[0] or 0
    most = max(0, min(math.ceil(12 * (longest / 100) ** 0.25), longest // 2 - 2))
    of = W.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("step", F.col("c") - F.lag("c").over(of))
    rows = rows.withColumns({"level": F.lag("c").over(of), "room": _most_lags(F.col("n")), **{f"step_{i}": F.lag("step", i).over(of) for i in range(1, most + 1)}})
    columns = [F.lit(1.0), F.col("level"), *[F.col(f"step_{i}") for i in range(1, most + 1)], F.col("step")]
    fit = products(rows.where(F.col("pos") > F.col("room") + 1), [key, "room"], columns)
    # After the constant and the level are swept, each further sweep adds a lag.
    rss = F.slice(swept(leading(F.col("m"), F.col("room") + 2), F.col("room") + 2)["rss"], F.lit(3), F.col("room") + 1)
    n = F.col("n").cast("double")
    criterion = F.transform(rss, lambda r, p: n * (F.ln(2 * math.pi * r / n) + 1) + 2 * (p + 2))
    fit = fit.withColumn("aic", criterion)
    lags = fit.select(key, (F.array_position("aic", F.array_min("aic")) - 1).cast("int").alias("lags"))
    again = rows.join(lags, key).where(F.col("pos") > F.col("lags") + 1)
    last = products(again, [key, "lags"], columns)
    k = F.col("lags") + 2
    last = last.withColumn("s", swept(leading(F.col("m"), k), k))
    level = F.get(F.col("s.m"), F.lit(1))
    spread = F.element_at(F.col("s.rss"), -1) / (n - k) * -F.get(level, F.lit(1))
    stat = last.select(key, "lags", (F.element_at(level, -1) / F.sqrt(F.when(spread > 0, spread))).alias("adf"))
    out = ends.join(stat, key, "left")
    usable = (F.col("n") >= 8) & (F.col("size") > 0)
    tau = F.when(usable, F.col("adf"))
    surface = F.when(tau <= UNIT_ROOT["small_up_to"], polynomial(tau, UNIT_ROOT["small"])).otherwise(polynomial(tau, UNIT_ROOT["large"]))
    chance = F.when(tau > UNIT_ROOT["most"], 1.0).when(tau < UNIT_ROOT["least"], 0.0).otherwise(normal_share(surface))
    return out.select(key, "n", F.when(usable, F.col("lags")).cast("long").alias("adf_lags"), tau.alias("adf"), F.when(tau.isNotNull(), chance).alias("adf_p"))


def stationarity(rows: DataFrame, key: str) -> DataFrame:
    """key, kpss_lags, kpss, kpss_p: the statistic of Kwiatkowski and others around a constant, lags by the rule of Hobijn and others.

    The chance is read off the four published critical values, so it lies
    between 0.01 and 0.1. Series without variation have nulls. rows are
    centred ones.
    """
    longest = rows.agg(F.max("n")).first()[0] or 0
    near = F.floor(F.pow(F.col("n").cast("double"), F.lit(2 / 9)) + 1e-12)
    few = lagged_products(rows, key, max(1, int(longest ** (2 / 9) + 1e-12)))
    pair = F.when(F.col("lag") == 0, F.col("s") / F.col("n")).when(F.col("lag") <= near, 2 * F.col("s") / F.col("n")).otherwise(0.0)
    rule = few.groupBy(key).agg(F.max("n").alias("n"), F.sum(pair).alias("s0"), F.sum(pair * F.col("lag")).alias("s1"))
    ratio = F.col("s1") / F.nullif(F.col("s0"), F.lit(0.0))
    lags = F.least(F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow(F.col("n").cast("double"), F.lit(1 / 3))), F.col("n") - 1)
    rule = rule.select(key, F.coalesce(lags, F.lit(0)).cast("int").alias("lags"))
    most = rule.agg(F.max("lags")).first()[0] or 0
    weighted = lagged_products(rows, key, max(1, most)).join(rule, key).where(F.col("lag") <= F.col("lags"))
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.col("lags") + 1)))
    spread = weighted.groupBy(key).agg(F.max("lags").alias("lags"), (F.sum(weight * F.col("s")) / F.max("n")).alias("spread"))
    sums = rows.withColumn("upto", F.sum("c").over(W.partitionBy(key).orderBy("pos")))
    eta = sums.groupBy(key).agg((F.sum(F.col("upto") * F.col("upto")) / F.max("n") / F.max("n")).alias("eta"), F.max(F.abs("c")).alias("size"))
    stat = F.when((F.col("size") > 0) & (F.col("spread") > 0), F.col("eta") / F.col("spread"))
    out = eta.join(spread, key).withColumn("kpss", stat)
    return out.select(key, F.when(stat.isNotNull(), F.col("lags")).cast("long").alias("kpss_lags"), "kpss", F.when(stat.isNotNull(), interpolated(F.col("kpss"), STATIONARITY)).alias("kpss_p"))


def verdict(adf_p: Column, kpss_p: Column, alpha: float = 0.05) -> Column:
    """What both tests say together; their null hypotheses are opposite."""
    rejects, keeps = adf_p < alpha, kpss_p > alpha
    return (
        F.when(adf_p.isNull() | kpss_p.isNull(), "undecided")
        .when(rejects & keeps, "stationary")
        .when(~rejects & ~keeps, "unit root")
        .when(rejects, "stationary around a trend")
        .otherwise("too little evidence")
    )


def unit_roots(series: DataFrame, key: str, time: str, value: str) -> DataFrame:
    rows = written(centred(series, key, time, value), "series-centred")
    both = unit_root(rows, key).join(stationarity(rows, key), key, "left")
    return both.withColumn("verdict", verdict(F.col("adf_p"), F.col("kpss_p")))


def _local_line(y: Column, w: Column | None, left: Column, right: Column, x: Column, n: Column, q: int) -> Column:
    """The value at x of the line fitted to y[left..right] (from 1) with tricube weights times w; null where all weights are zero."""
    reach = F.greatest(x - left, right - x) + F.when(F.lit(q) > n, F.floor((q - n) / 2)).otherwise(0)

    def sums(h: Column) -> Column:
        def add(s: Column, j: Column) -> Column:
            r = F.abs(j - x)
            near = F.when(r <= 0.001 * h, 1.0).when(r <= 0.999 * h, F.pow(1 - F.pow(r / h, F.lit(3.0)), F.lit(3.0))).otherwise(0.0)
            weight = near if w is None else near * F.get(w, j - 1)
            return let(
                F.struct(weight.alias("w"), (j - x).cast("double").alias("d"), F.get(y, j - 1).alias("y")),
                lambda p: F.array(
                    F.get(s, F.lit(0)) + p["w"], F.get(s, F.lit(1)) + p["w"] * p["d"], F.get(s, F.lit(2)) + p["w"] * p["d"] * p["d"], F.get(s, F.lit(3)) + p["w"] * p["y"], F.get(s, F.lit(4)) + p["w"] * p["d"] * p["y"]
                ),
            )

        return F.aggregate(F.sequence(left, right), F.array(*[F.lit(0.0)] * 5), add)

    def value(s: Column) -> Column:
        total = F.get(s, F.lit(0))
        mean, flat = F.get(s, F.lit(1)) / total, F.get(s, F.lit(3)) / total
        spread = F.get(s, F.lit(2)) / total - mean * mean
        line = flat - mean / spread * (F.get(s, F.lit(4)) / total - mean * flat)
        return F.when(total > 0, F.when(F.sqrt(F.greatest(spread, F.lit(0.0))) > 0.001 * (n - 1), line).otherwise(flat))

    return let(let(reach.cast("double"), sums), value)


def _tricube(q: int) -> list[list[float]]:
    """The weights of a window of q places, for each place in it that is smoothed."""
    out = []
    for x in range(q):
        h = max(x, q - 1 - x)
        out.append([1.0 if abs(j - x) <= 0.001 * h else (1 - (abs(j - x) / h) ** 3) ** 3 if abs(j - x) <= 0.999 * h else 0.0 for j in range(q)])
    return out


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _smooth(y: Column, w: Column | None, n: Column, q: int) -> Column:
    """Local lines over q neighbours at each place; where they have no weight y stays."""
    # Constants as text: one literal each, where thousands of them would be made one by one.
    near, places = F.from_json(F.lit(json.dumps(_tricube(q))), "array<array<double>>"), F.from_json(F.lit(json.dumps(list(range(q)))), "array<double>")

    def left_of(i: Column) -> Column:
        return F.greatest(F.lit(1), F.least(i - (q + 1) // 2 + 1, n - q + 1))

    def line(i: Column, p: Column) -> Column:
        """The same as _local_line where a window is full, with weights that are known before and places counted within the window."""
        at, own = p["at"], p["y"]

        def value(a: Column, b: Column) -> Column:
            sums = F.struct(_sum(a).alias("total"), _sum(b).alias("m"), _sum(_times(b, places)).alias("s"), _sum(_times(a, own)).alias("y"), _sum(_times(b, own)).alias("my"))

            def solved(t: Column) -> Column:
                mean, flat = t["m"] / t["total"], t["y"] / t["total"]
                spread = t["s"] / t["total"] - mean * mean
                sloped = flat + (at - mean) / spread * (t["my"] / t["total"] - mean * flat)
                return F.when(t["total"] > 0, F.when(F.sqrt(F.greatest(spread, F.lit(0.0))) > 0.001 * (n - 1), sloped).otherwise(flat))

            return let(sums, solved)

        return F.coalesce(let(p["a"], lambda a: let(_times(a, places), lambda b: value(a, b))), F.get(y, i - 1))

    def full(i: Column) -> Column:
        def window(left: Column) -> Column:
            weights = F.get(near, i - left)
            weights = weights if w is None else _times(weights, F.slice(w, left, q))
            return let(F.struct((i - left).alias("at"), F.slice(y, left, q).alias("y"), weights.alias("a")), lambda p: line(i, p))

        return let(left_of(i), window)

    def partial(i: Column) -> Column:
        return F.coalesce(_local_line(y, w, F.lit(1), n, i, n, q), F.get(y, i - 1))

    every = F.sequence(F.lit(1), n)
    return F.when(n >= q, F.transform(every, full)).otherwise(F.transform(every, partial))


def _moving(y: Column, q: int) -> Column:
    """Means of q neighbours, as many as there are."""
    starts = F.sequence(F.lit(1), F.size(y) - q + 1)
    return F.transform(starts, lambda i: F.aggregate(F.slice(y, i, q), F.lit(0.0), lambda s, v: s + v) / q)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _cycles(y: Column, w: Column, n: Column, period: int, q: int) -> Column:
    """Each place's own series, a period apart, smoothed and continued by one period on either side: n + 2 period values."""

    def one(j: Column) -> Column:
        places = F.sequence(j, n, F.lit(period))

        def smoothed(p: Column) -> Column:
            own, weight, k = p["y"], p["w"], F.size(p["y"])
            before = F.coalesce(_local_line(own, weight, F.lit(1), F.least(F.lit(q), k), F.lit(0), k, q), F.get(p["s"], F.lit(0)))
            after = F.coalesce(_local_line(own, weight, F.greatest(F.lit(1), k - q + 1), k, k + 1, k, q), F.element_at(p["s"], -1))
            return F.concat(F.array(before), p["s"], F.array(after))

        pair = F.struct(F.transform(places, lambda i: F.get(y, i - 1)).alias("y"), F.transform(places, lambda i: F.get(w, i - 1)).alias("w"))
        return let(let(pair, lambda p: F.struct(p["y"].alias("y"), p["w"].alias("w"), _smooth(p["y"], p["w"], F.size(p["y"]), q).alias("s"))), smoothed)

    whole = F.transform(F.sequence(F.lit(1), F.lit(period)), one)
    places = F.transform(F.sequence(F.lit(0), n + 2 * period - 1), lambda i: i)
    return let(whole, lambda c: F.transform(places, lambda i: F.get(F.get(c, i % period), F.floor(i / period).cast("int"))))


def _odd(x: float) -> int:
    n = math.ceil(x)
    return n + 1 - n % 2


def _robust_weights(y: Column, fit: Column, n: Column) -> Column:
    def weights(r: Column) -> Column:
        ordered = F.array_sort(r)
        wide = 3 * (F.get(ordered, F.floor(n / 2).cast("int")) + F.get(ordered, (n - F.floor(n / 2) - 1).cast("int")))
        return let(wide, lambda h: F.transform(r, lambda v: F.when(v <= 0.001 * h, 1.0).when(v <= 0.999 * h, F.pow(1 - F.pow(v / h, F.lit(2.0)), F.lit(2.0))).otherwise(0.0)))

    return let(F.transform(_minus(y, fit), F.abs), weights)


def _variance(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return let(mean, lambda m: F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a))


def decompose(series: DataFrame, key: str, time: str, value: str, period: int, seasonal: int = 7, inner: int = 2, outer: int = 15) -> DataFrame:
    """key, n, values, trend, season, rest (arrays in the order of time): decomposition by local lines with robust weights.

    Each of outer + 1 rounds runs inner passes: what is left without the trend
    is smoothed within each place of the period and freed from its low
    frequencies, and what is left without that season is smoothed to the
    trend; then values far from both lose weight. Series of two periods or
    less are taken at a period of 2; of fewer than 5 steps there are none.
    """
    rows = series.where(F.col(value).isNotNull())
    whole = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("values"))
    # A row is a series and much work: rows are spread, which small partitions joined into one would undo.
    spread = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = whole.withColumn("n", F.size("values")).where("n >= 5").repartition(spread, key)
    short = whole.where(F.col("n") <= 2 * period)
    found = [_decomposed(whole.where(F.col("n") > 2 * period), key, period, seasonal, inner, outer), _decomposed(short, key, 2, seasonal, inner, outer)]
    return found[0].unionByName(found[1]) if period > 2 else _decomposed(whole, key, 2, seasonal, inner, outer)


def _decomposed(whole: DataFrame, key: str, period: int, seasonal: int, inner: int, outer: int) -> DataFrame:
    y, n = F.col("values"), F.col("n")
    of_trend, low = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1)

    def a_pass(s: Column) -> Column:
        def with_cycles(c: Column) -> Column:
            flat = let(let(let(c, lambda x: _moving(x, period)), lambda x: _moving(x, period)), lambda x: _moving(x, 3))
            base = let(flat, lambda f: _smooth(f, None, n, low))
            return let(_minus(F.slice(c, F.lit(period + 1), n), base), lambda season: F.struct(season.alias("season"), let(_minus(y, season), lambda d: _smooth(d, s["w"], n, of_trend)).alias("trend"), s["w"].alias("w")))

        return let(let(_minus(y, s["trend"]), lambda d: _cycles(d, s["w"], n, period, seasonal)), with_cycles)

    def a_round(s: Column, i: Column) -> Column:
        weighed = F.when(i == 1, s["w"]).otherwise(_robust_weights(y, _plus(s["season"], s["trend"]), n))
        begun = F.struct(s["season"].alias("season"), s["trend"].alias("trend"), weighed.alias("w"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(inner)), begun, lambda t, _: a_pass(t))

    zero, one = F.transform(y, lambda v: v * 0.0), F.transform(y, lambda v: v * 0.0 + 1.0)
    begin = F.struct(zero.alias("season"), zero.alias("trend"), one.alias("w"))
    done = whole.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(outer + 1)), begin, a_round))
    return done.select(key, "n", "values", F.col("s.trend").alias("trend"), F.col("s.season").alias("season"), _minus(_minus(y, F.col("s.trend")), F.col("s.season")).alias("rest"))


def strengths(parts: DataFrame, key: str) -> DataFrame:
    """key, n, trend_strength, season_strength and rest_share of decomposed series: how much of the variance with the rest is not the rest."""
    wide = parts.select(key, "n", _variance(F.col("rest")).alias("r"), _variance(_plus(F.col("rest"), F.col("trend"))).alias("rt"), _variance(_plus(F.col("rest"), F.col("season"))).alias("rs"), _variance(F.col("values")).alias("v"))
    least = F.lit(1e-12)

    def strength(c: str) -> Column:
        return F.greatest(F.lit(0.0), 1 - F.col("r") / F.greatest(least, F.col(c)))

    return wide.select(key, "n", strength("rt").alias("trend_strength"), strength("rs").alias("season_strength"), (F.col("r") / F.greatest(least, F.col("v"))).alias("rest_share"))
