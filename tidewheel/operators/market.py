"""Price bars: returns, backward features, a signal's backtest and its performance.

A series has one row a day, so its windows over all rows are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import ratio


def order() -> W:
    return W.orderBy("day")


def full(value: Column, frame: W, width: int, fold) -> Column:
    """A fold over the frame, null until it holds width values."""
    return F.when(F.count(value).over(frame) == width, fold(value).over(frame))


def bars(orders: DataFrame, time: str, price: str) -> DataFrame:
    """day, close (sum), high, low, volume (rows)."""
    return orders.groupBy(F.to_date(time).alias("day")).agg(
        F.sum(F.col(price).cast("decimal(18,2)")).cast("double").alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.count(F.lit(1)).alias("volume")
    )


def returns(df: DataFrame, horizon: int = 5) -> DataFrame:
    """Log return, and the forward return over horizon rows."""
    p = F.ln("close")
    return df.withColumns({"ret": p - F.lag(p).over(order()), "target": F.lead(p, horizon).over(order()) - p})


def features(df: DataFrame) -> DataFrame:
    """Lagged returns, momentum, volatility, volume z-score, relative strength and range, from rows before the current one."""
    out = returns(df)
    out = out.withColumns({f"ret_lag_{k}": F.lag("ret", k).over(order()) for k in (1, 2, 3, 5, 10)})
    for w in (5, 10, 21):
        frame = order().rowsBetween(-w, -1)
        out = out.withColumns({f"momentum_{w}": full(F.col("ret"), frame, w, F.sum), f"volatility_{w}": full(F.col("ret"), frame, w, F.stddev_samp)})
    return range_lag(rsi(volume_z(out)))


def volume_z(df: DataFrame, width: int = 21) -> DataFrame:
    rows = df.withColumn("_v", F.lag(F.ln(F.nullif("volume", F.lit(0)))).over(order()))
    frame = order().rowsBetween(1 - width, 0)
    mean, std = full(F.col("_v"), frame, width, F.avg), full(F.col("_v"), frame, width, F.stddev_samp)
    return rows.withColumn("volume_z", (F.col("_v") - mean) / F.nullif(std, F.lit(0.0))).drop("_v")


def rsi(df: DataFrame, width: int = 14) -> DataFrame:
    """Relative strength of simple means, one row late; null where the mean loss is zero."""
    rows = df.withColumn("_d", F.col("close") - F.lag("close").over(order()))
    frame = order().rowsBetween(1 - width, 0)
    gain = full(F.greatest(F.col("_d"), F.lit(0.0)), frame, width, F.avg)
    loss = full(F.greatest(-F.col("_d"), F.lit(0.0)), frame, width, F.avg)
    known = F.count("_d").over(frame) == width
    rows = rows.withColumn("_r", F.when(known, 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))))
    return rows.withColumn("rsi", F.lag("_r").over(order())).drop("_d", "_r")


def range_lag(df: DataFrame) -> DataFrame:
    return df.withColumn("range_lag", F.lag((F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0))).over(order()))


def signal_backtest(df: DataFrame, forecast: str, cost: float = 0.001) -> DataFrame:
    """Long if the forecast is positive: position, next return, turnover, net return; nothing is held without a forecast."""
    position = F.when(F.col(forecast) > 0, 1.0).otherwise(0.0)
    rows = df.withColumns({"position": position, "next_ret": F.coalesce(F.exp(F.lead("ret").over(order())) - 1, F.lit(0.0))})
    rows = rows.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(order()), F.lit(0.0))))
    return rows.withColumn("net", F.col("position") * F.col("next_ret") - F.col("turnover") * cost)


def drawdown(df: DataFrame, ret: str) -> DataFrame:
    """Adds equity (product of 1 + return) and drawdown from its highest point so far."""
    upto = order().rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col(ret))).over(upto)))
    return rows.withColumn("drawdown", F.col("equity") / F.max("equity").over(upto) - 1)


def performance(df: DataFrame, ret: str, year: int = 252) -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, worst drawdown, hit rate, best and worst row.

    Sharpe and Sortino divide the annual return by the annual volatility, of
    all rows and of losing ones; they are null where that is next to nothing.
    The hit rate is the share of winning rows among all.
    """
    rows = drawdown(df, ret)
    r = F.col(ret)
    one = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.exp(F.sum(F.ln(1 + r))).alias("growth"),
        F.stddev_samp(r).alias("std"),
        F.stddev_samp(F.when(r < 0, r)).alias("down"),
        F.min("drawdown").alias("max_drawdown"),
        ratio(F.count_if(r > 0), F.count(F.lit(1))).alias("hit_rate"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
    )
    annual = F.pow("growth", F.lit(float(year)) / F.col("n")) - 1

    def over(deviation: str) -> Column:
        yearly = F.col(deviation) * year**0.5
        return F.when(yearly > 1e-9, annual / yearly)

    return one.select(
        "n",
        (F.col("growth") - 1).alias("total_return"),
        annual.alias("annual_return"),
        (F.col("std") * year**0.5).alias("volatility"),
        over("std").alias("sharpe"),
        over("down").alias("sortino"),
        "max_drawdown",
        "hit_rate",
        "best",
        "worst",
    )


def verdict() -> Column:
    """In words, a strategy's annual_return and sharpe against those of holding (hold_...), rounded to four digits."""
    gain, risk = (F.round(c, 4) > F.round(f"hold_{c}", 4) for c in ("annual_return", "sharpe"))
    unknown = F.col("sharpe").isNull() | F.col("hold_sharpe").isNull()
    return F.when(unknown, "undecided").when(gain & risk, "better than holding").when(risk, "less return for less risk").when(gain, "more return for more risk").otherwise("worse than holding")


def price_trap(df: DataFrame) -> DataFrame:
    """R2 of yesterday's price for the price, and of zero for the return: one impresses, the other tells."""
    rows = returns(df).withColumn("before", F.lag("close").over(order())).where("before is not null")
    sse, sst = F.sum((F.col("close") - F.col("before")) ** 2), F.var_pop("close") * F.count("close")
    return rows.agg(
        (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2_price"), (1 - F.sum(F.col("ret") ** 2) / F.nullif(F.var_pop("ret") * F.count("ret"), F.lit(0.0))).alias("r2_return"), F.count(F.lit(1)).alias("n")
    )


def rescaled_after(df: DataFrame, day: str, factor: float) -> DataFrame:
    """The bars with everything from day on scaled: features of earlier days must not move."""
    late = F.col("day") >= F.lit(day).cast("date")
    return df.withColumns({c: F.when(late, F.col(c) * factor).otherwise(F.col(c)) for c in ("close", "high", "low", "volume")})
