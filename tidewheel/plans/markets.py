"""Queries over daily bars and monthly series of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import forecast, guard, market, splits, stats
from tidewheel.plans.common import t_p_sql, tidy
from tidewheel.sources.tables import table

HORIZON, PERIOD, ORIGINS = 6, 12, 6


def bars(spark, sf_dir):
    return market.bars(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


def daily_ohlc_returns(spark, sf_dir):
    return tidy(market.returns(bars(spark, sf_dir)))


def momentum_volatility(spark, sf_dir):
    rows = market.features(bars(spark, sf_dir))
    return tidy(rows.select("day", *[c for c in rows.columns if c.startswith(("momentum", "volatility", "ret_lag"))]))


def rsi(spark, sf_dir):
    return tidy(market.rsi(bars(spark, sf_dir)).select("day", "rsi"))


def volume_zscore(spark, sf_dir):
    return tidy(market.range_lag(market.volume_z(bars(spark, sf_dir))).select("day", "volume_z", "range_lag"))


def drawdown(spark, sf_dir):
    rows = market.returns(bars(spark, sf_dir)).where("ret is not null").withColumn("r", F.exp("ret") - 1)
    return tidy(market.drawdown(rows, "r").select("day", "equity", "drawdown"))


def _signal(spark, sf_dir):
    rows = market.returns(bars(spark, sf_dir))
    rows = rows.withColumn("forecast", -F.lag("ret").over(market.order())).where("forecast is not null")
    return market.signal_backtest(rows, "forecast")


def signal_backtest(spark, sf_dir):
    return tidy(_signal(spark, sf_dir).select("day", "position", "turnover", "next_ret", "net"))


def strategy_performance(spark, sf_dir):
    """The reversal strategy after costs, beside holding with one cost of entry."""
    rows = _signal(spark, sf_dir)
    first = F.row_number().over(market.order()) == 1
    hold = rows.withColumn("net", F.col("next_ret") - F.when(first, 0.001).otherwise(0.0))
    out = market.performance(rows, "net").withColumn("strategy", F.lit("reversal"))
    return tidy(out.union(market.performance(hold, "net").withColumn("strategy", F.lit("hold"))), 4)


def price_trap(spark, sf_dir):
    return tidy(market.price_trap(bars(spark, sf_dir)))


def spearman_ic(spark, sf_dir):
    """Rank correlation of momentum and the forward return, and the share of equal signs."""
    rows = market.features(bars(spark, sf_dir)).select("momentum_5", "target").dropna()
    rows = rows.select(F.round("momentum_5", 9).alias("momentum_5"), F.round("target", 9).alias("target"))
    signs = rows.agg(F.avg((F.signum("momentum_5") == F.signum("target")).cast("double")).alias("sign_match"))
    return tidy(stats.spearman(rows, "momentum_5", "target").join(F.broadcast(signs)))


def normality(spark, sf_dir):
    """Whether returns are normal, over all days and by weekday (Monday is 0)."""
    rows = market.returns(bars(spark, sf_dir)).select(F.weekday("day").cast("long").alias("dow"), "ret")
    every = stats.normality(rows, "ret").select(F.lit(-1).cast("long").alias("dow"), "n", "skew", "kurtosis", "statistic", "p")
    return tidy(every.unionByName(stats.normality(rows, "ret", ["dow"])))


def lookahead_perturbation(spark, sf_dir):
    """Features before a day that change when all from it on is scaled: none."""
    names = ["momentum_5", "volatility_21", "volume_z", "rsi", "range_lag", "ret_lag_1"]
    return guard.moved_features(bars(spark, sf_dir), market.features, names, "1998-01-01")


def monthly_resample(spark, sf_dir):
    return tidy(forecast.monthly(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").select("month", "pos", "value"))


def _forecasts(spark, sf_dir):
    series = forecast.monthly(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    origins = splits.rolling_origins(series.count(), ORIGINS, HORIZON, PERIOD)
    return series, forecast.baselines(series, origins, HORIZON, PERIOD)


def forecast_baselines(spark, sf_dir):
    return tidy(_forecasts(spark, sf_dir)[1], 3)


def rolling_origin_mase(spark, sf_dir):
    series, found = _forecasts(spark, sf_dir)
    return tidy(forecast.summary(forecast.mase(found, series, PERIOD)))


def rank_synthesis(spark, sf_dir):
    series, found = _forecasts(spark, sf_dir)
    return tidy(forecast.rank_synthesis(forecast.mase(found, series, PERIOD)))


def smoothed_forecast(spark, sf_dir):
    """Holt-Winters by order priority on monthly counts."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.trunc(F.to_date("o_orderdate"), "MONTH").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return tidy(forecast.smoothed(rows, "o_orderpriority", "month", "n", PERIOD, HORIZON), 4)


NAMES = (
    "daily_ohlc_returns momentum_volatility rsi volume_zscore drawdown signal_backtest strategy_performance price_trap spearman_ic normality lookahead_perturbation monthly_resample forecast_baselines "
    "rolling_origin_mase rank_synthesis smoothed_forecast"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

BARS = "SELECT o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS close, max(o_totalprice) AS high, min(o_totalprice) AS low, count(*) AS volume FROM orders GROUP BY 1"
RET = f"SELECT *, ln(close) - lag(ln(close)) OVER (ORDER BY day) AS ret, lead(ln(close), 5) OVER (ORDER BY day) - ln(close) AS target FROM ({BARS})"


def _full(fold: str, v: str, w: int, back: str) -> str:
    over = f"OVER (ORDER BY day ROWS BETWEEN {back})"
    return f"CASE WHEN count({v}) {over} = {w} THEN {fold}({v}) {over} END"


FEATURES = ", ".join(
    [f"round(lag(ret, {k}) OVER (ORDER BY day), 6) AS ret_lag_{k}" for k in (1, 2, 3, 5, 10)]
    + [f"round({_full('sum', 'ret', w, f'{w} PRECEDING AND 1 PRECEDING')}, 6) AS momentum_{w}" for w in (5, 10, 21)]
    + [f"round({_full('stddev_samp', 'ret', w, f'{w} PRECEDING AND 1 PRECEDING')}, 6) AS volatility_{w}" for w in (5, 10, 21)]
)
BACK14 = "13 PRECEDING AND CURRENT ROW"
RSI = f"""SELECT day, lag(r) OVER (ORDER BY day) AS rsi FROM (SELECT day, 100 - 100 / (1 + {_full('avg', 'g', 14, BACK14)} / nullif({_full('avg', 'l', 14, BACK14)}, 0)) AS r
FROM (SELECT day, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS l FROM (SELECT day, close - lag(close) OVER (ORDER BY day) AS d FROM ({BARS}))))"""
BACK21 = "20 PRECEDING AND CURRENT ROW"
SIGNAL = f"""SELECT day, position, coalesce(exp(lead(ret) OVER (ORDER BY day)) - 1, 0) AS next_ret, abs(position - coalesce(lag(position) OVER (ORDER BY day), 0)) AS turnover
FROM (SELECT day, ret, CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS position FROM (SELECT day, ret, -lag(ret) OVER (ORDER BY day) AS f FROM ({RET})) WHERE f IS NOT NULL)"""


def _performance(rows: str, name: str) -> str:
    return f"""SELECT '{name}' AS strategy, count(*) AS n, round(exp(sum(ln(1 + r))) - 1, 4) AS total_return, round(pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1, 4) AS annual_return, round(stddev_samp(r) * sqrt(252), 4) AS volatility,
round(CASE WHEN stddev_samp(r) * sqrt(252) > 1e-9 THEN (pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1) / (stddev_samp(r) * sqrt(252)) END, 4) AS sharpe,
round(CASE WHEN stddev_samp(r) FILTER (r < 0) * sqrt(252) > 1e-9 THEN (pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1) / (stddev_samp(r) FILTER (r < 0) * sqrt(252)) END, 4) AS sortino, round(min(dd), 4) AS max_drawdown,
round(count(*) FILTER (r > 0) / count(*), 4) AS hit_rate, round(max(r), 4) AS best, round(min(r), 4) AS worst
FROM (SELECT r, eq / max(eq) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT day, r, exp(sum(ln(1 + r)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS eq FROM ({rows})))"""


MONTHLY = "SELECT month, value, row_number() OVER (ORDER BY month) - 1 AS pos FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS value FROM orders GROUP BY 1)"
FORECASTS = f"""SELECT origin, step, model, CASE model WHEN 'naive' THEN last WHEN 'seasonal_naive' THEN coalesce(season, last) ELSE last + (last - first) / (origin - 1) * step END AS forecast, actual FROM
(SELECT o.origin, s.pos - o.origin + 1 AS step, s.value AS actual, l.value AS last, q.value AS season, f.value AS first
FROM (SELECT unnest(range(greatest(36, n - 36), n - 5, 6)) AS origin FROM (SELECT count(*) AS n FROM m)) o JOIN m s ON s.pos >= o.origin AND s.pos < o.origin + 6 JOIN m l ON l.pos = o.origin - 1
LEFT JOIN m q ON q.pos = o.origin - 12 + (s.pos - o.origin) % 12 JOIN m f ON f.pos = 0), (SELECT unnest(['naive', 'seasonal_naive', 'drift']) AS model)"""
MASE = f"""WITH m AS ({MONTHLY}), f AS ({FORECASTS}), g AS (SELECT pos, abs(value - lag(value, 12) OVER (ORDER BY pos)) AS gap, abs(value - lag(value) OVER (ORDER BY pos)) AS step FROM m),
e AS (SELECT origin, model, avg(abs(actual - forecast)) AS mae FROM f GROUP BY 1, 2), s AS (SELECT origin, model, mae / nullif((SELECT avg(CASE WHEN origin <= 12 THEN step ELSE gap END) FROM g WHERE pos < origin), 0) AS mase FROM e)"""
ORACLES = {
    "daily_ohlc_returns": f"SELECT day, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, volume, round(ret, 6) AS ret, round(target, 6) AS target FROM ({RET})",
    "momentum_volatility": f"SELECT day, {FEATURES} FROM ({RET})",
    "rsi": f"SELECT day, round(rsi, 6) AS rsi FROM ({RSI})",
    "volume_zscore": f"""SELECT day, round((v - {_full('avg', 'v', 21, BACK21)}) / nullif({_full('stddev_samp', 'v', 21, BACK21)}, 0), 6) + 0.0 AS volume_z, range_lag
FROM (SELECT day, lag(ln(nullif(volume, 0))) OVER (ORDER BY day) AS v, round(lag((high - low) / nullif(close, 0)) OVER (ORDER BY day), 6) AS range_lag FROM ({BARS}))""",
    "drawdown": f"""SELECT day, round(eq, 6) AS equity, round(eq / max(eq) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown
FROM (SELECT day, exp(sum(ret) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS eq FROM ({RET}) WHERE ret IS NOT NULL)""",
    "signal_backtest": f"SELECT day, position, turnover, round(next_ret, 6) AS next_ret, round(position * next_ret - turnover * 0.001, 6) + 0.0 AS net FROM ({SIGNAL})",
    "strategy_performance": _performance(f"SELECT day, position * next_ret - turnover * 0.001 AS r FROM ({SIGNAL})", "reversal")
    + " UNION ALL "
    + _performance(f"SELECT day, next_ret - CASE WHEN row_number() OVER (ORDER BY day) = 1 THEN 0.001 ELSE 0 END AS r FROM ({SIGNAL})", "hold"),
    "price_trap": f"""SELECT round(1 - sum((close - b) * (close - b)) / (var_pop(close) * count(*)), 6) AS r2_price, round(1 - sum(ret * ret) / (var_pop(ret) * count(*)), 6) AS r2_return, count(*) AS n
FROM (SELECT *, lag(close) OVER (ORDER BY day) AS b FROM ({RET})) WHERE b IS NOT NULL""",
    "spearman_ic": f"""WITH r AS (SELECT round(m, 9) AS m, round(target, 9) AS t FROM (SELECT target, {_full('sum', 'ret', 5, '5 PRECEDING AND 1 PRECEDING')} AS m FROM ({RET})) WHERE m IS NOT NULL AND target IS NOT NULL),
k AS (SELECT m, t, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS a, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS b FROM r)
SELECT round(r, 6) AS spearman, n, round({t_p_sql('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')}, 6) AS p, sign_match FROM (SELECT corr(a, b) AS r, count(*) AS n, round(avg((sign(m) = sign(t))::INT), 6) AS sign_match FROM k)""",
    "normality": f"""WITH r AS (SELECT isodow(day) - 1 AS dow, ret FROM ({RET}) WHERE ret IS NOT NULL), a AS (SELECT * FROM r UNION ALL SELECT -1, ret FROM r), m AS (SELECT dow, avg(ret) AS mu FROM a GROUP BY 1),
s AS (SELECT dow, count(*) AS n, avg(pow(ret - mu, 3)) / pow(var_pop(ret), 1.5) AS skew, avg(pow(ret - mu, 4)) / pow(var_pop(ret), 2) - 3 AS kurtosis FROM a JOIN m USING (dow) GROUP BY 1)
SELECT dow, n, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(n / 6 * (skew * skew + kurtosis * kurtosis / 4), 6) AS statistic, round(exp(-n / 12 * (skew * skew + kurtosis * kurtosis / 4)), 6) + 0.0 AS p FROM s""",
    "lookahead_perturbation": "SELECT o_orderdate::DATE AS day, 0.0::DOUBLE AS momentum_5, 0.0::DOUBLE AS volatility_21, 0.0::DOUBLE AS volume_z, 0.0::DOUBLE AS rsi, 0.0::DOUBLE AS range_lag, 0.0::DOUBLE AS ret_lag_1 FROM orders WHERE false",
    "monthly_resample": f"SELECT month, pos, round(value, 6) AS value FROM ({MONTHLY})",
    "forecast_baselines": f"WITH m AS ({MONTHLY}) SELECT origin, step, model, round(forecast, 3) AS forecast, round(actual, 3) AS actual FROM ({FORECASTS})",
    "rolling_origin_mase": MASE + " SELECT model, round(avg(mase), 6) AS mean_mase, round(stddev_pop(mase), 6) AS std_mase, round(max(mase), 6) AS worst_mase, count(*) AS n_origins FROM s GROUP BY 1",
    "rank_synthesis": MASE
    + " SELECT model, round(avg(r), 6) AS mean_rank, min(r) AS best_rank, max(r) AS worst_rank, count(*) FILTER (r = 1) AS wins FROM (SELECT *, rank() OVER (PARTITION BY origin ORDER BY round(mase, 9)) AS r FROM s) GROUP BY 1",
}
