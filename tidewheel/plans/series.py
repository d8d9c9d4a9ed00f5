"""Queries over the hourly series of each kind of event."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import series
from tidewheel.plans.common import tidy
from tidewheel.plans.panels import DENSE, panel_dense

PERIOD, LAST = 24, 240


def pacf_by_zone(spark, sf_dir):
    """Autocorrelation and partial autocorrelation up to 60 hours, or a third of the hours."""
    return tidy(series.partial_autocorrelation(panel_dense(spark, sf_dir), "zone", "hour_ts", "n"))


def unit_roots(spark, sf_dir):
    """Unit-root and stationarity statistics with their joint verdict."""
    return tidy(series.unit_roots(panel_dense(spark, sf_dir), "zone", "hour_ts", "n"))


def decomposition(spark, sf_dir):
    """How strong trend and daily season are."""
    return tidy(series.strengths(series.decompose(panel_dense(spark, sf_dir), "zone", "hour_ts", "n", PERIOD), "zone"), 4)


def decomposition_parts(spark, sf_dir):
    """Trend, season and rest of the last ten days."""
    parts = series.decompose(panel_dense(spark, sf_dir), "zone", "hour_ts", "n", PERIOD)
    rows = parts.select("zone", "n", F.posexplode(F.arrays_zip("values", "trend", "season", "rest")).alias("pos", "x"))
    return tidy(rows.where(F.col("pos") >= F.col("n") - LAST).select("zone", "pos", "x.values", "x.trend", "x.season", "x.rest"), 4)


NAMES = "pacf_by_zone unit_roots decomposition decomposition_parts".split()
QUERIES = {n: globals()[n] for n in NAMES}

ORACLES = {
    "pacf_by_zone": f"""WITH RECURSIVE c AS (SELECT zone, row_number() OVER (PARTITION BY zone ORDER BY hour_ts) AS i, count(*) OVER (PARTITION BY zone) AS n, n - avg(n) OVER (PARTITION BY zone) AS c FROM ({DENSE})),
s AS (SELECT a.zone, b.i - a.i AS lag, any_value(a.n) AS n, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.zone = b.zone AND b.i - a.i BETWEEN 0 AND least(60, a.n // 3) GROUP BY ALL),
r AS (SELECT zone, list(s ORDER BY lag) AS s, list(s * n / (n - lag) ORDER BY lag) AS g FROM s GROUP BY 1 HAVING max(s) > 0),
p(zone, k, phi, rest, a) AS (SELECT zone, 0, []::DOUBLE[], 1.0::DOUBLE, NULL::DOUBLE FROM r UNION ALL
SELECT zone, k + 1, list_append([phi[j] - a * phi[k + 1 - j] FOR j IN range(1, k + 1)], a), rest * (1 - a * a), a FROM
(SELECT p.zone, k, phi, rest, (g[k + 2] / g[1] - coalesce(list_sum([phi[j] * g[k + 2 - j] / g[1] FOR j IN range(1, k + 1)]), 0)) / rest AS a FROM p JOIN r USING (zone) WHERE k + 1 < len(g)))
SELECT zone, k::BIGINT AS lag, round(s[k + 1] / s[1], 6) + 0.0 AS acf, round(a, 6) + 0.0 AS pacf FROM p JOIN r USING (zone) WHERE k > 0""",
}
