"""Series and tail chances against numpy, by the definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import special
from tidewheel.operators import regress, series

rng = np.random.default_rng(11)
T = np.arange(130)
SERIES = {
    "season": 5 * np.sin(2 * np.pi * T / 12) + 0.05 * T + rng.normal(size=130),
    "walk": np.cumsum(rng.normal(size=130)),
    "noise": rng.normal(size=90),
    "outlier": np.where(T[:80] == 40, 50.0, np.cos(2 * np.pi * T[:80] / 12)) + 0.1 * rng.normal(size=80),
    "short": rng.normal(size=17).cumsum(),
    "flat": np.ones(30),
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, int(t), float(v)) for k, y in SERIES.items() for t, v in enumerate(y)] + [("noise", 1000, None), ("one", 1, 2.0)]
    return spark.createDataFrame(rows, "k string, t long, v double").repartition(5)


def test_chances_at_known_points(spark):
    chi, t = lambda x, d: special.chi_square_p(F.lit(x), F.lit(d)), lambda x, d: special.t_p(F.lit(x), F.lit(d))
    cases = []
    for x in (0.01, 0.5, 3.0, 20.0, 200.0):
        cases += [(chi(x, 2), math.exp(-x / 2), 1e-11), (chi(x, 1), math.erfc(math.sqrt(x / 2)), 1e-10), (chi(x, 4), math.exp(-x / 2) * (1 + x / 2), 1e-11)]
        cases += [(t(x, 1), 1 - 2 / math.pi * math.atan(x), 1e-9), (t(x, 2), 1 - x / math.sqrt(2 + x * x), 1e-8)]
    cases += [(special.normal_share(F.lit(z)), 0.5 * math.erfc(-z / math.sqrt(2)), 1e-10) for z in (-8.0, -1.96, -0.1, 0.0, 0.7, 3.0)]
    # Tabled 5 per cent points.
    cases += [(chi(x, d), 0.05, 1e-7) for x, d in ((18.307038053275146, 10), (124.34211340400407, 100), (1074.679449, 1000))]
    cases += [(t(x, d), 0.05, 1e-6) for x, d in ((2.2281388519649385, 10), (1.9839715185235516, 100), (1.9599664, 1_000_000))]
    cases += [(chi(0.0, 3), 1.0, 0), (special.log_gamma(F.lit(10.0)), math.lgamma(10), 1e-14)]
    found = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _, _) in enumerate(cases)], chi(1.0, 0).alias("none")).first()
    for i, (_, want, rel) in enumerate(cases):
        assert found[i] == pytest.approx(want, rel=rel), i
    assert found["none"] is None


def test_least_squares_by_group(spark):
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=60)
    rows = [(int(i % 2), *map(float, v), float(v[0] * 2), float(w)) for i, (v, w) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, twice double, y double")
    found = regress.products(df, ["g"], [F.lit(1.0), F.col("a"), F.col("b"), F.col("twice"), F.col("y")])
    found = found.withColumn("s", regress.swept(F.col("m"), F.lit(4)))
    for r in found.collect():
        own = np.arange(60) % 2 == r["g"]
        design = np.column_stack([np.ones(own.sum()), x[own][:, :2]])
        want, rss, *_ = np.linalg.lstsq(design, y[own], rcond=None)
        assert [r["s"]["m"][i][-1] for i in range(3)] == pytest.approx(want.tolist(), rel=1e-9)
        assert r["s"]["rss"][-1] == pytest.approx(float(rss[0]), rel=1e-9) and r["s"]["rss"][-1] == r["s"]["rss"][-2]  # the fourth is twice the second
        inverse = np.linalg.inv(design.T @ design)
        assert np.allclose([[-r["s"]["m"][i][j] for j in range(3)] for i in range(3)], inverse, rtol=1e-9, atol=1e-12)


def slow_pacf(y, most):
    c, n = y - y.mean(), len(y)
    r = [np.dot(c[: n - k], c[k:]) / (n - k) for k in range(most + 1)]
    out = []
    for k in range(1, most + 1):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])
    acf = [np.dot(c[: n - k], c[k:]) / np.dot(c, c) for k in range(1, most + 1)]
    return acf, out


def test_partial_autocorrelation(table):
    found = {}
    for r in series.partial_autocorrelation(table, "k", "t", "v").orderBy("lag").collect():
        found.setdefault(r["k"], []).append((r["lag"], r["acf"], r["pacf"]))
    assert set(found) == set(SERIES) - {"flat"}
    for name, rows in found.items():
        most = min(60, len(SERIES[name]) // 3)
        acf, pacf = slow_pacf(SERIES[name], most)
        assert [r[0] for r in rows] == list(range(1, most + 1))
        assert [r[1] for r in rows] == pytest.approx(acf, abs=1e-9) and [r[2] for r in rows] == pytest.approx(pacf, abs=1e-7)


def slow_adf(y):
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(y)

    def fit(lags, skip):
        rows = range(skip, len(d))
        design = np.array([[1.0, y[t], *[d[t - i] for i in range(1, lags + 1)]] for t in rows])
        aim = d[list(rows)]
        coef = np.linalg.lstsq(design, aim, rcond=None)[0]
        rss = ((aim - design @ coef) ** 2).sum()
        return len(aim), design, coef, rss

    best = min(range(most + 1), key=lambda p: (lambda m, _, __, rss: m * (math.log(2 * math.pi * rss / m) + 1) + 2 * (p + 2))(*fit(p, most)))
    m, design, coef, rss = fit(best, best)
    se = math.sqrt(rss / (m - best - 2) * np.linalg.inv(design.T @ design)[1, 1])
    return best, coef[1] / se


def slow_kpss(y):
    n, e = len(y), y - y.mean()
    few = int(n ** (2 / 9))
    c = [np.dot(e[i:], e[: n - i]) for i in range(n)]
    s0 = c[0] / n + sum(2 * c[i] / n for i in range(1, few + 1))
    s1 = sum(i * 2 * c[i] / n for i in range(1, few + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    spread = (c[0] + 2 * sum((1 - i / (lags + 1)) * c[i] for i in range(1, lags + 1))) / n
    return lags, (np.cumsum(e) ** 2).sum() / n**2 / spread


def test_unit_roots(table):
    found = {r["k"]: r for r in series.unit_roots(table, "k", "t", "v").collect()}
    assert set(found) == {*SERIES, "one"}
    for name, y in SERIES.items():
        r = found[name]
        if name == "flat":
            assert r["adf"] is None and r["kpss"] is None and r["verdict"] == "undecided"
            continue
        lags, stat = slow_adf(y)
        assert r["adf_lags"] == lags and r["adf"] == pytest.approx(stat, rel=1e-6)
        lags, stat = slow_kpss(y)
        assert r["kpss_lags"] == lags and r["kpss"] == pytest.approx(stat, rel=1e-9) and 0.01 <= r["kpss_p"] <= 0.1
    assert found["walk"]["adf_p"] > 0.05 and found["noise"]["verdict"] == "stationary" and found["noise"]["adf_p"] < 1e-6


def test_chances_of_the_unit_root_statistic(spark):
    """The published 1, 5 and 10 per cent points of the statistic with a constant."""
    for tau, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        surface = special.polynomial(F.lit(tau), series.UNIT_ROOT["small"])
        assert spark.range(1).select(special.normal_share(surface)).first()[0] == pytest.approx(p, abs=0.002)


def local(y, w, left, right, x, n, q):
    h = max(x - left, right - x) + ((q - n) // 2 if q > n else 0)
    js = np.arange(left, right + 1)
    r = np.abs(js - x)
    a = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / max(h, 1e-9)) ** 3) ** 3, 0.0)) * (1 if w is None else w[left - 1 : right])
    if a.sum() <= 0:
        return None
    a = a / a.sum()
    mean = (a * js).sum()
    spread = (a * (js - mean) ** 2).sum()
    if math.sqrt(spread) > 0.001 * (n - 1):
        a = a * ((x - mean) / spread * (js - mean) + 1)
    return float((a * y[left - 1 : right]).sum())


def smooth(y, w, q):
    n, out = len(y), []
    for i in range(1, n + 1):
        left = max(1, min(i - (q + 1) // 2 + 1, n - q + 1))
        v = local(y, w, left, min(left + q - 1, n), i, n, q)
        out.append(y[i - 1] if v is None else v)
    return np.array(out)


def slow_decomposition(y, period, seasonal=7, inner=2, outer=15):
    n = len(y)
    odd = lambda x: math.ceil(x) + 1 - math.ceil(x) % 2
    of_trend, low = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period + 1)
    trend, season, w = np.zeros(n), np.zeros(n), np.ones(n)
    for k in range(outer + 1):
        if k:
            r = np.abs(y - trend - season)
            s = np.sort(r)
            h = 3 * (s[n // 2] + s[n - n // 2 - 1])
            w = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0.0))
        for _ in range(inner):
            d, c = y - trend, np.zeros(n + 2 * period)
            for j in range(period):
                own, ow = d[j::period], w[j::period]
                m = len(own)
                s = smooth(own, ow, seasonal)
                before = local(own, ow, 1, min(seasonal, m), 0, m, seasonal)
                after = local(own, ow, max(1, m - seasonal + 1), m, m + 1, m, seasonal)
                c[j::period] = [s[0] if before is None else before, *s, s[-1] if after is None else after]
            f = c
            for q in (period, period, 3):
                f = np.convolve(f, np.ones(q) / q, "valid")
            season = c[period : period + n] - smooth(f, None, low)
            trend = smooth(y - season, w, of_trend)
    return trend, season


def test_decomposition(spark):
    use = {"season": 130, "outlier": 80, "short": 17}
    rows = [(k, int(t), float(v)) for k in use for t, v in enumerate(SERIES[k])] + [("tiny", t, 1.0) for t in range(4)] + [("season", 999, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(3)
    found = {r["k"]: r for r in series.decompose(df, "k", "t", "v", 12).collect()}
    assert set(found) == set(use)
    for name, r in found.items():
        trend, season = slow_decomposition(SERIES[name], 12 if len(SERIES[name]) > 24 else 2)
        assert r["trend"] == pytest.approx(trend.tolist(), abs=1e-8) and r["season"] == pytest.approx(season.tolist(), abs=1e-8)
        assert (np.array(r["trend"]) + r["season"] + r["rest"]).tolist() == pytest.approx(r["values"], abs=1e-9)
    assert abs(found["outlier"]["rest"][40]) > 45  # the outlier moves neither trend nor season
    strong = {r["k"]: r for r in series.strengths(series.decompose(df, "k", "t", "v", 12), "k").collect()}
    assert strong["season"]["season_strength"] > 0.9 and strong["season"]["trend_strength"] > 0.7


def test_no_python_workers(table):
    for df in (series.partial_autocorrelation(table, "k", "t", "v"), series.unit_roots(table, "k", "t", "v"), series.decompose(table, "k", "t", "v", 12, outer=1)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
