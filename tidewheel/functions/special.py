"""Special functions and tail chances as column expressions: no Python worker, and any number of tests at once.

Sums and continued fractions are folds over a sequence whose length grows with
the square root of the parameters, which is what they need to settle to about
1e-12.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
HALF_LOG_2PI = 0.91893853320467274178
TINY = 1e-300


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    less = x - 1
    total = sum((F.lit(c) / (less + i) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    high = less + 7.5
    return F.lit(HALF_LOG_2PI) + (less + 0.5) * F.ln(high) - high + F.ln(total)


def _steps(size: Column) -> Column:
    return F.sequence(F.lit(1), (F.lit(80) + 14 * F.sqrt(size)).cast("int"))


def gamma_tail(a: Column, x: Column) -> Column:
    """Q(a, x), the upper regularised incomplete gamma function; 1 at x <= 0."""
    a, x = a.cast("double"), x.cast("double")

    def tail(p: Column) -> Column:
        a, x = p["a"], p["x"]
        front = F.exp(a * F.ln(x) - x - log_gamma(a))
        start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
        series = F.aggregate(
            _steps(a), start, lambda s, k: let(s["term"] * x / (a + k), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))), lambda s: s["sum"]
        )
        b0 = x + 1 - a
        begin = F.struct(F.lit(1 / TINY).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h"))

        def lentz(s: Column, k: Column) -> Column:
            up, b = -k * (k - a), x + 1 - a + 2 * k
            return let(
                F.struct((1 / _off_zero(up * s["d"] + b)).alias("d"), _off_zero(b + up / s["c"]).alias("c")),
                lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h")),
            )

        fraction = F.aggregate(_steps(a), begin, lentz, lambda s: s["h"])
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return let(F.struct(a.alias("a"), x.alias("x")), tail)


def _off_zero(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b), the regularised incomplete beta function."""

    def fraction(a: Column, b: Column, x: Column) -> Column:
        d0 = 1 / _off_zero(1 - (a + b) * x / (a + 1))
        begin = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def half(s: Column, up: Column) -> Column:
            return let(
                F.struct((1 / _off_zero(1 + up * s["d"])).alias("d"), _off_zero(1 + up / s["c"]).alias("c")),
                lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h")),
            )

        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
            return let(half(s, even), lambda t: half(t, odd))

        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
        return front * F.aggregate(_steps(F.greatest(a, b)), begin, step, lambda s: s["h"]) / a

    def share(p: Column) -> Column:
        a, b, x = p["a"], p["b"], p["x"]
        near = x < (a + 1) / (a + b + 2)
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, fraction(a, b, x)).otherwise(1 - fraction(b, a, 1 - x))

    return let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x")), share)


def chi_square_p(stat: Column, dof: Column) -> Column:
    """The chance of a chi-square statistic as large or larger; null without degrees of freedom."""
    return F.when(dof > 0, gamma_tail(dof / 2, stat / 2))


def t_p(stat: Column, dof: Column) -> Column:
    """The two-sided chance of Student's t; null without degrees of freedom."""
    return F.when(dof > 0, beta_share(dof / 2, F.lit(0.5), dof / (dof + stat * stat)))


def normal_share(z: Column) -> Column:
    """The chance of a standard normal value of z or less."""
    half = gamma_tail(F.lit(0.5), z * z / 2) / 2
    return F.when(z > 0, 1 - half).otherwise(half)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Coefficients from the constant upwards."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def interpolated(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear between points (x, y) by rising x, level beyond them."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x < points[0][0], F.lit(float(points[0][1]))).otherwise(out)
