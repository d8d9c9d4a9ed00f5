"""Least squares per group from sums of products: one pass with partial aggregation, then sweeps in an expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def products(df: DataFrame, by: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """Per value of by: n, and m, the symmetric matrix of sums of products of the columns; null columns count as zero."""
    k = len(columns)
    named = df.select(*by, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(columns)])
    sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i in range(k) for j in range(i + 1)]
    one = named.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    matrix = F.array(*[F.array(*[F.col(f"_s{max(i, j)}_{min(i, j)}") for j in range(k)]) for i in range(k)])
    return one.select(*by, "n", matrix.alias("m"))


def swept(matrix: Column, k: Column) -> Column:
    """A struct: m, the matrix after its first k columns are swept, and rss, its last corner before and after each sweep.

    With the products of regressors and, last, the aim, m holds then the
    coefficients in its last column, minus the inverse of the regressors'
    products in its first k rows and columns, and the sum of squared residuals
    in its corner. A column that the ones before it explain is passed over.
    """
    first = F.struct(matrix.alias("m"), F.array(F.element_at(F.element_at(matrix, -1), -1)).alias("rss"), F.transform(matrix, lambda row, i: F.get(row, i)).alias("scale"))

    def sweep(s: Column, p: Column) -> Column:
        own, d = F.get(s["m"], p), F.get(F.get(s["m"], p), p)

        def row(r: Column, i: Column) -> Column:
            factor = F.get(r, p) / d
            other = F.zip_with(r, own, lambda a, b: a - factor * b)
            pivot = F.transform(own, lambda v: v / d)
            out = F.when(i == p, pivot).otherwise(other)
            return F.transform(out, lambda v, j: F.when((i == p) & (j == p), -1 / d).when(j == p, factor).otherwise(v))

        plain = d > 1e-11 * F.get(s["scale"], p)
        m = F.when(plain, F.transform(s["m"], row)).otherwise(s["m"])
        corner = F.element_at(F.element_at(m, -1), -1)
        return F.struct(m.alias("m"), F.concat(s["rss"], F.array(corner)).alias("rss"), s["scale"].alias("scale"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), k.cast("int")), lambda x: x - 1), first, sweep)


def leading(matrix: Column, k: Column) -> Column:
    """The matrix of the first k columns and the last one only."""

    def part(a: Column) -> Column:
        return F.concat(F.slice(a, F.lit(1), k.cast("int")), F.slice(a, F.lit(-1), F.lit(1)))

    return F.transform(part(matrix), part)
