"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources.tables import table


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, ints widened: the form in which engines are compared."""
    out = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out[name] = F.round(F.col(name).cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            out[name] = F.col(name).cast("bigint")
    return df.withColumns(out)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxic and quality as outcomes, lang as group, a score from the length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.withColumn("score", F.round(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), 3))


def gamma_tail_sql(a: str, x: str) -> str:
    """Q(a, x) as one less a sum of positive terms."""
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum([exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1)) FOR k IN range(0, (2 * {x} + 300)::BIGINT)])) END::DOUBLE"


def t_p_sql(t: str, dof: str) -> str:
    """The two-sided chance of t by a sum of positive terms; for statistics that are not huge."""
    y, b = f"({t} * {t} / ({dof} + {t} * {t}))", f"({dof} / 2.0::DOUBLE)"
    front = f"exp(0.5 * ln({y}) + {b} * ln(1 - {y}) + lgamma(0.5 + {b}) - lgamma({b}) - lgamma(0.5)) / 0.5"
    return f"CASE WHEN {t} = 0 THEN 1.0 ELSE 1 - {front} * list_sum([exp(lgamma(0.5 + {b} + k) - lgamma(0.5 + {b}) - lgamma(1.5 + k) + lgamma(1.5) + k * ln({y})) FOR k IN range(0, 4000)]) END::DOUBLE"


#: The same rows for an engine of SQL.
SCORED = "SELECT l.*, d.lang, d.source, d.n_chars, round(least(d.n_chars / 5000.0, 1.0), 3) AS score FROM labels l JOIN documents d USING (doc_id)"
BY_SCORE = f"""SELECT score, pos, neg, sum(pos) OVER () AS p, sum(neg) OVER () AS q, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
FROM (SELECT score, sum(toxic) AS pos, sum(1 - toxic) AS neg FROM ({SCORED}) GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""
