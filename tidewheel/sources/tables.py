"""The registered tables and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(r_regionkey=I, r_name=S),
    "nation": _schema(n_nationkey=I, n_name=S, n_regionkey=I),
    "customer": _schema(c_custkey=L, c_name=S, c_nationkey=I, c_acctbal=D, c_mktsegment=S),
    "supplier": _schema(s_suppkey=L, s_name=S, s_nationkey=I, s_acctbal=D),
    "part": _schema(p_partkey=L, p_name=S, p_brand=S, p_type=S, p_size=I, p_retailprice=D),
    "orders": _schema(o_orderkey=L, o_custkey=L, o_orderstatus=S, o_totalprice=D, o_orderdate=TS, o_orderpriority=S),
    "lineitem": _schema(
        l_orderkey=L, l_partkey=L, l_suppkey=L, l_linenumber=I, l_quantity=D, l_extendedprice=D, l_discount=D, l_tax=D, l_returnflag=S, l_linestatus=S, l_shipdate=TS
    ),
    "events": _schema(event_id=L, ts=TS, user_id=L, event_type=S, value=D, props=S),
    "documents": _schema(doc_id=L, text=S, lang=S, source=S, n_chars=L),
    "embeddings": _schema(vec_id=L, embedding=T.ArrayType(T.FloatType()), label=I),
    "pages": _schema(page_id=L, url=S, html=S),
    "benchmark": _schema(item_id=L, text=S),
    "labels": _schema(doc_id=L, quality=I, toxic=I),
    "conversations": _schema(conv_id=L, turn=L, role=S, text=S),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A registered table with the types that it is declared with; an unknown name, or a declared column that is not there, raises KeyError.

    Columns beside the declared ones are kept as they are.
    """
    if name not in SCHEMAS:
        raise KeyError(f"no table is registered as {name!r}")
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kinds = {f.name: f.dataType for f in found.schema}
    if missing := set(SCHEMAS[name].names) - set(kinds):
        raise KeyError(f"{name} has no columns named {sorted(missing)}")
    return found.withColumns({f.name: found[f.name].cast(f.dataType) for f in SCHEMAS[name] if kinds[f.name].simpleString() != f.dataType.simpleString()})
