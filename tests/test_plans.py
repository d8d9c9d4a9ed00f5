"""What Catalyst makes of the queries."""

import contextlib
import io

from pyspark.sql import functions as F

from tidewheel.oracle import ORACLES
from tidewheel.queries import QUERIES
from tidewheel.sources.tables import table


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_read_what_is_used(spark, sf_dir):
    text = plan(QUERIES["panel_counts"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text


def test_filters_reach_the_scan(spark, sf_dir):
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan(table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 40).select("l_orderkey"))


def test_relational_queries_run_without_python(spark, sf_dir):
    for name in ("panel_features", "average_precision", "similar_pairs", "split_temporal", "benchmark_overlap"):
        assert name in ORACLES
        text = plan(QUERIES[name](spark, sf_dir))
        assert not any(w in text for w in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct"))


def test_one_partitioning_serves_all_panel_windows(spark, sf_dir):
    text = plan(QUERIES["panel_features"](spark, sf_dir)).split("===")[0]
    tree = text.split("(1)")[0]
    assert tree.count("hashpartitioning(zone") <= 1
