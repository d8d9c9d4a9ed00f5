from pyspark.sql import functions as F

from tidewheel import streaming


def test_hourly_counts_follow_batch(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.orderBy("ts").coalesce(1).write.parquet(source)
    stream = streaming.event_stream(spark, source)
    query = streaming.to_table(streaming.hourly_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = {(r["event_type"], r["hour"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = batch.groupBy("event_type", F.date_trunc("HOUR", F.col("ts").cast("timestamp")).alias("hour")).count().collect()
    want = {(r["event_type"], r["hour"]): r["count"] for r in want}
    assert got and all(want[k] == n for k, n in got.items())


def test_sessions_and_duplicates_have_streaming_plans(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(100).write.parquet(source)
    for k, make in enumerate((streaming.sessions, streaming.deduplicated)):
        query = streaming.to_table(make(streaming.event_stream(spark, source)), str(tmp_path / f"out{k}"), str(tmp_path / f"ck{k}"))
        query.awaitTermination(120)
        assert query.exception() is None
