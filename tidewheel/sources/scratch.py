"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset on a local master (tests) a folder of this machine
    is taken and recorded in the session. On a cluster it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidewheel.scratch.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("tidewheel.scratch.dir", where)
    return where.rstrip("/")


def written_at(df: DataFrame, label: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder; the table, read again, and its path.

    This cuts the lineage, so lost executors do not repeat the work before it,
    and expensive columns are computed once however often they are used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    return written_at(df, label, compression)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that written_at made and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
