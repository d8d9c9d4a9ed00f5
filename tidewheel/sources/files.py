"""Loosely structured inputs: delimited files, ragged baskets, tagged unions, tolerant parsing, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """A delimited file with a header; without a schema every column is a string."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """One basket a line: items split at commas, trimmed, not empty, distinct and sorted; empty baskets go."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")))
    return spark.read.text(path).select(items.alias("items")).where(F.size("items") > 0)


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows of all parts by column name, with the part's name in the column tag."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def tidy_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def value_column(df: DataFrame, name: str, share: float = 0.5) -> str:
    """The column of this name, or where there is none the last one of which at least the share of filled cells are numbers."""
    if name in df.columns:
        return name
    filled = df.agg(*[F.struct(F.count(c), F.count(parse_number(F.col(c).cast("string")))).alias(c) for c in df.columns]).first()
    fit = [c for c in df.columns if filled[c][0] and filled[c][1] >= share * filled[c][0]]
    if not fit:
        raise KeyError(f"no column is named {name!r} and none holds numbers")
    return fit[-1]


def parse_time(column: Column, formats: Sequence[str]) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(column), F.lit(f)) for f in formats])


def parse_number(column: Column) -> Column:
    return F.trim(column).try_cast("double")


def finite(column: Column) -> Column:
    """Null in place of NaN and infinities, as JSON has neither."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)


def write_json(df: DataFrame, path: str, run: dict[str, str]) -> None:
    """JSON lines with a _run struct; doubles that are not finite become null and nulls are written."""
    doubles = {f.name: finite(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    stamp = F.struct(*[F.lit(v).alias(k) for k, v in run.items()])
    df.withColumns({**doubles, "_run": stamp}).write.option("ignoreNullFields", False).json(path)


def verify_digests(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files under path with their SHA-256 and whether it equals the manifest's (name, sha256); null where unlisted."""
    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("found")
    )
    return files.join(manifest, "name", "left").select("name", "bytes", "found", (F.col("found") == F.col("sha256")).alias("matches"))


def first_seen(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Files under path as verify_digests tells them against the record, a table of digests first seen; new files are added to it.

    Of files recorded more than once the earliest record counts, so a file
    that changes and comes back is told from its first state.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(record)
    known = "name string, sha256 string, seen timestamp"
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(known).parquet(record) if there else spark.createDataFrame([], known)
    first = rows.groupBy("name").agg(F.min_by("sha256", "seen").alias("sha256"))
    found = verify_digests(spark, path, first)
    new = found.where(F.col("matches").isNull()).select("name", F.col("found").alias("sha256"), F.current_timestamp().alias("seen"))
    told = [tuple(r) for r in found.collect()]  # a folder's files, told before the record grows
    new.write.mode("append").parquet(record)
    return spark.createDataFrame(told, found.schema)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON documents, one or more a file; unreadable ones keep their text in _corrupt_record where the schema is inferred."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_report(spark: SparkSession, path: str, most_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """Per file: name, bytes, whether its text is JSON, and whether it is larger than most_bytes."""
    files = spark.read.format("binaryFile").load(path)
    text = F.try_parse_json(F.col("content").cast("string"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), text.isNotNull().alias("valid"), (F.col("length") > most_bytes).alias("too_large"))


def stamped_files(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """Files under path (listed, not read) with the seconds that runs (name, seconds) measured; null where none did."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    return files.join(runs.groupBy("name").agg(F.max("seconds").alias("seconds")), "name", "left")


def without_leaks(df: DataFrame, leaks: Sequence[str]) -> DataFrame:
    """df without the columns known to give the outcome away; a name that is no column is an error."""
    if missing := set(leaks) - set(df.columns):
        raise KeyError(f"no columns named {sorted(missing)}")
    return df.drop(*leaks)
