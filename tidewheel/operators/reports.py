"""Reports kept as JSON files of any shape: sizes, fields, headlines, and records of phases in their canonical order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """name, folder, bytes, v (variant, null where a file is no JSON), valid: one row a file below path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = files.select(F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), F.col("_metadata.file_size").alias("bytes"), F.try_parse_json("value").alias("v"))
    return rows.withColumn("valid", F.col("v").isNotNull())


def sizes(reports: DataFrame, most_bytes: int) -> DataFrame:
    """Per folder, and over all (folder null): n_files, n_invalid, bytes, and whether they are more than most_bytes."""
    one = reports.rollup("folder").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.sum("bytes").alias("bytes"))
    return one.withColumn("too_large", F.col("bytes") > most_bytes)


def fields(reports: DataFrame) -> DataFrame:
    """key, kind (as the variant's schema names it), n_reports: the top-level fields that the reports have."""
    objects = reports.where(F.schema_of_variant("v").startswith("OBJECT"))
    found = objects.lateralJoin(reports.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return found.groupBy("key", F.schema_of_variant("value").alias("kind")).agg(F.count(F.lit(1)).alias("n_reports"))


def headlines(reports: DataFrame, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """name, folder and, for each name of paths, what the report has at its (path, type); null where it has nothing of that type."""
    return reports.select("name", "folder", *[F.try_variant_get("v", path, kind).alias(c) for c, (path, kind) in paths.items()])


def phases(reports: DataFrame, key_path: str, array_path: str, order: Sequence[str]) -> DataFrame:
    """project, phases, recorded, missing, complete: each report's phases, however it lists them, in the canonical order.

    A phase listed more than once counts as its last entry; names out of the
    order are left out. phases holds structs of name, place and summary.
    """
    kind = "array<struct<name:string,summary:string>>"
    rows = reports.where("valid").select(F.try_variant_get("v", key_path, "string").alias("project"), F.coalesce(F.try_variant_get("v", array_path, kind), F.array().cast(kind)).alias("found"))
    names = F.array(*[F.lit(p) for p in order])

    def last(name: Column, place: Column) -> Column:
        own = F.filter("found", lambda x: x["name"] == name)
        return F.struct(name.alias("name"), (place + 1).alias("place"), F.get(own, F.size(own) - 1)["summary"].alias("summary"), (F.size(own) > 0).alias("there"))

    rows = rows.withColumn("all", F.transform(names, last))
    told = F.transform(F.filter("all", lambda x: x["there"]), lambda x: F.struct(x["name"].alias("name"), x["place"].alias("place"), x["summary"].alias("summary")))
    missing = F.transform(F.filter("all", lambda x: ~x["there"]), lambda x: x["name"])
    return rows.select("project", told.alias("phases"), F.size(told).cast("long").alias("recorded"), missing.alias("missing"), (F.size(missing) == 0).alias("complete"))
