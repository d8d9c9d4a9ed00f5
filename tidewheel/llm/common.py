"""Shared helpers: table access, scratch tables and lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from functools import reduce
from operator import and_
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources.memory import release
from tidewheel.sources.scratch import remove, shared_dir, written, written_at

__all__ = ["WORD", "beside_classes", "keep_nothing", "kept", "release", "remove", "shared_dir", "table", "text_of", "written", "written_at"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text as string; null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


#: A class is hot if it holds more than one of so many rows, so there are fewer hot ones than this.
HOT = 4096


def beside_classes(rows: DataFrame, classes: DataFrame, keys: Sequence[str], n: str, light: Column | None = None) -> DataFrame:
    """Rows with the columns of their class, which keys name (nulls are values); n, the number of rows in the class, is dropped.

    Classes that hold more than one in HOT of all rows are broadcast, which is
    fewer than HOT rows at any size; light says which classes are narrow enough
    for that (all, if it is not given). The rest meet their rows in a shuffle in
    which no key is hot. Both tables are read twice, so they should be written ones.
    """
    total = classes.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > F.lit(total / HOT)
    hot = hot if light is None else hot & light
    named = classes.withColumnsRenamed({k: f"_class_{k}" for k in keys})
    names = [f"_class_{k}" for k in keys]
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, names, strict=True)])
    few = F.broadcast(named.where(hot))
    met = rows.join(few, same)
    rest = rows.join(F.broadcast(named.where(hot).select(*names)), same, "left_anti").join(named.where(~hot), same)
    return met.unionByName(rest).drop(*names, n)


T = TypeVar("T")
_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """What a worker process keeps between its tasks: one large thing at a time.

    Workers outlive queries. What an earlier operator kept is dropped here, so
    that memory is bounded by the largest operator and not by their sum.
    """
    if key not in _kept:
        _kept.clear()
        release()
        _kept[key] = make()
    return _kept[key]


def keep_nothing() -> None:
    """For operators that keep nothing: drop what an earlier one kept."""
    kept("nothing", dict)
