"""Guards against looking ahead: a reader of analysed plans, and the perturbation test."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from tidewheel.operators.market import rescaled_after

FRAME = re.compile(r"specifiedwindowframe\(\w+, [^,]+, ([^)]+?)\)\)?")


def forward_frames(df: DataFrame) -> list[str]:
    """Window frames of the analysed plan that end after the current row, and leads."""
    plan = df._jdf.queryExecution().analyzed().toString()
    ends = [m[0] for m in FRAME.finditer(plan) if re.match(r"[1-9]|unboundedfollowing", m[1])]
    leads = re.findall(r"\blead\([^)]*\)", plan)
    return [f for f in ends if "unboundedpreceding" not in f.split(",")[1]] + leads


def require_backward(df: DataFrame) -> DataFrame:
    if found := forward_frames(df):
        raise ValueError(f"these windows look ahead: {found}")
    return df


def moved_features(bars: DataFrame, features: Callable[[DataFrame], DataFrame], columns: list[str], day: str) -> DataFrame:
    """Rows before day whose features change when everything from day on is scaled; none, if nothing looks ahead."""

    def before(df: DataFrame) -> DataFrame:
        return features(df).where(f"day < date'{day}'").select("day", *columns)

    return before(bars).exceptAll(before(rescaled_after(bars, day, 1.5)))
