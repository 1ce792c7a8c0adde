"""List filters as one helper."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_filters(df: DataFrame, exact: dict | None = None, partial: dict | None = None, between: dict | None = None) -> DataFrame:
    """Rows that agree with all given filters: equal values (or one of a list), substrings in any case, ranges; None is no filter."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in (exact or {}).items() if v is not None]
    tests += [F.lower(c).contains(v.lower()) for c, v in (partial or {}).items() if v is not None]
    for c, (low, high) in (between or {}).items():
        tests += ([F.col(c) >= low] if low is not None else []) + ([F.col(c) <= high] if high is not None else [])
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df
