"""Relational operators over DataFrames. Each states what it needs and leaves the physical strategy to Spark: the width of
scans, pushed filters, partial aggregation, the side of a join that is built and top-n are Catalyst's choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..errors import UnsupportedError


def project(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    return df.select(*columns)


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; unknown drops them."""
    return df.filter(condition)


def equi_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Inner join on all pairs; rows with a NULL key find no partner."""
    if not pairs:
        raise UnsupportedError("cross join (every table must be connected by an equality predicate)")
    condition = pairs[0][0] == pairs[0][1]
    for a, b in pairs[1:]:
        condition &= a == b
    return left.join(right, condition, "inner")


def aggregate(df: DataFrame, keys: Sequence[Column], aggregates: Sequence[Column]) -> DataFrame:
    """Grouped (NULL is a group; no rows from no rows), or without keys one row; without aggregates the distinct keys."""
    if not keys:
        return df.agg(*aggregates)
    return df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()


def order(df: DataFrame, keys: Sequence[tuple[Column, bool, bool]]) -> DataFrame:
    """Sorts by (column, ascending, nulls first); a limit above makes it a top-n."""
    named = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
    return df.orderBy(*(getattr(c, named[asc, first])() for c, asc, first in keys))


def window_of_rows(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """Skips ``offset`` rows and keeps ``limit``."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
