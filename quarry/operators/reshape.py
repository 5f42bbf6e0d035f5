"""Pivot, unpivot, unnest and set operations by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max}


def pivot(df: DataFrame, column: str, using: dict[str, Column], group_by: list[str] | None = None, values: list | None = None) -> DataFrame:
    """PIVOT: one column for each value (and aggregate) of column; values not given are discovered, in order.

    using maps names to aggregates; with several, columns are named value_name. Without
    group_by, all columns that the call does not mention are grouped by.
    """
    if group_by is None:
        used = {column} | {c for c in df.columns if any(re.search(rf"\b{re.escape(c)}\b", str(a)) for a in using.values())}
        group_by = [c for c in df.columns if c not in used]
    grouped = df.groupBy(*group_by)
    rotated = grouped.pivot(column, values) if values is not None else grouped.pivot(column)
    return rotated.agg(*[a.alias(n) for n, a in using.items()])


def unpivot(df: DataFrame, columns: list[str], name: str = "name", value: str = "value", include_nulls: bool = False) -> DataFrame:
    """UNPIVOT: a row for each of columns, the other columns repeated; null values are left out."""
    out = df.unpivot([c for c in df.columns if c not in columns], columns, name, value)
    return out if include_nulls else out.where(F.col(value).isNotNull())


def unnest(df: DataFrame, column: str, value: str = "Value") -> DataFrame:
    """UNNEST of a list column: a row for each element; a value that is no list is one row, null none."""
    kind = dict(df.dtypes)[column]
    if not kind.startswith("array"):
        return df.where(F.col(column).isNotNull()).withColumn(value, F.col(column))
    return df.select("*", F.explode(column).alias(value))


def flatten(df: DataFrame, column: str, value: str = "Value") -> DataFrame:
    """FLATTEN: like unnest, with one nested level opened."""
    kind = dict(df.dtypes)[column]
    return df.select("*", F.explode(F.flatten(column)).alias(value)) if kind.startswith("array<array") else unnest(df, column, value)


def union_by_name(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    """UNION [ALL] BY NAME: a's columns, then those only b has; missing ones null; names without regard to case."""
    low = {c.lower(): c for c in a.columns}
    b = b.select(*[F.col(f"`{c}`").alias(low.get(c.lower(), c)) for c in b.columns])
    out = a.unionByName(b, allowMissingColumns=True)
    return out.distinct() if distinct else out


def select_columns(df: DataFrame, pattern: str | None = None, exclude: list[str] = ()) -> list[str]:
    """COLUMNS('regex') and COLUMNS(* EXCLUDE (..)): column names, in order."""
    gone = {c.lower() for c in exclude}
    return [c for c in df.columns if c.lower() not in gone and (pattern is None or re.search(pattern, c, re.I))]


def star(df: DataFrame, exclude: list[str] = (), replace: dict[str, str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """* EXCLUDE (..) REPLACE (expr AS c) RENAME (a AS b): columns in place, in that order of steps."""
    replace = {k.lower(): v for k, v in (replace or {}).items()}
    rename = {k.lower(): v for k, v in (rename or {}).items()}
    gone = {c.lower() for c in exclude}
    known = {c.lower() for c in df.columns}
    for c in [*gone, *replace, *rename]:
        if c not in known:
            raise ValueError(f"unknown column {c}")
    return df.select(*[F.expr(replace.get(c.lower(), f"`{c}`")).alias(rename.get(c.lower(), c)) for c in df.columns if c.lower() not in gone])
