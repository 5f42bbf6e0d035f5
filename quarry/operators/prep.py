"""Generated tables and dataset comparison."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar(spark: SparkSession, start: str | date, end: str | date, today: str | date | None = None) -> DataFrame:
    """GENERATE CALENDAR: a row of 27 columns for each day from start to end, both included."""
    d = F.col("Date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))).alias("Date")) if str(start) <= str(end) else spark.range(0).select(F.current_date().alias("Date"))
    quarter, month_end = F.quarter(d), d == F.last_day(d)
    weekday = F.dayofweek(d) - 1
    now = F.lit(str(today)).cast("date") if today else F.current_date()
    return days.select(
        (F.year(d) * 10000 + F.month(d) * 100 + F.day(d)).alias("DateKey"),
        "Date",
        F.date_format(d, "yyyy-MM-dd").alias("FullDateISO"),
        F.year(d).alias("Year"),
        quarter.alias("Quarter"),
        F.concat(F.year(d), F.lit("-Q"), quarter).alias("YearQuarter"),
        F.month(d).alias("Month"),
        F.date_format(d, "MMMM").alias("MonthName"),
        F.date_format(d, "MMM").alias("MonthShortName"),
        (F.year(d) * 100 + F.month(d)).alias("YearMonth"),
        F.day(d).alias("Day"),
        weekday.alias("DayOfWeek"),
        F.date_format(d, "EEEE").alias("DayName"),
        F.date_format(d, "EEE").alias("DayShortName"),
        F.dayofyear(d).alias("DayOfYear"),
        F.weekofyear(d).alias("ISOWeek"),
        weekday.isin(0, 6).alias("IsWeekend"),
        (~weekday.isin(0, 6)).alias("IsWeekday"),
        (F.day(d) == 1).alias("IsMonthStart"),
        month_end.alias("IsMonthEnd"),
        ((F.day(d) == 1) & (F.month(d) % 3 == 1)).alias("IsQuarterStart"),
        (month_end & (F.month(d) % 3 == 0)).alias("IsQuarterEnd"),
        (F.dayofyear(d) == 1).alias("IsYearStart"),
        ((F.month(d) == 12) & month_end).alias("IsYearEnd"),
        F.year(d).alias("FiscalYear"),
        F.concat(F.lit("FQ"), quarter).alias("FiscalQuarter"),
        F.datediff(d, now).alias("RelativeDays"),
    )


_GENERATOR = re.compile(r"(?is)^\s*(\w+)\s*(?:\((.*)\))?\s*$")


def _generated(spec: str, seed: int) -> Column:
    """A column from a generator text such as SEQUENCE(1,1), RANDOM_INT(1,9), RANDOM(a,b), CHOICE('a','b')."""
    kind, inner = _GENERATOR.match(spec).groups()
    kind = kind.upper()
    args = [a.strip().strip("'\"") for a in inner.split(",")] if inner and inner.strip() else []
    numeric = all(re.fullmatch(r"-?\d+(\.\d+)?", a) for a in args)
    pick = lambda items: F.element_at(F.array(*[F.lit(i) for i in items]), F.floor(F.rand(seed) * len(items)).cast("int") + 1)
    if kind == "SEQUENCE":
        start = args[0] if args else "1"
        if re.fullmatch(r"-?\d+", start):
            return F.lit(int(start)) + F.col("id") * (int(args[1]) if len(args) > 1 else 1)
        unit = args[2].upper().rstrip("S") if len(args) > 2 else "DAY"
        step = int(args[1]) if len(args) > 1 else 1
        return F.timestamp_add(unit, (F.col("id") * step).cast("int"), F.lit(start).cast("timestamp_ntz"))
    if kind == "RANDOM_INT" or kind == "RANDOM" and numeric and len(args) == 2 and all("." not in a for a in args):
        a, b = int(args[0]), int(args[1])
        return (F.floor(F.rand(seed) * (b - a + 1)) + a).cast("int")
    if kind == "RANDOM_DECIMAL" or kind == "RANDOM" and numeric and len(args) == 2:
        a, b = float(args[0]), float(args[1])
        return F.round(F.rand(seed) * (b - a) + a, 2).cast("decimal(38,2)")
    if kind == "RANDOM_DATE":
        return F.date_add(F.lit(args[0]).cast("date"), F.floor(F.rand(seed) * (F.datediff(F.lit(args[1]).cast("date"), F.lit(args[0]).cast("date")) + 1)).cast("int"))
    if kind == "RANDOM" and numeric and len(args) == 1:
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        return F.concat(*[F.substring(F.lit(letters), F.floor(F.rand(seed * 1000 + i) * len(letters)).cast("int") + 1, F.lit(1)) for i in range(int(args[0]))])
    if kind in ("RANDOM", "CHOICE") and args:
        return pick(args)
    if kind == "VALUE":
        return F.lit(args[0]) if args else F.lit(None).cast("string")
    raise ValueError(f"generator {spec!r}")


def generate_rows(spark: SparkSession, n: int, columns: dict[str, str], seed: int = 0) -> DataFrame:
    """GENERATE n ROWS: columns from generator texts, made in parallel; the same seed gives the same rows."""
    return spark.range(n).select(*[_generated(spec, seed * 131 + i).alias(c) for i, (c, spec) in enumerate(columns.items())])


def compare_datasets(source: DataFrame, baseline: DataFrame, key: list[str], exclude: list[str] = ()) -> DataFrame:
    """COMPARE DATASETS: rows of source that are new (INSERT) or changed (UPDATE) and rows only baseline has (DELETE).

    Columns: _change_type, _changed_columns (joined by ", "), the keys, and c_old and c_new for
    each compared column. Nulls are equal to each other; keys compare as text; of baseline rows
    with one key the largest counts.
    """
    gone = {c.lower() for c in [*key, *exclude]}
    other = {c.lower(): c for c in baseline.columns}
    compared = [c for c in source.columns if c.lower() not in gone and c.lower() in other]
    k = [f"__k{i}" for i in range(len(key))]
    new = source.select(*[F.col(c).cast("string").alias(n) for n, c in zip(k, key, strict=True)], F.struct(*[F.col(c) for c in [*key, *compared]]).alias("s"))
    old = baseline.select(*[F.col(other[c.lower()]).cast("string").alias(n) for n, c in zip(k, key, strict=True)], F.struct(*[F.col(other[c.lower()]).alias(c) for c in [*key, *compared]]).alias("b"))
    old = old.groupBy(*k).agg(F.max("b").alias("b"))
    same = None
    for n in k:
        e = F.col(f"n.{n}").eqNullSafe(F.col(f"o.{n}"))
        same = e if same is None else same & e
    both = new.alias("n").join(old.alias("o"), same, "full").select("s", "b")
    changed = F.filter(F.array(*[F.when(~F.col(f"s.`{c}`").eqNullSafe(F.col(f"b.`{c}`")), F.lit(c)) for c in compared]) if compared else F.array().cast("array<string>"), lambda x: x.isNotNull())
    kind = F.when(F.col("b").isNull(), "INSERT").when(F.col("s").isNull(), "DELETE").when(F.size("__c") > 0, "UPDATE")
    out = both.withColumn("__c", changed).withColumn("_change_type", kind).where("_change_type is not null")
    return out.select(
        "_change_type",
        F.when(F.col("_change_type") == "UPDATE", F.array_join("__c", ", ")).alias("_changed_columns"),
        *[F.coalesce(F.col(f"s.`{c}`"), F.col(f"b.`{c}`")).alias(c) for c in key],
        *[x for c in compared for x in (F.col(f"b.`{c}`").alias(f"{c}_old"), F.col(f"s.`{c}`").alias(f"{c}_new"))],
    )
