"""The TRANSFORM algorithms, as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import sort_columns
from .reshape import AGGREGATES, pivot


def fill_dates(df: DataFrame, date_col: str, by_group: list[str] = (), gaps_fill=0) -> DataFrame:
    """A row for each day from a group's first to its last date; new rows hold gaps_fill in all other columns."""
    by_group = list(by_group)
    day = F.col(date_col).cast("date")
    span = df.groupBy(*by_group).agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    days = span.select(*by_group, F.explode(F.sequence("a", "b")).alias("__day"))
    had = df.withColumn("__day", day).withColumn("__had", F.lit(True))
    same = F.col("d.__day").eqNullSafe(F.col("s.__day"))
    for c in by_group:
        same = same & F.col(f"d.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
    joined = days.alias("d").join(had.alias("s"), same, "left")
    kinds = dict(df.dtypes)

    def column(c: str):
        if c in by_group:
            return F.col(f"d.`{c}`").alias(c)
        if c == date_col:
            return F.coalesce(F.col(f"s.`{c}`"), F.col("d.__day").cast(kinds[c])).alias(c)
        return F.when(F.col("s.__had"), F.col(f"s.`{c}`")).otherwise(F.lit(gaps_fill).try_cast(kinds[c])).alias(c)

    return joined.select(*[column(c) for c in df.columns])


def interpolate(df: DataFrame, value_col: str, order_col: str, method: str = "LINEAR", by_group: list[str] = ()) -> DataFrame:
    """Null values filled from their neighbours: LINEAR by the order column's distance, FORWARD or BACKWARD; ends without a neighbour stay null."""
    method = method.upper().removesuffix("_FILL")
    kind = dict(df.dtypes)[value_col]
    w = Window.partitionBy(*by_group).orderBy(order_col)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.col(value_col)
    if method == "FORWARD":
        return df.withColumn(value_col, F.last(v, ignorenulls=True).over(past))
    if method == "BACKWARD":
        return df.withColumn(value_col, F.first(v, ignorenulls=True).over(future))
    if method != "LINEAR":
        raise ValueError(f"method {method!r}: LINEAR, FORWARD or BACKWARD")
    place = F.col(order_col)
    x = place.cast("timestamp").cast("double") if dict(df.dtypes)[order_col].startswith(("date", "timestamp")) else place.cast("double")
    at = F.when(v.isNotNull(), x)
    out = df.withColumns(
        {
            "__v0": F.last(v, ignorenulls=True).over(past),
            "__x0": F.last(at, ignorenulls=True).over(past),
            "__v1": F.first(v, ignorenulls=True).over(future),
            "__x1": F.first(at, ignorenulls=True).over(future),
        }
    )
    line = F.col("__v0").cast("double") + (F.col("__v1").cast("double") - F.col("__v0").cast("double")) * (x - F.col("__x0")) / F.nullif(F.col("__x1") - F.col("__x0"), F.lit(0.0))
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return out.withColumn(value_col, F.coalesce(v, (F.round(line) if whole else line).cast(kind))).drop("__v0", "__x0", "__v1", "__x1")


def deduplicate(df: DataFrame, key_cols: list[str], order_by: str | None = None, keep: str = "FIRST") -> DataFrame:
    """One row of each key: the first or last in order_by."""
    last = keep.upper() == "LAST"
    order = sort_columns(order_by, reverse=last) if order_by else [F.monotonically_increasing_id().desc() if last else F.monotonically_increasing_id()]
    if not order_by:
        df_ = df.withColumn("__i", F.monotonically_increasing_id())
        order = [F.col("__i").desc() if last else F.col("__i")]
        return df_.withColumn("__n", F.row_number().over(Window.partitionBy(*key_cols).orderBy(*order))).where("__n = 1").drop("__n", "__i")
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key_cols).orderBy(*order))).where("__n = 1").drop("__n")


def pivot_table(df: DataFrame, row_fields: list[str], pivot_field: str, value_field: str, aggregate: str = "SUM") -> DataFrame:
    """A cross table: row_fields down, the values of pivot_field across."""
    return pivot(df, pivot_field, {value_field: AGGREGATES[aggregate.upper()](value_field)}, list(row_fields))


def top_n_others(df: DataFrame, n: int, value_col: str, category_col: str, others_label: str = "Others", aggregate: str = "SUM", by_group: list[str] = ()) -> DataFrame:
    """The n categories of largest aggregate (ties to the smaller name), all others together under others_label, aggregated from the base rows."""
    by_group = list(by_group)
    agg = AGGREGATES[aggregate.upper()]
    totals = df.groupBy(*by_group, category_col).agg(agg(value_col).alias("__t"))
    w = Window.partitionBy(*by_group).orderBy(F.desc("__t"), category_col)
    top = totals.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    top = top.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by_group)], F.col(category_col).alias("__c"), F.lit(True).alias("__top"))
    same = F.col(category_col).eqNullSafe(F.col("__c"))
    for i, c in enumerate(by_group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    flagged = df.join(top, same, "left").select(*by_group, value_col, F.when(F.col("__top"), F.col(category_col)).otherwise(F.lit(others_label)).alias(category_col))
    return flagged.groupBy(*by_group, category_col).agg(agg(value_col).alias(value_col))


def period_comparison(df: DataFrame, date_col: str, value_col: str, period: str = "MONTH", by_group: list[str] = (), diff_col: str | None = None, pct_col: str | None = None) -> DataFrame:
    """Difference from, and growth in percent over, the value one day, month or year before in the group; null without one (or over 0)."""
    diff_col, pct_col = diff_col or f"{value_col}_Diff", pct_col or f"{value_col}_Pct"
    kind = dict(df.dtypes)[date_col]
    step = {"DAY": "interval 1 day", "MONTH": "interval 1 month", "YEAR": "interval 1 year"}[period.upper()]
    d = F.col(date_col)
    prior = df.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by_group)], d.alias("__d"), F.col(value_col).alias("__p"))
    prior = prior.groupBy(*[c for c in prior.columns if c != "__p"]).agg(F.first("__p").alias("__p"))
    before = (d - F.expr(step)).cast(kind)
    same = before == F.col("__d")
    for i, c in enumerate(by_group):
        same = same & df[c].eqNullSafe(F.col(f"__g{i}"))
    out = df.join(prior, same, "left")
    diff = F.col(value_col) - F.col("__p")
    return out.select(*[df[c] for c in df.columns], diff.alias(diff_col), F.try_divide(diff * 100, F.col("__p")).alias(pct_col))


def _ungrouped(df: DataFrame, by_group: list[str], aggs: dict) -> DataFrame:
    """df with aggregates of its group; without a group, of all rows: joined as one row, not a window in one task."""
    if by_group:
        w = Window.partitionBy(*by_group)
        return df.withColumns({k: v.over(w) for k, v in aggs.items()})
    return df.join(F.broadcast(df.agg(*[v.alias(k) for k, v in aggs.items()])))


def share_of_total(df: DataFrame, value_col: str, by_group: list[str] = (), share_col: str | None = None) -> DataFrame:
    """The value as a fraction of its group's, or all rows', total; null over a total of 0."""
    out = _ungrouped(df, list(by_group), {"__s": F.sum(value_col)})
    return out.withColumn(share_col or f"{value_col}_Share", F.try_divide(F.col(value_col).cast("double"), F.col("__s"))).drop("__s")


def normalize(df: DataFrame, value_col: str, method: str = "MIN_MAX", by_group: list[str] = (), norm_col: str | None = None) -> DataFrame:
    """MIN_MAX: (x - min) / (max - min); Z_SCORE: (x - mean) / standard deviation of the population; 0 where that is 0."""
    name, v = norm_col or f"{value_col}_Normalized", F.col(value_col).cast("double")
    if method.upper() == "MIN_MAX":
        out = _ungrouped(df, list(by_group), {"__a": F.min(v), "__b": F.max(v) - F.min(v)})
    elif method.upper() == "Z_SCORE":
        out = _ungrouped(df, list(by_group), {"__a": F.avg(v), "__b": F.stddev_pop(v)})
    else:
        raise ValueError(f"method {method!r}: MIN_MAX or Z_SCORE")
    scaled = F.when(F.col("__b") == 0, 0.0).otherwise((v - F.col("__a")) / F.nullif(F.col("__b"), F.lit(0.0)))
    return out.withColumn(name, F.when(v.isNotNull(), scaled)).drop("__a", "__b")


def rolling_aggregate(df: DataFrame, value_col: str, order_col: str, window_size: int, aggregate: str = "AVG", by_group: list[str] = (), rolling_col: str | None = None) -> DataFrame:
    """An aggregate over the last window_size rows of the order, the current one included."""
    w = Window.partitionBy(*by_group).orderBy(order_col).rowsBetween(-(window_size - 1), 0)
    return df.withColumn(rolling_col or f"{value_col}_Rolling", AGGREGATES[aggregate.upper()](value_col).over(w))


ALGORITHMS = {
    "FILL_DATES": fill_dates,
    "INTERPOLATE": interpolate,
    "DEDUPLICATE": deduplicate,
    "PIVOT": pivot_table,
    "TOP_N_OTHERS": top_n_others,
    "PERIOD_COMPARISON": period_comparison,
    "SHARE_OF_TOTAL": share_of_total,
    "NORMALIZE": normalize,
    "ROLLING_AGGREGATE": rolling_aggregate,
}
