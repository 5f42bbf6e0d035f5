"""Window features beyond Spark SQL: QUALIFY, GROUPS frames, frame exclusion, FILTER on windows; top-n forms and samples.

Orders are texts such as "amount DESC, id" (see order.keys).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .order import keys, sort_columns
from .recursion import written

UNBOUNDED = (Window.unboundedPreceding, Window.unboundedFollowing)


def qualify(df: DataFrame, window: Column, predicate: Callable[[Column], Column]) -> DataFrame:
    """Rows for which predicate holds of a window expression; the expression is not kept."""
    return df.withColumn("__q", window).where(predicate(F.col("__q"))).drop("__q")


def filtered(column: Column, condition: Column) -> Column:
    """The argument of AGG(column) FILTER (WHERE condition) OVER w: null where the condition fails, as aggregates skip nulls."""
    return F.when(condition, column)


def groups_frame(df: DataFrame, partition: list[str], order: str, name: str, make: Callable[[WindowSpec], Column], start: int, end: int) -> DataFrame:
    """df with name = make(window), whose frame counts peer groups from start to end.

    The order's dense rank numbers the groups; a RANGE frame over it spans whole groups.
    """
    g = F.dense_rank().over(Window.partitionBy(*partition).orderBy(*sort_columns(order)))
    frame = Window.partitionBy(*partition).orderBy("__g").rangeBetween(start, end)
    return df.withColumn("__g", g).withColumn(name, make(frame)).drop("__g")


def exclude(df: DataFrame, partition: list[str], order: str, name: str, agg: str, column: str, rows: tuple[int, int] = UNBOUNDED, what: str = "CURRENT ROW") -> DataFrame:
    """df with name = agg(column) over a ROWS frame with EXCLUDE what: CURRENT ROW, GROUP, TIES or NO OTHERS.

    sum, count and avg without the current row subtract it from the frame's running totals. The
    other cases hold the frame of the row at hand, so they fit bounded frames.
    """
    agg, what = agg.lower(), what.upper()
    spec = Window.partitionBy(*partition).orderBy(*sort_columns(order))
    frame = spec.rowsBetween(*rows)
    x = F.col(column)
    if what == "NO OTHERS":
        return df.withColumn(name, getattr(F, agg)(x).over(frame))
    if what == "CURRENT ROW" and agg in ("sum", "count", "avg"):
        inside = F.lit(rows[0] <= 0 <= rows[1]) & x.isNotNull()
        n = F.count(x).over(frame) - inside.cast("long")
        total = F.sum(x).over(frame) - F.when(inside, x).otherwise(0)
        return df.withColumn(name, {"count": n, "sum": F.when(n > 0, total), "avg": F.when(n > 0, total / n)}[agg])
    gone = {"CURRENT ROW": "v.rn <> __rn", "GROUP": "v.peer <> __peer", "TIES": "v.peer <> __peer or v.rn = __rn"}[what]
    held = df.withColumn("__rn", F.row_number().over(spec)).withColumn("__peer", F.dense_rank().over(spec))
    held = held.withColumn("__f", F.collect_list(F.struct(F.col("__rn").alias("rn"), F.col("__peer").alias("peer"), x.alias("x"))).over(frame))
    left = f"filter(transform(filter(__f, v -> {gone}), v -> v.x), x -> x is not null)"
    total = f"aggregate({left}, cast(0 as double), (a, x) -> a + x)"
    expression = {
        "sum": f"case when size({left}) > 0 then {total} end",
        "count": f"cast(size({left}) as bigint)",
        "avg": f"case when size({left}) > 0 then {total} / size({left}) end",
        "min": f"array_min({left})",
        "max": f"array_max({left})",
    }[agg]
    return held.withColumn(name, F.expr(expression)).drop("__rn", "__peer", "__f")


def top_n(df: DataFrame, order: str, n: int, offset: int = 0) -> DataFrame:
    """TOP n, or LIMIT n OFFSET m, of an order."""
    out = df.orderBy(*sort_columns(order))
    return (out.offset(offset) if offset else out).limit(n)


def top_with_ties(df: DataFrame, order: str, n: int) -> DataFrame:
    """TOP n WITH TIES: the first n rows of an order and all peers of the last.

    A distributed top-n of the sort keys finds the boundary; rows are compared with it, so
    nothing is ranked over the whole table.
    """
    if n <= 0:
        return df.limit(0)
    ks = keys(order)
    names = [f"__o{i}" for i in range(len(ks))]
    keyed = df.withColumns({name: F.expr(k.expression) for k, name in zip(ks, names, strict=True)})
    first = keyed.select(*names).orderBy(*[k.sort(name) for k, name in zip(ks, names, strict=True)]).limit(n)
    edge = first.orderBy(*[k.sort(name, reverse=True) for k, name in zip(ks, names, strict=True)]).limit(1)
    edge = edge.select(*[F.col(c).alias(f"{c}_e") for c in names])
    keep, equal = F.lit(False), F.lit(True)
    for k, name in zip(ks, names, strict=True):
        keep = keep | (equal & k.before(name, f"{name}_e"))
        equal = equal & F.col(name).eqNullSafe(F.col(f"{name}_e"))
    return keyed.join(F.broadcast(edge), keep | equal).select(*df.columns)


#: Rows up to which a top-n is taken as such; more are found by a boundary.
TOP_ROWS = 1_000_000


def top_percent(df: DataFrame, order: str, percent: float, top_rows: int = TOP_ROWS) -> DataFrame:
    """TOP n PERCENT: the first ceil(rows * n / 100) rows of an order.

    Beyond top_rows the sort keys alone are sorted and written; the place of the last row in
    them is found from the row counts of their files, and rows are compared with its keys. Of
    its peers as many are taken as are missing, so nothing but peers goes through one task.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie in 0..100")
    n = ceil(Decimal(df.count()) * Decimal(str(percent)) / 100)
    if n <= top_rows:
        return df.orderBy(*sort_columns(order)).limit(n)
    ks = keys(order)
    names = [f"__o{i}" for i in range(len(ks))]
    keyed = df.withColumns({name: F.expr(k.expression) for k, name in zip(ks, names, strict=True)})
    places = written(keyed.select(*names).orderBy(*[k.sort(name) for k, name in zip(ks, names, strict=True)]))
    at = places.select(*names, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    left = n - 1
    for file, rows in sorted((r["__file"], r["count"]) for r in at.groupBy("__file").count().collect()):
        if left < rows:
            break
        left -= rows
    edge = at.where((F.col("__file") == file) & (F.col("__row") == left)).select(*[F.col(c).alias(f"{c}_e") for c in names])
    before, equal = F.lit(False), F.lit(True)
    for k, name in zip(ks, names, strict=True):
        before = before | (equal & k.before(name, f"{name}_e"))
        equal = equal & F.col(name).eqNullSafe(F.col(f"{name}_e"))
    missing = n - places.join(F.broadcast(edge), before).count()
    first = keyed.join(F.broadcast(edge), before).select(*df.columns)
    peers = keyed.join(F.broadcast(edge), equal).select(*df.columns).limit(missing)
    return first.union(peers).orderBy(*sort_columns(order))


def sample_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """USING SAMPLE n ROWS: exactly n rows (all, if fewer), as a distributed top-n of random numbers."""
    if n < 0:
        raise ValueError("a sample cannot be negative")
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")


def sample_percent(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """USING SAMPLE p PERCENT: each row with chance p / 100."""
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie in 0..100")
    return df.where(F.rand(seed) < percent / 100)
