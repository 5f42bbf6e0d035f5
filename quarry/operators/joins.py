"""Joins that Spark SQL has no syntax for: as-of, fuzzy and lateral top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import similarity
from .order import sort_columns
from .recursion import written

#: Rows of both sides per time slice of an as-of join; each key's rows are cut into slices, so that a hot key is not one task.
SLICE_ROWS = 4_000_000

#: Pairs of rows that a task of a fuzzy join makes; and the most tasks that left rows are dealt to.
PAIR_ROWS, PAIR_TASKS = 4_000_000, 20_000

#: Rows of one text that a fuzzy join packs together at most; and how often a row moves where the right side is not broadcast.
PACK_ROWS, MOVES = 512, 10


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    on: list[str | tuple[str, str]] = (),
    op: str = ">=",
    how: str = "left",
    suffix: str = "_right",
    slices: int | None = None,
) -> DataFrame:
    """Each left row with at most one right row: equal keys and the nearest ts with left_ts op right_ts.

    >= and > take the largest such right value, <= and < the smallest. Null keys and null
    times never match; of right rows with the same time one is taken (the largest row). how is
    "left" (unmatched rows padded with nulls) or "inner". Right columns whose name is taken get
    suffix.

    Both sides are tagged, united and ordered once; no pair of rows is ever formed. Time is cut
    into slices of about SLICE_ROWS rows, each ordered on its own, and the last right row of a
    slice is carried to those after it, so one key may hold most of the rows.
    """
    if op not in (">=", ">", "<=", "<"):
        raise ValueError(f"op {op!r}: one of >= > <= <")
    if how not in ("left", "inner"):
        raise ValueError(f"how {how!r}: left or inner")
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    back = op[0] == ">"
    names = {c: c + suffix if c in left.columns else c for c in right.columns}
    if len(set(names.values()) | set(left.columns)) != len(names) + len(left.columns):
        raise ValueError("column names still clash with the suffix")
    keys = [f"__k{i}" for i in range(len(pairs))]
    tag = lambda df, side, ts, cols, other: df.select(
        *[F.col(c).alias(k) for k, c in zip(keys, cols, strict=True)],
        F.col(ts).alias("__ts"),
        F.lit(side).alias("__side"),
        *other,
    )
    l_row, r_row = F.struct(*[F.col(c) for c in left.columns]), F.struct(*[F.col(c) for c in right.columns])
    usable = right.where(F.col(right_ts).isNotNull())
    for _, r in pairs:
        usable = usable.where(F.col(r).isNotNull())
    # on equal times a right row counts for >= and <=: it then comes before the left row in the order of the scan
    first = op.endswith("=")
    both = tag(left, 1 if first else 0, left_ts, [a for a, _ in pairs], [l_row.alias("__l"), F.lit(None).cast(right.schema).alias("__r")]).unionByName(
        tag(usable, 0 if first else 1, right_ts, [b for _, b in pairs], [F.lit(None).cast(left.schema).alias("__l"), r_row.alias("__r")])
    )
    if slices is None:  # rows of both sides count: either may hold most of one key
        slices = max(1, -(-(left.count() + right.count()) // SLICE_ROWS))
    kind = dict(both.dtypes)["__ts"]
    number = F.col("__ts").cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col("__ts").cast("double")
    if slices > 1:
        cuts = both.select(number.alias("x")).approxQuantile("x", [i / slices for i in range(1, slices)], 0.5 / slices)
        place = F.lit(0)
        for c in sorted(set(cuts)):
            place = place + (number >= F.lit(c)).cast("int")
        both = both.withColumn("__slice", F.coalesce(place if back else -place, F.lit(-1_000_000)))
        part = [*keys, "__slice"]
    else:
        part = keys
    time = F.col("__ts").asc() if back else F.col("__ts").desc()
    w = Window.partitionBy(*part).orderBy(time, F.col("__side"), F.col("__r"))
    seen = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__m", seen)
    if slices > 1:
        last = both.where("__r is not null").groupBy(*keys, "__slice").agg((F.max_by if back else F.min_by)("__r", F.struct("__ts", "__r")).alias("__c"))
        later = Window.partitionBy(*keys).orderBy("__slice")
        slots = both.select(*keys, "__slice").distinct().join(last, [*keys, "__slice"], "left")
        carried = slots.withColumn("__before", F.last("__c", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, -1))).where("__before is not null").drop("__c")
        out = out.where("__l is not null").join(carried, [*keys, "__slice"], "left").withColumn("__m", F.coalesce("__m", "__before"))
    out = out.where("__l is not null").withColumn("__m", F.when(F.col("__ts").isNotNull(), F.col("__m")))
    if how == "inner":
        out = out.where("__m is not null")
    return out.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__m.`{c}`").alias(names[c]) for c in right.columns])


def trigrams(text: Column) -> Column:
    """Distinct lower-case trigrams of ' text '; none for null or empty."""
    s = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
    return F.when(F.length(text) > 0, F.array_distinct(grams))


def fuzzy_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float, mode: str = "JAROWINKLER", op: str = ">", keep_best: int | None = None, how: str = "inner", suffix: str = "_right", digits: int | None = None) -> DataFrame:
    """Pairs of rows whose texts are similar, with their __score; candidates share a trigram.

    Texts are reduced to their distinct values first, so equal names are scored once, however
    many rows have them (and the score that is returned is rounded once, if digits are given).
    The similar texts are a written table, with the numbers of rows of each. A result of more than
    PAIR_ROWS pairs comes from packs of rows (see packed_pairs). keep_best keeps the n right
    rows of highest score per left row (ties to the smaller right row); how="left" keeps unmatched
    left rows with a null score. Null and empty texts match nothing.
    """
    compare = {">": lambda s: s > threshold, ">=": lambda s: s >= threshold}[op]
    names = {c: c + suffix if c in left.columns else c for c in right.columns}
    a = left.select(F.col(left_on).alias("__a")).where("length(__a) > 0").distinct()
    b = right.select(F.col(right_on).alias("__b")).where("length(__b) > 0").distinct()
    grams_a = a.select("__a", F.explode(trigrams(F.col("__a"))).alias("g"))
    grams_b = b.select("__b", F.explode(trigrams(F.col("__b"))).alias("g"))
    pairs = grams_a.join(grams_b, "g").select("__a", "__b").distinct()
    scored = pairs.withColumn("__score", similarity(F.col("__a"), F.col("__b"), mode)).where(compare(F.col("__score")))
    scored = scored if digits is None else scored.withColumn("__score", F.round("__score", digits))
    count = lambda df, on, name, n: df.groupBy(F.col(on).alias(name)).agg(F.count("*").cast("double").alias(n))
    scored = written(scored.join(count(left, left_on, "__a", "__na"), "__a").join(count(right, right_on, "__b", "__nb"), "__b"))
    total = scored.agg(F.sum(F.expr("__na * __nb"))).first()[0] or 0
    rows = left.withColumn("__id", F.monotonically_increasing_id()) if keep_best or how == "left" else left
    renamed = right.select(*[F.col(c).alias(names[c]) for c in right.columns])
    if total < PAIR_ROWS:
        out = rows.join(scored, F.col(left_on) == F.col("__a"), how).join(renamed, F.col("__b") == F.col(names[right_on]), how)
    else:
        out = packed_pairs(rows, renamed, scored, left_on, names[right_on], total).select(*rows.columns, *names.values(), "__score")
        if how == "left":
            out = out.unionByName(rows.join(scored, F.col(left_on) == F.col("__a"), "left_anti"), allowMissingColumns=True)
    if keep_best:
        w = Window.partitionBy("__id").orderBy(F.desc("__score"), *[F.col(c) for c in names.values()])
        out = out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep_best)
    return out.select(*left.columns, *names.values(), "__score")


def packed_pairs(left: DataFrame, right: DataFrame, scored: DataFrame, left_on: str, right_on: str, total: float) -> DataFrame:
    """left and right rows of the texts __a and __b of scored (with __score and rows of each, __na and __nb), total pairs.

    Rows of a text are packed into arrays on both sides, and two packs are unrolled last, left
    rows within each right row: what is shuffled, sorted or spilled is packs, and in the result
    runs of a pack's length share text, score and right row, and left rows come round in the same
    order, which columnar files hold in about a bit a row. Pairs of packs are dealt to tasks
    evenly. A right side that may not be broadcast is cut into parts of each text, and so are the
    rows that it meets; each two parts are one task. The parts are so large that a row moves about
    MOVES times, however many pairs there are.
    """

    def packed(df: DataFrame, on: str, key: str, size: Column, rows: str) -> DataFrame:
        # the text is known from the key, unless its type has another equality than the plain string
        kept = [c for c in df.columns if c != on or dict(df.dtypes)[c] != "string"] or [on]
        size = F.greatest(F.lit(1), F.least(F.lit(PACK_ROWS), size)).cast("int")
        sizes = scored.groupBy(key).agg(F.max(rows).alias("__n"), F.when(size < 8, size).otherwise(size - size % 8).alias("__size"))
        numbered = df.withColumn("__u", F.xxhash64(F.monotonically_increasing_id())).join(sizes, F.col(on) == F.col(key))
        # rows are dealt by hash into about 8 packs, then cut, so that most packs are equally long
        groups = numbered.groupBy(key, "__size", F.pmod("__u", F.ceil(F.col("__n") / F.col("__size") / 8)).alias("__i")).agg(F.collect_list(F.struct(*kept)).alias("__rows"))
        starts = F.sequence(F.lit(1), F.size("__rows"), F.col("__size"))
        cut = groups.select(key, "__i", F.posexplode(F.transform(starts, lambda x: F.slice("__rows", x, F.col("__size")))).alias("__p", "__rows"))
        return cut.select(key, (F.col("__i") * 8 + F.col("__p")).alias("__i"), "__rows")

    def unrolled(df: DataFrame, side: DataFrame, key: str, rows: str, others: list[str]) -> DataFrame:
        # generated code would hold all rows that come from one; there is none for a lambda, so rows are yielded one by one
        out = df.select(*others, key, F.explode(F.transform(rows, lambda x: x)).alias("__row"))
        inside = set(df.schema[rows].dataType.elementType.names)
        return out.select(*others, *[F.col(f"__row.`{c}`" if c in inside else key).alias(c) for c in side.columns])

    texts = scored.select("__a", "__b", "__score")
    most = max(PAIR_ROWS, total / PAIR_TASKS)
    units = packed(left, left_on, "__a", F.floor(most / 2 / F.max("__nb")), "__na").withColumnsRenamed({"__rows": "__lefts", "__i": "__li"})
    packs = packed(right, right_on, "__b", F.lit(PACK_ROWS), "__nb").withColumnsRenamed({"__rows": "__rights", "__i": "__ri"})
    limit = left.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit:
        units = units.join(texts, "__a").repartition(min(PAIR_TASKS, int(total // PAIR_ROWS) + 1))
        out = units.join(F.broadcast(packs), "__b")
    else:
        rows = sum(scored.select(c, n).distinct().agg(F.sum(n)).first()[0] for c, n in (("__a", "__na"), ("__b", "__nb")))
        side = max(PAIR_ROWS**0.5, 2 * total / (MOVES * rows))
        cuts = lambda n: F.greatest(F.lit(1), F.round(n / side)).cast("long")
        parts = scored.groupBy("__b").agg(cuts(F.sum("__na")).alias("__g"), cuts(F.max("__nb")).alias("__h"))
        n = min(PAIR_TASKS, int(parts.agg(F.sum(F.expr("__g * __h"))).first()[0]))
        each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        cell = ["__b", "__x", "__y"]
        units = units.join(texts.join(parts, "__b"), "__a").withColumn("__x", F.pmod(F.xxhash64("__a", "__li"), "__g")).withColumn("__y", each("__h"))
        packs = packs.join(parts, "__b").withColumn("__y", F.pmod("__ri", "__h")).withColumn("__x", each("__g"))
        out = units.select("__a", "__lefts", "__score", *cell).repartition(n, *cell).join(packs.select("__rights", *cell).repartition(n, *cell), cell)
    out = unrolled(out, right, "__b", "__rights", ["__a", "__lefts", "__score"])
    return unrolled(out, left, "__a", "__lefts", [*right.columns, "__score"])


def lateral_top_n(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], order: str, n: int, how: str = "inner", suffix: str = "_right") -> DataFrame:
    """APPLY / LATERAL with ORDER BY and LIMIT: the first n right rows of each left row's key.

    The right side is ranked once per key, before the join, so no more than n rows of a key are
    joined. how="left" is OUTER APPLY.
    """
    names = {c: c + suffix if c in left.columns else c for c in right.columns}
    w = Window.partitionBy(*[b for _, b in on]).orderBy(*sort_columns(order))
    top = right.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    top = top.select(*[F.col(c).alias(names[c]) for c in right.columns])
    condition = None
    for a, b in on:
        c = left[a] == top[names[b]]
        condition = c if condition is None else condition & c
    return left.join(top, condition, "left" if how == "left" else "inner")


def semi_join_filter(remote: DataFrame, local: DataFrame, remote_key: str, local_key: str, limit: int = 1000) -> DataFrame:
    """remote restricted to local's keys: an IN list (which JDBC sources push down) for up to `limit` keys, else a semi join."""
    keys = [r[0] for r in local.select(local_key).where(F.col(local_key).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(keys) <= limit:
        return remote.where(F.col(remote_key).isin(keys))
    return remote.join(local.select(F.col(local_key).alias(remote_key)), remote_key, "left_semi")
