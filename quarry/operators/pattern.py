"""MATCH_RECOGNIZE: greedy row patterns over ordered partitions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import sort_columns

_PART = re.compile(r"\s*([A-Za-z_]\w*)\s*([+*?]|\{\s*\d*\s*(?:,\s*\d*\s*)?\})?")
_CALL = re.compile(r"(?i)\b(first|last|prev|next|max|min|sum|avg|count)\s*\(\s*(?:(\w+)\.)?(\w+|\*)\s*(?:,\s*(\d+)\s*)?\)")
MANY = 1 << 62


def parse_pattern(pattern: str) -> list[tuple[str, int, int]]:
    """(variable, least, most) parts of a pattern such as "A B+ C{2,3} D?"."""
    out, at = [], 0
    pattern = pattern.strip()
    while at < len(pattern):
        m = _PART.match(pattern, at)
        if not m:
            raise ValueError(f"pattern {pattern!r} at {pattern[at:]!r}")
        q = m[2] or ""
        if q.startswith("{"):
            low, comma, high = q[1:-1].replace(" ", "").partition(",")
            least = int(low or 0)
            most = int(high) if high else MANY if comma else least
        else:
            least, most = {"": (1, 1), "+": (1, MANY), "*": (0, MANY), "?": (0, 1)}[q]
        out.append((m[1], least, most))
        at = m.end()
    if not out:
        raise ValueError("empty pattern")
    return out


class Matcher:
    """Feeds rows (bit k: part k's condition holds) to a pattern, greedily and without backtracking.

    A match that fails starts again one row later; a match that ends is followed by the next row.
    Only the rows since the current start are held.
    """

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts
        self.reset()

    def reset(self) -> None:
        self.pending: list[int] = []
        self.labels: list[int] = []
        self.taken = self.number = 0

    def _finish(self, out: list[tuple[int, int]]) -> None:
        self.number += 1
        out += [(self.number, k) for k in self.labels]
        del self.pending[: len(self.labels)]
        self.labels = []

    def feed(self, row: int | None) -> list[tuple[int, int]]:
        """(match number or 0, part) of the rows that are settled by this row; None ends the partition."""
        out: list[tuple[int, int]] = []
        if row is not None:
            self.pending.append(row)
        while True:
            done = self._run(row is None)
            if done is None:
                return out
            if done and self.labels:
                self._finish(out)
            elif self.pending:
                out.append((0, -1))
                del self.pending[0]
                self.labels = []
            else:
                return out

    def _run(self, ended: bool) -> bool | None:
        """Whether the match from the first pending row ends (True), fails (False), or needs more rows (None)."""
        labels = self.labels
        # the last part that took rows and how many, kept so that a long match is not read again with each row
        k, c = (labels[-1], self.taken) if labels else (0, 0)
        at = len(labels)
        while True:
            var, least, most = self.parts[k]
            if at < len(self.pending):
                if c < most and self.pending[at] >> k & 1:
                    labels.append(k)
                    c, at = c + 1, at + 1
                    self.taken = c
                    if c == most and k == len(self.parts) - 1:
                        return True
                    continue
            elif not ended and not (c == most and k == len(self.parts) - 1):
                return None
            if c < least:
                return False
            k, c = k + 1, 0
            if k == len(self.parts):
                return True


def match_recognize(
    df: DataFrame,
    order_by: str,
    pattern: str,
    define: dict[str, str],
    measures: dict[str, str],
    partition_by: list[str] = (),
    all_rows: bool = False,
) -> DataFrame:
    """Rows of MATCH_RECOGNIZE: ONE ROW PER MATCH (partition columns and measures), or ALL ROWS.

    define maps variables to SQL conditions, which may use PREV(x[, n]) and NEXT(x[, n]); a
    variable without one matches any row, one that the pattern lacks is an error. Measures are
    SQL over FIRST, LAST and aggregates of a column, or of a variable's rows as in LAST(B.price);
    A.price alone is that of the first A row. ALL ROWS keeps every column and adds MATCH_NUMBER
    and CLASSIFIER; numbers count over all partitions in their order.

    Conditions are evaluated as columns; the matcher streams the sorted rows of a partition and
    holds those of the match at hand only.
    """
    parts = parse_pattern(pattern)
    names = [p[0] for p in parts]
    lower = {n.lower(): n for n in names}
    for v in define:
        if v.lower() not in lower:
            raise ValueError(f"DEFINE variable {v} is not in the pattern")
    conditions = {k.lower(): v for k, v in define.items()}
    sort = sort_columns(order_by)
    w = Window.partitionBy(*partition_by).orderBy(*sort)
    rows = df.withColumn("__rn", F.row_number().over(w))
    columns: dict[str, str] = {}

    def neighbour(m: re.Match) -> str:
        kind, column, n = m[1].lower(), m[3], int(m[4] or 1)
        if kind not in ("prev", "next"):
            return m[0]
        name = f"__{kind}{n}_{column}"
        columns[name] = column
        nonlocal rows
        if name not in rows.columns:
            rows = rows.withColumn(name, (F.lag if kind == "prev" else F.lead)(column, n).over(w))
        return name

    flags = F.lit(0).cast("long")
    for k, name in enumerate(names):
        text = conditions.get(name.lower(), "true")
        text = _CALL.sub(neighbour, text)
        text = re.sub(rf"(?i)\b(?:{'|'.join(map(re.escape, names))})\.(\w+)", r"\1", text)
        flags = flags + F.when(F.coalesce(F.expr(text).cast("boolean"), F.lit(False)), F.lit(1 << k)).otherwise(0)
    rows = rows.withColumn("__flags", flags).drop(*columns)
    rows = rows.withColumn("__part", F.struct(*[F.col(c) for c in partition_by]).cast("string") if partition_by else F.lit(""))
    dealt = rows.repartition(*[F.col(c) for c in partition_by]) if partition_by else rows.coalesce(1)
    dealt = dealt.sortWithinPartitions(*partition_by, "__rn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, held, found, last = Matcher(parts), [], [], None

        def settled() -> pd.DataFrame | None:
            """The held rows whose fate is known."""
            nonlocal held, found
            if not found:
                return None
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            out = rows.iloc[: len(found)].copy()
            out["__match"], out["__var"] = [n for n, _ in found], [k for _, k in found]
            held, found = [rows.iloc[len(found) :]], []
            return out[out["__match"] > 0]

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch.reset_index(drop=True))
            for rn, flag in zip(batch["__rn"], batch["__flags"], strict=True):
                if rn == 1 and last is not None:
                    found += matcher.feed(None)
                    matcher.reset()
                last = rn
                found += matcher.feed(int(flag))
            if (out := settled()) is not None:
                yield out
        if last is not None:
            found += matcher.feed(None)
            if (out := settled()) is not None:
                yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", __match long, __var int"
    labels = F.array(*[F.lit(n) for n in names])
    matched = dealt.mapInPandas(run, schema).withColumn("CLASSIFIER", F.element_at(labels, F.col("__var") + 1))
    counts = matched.groupBy(*partition_by, "__part").agg(F.max("__match").alias("__n")) if partition_by else None
    if counts is not None:
        before = F.coalesce(F.sum("__n").over(Window.orderBy(*partition_by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.select("__part", before.alias("__before"))
    if all_rows or any("match_number" in m.lower() for m in measures.values()):
        if counts is not None:
            matched = matched.join(offsets, "__part")
        else:
            matched = matched.withColumn("__before", F.lit(0))
        matched = matched.withColumn("MATCH_NUMBER", F.col("__match") + F.col("__before"))
    if all_rows:
        own = [F.expr(_measure(m, names, over=True)).alias(a) for a, m in measures.items()]
        return matched.select(*df.columns, "MATCH_NUMBER", "CLASSIFIER", *own)
    aggs = [F.expr(_measure(m, names, over=False)).alias(a) for a, m in measures.items()]
    grouped = matched.groupBy("__part", *partition_by, "__match")
    out = grouped.agg(*aggs) if aggs else grouped.count()
    return out.select(*partition_by, *measures)


def _measure(text: str, names: list[str], over: bool) -> str:
    """A measure as an aggregate over the rows of a match (over: as a window, for ALL ROWS)."""
    tail = " over (partition by __part, __match)" if over else ""
    choose = lambda var: f" filter (where lower(CLASSIFIER) = '{var.lower()}')" if var and not over else ""
    given = lambda var, x: f"case when lower(CLASSIFIER) = '{var.lower()}' then {x} end" if var and over else x

    def call(m: re.Match) -> str:
        kind, var, column = m[1].lower(), m[2], m[3]
        var = var if var and var.lower() in {n.lower() for n in names} else None
        if kind in ("first", "last", "prev", "next"):
            by = "min_by" if kind == "first" else "max_by"
            return f"{by}({column}, {given(var, '__rn')}){choose(var)}{tail}"
        x = "1" if column == "*" else column
        return f"{kind}({given(var, x)}){choose(var)}{tail}"

    done = [f"max(MATCH_NUMBER){tail}"]

    def keep(m: re.Match) -> str:
        done.append(call(m))
        return f"\x00{len(done) - 1}\x00"

    text = re.sub(r"(?i)\bmatch_number\s*\(\s*\)", "\x000\x00", text)
    text = _CALL.sub(keep, text)
    text = re.sub(r"(?i)\bclassifier\s*\(\s*\)", lambda m: f"max_by(CLASSIFIER, __rn){tail}", text)
    for n in names:
        text = re.sub(rf"(?i)\b{re.escape(n)}\.(\w+)", lambda m, n=n: f"min_by({m[1]}, {given(n, '__rn')}){choose(n)}{tail}", text)
    return re.sub(r"\x00(\d+)\x00", lambda m: done[int(m[1])], text)
