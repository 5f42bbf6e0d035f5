"""Sort keys given as text: "expression [ASC|DESC] [NULLS FIRST|NULLS LAST]"."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = re.compile(r"(?is)^(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*$")


@dataclass(frozen=True)
class Key:
    """One sort key. Without NULLS, nulls come first ascending and last descending."""

    expression: str
    descending: bool = False
    nulls_first: bool = True

    def sort(self, name: str | None = None, reverse: bool = False) -> Column:
        c = F.expr(name or self.expression)
        desc, first = self.descending != reverse, self.nulls_first != reverse
        return (c.desc_nulls_first() if first else c.desc_nulls_last()) if desc else (c.asc_nulls_first() if first else c.asc_nulls_last())

    def before(self, a: str, b: str) -> Column:
        """Whether column a comes strictly before column b."""
        x, y = F.col(a), F.col(b)
        nulls = x.isNull() & y.isNotNull() if self.nulls_first else x.isNotNull() & y.isNull()
        return F.coalesce(x > y if self.descending else x < y, F.lit(False)) | nulls


def keys(order: str | list[str]) -> list[Key]:
    """Sort keys from a list of texts, or from one text with commas outside parentheses."""
    parts = order if isinstance(order, list) else [p for p in re.split(r",(?![^()]*\))", order) if p.strip()]
    out = []
    for p in parts:
        expression, direction, nulls = _KEY.match(p.strip()).groups()
        desc = (direction or "").lower() == "desc"
        out.append(Key(expression, desc, not desc if nulls is None else nulls.lower() == "first"))
    return out


def sort_columns(order: str | list[str], reverse: bool = False) -> list[Column]:
    return [k.sort(reverse=reverse) for k in keys(order)]


def consecutive(df: DataFrame, name: str, start: int = 0, step: int = 1) -> DataFrame:
    """df with consecutive numbers in name, in the order of its partitions and of rows in them.

    Partitions are counted first, so that each numbers its own rows and none has to hold all;
    the driver sees one count for each partition. df must give the same rows again.
    """
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
    before, at = {}, 0
    for r in sorted(counts, key=lambda r: r["p"]):
        before[r["p"]] = at
        at += r["n"]
    offsets = df.sparkSession.createDataFrame(list(before.items()), "__part int, __before long")
    joined = placed.withColumn("__part", part.cast("int")).join(F.broadcast(offsets), "__part")
    number = F.lit(start) + F.lit(step) * (F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1))
    return joined.select(*df.columns, number.alias(name))
