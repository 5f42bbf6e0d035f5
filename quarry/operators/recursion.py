"""Recursive queries: WITH RECURSIVE ... UNION [ALL] as a loop of joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 10_000


def shared_folder(df: DataFrame) -> str:
    """Where intermediate tables go: spark.checkpoint.dir, which all executors reach. Only a session of one machine may leave it unset."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        master = df.sparkSession.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")

        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        df.sparkSession.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder; cuts the lineage of a loop."""
    path = f"{shared_folder(df)}/step-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recursive(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False, max_depth: int = MAX_DEPTH) -> DataFrame:
    """anchor, then step(new rows) until there are none; distinct (UNION) drops rows seen before, so cycles end.

    Only the rows of the last round are joined again (semi-naive). More than max_depth rounds
    is an error. Columns take the anchor's names and types.
    """
    fit = lambda df: df.toDF(*anchor.columns).select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in anchor.dtypes])
    new = written(anchor.distinct() if distinct else anchor)
    parts = [new]
    for depth in range(max_depth + 1):
        rows = fit(step(new))
        if distinct:
            seen = reduce(DataFrame.union, parts)
            same = reduce(and_, [F.col(f"new.`{c}`").eqNullSafe(F.col(f"seen.`{c}`")) for c in anchor.columns])
            rows = rows.distinct().alias("new").join(seen.alias("seen"), same, "left_anti")
        new = written(rows)
        if not new.limit(1).count():
            break
        if depth == max_depth:
            raise RecursionError(f"recursion deeper than {max_depth}")
        parts.append(new)
        if distinct and len(parts) > 16:
            parts = [written(reduce(DataFrame.union, parts))]
    return reduce(DataFrame.union, parts)
