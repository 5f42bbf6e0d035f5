"""Helpers shared by the training-data operators: shared-folder tables and distributed union-find."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast, by the widths of its columns; larger sides go through a shuffle.
BROADCAST_BYTES = 24 << 20


#: Rows and bytes that go to a Python worker at once: texts can be long, and a worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(df: DataFrame) -> None:
    """Keep the Arrow batches of this session to BATCH_ROWS rows and about BATCH_BYTES at most.

    Frames are run after the operator has returned, so the session keeps the setting.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session of one machine may leave it unset and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_SCOPES = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that settle writes inside are deleted at the end, but for those written with keep."""
    stack = _SCOPES.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for table in stack.pop():
            _delete(table)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no rerun.

    The shuffle files of the write go when it has ended; nothing reads them again. keep: the
    table outlives the innermost scratch.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    stack = getattr(_SCOPES, "stack", [])
    if len(stack) > keep:
        stack[-1 - keep].append(out)
    return out


def _delete(table: DataFrame) -> None:
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table._settled_at)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that settle wrote and nothing reads any more, before their scratch ends."""
    for t in tables:
        for held in getattr(_SCOPES, "stack", []):
            held[:] = [x for x in held if x is not t]
        _delete(t)


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until no frame has such a column (letter case aside)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def may_broadcast(df: DataFrame) -> bool:
    """Whether df, a written table of columns of fixed width, has at most BROADCAST_BYTES; counts no further than that."""
    width = 16 + sum(16 if "string" in kind or "binary" in kind else 8 for _, kind in df.dtypes)
    most = BROADCAST_BYTES // width
    return df.limit(most + 1).count() <= most


def keep_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is among ids (left_anti: is not); few ids are broadcast, more go through a shuffle."""
    return df.join(F.broadcast(ids) if may_broadcast(ids) else ids, on, how)


#: Distinct edges (16 bytes each) whose components one task finds; more go through rounds over DataFrames.
ONE_TASK_EDGES = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of edges (u, v), sorted, and the smallest id that each reaches: roots hook onto smaller ones, then paths are compressed."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    comp, x, y = np.arange(len(ids)), at[: len(u)], at[len(u) :]
    while len(x):
        np.minimum.at(comp, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(comp, up := comp[comp]):
            comp = up
        x, y = comp[x], comp[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    return ids, ids[comp]


def _linked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    if parts:
        found = least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): rows (id, comp), comp the smallest id reachable.

    Up to ONE_TASK_EDGES edges are linked in one task. More go through large-star and small-star
    rounds over DataFrames (a distributed union-find with path compression), each a written
    table. Self loops are fine, null ends are dropped. Only ids that occur in edges are returned.
    """
    e = settle(
        edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    if e.count() <= ONE_TASK_EDGES:
        kind = e.dtypes[0][1]
        return e.coalesce(1).mapInArrow(_linked_batches, f"id {kind}, comp {kind}")
    before = None
    while True:
        old = e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).union(e.where("u = v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = settle(small.distinct(), "edges")
        discard(old)
        row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s"), F.sum((F.col("u") != F.col("v")).cast("long")).alias("d")).first()
        now = (row["n"], row["s"], row["d"])
        if now == before or not row["d"]:
            break
        before = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("comp"))
