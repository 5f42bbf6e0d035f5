"""Structured Streaming operators: windows over event time, sessions, deduplication, bounded polls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recursion import shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream; the schema is that of the files."""
    path = f"{sf_dir}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return stream.parquet(path)
    # a stream reads folders: this table is a single file among others
    return stream.option("pathGlobFilter", f"{table}.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)


def _stamp(column: str):
    """Event time as a timestamp, which windows and watermarks ask for."""
    return F.col(column).cast("timestamp")


def tumbling(stream: DataFrame, time: str, length: str, by: list[str] = (), late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by tumbling (or, with slide, sliding) windows of event time: start, keys, n. Rows later than `late` are dropped."""
    s = stream.withColumn("__ts", _stamp(time)).withWatermark("__ts", late)
    w = F.window("__ts", length, slide) if slide else F.window("__ts", length)
    return s.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Counts by sessions that end after a gap without events: keys, start, n."""
    s = stream.withColumn("__ts", _stamp(time)).withWatermark("__ts", late)
    return s.groupBy(F.session_window("__ts", gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def deduplicate(stream: DataFrame, time: str, within: str, keys: list[str]) -> DataFrame:
    """The first row of each key within a span of event time: at-least-once delivery made once."""
    return stream.withColumn("__ts", _stamp(time)).withWatermark("__ts", within).dropDuplicatesWithinWatermark(keys).drop("__ts")


def latest(stream: DataFrame, time: str, keys: list[str], values: list[str]) -> DataFrame:
    """The row of the latest event time for each key, kept as state."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*values), time).alias("v")).select(*keys, "v.*")


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all rows there are now and stop (a bounded poll); its result as a table.

    Progress is kept in the shared folder, so a restarted driver goes on where it was.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(stream)}/stream-{uuid.uuid4().hex}"
    has_state = mode == "complete"
    if has_state:
        out: list[str] = []

        def keep(batch: DataFrame, n: int) -> None:
            # each batch of a complete-mode stream is the whole result
            path = f"{base}/result-{n}"
            batch.write.mode("overwrite").parquet(path)
            out.append(path)

        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
        schema = stream.schema
        return spark.read.schema(schema).parquet(out[-1]) if out else spark.createDataFrame([], schema)
    path = f"{base}/rows"
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
