"""Writers by connection kind. File writes are staged and renamed, so readers see all rows or none."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .http import write_api
from .readers import _JDBC, SourceError, _flag, jdbc_options


def staged(df: DataFrame, path: str, write: Callable[[DataFrame, str], None], mode: str = "overwrite") -> None:
    """Write to a folder beside path, then move it there (or, to append, its files)."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    temp = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    write(df, temp)
    if mode == "append" and fs.exists(target):
        for s in fs.listStatus(hadoop.Path(temp)):
            name = s.getPath().getName()
            if not name.startswith(("_", ".")):
                fs.rename(s.getPath(), hadoop.Path(target, f"{uuid.uuid4().hex}-{name}"))
        fs.delete(hadoop.Path(temp), True)
        return
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(hadoop.Path(temp), target):
        raise SourceError(f"cannot move {temp} to {path}")


def _csv(options: dict) -> Callable:
    o = {"sep": str(options.get("DELIMITER", ",")), "header": str(_flag(options.get("HEADER", True))).lower(), "quote": str(options.get("QUALIFIER", '"')), "nullValue": str(options.get("NULL_AS", ""))}
    return lambda df, p: df.write.options(**o).csv(p)


def write(df: DataFrame, kind: str, options: dict, table: str | None = None, mode: str = "overwrite") -> None:
    """Write df to a connection."""
    kind = kind.upper()
    path = str(options.get("PATH", "")) + (f"/{table}" if table and "PATH" in options else "")
    if kind in ("FLATFILE", "CSV", "TSV"):
        staged(df, path, _csv({"DELIMITER": "\t"} | options if kind == "TSV" else options), mode)
    elif kind == "JSON":
        staged(df, path, lambda d, p: d.write.json(p), mode)
    elif kind == "PARQUET":
        staged(df, path, lambda d, p: d.write.parquet(p), mode)
    elif kind == "XML":
        staged(df, path, lambda d, p: d.write.format("xml").option("rowTag", options.get("ROW_TAG", "row")).save(p), mode)
    elif kind in _JDBC:
        df.write.format("jdbc").options(**jdbc_options(kind, options)).option("dbtable", table or options["TABLE"]).mode(mode).save()
    elif kind == "KAFKA":
        rows = df.select(F.col("Key").cast("string").alias("key"), F.col("Value").cast("string").alias("value"))
        rows.write.format("kafka").option("kafka.bootstrap.servers", options["SERVERS"]).option("topic", table or options["TOPIC"]).save()
    elif kind in ("API", "REST", "HTTP", "WEBHOOK", "SLACK", "TEAMS"):
        write_api(df, options, "API" if kind in ("API", "REST", "HTTP") else kind)
    else:
        raise SourceError(f"no writer for {kind}")
