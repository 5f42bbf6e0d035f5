"""Readers by connection kind: files, databases, Kafka, folders."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .http import read_api
from pyspark.sql import types as T


class SourceError(Exception):
    """A file or source that is not as its options say."""


def _flag(value) -> bool:
    return str(value).upper() in ("TRUE", "ON", "YES", "1")


def flatfile(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
    """Delimited or fixed-width text.

    Options: PATH, DELIMITER, HEADER, QUALIFIER, ENCODING, NULL_AS, START_AT, END_AT (lines, from 1),
    COUNT_AT_END (the last line holds the number of rows), STRICT_SCHEMA, COLUMNS (names), FIXED
    (a list of (name, start, length)), TYPES (name to type). Without a header, columns are Column1, ...
    """
    path = options["PATH"] if not table else f"{options['PATH']}/{table}"
    if options.get("FIXED"):
        return fixed_width(spark, path, options["FIXED"], options)
    header = _flag(options.get("HEADER", True))
    numbered = any(options.get(k) for k in ("START_AT", "END_AT", "COUNT_AT_END"))
    csv = {"sep": str(options.get("DELIMITER", ",")), "quote": str(options.get("QUALIFIER", '"')), "escape": str(options.get("QUALIFIER", '"')), "encoding": str(options.get("ENCODING", "UTF-8")), "nullValue": str(options.get("NULL_AS", "")), "mode": "FAILFAST" if _flag(options.get("STRICT_SCHEMA", False)) else "PERMISSIVE"}
    if numbered:
        lines = numbered_lines(spark, path)
        kept = lines.where(F.col("n") >= int(options.get("START_AT") or 1))
        if options.get("END_AT"):
            kept = kept.where(F.col("n") <= int(options["END_AT"]))
        if _flag(options.get("COUNT_AT_END", False)):
            trailer = kept.agg(F.max_by("value", "n").alias("text"), F.max("n").alias("n"), F.count("*").alias("lines")).first()
            counted, there = int(re.sub(r"\D", "", trailer["text"])), trailer["lines"] - 1 - header
            if counted != there:
                raise SourceError(f"{path}: the trailer counts {counted} rows, there are {there}")
            kept = kept.where(F.col("n") < trailer["n"])
        df = spark.read.options(**csv).option("header", header).option("inferSchema", _flag(options.get("INFER", False))).csv(kept.rdd.map(lambda r: r["value"]))
    else:
        df = spark.read.options(**csv).option("header", header).option("inferSchema", _flag(options.get("INFER", False))).csv(path)
    names = options.get("COLUMNS")
    if names:
        df = df.toDF(*([n.strip() for n in names.split(",")] if isinstance(names, str) else names))
    elif not header:
        df = df.toDF(*[f"Column{i + 1}" for i in range(len(df.columns))])
    for name, kind in (options.get("TYPES") or {}).items():
        df = df.withColumn(name, F.col(name).cast(kind))
    return df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, n): the lines of files in the order of their paths, numbered from 1.

    Lines are counted for each block of a file, which is what a task reads in one piece; the
    driver adds up the blocks' counts and sees no line.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *block, F.monotonically_increasing_id().alias("at"))
    counts = sorted((r["file"], r["block"], r["first"], r["n"]) for r in lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect())
    before, rows = 0, []
    for file, start, first, n in counts:
        rows.append((file, start, before + 1 - first))
        before += n
    shift = spark.createDataFrame(rows, "file string, block long, shift long")
    return lines.join(F.broadcast(shift), ["file", "block"]).select("value", (F.col("at") + F.col("shift")).alias("n"))


def fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int]], options: dict | None = None) -> DataFrame:
    """Lines cut at (name, start from 1, length), trimmed; blank lines left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(*[F.trim(F.substring("value", start, length)).alias(name) for name, start, length in fields])


def json_file(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
    """JSON: an array or lines; ROOT_PATH such as $.data.items names the array inside one document."""
    path = options["PATH"] if not table else f"{options['PATH']}/{table}"
    df = spark.read.option("multiLine", not _flag(options.get("LINES", False))).json(path)
    steps = [s for s in re.split(r"[.\[\]$*]+", str(options.get("ROOT_PATH", ""))) if s]
    for s in steps:
        kind = df.schema[s].dataType
        if isinstance(kind, T.ArrayType):
            df = df.select(F.explode(s).alias("__x"))
            df = df.select("__x.*") if isinstance(kind.elementType, T.StructType) else df.withColumnRenamed("__x", s)
        elif isinstance(kind, T.StructType):
            df = df.select(f"{s}.*")
        else:
            df = df.select(s)
    return df


def xml_file(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
    """XML: the last step of ROW_PATH is the element of a row."""
    path = options["PATH"] if not table else f"{options['PATH']}/{table}"
    tag = str(options.get("ROW_TAG") or str(options["ROW_PATH"]).rstrip("/").split("/")[-1])
    return spark.read.format("xml").option("rowTag", tag).load(path)


def parquet(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
    return spark.read.parquet(options["PATH"] if not table else f"{options['PATH']}/{table}")


def avro(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
    """AVRO, where the cluster has Spark's avro package; SCHEMA is an .avsc file."""
    reader = spark.read.format("avro")
    if options.get("SCHEMA"):
        with open(options["SCHEMA"]) as f:
            reader = reader.option("avroSchema", json.dumps(json.load(f)))
    return reader.load(options["PATH"])


def excel(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
    """A sheet of a workbook, read on the driver; needs an engine that pandas can use."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(options["PATH"], sheet_name=table or options.get("SHEET", 0)))


_JDBC = {"MSSQL": "jdbc:sqlserver://{HOST}:{PORT};databaseName={DATABASE}", "POSTGRES": "jdbc:postgresql://{HOST}:{PORT}/{DATABASE}", "MYSQL": "jdbc:mysql://{HOST}:{PORT}/{DATABASE}", "ORACLE": "jdbc:oracle:thin:@//{HOST}:{PORT}/{DATABASE}", "SQLITE": "jdbc:sqlite:{DATABASE}", "SNOWFLAKE": "jdbc:snowflake://{HOST}/?db={DATABASE}", "BIGQUERY": "jdbc:bigquery://{HOST};ProjectId={DATABASE}", "ODBC": "{URL}"}
_PORTS = {"MSSQL": 1433, "POSTGRES": 5432, "MYSQL": 3306, "ORACLE": 1521}


def jdbc_options(kind: str, options: dict) -> dict[str, str]:
    """Spark's JDBC options of a connection; PARTITION_COLUMN with bounds reads in parallel."""
    o = {k.upper(): str(v) for k, v in options.items()}
    if kind == "MSSQL" and "SERVER" in o:
        o.setdefault("HOST", o["SERVER"])
    o.setdefault("PORT", str(_PORTS.get(kind, "")))
    out = {"url": o.get("URL") or _JDBC[kind].format(**{"HOST": "", "DATABASE": "", "URL": ""} | o)}
    for ours, theirs in {"USER": "user", "PASSWORD": "password", "DRIVER": "driver", "FETCH_SIZE": "fetchsize", "PARTITION_COLUMN": "partitionColumn", "LOWER": "lowerBound", "UPPER": "upperBound", "PARTITIONS": "numPartitions"}.items():
        if ours in o:
            out[theirs] = o[ours]
    return out


def jdbc(kind: str) -> Callable:
    def read_table(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
        reader = spark.read.format("jdbc").options(**jdbc_options(kind, options))
        # a native query runs in the database as it is; a table gets filters and columns pushed down
        return reader.option("query", options["QUERY"]).load() if options.get("QUERY") else reader.option("dbtable", table or options["TABLE"]).load()

    return read_table


def kafka(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
    """A bounded poll of a topic: Key, Value, Partition, Offset, Timestamp, up to MAX_MESSAGES."""
    df = spark.read.format("kafka").option("kafka.bootstrap.servers", options["SERVERS"]).option("subscribe", table or options["TOPIC"]).option("startingOffsets", options.get("FROM", "earliest")).option("endingOffsets", "latest").load()
    return kafka_columns(df, options.get("MAX_MESSAGES"))


def kafka_columns(df: DataFrame, limit=None) -> DataFrame:
    out = df.select(F.col("key").cast("string").alias("Key"), F.col("value").cast("string").alias("Value"), F.col("partition").alias("Partition"), F.col("offset").alias("Offset"), F.col("timestamp").alias("Timestamp"))
    return out.limit(int(limit)) if limit else out


def directory(spark: SparkSession, options: dict, table: str | None = None) -> DataFrame:
    """A folder's files, by Spark's own file listing, so remote stores work too: Path, Name, Size, Modified."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", _flag(options.get("RECURSIVE", False))).load(options["PATH"])
    return df.select(F.col("path").alias("Path"), F.regexp_extract("path", "([^/]*)$", 1).alias("Name"), F.col("length").alias("Size"), F.col("modificationTime").alias("Modified"))


def file_system(spark: SparkSession, kind: str, options: dict):
    """(file system, root) of a folder or object store connection, by Spark's own clients."""
    conf = spark._jsc.hadoopConfiguration()
    kind = kind.upper()
    if kind in ("S3", "AWS_S3"):
        root = f"s3a://{options['BUCKET']}"
        for key, name in (("ACCESS_KEY", "fs.s3a.access.key"), ("SECRET_KEY", "fs.s3a.secret.key"), ("SESSION_TOKEN", "fs.s3a.session.token"), ("ENDPOINT", "fs.s3a.endpoint"), ("FORCE_PATH_STYLE", "fs.s3a.path.style.access")):
            if key in options:
                conf.set(name, str(options[key]))
    elif kind == "AZURE_BLOB":
        root = f"abfss://{options['CONTAINER']}@{options['ACCOUNT']}.dfs.core.windows.net"
        if "ACCOUNT_KEY" in options:
            conf.set(f"fs.azure.account.key.{options['ACCOUNT']}.dfs.core.windows.net", str(options["ACCOUNT_KEY"]))
    elif kind in ("FTP", "SFTP"):
        root = f"{kind.lower()}://{options['USER']}:{options['PASSWORD']}@{options['HOST']}"
    else:
        root = str(options["PATH"])
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(conf), path


def remote(spark: SparkSession, kind: str, options: dict, path: str | None = None) -> list[tuple[str, str, int, int, bool]]:
    """(name, full path, size, time of change in ms, whether a folder) of what stands at a path, itself or, for a folder, inside; empty if nothing does."""
    fs, root = file_system(spark, kind, options)
    at = spark._jvm.org.apache.hadoop.fs.Path(root, str(path).lstrip("/")) if path else root
    return [(x.getPath().getName(), x.getPath().toString(), x.getLen(), x.getModificationTime(), x.isDirectory()) for x in fs.listStatus(at)] if fs.exists(at) else []


READERS: dict[str, Callable] = {"FLATFILE": flatfile, "CSV": flatfile, "TSV": lambda s, o, t=None: flatfile(s, {"DELIMITER": "\t"} | o, t), "JSON": json_file, "XML": xml_file, "PARQUET": parquet, "AVRO": avro, "EXCEL": excel, "KAFKA": kafka, "DIRECTORY": directory, "API": read_api, "REST": read_api, "HTTP": read_api} | {k: jdbc(k) for k in _JDBC}


def read(spark: SparkSession, kind: str, options: dict, table: str | None = None) -> DataFrame:
    """A connection's table."""
    if kind.upper() not in READERS:
        raise SourceError(f"no reader for {kind}")
    return READERS[kind.upper()](spark, options, table)


def bulk_insert(spark: SparkSession, path: str, target: DataFrame, mapping: str = "POSITION", first_row: int = 1, max_errors: int = 10, delimiter: str = ",", header: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """BULK INSERT: (rows in target's types, rejected lines). More than max_errors rejects fail the load.

    mapping is POSITION, or NAME (the first row holds the names; names that are not all there
    fall back to positions). first_row is the first data row of each file, counted from 1: rows
    before it stand in the file's first block, which is all that is numbered.
    """
    kinds = {c.lower(): t for c, t in target.dtypes}
    header = mapping.upper() == "NAME" if header is None else header
    lines = spark.read.option("sep", delimiter).option("header", header).option("mode", "PERMISSIVE")
    found = [c.lower() for c in lines.csv(path).columns] if header and mapping.upper() == "NAME" else []
    names = found if set(kinds) <= set(found) else [c.lower() for c in target.columns]
    raw = spark.read.option("sep", delimiter).option("header", header).option("mode", "PERMISSIVE").schema(", ".join(f"c{i} string" for i in range(len(names)))).csv(path)
    skip = first_row - (2 if header else 1)
    if skip > 0:
        raw = raw.select("*", F.col("_metadata.file_path").alias("__file"), (F.col("_metadata.file_block_start") == 0).alias("__head"), F.monotonically_increasing_id().alias("__n"))
        w = Window.partitionBy("__file").orderBy("__n")
        early = raw.where("__head").select("__file", "__n").withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= skip).select("__file", "__n")
        raw = raw.join(F.broadcast(early), ["__file", "__n"], "left_anti").drop("__file", "__head", "__n")
    raw = raw.toDF(*names)
    used = [n for n in names if n in kinds]
    bad = F.lit(False)
    for n in used:
        bad = bad | (F.col(n).isNotNull() & F.col(n).try_cast(kinds[n]).isNull())
    rejected = raw.where(bad)
    if rejected.limit(max_errors + 1).count() > max_errors:
        raise SourceError(f"{path}: more than {max_errors} rejected rows")
    good = raw.where(~bad).select(*[F.col(c.lower()).cast(t).alias(c) if c.lower() in used else F.lit(None).cast(t).alias(c) for c, t in target.dtypes])
    return good, rejected
