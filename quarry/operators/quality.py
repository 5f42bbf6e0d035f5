"""Inline data quality: column rules, routing of failing rows, and assertions about tables and jobs."""

from __future__ import annotations

import operator
import re
import statistics
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class QualityError(Exception):
    """A rule with ON FAILURE THROW, or an assertion, does not hold."""


@dataclass
class Rule:
    """One rule of a column. kind and args: see passes(); action: WARN, QUARANTINE or THROW.

    All kinds but NOT NULL and NOT BLANK let null pass.
    """

    column: str
    kind: str
    args: tuple = ()
    action: str = "WARN"

    @property
    def name(self) -> str:
        return f"{self.kind}({', '.join(map(str, self.args))})" if self.args else self.kind


_COMPARE = {"=": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def passes(df: DataFrame, rule: Rule) -> tuple[DataFrame, Column]:
    """df (with helper columns, where a rule needs them) and the condition for a row to pass.

    Kinds: NOT NULL; NOT BLANK; UNIQUE; UNIQUE WITH (columns); UNIQUE_FIRST BY / UNIQUE_LAST BY
    (order); MATCHES / NOT MATCHES (regex); LENGTH (op, n); CASTABLE AS (type); a comparison (value);
    BETWEEN (a, b); IN / NOT IN (values); EXISTS IN (table, column); EXISTS WITH (table, own columns,
    its columns); EXPR (sql); AND / OR (rules).
    """
    c, kind, a = F.col(f"`{rule.column}`"), rule.kind.upper(), rule.args
    if kind == "NOT NULL":
        return df, c.isNotNull()
    if kind == "NOT BLANK":
        return df, c.isNotNull() & (F.trim(c.cast("string")) != "")
    if kind in ("AND", "OR"):
        tests = []
        for r in a:
            df, t = passes(df, r)
            tests.append(t)
        return df, reduce(operator.and_ if kind == "AND" else operator.or_, tests)
    if kind.startswith("UNIQUE"):
        name = f"__u{len(df.columns)}"
        keys = [rule.column, *(a if kind == "UNIQUE WITH" else ())]
        null = reduce(operator.or_, [F.col(f"`{k}`").isNull() for k in keys])
        if kind in ("UNIQUE_FIRST BY", "UNIQUE_LAST BY"):
            from .order import sort_columns

            w = Window.partitionBy(*keys).orderBy(*sort_columns(a[0], reverse=kind == "UNIQUE_LAST BY"))
            return df.withColumn(name, F.row_number().over(w)), null | (F.col(name) == 1)
        # keys with several rows, counted before they are shuffled; null keys pass and are not counted
        several = df.where(~null).groupBy(*[F.col(f"`{k}`").alias(f"{name}_{i}") for i, k in enumerate(keys)]).count().where("count > 1").withColumn(name, F.lit(True)).drop("count")
        same = reduce(operator.and_, [F.col(f"`{k}`") == F.col(f"{name}_{i}") for i, k in enumerate(keys)])
        return df.join(several, same, "left").drop(*[f"{name}_{i}" for i in range(len(keys))]), F.col(name).isNull()
    if kind in ("EXISTS IN", "EXISTS WITH"):
        table, own, theirs = (a[0], [rule.column], [a[1]]) if kind == "EXISTS IN" else a
        flag = f"__e{len(df.columns)}"
        known = table.select(*[F.col(t).alias(f"{flag}_{i}") for i, t in enumerate(theirs)]).distinct().withColumn(flag, F.lit(True))
        same = reduce(operator.and_, [F.col(f"`{o}`") == F.col(f"{flag}_{i}") for i, o in enumerate(own)])
        df = df.join(known, same, "left").drop(*[f"{flag}_{i}" for i in range(len(theirs))])
        return df, c.isNull() | F.coalesce(F.col(flag), F.lit(False))
    if kind == "MATCHES":
        test = c.cast("string").rlike(a[0])
    elif kind == "NOT MATCHES":
        test = ~c.cast("string").rlike(a[0])
    elif kind == "LENGTH":
        test = _COMPARE[a[0]](F.length(c.cast("string")), F.lit(a[1]))
    elif kind == "CASTABLE AS":
        test = c.try_cast(a[0]).isNotNull()
    elif kind in _COMPARE:
        test = _COMPARE[kind](c, F.lit(a[0]))
    elif kind == "BETWEEN":
        test = c.between(a[0], a[1])
    elif kind == "IN":
        test = c.isin(list(a))
    elif kind == "NOT IN":
        test = ~c.isin(list(a))
    elif kind == "EXPR":
        test = F.coalesce(F.expr(a[0]), F.lit(True))
    else:
        raise ValueError(f"rule kind {rule.kind!r}")
    return df, c.isNull() | F.coalesce(test, F.lit(False))


@dataclass
class Routed:
    """clean: rows that go on; quarantine and warned: captured rows with __dq_ columns."""

    clean: DataFrame
    quarantine: DataFrame
    warned: DataFrame


DQ_COLUMNS = ["__dq_rule", "__dq_column", "__dq_value", "__dq_reason", "__dq_ts", "__dq_run_id", "__dq_status", "__dq_row_id"]


def route(df: DataFrame, rules: list[Rule], select: list[str] | None = None, run_id: str = "run", dry_run: bool = False) -> Routed:
    """Evaluate all rules once per row and send rows on by the strictest failing action.

    THROW raises when a row is computed; QUARANTINE diverts the row, with all its source columns; WARN
    keeps it in clean and lists it in warned. clean has the columns of select (default: all). With
    dry_run no row is diverted or thrown.
    """
    columns = df.columns
    rows, fails = df, []
    for r in rules:
        rows, ok = passes(rows, r)
        fails.append(F.when(~ok, F.struct(F.lit(r.action.upper()).alias("action"), F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.col(f"`{r.column}`").cast("string").alias("value"))))
    none = "array<struct<action:string,rule:string,column:string,value:string>>"
    rows = rows.withColumn("__fails", F.filter(F.array(*fails), lambda x: x.isNotNull()) if fails else F.array().cast(none))
    rows = rows.withColumn("__thrown", F.try_element_at(F.filter("__fails", lambda x: x.action == "THROW"), F.lit(1)))
    if not dry_run:
        message = F.concat(F.lit("data quality: "), F.col("__thrown.column"), F.lit(" fails "), F.col("__thrown.rule"))
        rows = rows.where(F.when(F.col("__thrown").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    bad = F.exists("__fails", lambda x: x.action == "QUARANTINE")
    diverted = F.lit(False) if dry_run else bad

    def captured(part: DataFrame, action: str, status: str) -> DataFrame:
        f = F.try_element_at(F.filter("__fails", lambda x: x.action == action), F.lit(1))
        part = part.withColumn("__f", f)
        return part.select(
            *columns,
            F.col("__f.rule").alias("__dq_rule"),
            F.col("__f.column").alias("__dq_column"),
            F.col("__f.value").alias("__dq_value"),
            F.concat_ws("; ", F.transform("__fails", lambda x: F.concat(x.column, F.lit(" fails "), x.rule))).alias("__dq_reason"),
            F.current_timestamp().alias("__dq_ts"),
            F.lit(run_id).alias("__dq_run_id"),
            F.lit(status).alias("__dq_status"),
            F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns]), 256).alias("__dq_row_id"),
        )

    warned = rows.where(~diverted & F.exists("__fails", lambda x: x.action == "WARN"))
    return Routed(rows.where(~diverted).select(*(select or columns)), captured(rows.where(diverted), "QUARANTINE", "quarantined"), captured(warned, "WARN", "warned"))


def replay(quarantine: DataFrame, rules: list[Rule], select: list[str] | None = None, run_id: str = "replay") -> tuple[Routed, DataFrame]:
    """REPLAY QUARANTINE: released rows through the rules again, and the quarantine with those rows marked replayed."""
    source = [c for c in quarantine.columns if not c.lower().startswith("__dq_")]
    routed = route(quarantine.where("__dq_status = 'released'").select(*source), rules, select, run_id)
    marked = quarantine.withColumn("__dq_status", F.when(F.col("__dq_status") == "released", "replayed").otherwise(F.col("__dq_status")))
    return routed, marked


_FAMILIES = {
    "int": "INT", "bigint": "INT", "smallint": "INT", "tinyint": "INT", "integer": "INT", "long": "INT",
    "double": "FLOAT", "float": "FLOAT", "real": "FLOAT", "decimal": "DECIMAL", "numeric": "DECIMAL", "money": "DECIMAL",
    "string": "VARCHAR", "varchar": "VARCHAR", "nvarchar": "VARCHAR", "char": "VARCHAR", "text": "VARCHAR",
    "date": "DATE", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME", "datetime": "DATETIME", "datetime2": "DATETIME",
    "boolean": "BIT", "bool": "BIT", "bit": "BIT", "binary": "BINARY", "varbinary": "BINARY",
}


def expect_schema(df: DataFrame, columns: list[dict], warn: bool = False) -> list[str]:
    """EXPECT SCHEMA: problems by name, raised unless warn. columns: dicts of column_name, type_family, nullable (default true).

    Extra columns are fine; a column declared not null must hold no null.
    """
    actual = {f.name.lower(): f for f in df.schema.fields}
    family = lambda t: _FAMILIES.get(re.split(r"[(\s]", t.lower())[0], t.upper())
    problems, filled = [], []
    for c in columns:
        name = c["column_name"]
        f = actual.get(name.lower())
        if f is None:
            problems.append(f"missing column {name}")
        elif c.get("type_family") and family(c["type_family"]) != family(f.dataType.simpleString()):
            problems.append(f"column {name}: expected {c['type_family']}, found {f.dataType.simpleString()}")
        elif not c.get("nullable", True) and f.nullable:
            filled.append(name)
    if filled:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in filled]).first()
        problems += [f"column {c}: {nulls[c]} nulls" for c in filled if nulls[c]]
    if problems and not warn:
        raise QualityError("; ".join(problems))
    return problems


def assert_table(actual: DataFrame, expected: DataFrame, ignore_order: bool = True, tolerance: float = 0.0, ignore_columns: list[str] = (), message: str = "tables differ") -> None:
    """ASSERT TABLE ... MATCHES: the same columns and the same bag of rows (or rows in order), numbers within tolerance."""
    gone = {c.lower() for c in ignore_columns}
    a = [c for c in actual.columns if c.lower() not in gone]
    e = [c for c in expected.columns if c.lower() not in gone]
    if [c.lower() for c in a] != [c.lower() for c in e]:
        raise QualityError(f"{message}: columns {a} and {e}")
    left, right = actual.select(*a), expected.select(*e).toDF(*a)
    if not tolerance and ignore_order:
        if left.exceptAll(right).limit(1).count() or right.exceptAll(left).limit(1).count():
            raise QualityError(message)
        return
    numbered = lambda df, sort: df.withColumn("__i", F.row_number().over(Window.orderBy(*sort)))
    if ignore_order:
        l_, r_ = numbered(left, a), numbered(right, a)
    else:
        l_, r_ = (df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF([*a, "__i"]) if df.take(1) else df.withColumn("__i", F.lit(0)) for df in (left, right))
    equal = []
    for c, t in left.dtypes:
        x, y = F.col(f"l.`{c}`"), F.col(f"r.`{c}`")
        near = F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull()) if tolerance and t.startswith(("int", "bigint", "double", "float", "decimal", "smallint")) else x.eqNullSafe(y)
        equal.append(near)
    joined = l_.alias("l").join(r_.alias("r"), F.col("l.__i") == F.col("r.__i"), "full")
    if joined.where(~reduce(operator.and_, equal, F.col("l.__i").isNotNull() & F.col("r.__i").isNotNull())).limit(1).count():
        raise QualityError(message)


def job_metrics(df: DataFrame, routed: Routed | None = None, null_columns: list[str] = (), fresh_columns: list[str] = ()) -> dict[str, float]:
    """The metrics that ASSERT JOB reads, in one pass: ROW_COUNT, NULL_PERCENT(c), FRESHNESS(c) in seconds, and the quality fractions."""
    n = F.count("*")
    aggs = [n.alias("ROW_COUNT")]
    aggs += [F.try_divide(F.count_if(F.col(c).isNull()), n).alias(f"NULL_PERCENT({c})") for c in null_columns]
    aggs += [(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.max(F.col(c)).cast("timestamp"))).alias(f"FRESHNESS({c})") for c in fresh_columns]
    out = df.agg(*aggs).first().asDict()
    if routed is not None:
        bad, warned, clean = routed.quarantine.count(), routed.warned.count(), routed.clean.count()
        total = bad + clean
        out |= {"QUARANTINE_PERCENT": bad / total if total else 0.0, "WARN_PERCENT": warned / total if total else 0.0}
    return out


_WITHIN = re.compile(r"(?i)^\s*(\w+(?:\([^)]*\))?)\s+within\s+([\d.]+)\s+(sigma\s+)?of\s+historical\s*$")
_TEST = re.compile(r"^\s*(\w+(?:\([^)]*\))?)\s*(>=|<=|<>|!=|=|>|<)\s*([\d.]+)\s*$")


def assert_job(metrics: dict[str, float], predicates: list[str], history: list[dict[str, float]] = (), runs: int = 5, least_runs: int = 3, least_sigma_runs: int = 10, warn: bool = False) -> list[str]:
    """ASSERT JOB: failed predicates, raised unless warn. history: earlier runs' metrics, newest last.

    WITHIN f OF HISTORICAL compares with the mean of the last runs, WITHIN n SIGMA with their standard
    deviation; with too short a history, or a mean of 0, such a predicate is skipped.
    """
    found = {k.upper(): v for k, v in metrics.items()}
    problems = []
    for p in predicates:
        if m := _WITHIN.match(p):
            name, limit, sigma = m[1].upper(), float(m[2]), bool(m[3])
            need = least_sigma_runs if sigma else least_runs
            past = [h[k] for h in history for k in h if k.upper() == name][-max(runs, need if sigma else runs) :]
            if len(past) < need:
                continue
            mean = statistics.fmean(past)
            spread = statistics.stdev(past) if sigma else abs(mean)
            if spread and abs(found[name] - mean) / spread > limit:
                problems.append(p)
        elif m := _TEST.match(p):
            value = found.get(m[1].upper())
            if value is None or not _COMPARE[m[2]](value, float(m[3])):
                problems.append(p)
        else:
            raise ValueError(f"predicate {p!r}")
    if problems and not warn:
        raise QualityError("ASSERT JOB: " + "; ".join(problems))
    return problems


def assert_condition(df: DataFrame, condition: str, message: str = "assertion failed") -> None:
    """ASSERT: condition, an SQL aggregate over df, must be true."""
    if df.agg(F.expr(condition).alias("x")).first()["x"] is not True:
        raise QualityError(message)
