"""Data changes as functions from one version of a table to the next."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import consecutive


@dataclass
class Change:
    """The next version of a table and the rows that made it: OUTPUT INSERTED and DELETED."""

    table: DataFrame
    inserted: DataFrame | None = None
    deleted: DataFrame | None = None


def insert(target: DataFrame, rows: DataFrame, columns: list[str] | None = None, identity: str | None = None, defaults: dict[str, str] | None = None, numbers: tuple[int, int] = (1, 1)) -> Change:
    """INSERT: rows by position, or into named columns; other columns take their default (SQL) or null.

    identity numbers new rows on from the last value there is; numbers are the first value and the step.
    """
    given = list(columns or [c for c in target.columns if c != identity][: len(rows.columns)])
    if len(given) != len(rows.columns):
        raise ValueError(f"{len(rows.columns)} values for {len(given)} columns")
    known = {c.lower(): c for c in target.columns}
    for c in given:
        if c.lower() not in known:
            raise ValueError(f"unknown column {c}")
    rows = rows.toDF(*[known[c.lower()] for c in given])
    low = {c.lower() for c in given}
    kinds = dict(target.dtypes)
    defaults = {k.lower(): v for k, v in (defaults or {}).items()}
    if identity and identity.lower() not in low:
        first, step = numbers
        last = target.agg((F.max if step > 0 else F.min)(identity)).first()[0]
        rows = consecutive(rows, identity, first if last is None else last + step, step)
        low.add(identity.lower())
    new = rows.select(*[(F.col(c) if c.lower() in low else F.expr(defaults.get(c.lower(), "null"))).cast(kinds[c]).alias(c) for c in target.columns])
    return Change(target.unionByName(new), inserted=new)


def update(target: DataFrame, sets: dict[str, str], where: str = "true", source: DataFrame | None = None, on: str | None = None, target_alias: str = "t", source_alias: str = "s") -> Change:
    """UPDATE: SET expressions where a condition holds; with a source, of the first source row that matches on."""
    columns, kinds = target.columns, dict(target.dtypes)
    known = {c.lower(): c for c in columns}
    sets = {known[k.split(".")[-1].lower()]: v for k, v in sets.items()}
    if source is None:
        rows = target.alias(target_alias).select("*", F.coalesce(F.expr(where).cast("boolean"), F.lit(False)).alias("__hit"), *[F.expr(v).cast(kinds[c]).alias(f"__new_{c}") for c, v in sets.items()])
    else:
        numbered = target.withColumn("__row", F.monotonically_increasing_id())
        condition = f"({on or 'true'}) and ({where})"
        hits = numbered.alias(target_alias).join(source.alias(source_alias), F.expr(condition)).select("__row", *[F.expr(v).cast(kinds[c]).alias(f"__new_{c}") for c, v in sets.items()])
        values = [f"__new_{c}" for c in sets]
        hits = hits.groupBy("__row").agg(F.min(F.struct(*values)).alias("x")).select("__row", F.lit(True).alias("__hit"), "x.*")
        rows = numbered.join(hits, "__row", "left").drop("__row").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    now = [F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in columns]
    hit = rows.where("__hit")
    return Change(rows.select(*now), inserted=hit.select(*now), deleted=hit.select(*columns))


def delete(target: DataFrame, where: str = "true", alias: str = "t") -> Change:
    """DELETE: rows for which the condition is true go; false and unknown stay."""
    hit = F.coalesce(F.expr(where).cast("boolean"), F.lit(False))
    rows = target.alias(alias).select("*", hit.alias("__hit"))
    return Change(rows.where("not __hit").drop("__hit"), deleted=rows.where("__hit").drop("__hit"))


def replace_rows(target: DataFrame, rows: DataFrame, key: list[str], columns: list[str] | None = None) -> Change:
    """INSERT OR REPLACE: rows of an equal primary key are replaced; of new rows with one key the last value stays."""
    new = insert(target.limit(0), rows, columns).inserted
    new = new.withColumn("__o", F.monotonically_increasing_id())
    new = new.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__o")))).where("__n = 1").drop("__n", "__o")
    return Change(target.join(new.select(*key), key, "left_anti").select(*target.columns).unionByName(new), inserted=new, deleted=target.join(new.select(*key), key, "left_semi").select(*target.columns))


@dataclass
class When:
    """One WHEN clause of MERGE. kind: matched, not_matched, not_matched_by_source; action: update, delete or insert.

    values maps columns to SQL over the target's and source's aliases.
    """

    kind: str
    action: str
    condition: str = "true"
    values: dict[str, str] = field(default_factory=dict)


def merge(target: DataFrame, source: DataFrame, on: str, clauses: list[When], target_alias: str = "t", source_alias: str = "s") -> Change:
    """MERGE as one full outer join: for each row the first clause whose condition holds acts.

    A target row that matches several source rows is an error, as its update would be undefined.
    """
    columns, kinds = target.columns, dict(target.dtypes)
    known = {c.lower(): c for c in columns}
    t = target.withColumn("__t", F.monotonically_increasing_id()).alias(target_alias)
    s = source.withColumn("__s", F.lit(True)).alias(source_alias)
    both = t.join(s, F.expr(on), "full")
    in_t, in_s = f"{target_alias}.__t is not null", f"{source_alias}.__s is not null"
    place = {"matched": f"{in_t} and {in_s}", "not_matched": f"not ({in_t}) and {in_s}", "not_matched_by_source": f"{in_t} and not ({in_s})"}
    which = F.lit(-1)
    for i, c in reversed(list(enumerate(clauses))):
        which = F.when(F.expr(f"({place[c.kind]}) and coalesce(({c.condition}), false)"), i).otherwise(which)
    out = []
    for column in columns:
        value = F.col(f"{target_alias}.`{column}`")
        for i, c in enumerate(clauses):
            if c.action == "delete":
                continue
            given = {known[k.split(".")[-1].lower()]: v for k, v in c.values.items()}
            new = F.expr(given[column]).cast(kinds[column]) if column in given else F.lit(None).cast(kinds[column]) if c.action == "insert" else F.col(f"{target_alias}.`{column}`")
            value = F.when(F.col("__which") == i, new).otherwise(value)
        out.append(value.alias(column))
    both = both.withColumn("__which", which).withColumn("__dup", F.when(F.expr(place["matched"]), F.count("*").over(Window.partitionBy(f"{target_alias}.__t"))).otherwise(1))
    guard = F.when((F.col("__dup") > 1) & (F.col("__which") >= 0), F.raise_error(F.lit("MERGE: a target row matches several source rows"))).otherwise(F.lit(True)).cast("boolean")
    gone = [i for i, c in enumerate(clauses) if c.action == "delete"]
    adds = [i for i, c in enumerate(clauses) if c.action == "insert"]
    changes = [i for i, c in enumerate(clauses) if c.action == "update"]
    isin = lambda ids: F.col("__which").isin(ids) if ids else F.lit(False)
    # several source rows for one kept, unchanged target row: it stays once
    first = F.row_number().over(Window.partitionBy(f"{target_alias}.__t").orderBy(F.desc("__which")))
    rows = both.withColumn("__first", F.when(F.expr(in_t), first).otherwise(1)).where(guard)
    live = rows.where((F.expr(in_t) & (F.col("__first") == 1) & ~isin(gone)) | isin(adds))
    old = [F.col(f"{target_alias}.`{c}`").alias(c) for c in columns]
    return Change(live.select(*out), inserted=rows.where(isin(adds + changes)).select(*out), deleted=rows.where(isin(gone + changes)).select(*old))
