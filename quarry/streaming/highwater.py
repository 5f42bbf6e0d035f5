"""Incremental reads by a high-water mark: only rows beyond the largest value seen before."""

from __future__ import annotations

import json
import os
import tempfile
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class StateStore:
    """Keys and text values in a JSON file (or in memory), replaced as a whole so that a crash keeps the old one."""

    def __init__(self, folder: str | None = None):
        self.path = os.path.join(folder, "state.json") if folder else None
        self.values: dict[str, str] = {}
        if self.path and os.path.exists(self.path):
            with open(self.path) as f:
                self.values = json.load(f)

    def get(self, key: str) -> str | None:
        return self.values.get(key)

    def set(self, key: str, value) -> None:
        self.values[key] = None if value is None else str(value)
        if self.path:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            fd, tmp = tempfile.mkstemp(dir=os.path.dirname(self.path))
            with os.fdopen(fd, "w") as f:
                json.dump(self.values, f)
            os.replace(tmp, self.path)


def _beyond(df: DataFrame, column: str, mark: str, inclusive: bool):
    kind = dict(df.dtypes)[column]
    op = ">=" if inclusive else ">"
    if kind.startswith(("int", "bigint", "smallint", "decimal", "double", "float")):
        return F.expr(f"`{column}` {op} cast('{mark}' as {'decimal(38,10)' if not kind.startswith(('double', 'float')) else kind})")
    return F.expr(f"`{column}` {op} cast('{mark}' as {kind})")


def pending(df: DataFrame, column: str, store: StateStore, key: str, initial=None, inclusive: bool = False) -> DataFrame:
    """Rows beyond the stored mark (or initial); all rows if there is neither. The mark does not move."""
    mark = store.get(key)
    if mark is None:
        mark = initial
    return df if mark is None else df.where(_beyond(df, column, str(mark), inclusive))


def commit(df: DataFrame, column: str, store: StateStore, key: str) -> None:
    """Move the mark to the largest value of df, if it has one."""
    top = df.agg(F.max(column).alias("m")).first()["m"]
    if top is not None and (store.get(key) is None or _later(str(top), store.get(key))):
        store.set(key, top)


def _later(a: str, b: str) -> bool:
    try:
        return Decimal(a) > Decimal(b)
    except InvalidOperation:
        return a > b


def incremental(df: DataFrame, column: str, store: StateStore, key: str, initial=None, inclusive: bool = False) -> DataFrame:
    """pending rows, with the mark moved to their largest value at once."""
    out = pending(df, column, store, key, initial, inclusive)
    commit(out, column, store, key)
    return out
