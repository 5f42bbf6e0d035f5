"""Queries over whole tables: every row and element reaches the operator, and results equal the oracle SQL."""

import datetime as dt
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.operators import joins

from .test_entry import SF, TABLES, plain


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same_as_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    return got


def test_daily_transforms_read_all_events(spark, duck, tmp_path):
    for name in ("tf_fill_dates", "tf_period_comparison"):
        same_as_oracle(spark, duck, name)
    filled = entry.queries()["tf_fill_dates"](spark, SF)
    assert filled.agg({"n": "sum"}).first()[0] == duck.execute("select count(*) from events").fetchone()[0]
    day = lambda d: dt.datetime(2024, 5, d)
    rows = [(1, day(1), "click", 2.0), (2, day(1), "click", 3.0), (3, day(4), "click", 1.0), (5, day(3), "view", 1.0), (6, day(4), "view", 1.0), (7, day(4), "view", 4.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["d"].day, r["t"]): (r["n"], r["v"]) for r in entry.queries()["tf_fill_dates"](spark, str(tmp_path)).collect()}
    assert got == {(1, "click"): (2, 5.0), (2, "click"): (0, 0.0), (3, "click"): (0, 0.0), (4, "click"): (1, 1.0), (3, "view"): (1, 1.0), (4, "view"): (2, 5.0)}
    got = {(r["d"].day, r["t"]): (r["n"], r["n_Diff"]) for r in entry.queries()["tf_period_comparison"](spark, str(tmp_path)).collect()}
    assert got == {(1, "click"): (2, None), (4, "click"): (1, None), (3, "view"): (1, None), (4, "view"): (2, 1)}


def test_fuzzy_join_reads_all_parts(spark, duck):
    got = same_as_oracle(spark, duck, "fuzzy_join")
    cols = ["lid", "rid", "score"]
    keys = {r[0] for r in duck.execute("select p_partkey from part").fetchall()}
    assert {r[cols.index("lid")] for r in got} == {r[cols.index("rid")] for r in got} == keys


def test_fuzzy_join_of_packs(spark, duck, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_ROWS", 20_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            same_as_oracle(spark, duck, "fuzzy_join")
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unnest_gives_every_element(spark, duck):
    got = same_as_oracle(spark, duck, "unnest")
    assert sum(got.values()) == duck.execute("select sum(len(embedding)) from embeddings").fetchone()[0]
