"""Scripts that call scripts, load files, jump and run statements at the same time."""

import datetime as dt

import pytest

from quarry.functions.reldate import resolve
from quarry.operators.order import consecutive
from quarry.session import ScriptError, Session


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_run_script_hands_values_in_and_out(spark, tmp_path):
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "count.txt").write_text("DECLARE @least INT INPUT = 100; DECLARE @n INT OUTPUT; DECLARE @own INT = 1; SELECT @n = COUNT(*) FROM #ships WHERE tons >= @least; RUN SCRIPT 'mark.txt';")
    (tmp_path / "inner" / "mark.txt").write_text("INSERT INTO #ships VALUES ('Zephyr', 9)")
    s = Session(spark)
    s.folder = str(tmp_path)
    s.sql("CREATE TABLE #ships (name STRING, tons INT); INSERT INTO #ships VALUES ('Aurora', 40), ('Borealis', 7); DECLARE @out INT; RUN SCRIPT 'inner/count.txt' WITH (@least = 10, @n = @out);")
    assert s.variables["@out"] == 1 and "@own" not in s.variables
    assert rows(s.sql("SELECT name FROM #ships ORDER BY name")) == [("Aurora",), ("Borealis",), ("Zephyr",)]


def test_bulk_insert(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tons,name,flag\n5,Alpha,x\nmany,Beta,y\n7,Gamma,z\n")
    (tmp_path / "b.csv").write_text("made by hand\n\nDelta;1\nEpsilon;2\n")
    s = Session(spark)
    s.sql(f"CREATE TABLE #t (name STRING, tons INT); BULK INSERT #t FROM '{tmp_path}/a.csv' WITH (FIRSTROW = 2, HEADER = TRUE, MAXERRORS = 1);")
    assert sorted(rows(s.table("#t"))) == [("Alpha", 5), ("Gamma", 7)] and s.variables["@@rowcount"] == 2 and s.warnings
    with pytest.raises(Exception, match="rejected"):
        s.sql(f"BULK INSERT #t FROM '{tmp_path}/a.csv' WITH (HEADER = TRUE, FIRSTROW = 2)")
    s.sql(f"CREATE TABLE #u (name STRING, tons INT); BULK INSERT #u FROM '{tmp_path}/b.csv' WITH (FIRSTROW = 2, FIELDTERMINATOR = ';')")
    assert sorted(rows(s.table("#u"))) == [("Delta", 1), ("Epsilon", 2)]


def test_goto_leaves_blocks_and_finds_labels_of_its_own_level(spark):
    s = Session(spark)
    s.sql("DECLARE @i INT = 0; WHILE @i < 10 BEGIN SET @i = @i + 1; BEGIN TRY IF @i = 3 BEGIN GOTO out; END END TRY BEGIN CATCH PRINT 'caught'; END CATCH END PRINT 'missed'; out: PRINT 'here ${@i}';")
    assert s.printed == ["here 3"]
    with pytest.raises(ScriptError):
        s.sql("GOTO inside; IF 1 = 2 BEGIN inside: PRINT 'no'; END")


def test_parallel_runs_all_and_raises_after(spark):
    s = Session(spark)
    s.sql("CREATE TABLE #t (v INT); INSERT INTO #t VALUES (1), (2), (3);")
    with pytest.raises(ScriptError, match="broken"):
        s.sql("PARALLEL BEGIN SELECT SUM(v) AS x INTO #a FROM #t; THROW 51000, 'broken', 1; SELECT MAX(v) AS x INTO #b FROM #t; END")
    assert rows(s.sql("SELECT a.x, b.x FROM #a a CROSS JOIN #b b")) == [(6, 3)]


def test_unknown_interpolation_is_kept(spark):
    s = Session(spark)
    assert s.sql("SELECT 'a ${@nope} b' AS x").first()[0] == "a ${@nope} b"
    s.sql("DECLARE @v INT = 4; PRINT 'a ${@v} ${@nope}'")
    assert s.printed == ["a 4 ${@nope}"]


def test_relative_dates_in_zones():
    now = dt.datetime(2026, 3, 10, 2, 30, tzinfo=dt.timezone.utc)
    assert resolve("D EST", now) == dt.datetime(2026, 3, 9) and resolve("D-1 Asia/Tokyo", now) == dt.datetime(2026, 3, 9)
    assert resolve("N UTC", now) == dt.datetime(2026, 3, 10, 2, 30)
    assert resolve("soon") is None and resolve("") is None and resolve(None) is None and resolve("2026-01-02") == dt.datetime(2026, 1, 2)


def test_consecutive_numbers_need_no_single_task(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id * 3 as x")
    out = consecutive(df, "n", 10, 5)
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert [(r["x"], r["n"]) for r in sorted(out.collect())] == [(i * 3, 10 + 5 * i) for i in range(1000)]
    assert consecutive(df.limit(0), "n").count() == 0


def test_identity_goes_on_from_the_last_value(spark):
    s = Session(spark)
    s.sql("CREATE TABLE #t (id INT IDENTITY(100, 10), v STRING); INSERT INTO #t (v) VALUES ('a'), ('b'); INSERT INTO #t (v) VALUES ('c')")
    assert rows(s.sql("SELECT id FROM #t ORDER BY id")) == [(100,), (110,), (120,)]


def test_explain_analyze_tells_what_ran(spark):
    s = Session(spark)
    s.sql("CREATE TABLE #t (k INT, v INT); INSERT INTO #t VALUES (1, 1), (1, 2), (2, 3)")
    got = s.sql("EXPLAIN ANALYZE SELECT k, SUM(v) AS x FROM #t GROUP BY k").collect()
    assert any("Aggregate" in r["plan"] and r["rows"] == 2 for r in got)
    assert any("Exchange" in r["plan"] for r in got)
