"""DataFrame operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions import fuzzy, library
from quarry.functions.reldate import resolve
from quarry.operators import dml, joins, pattern, prep, quality, recursion, reshape, transforms, windows
from quarry.operators.quality import QualityError, Rule
from quarry.sources import readers, writers
from quarry.streaming import highwater, streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_asof_join_slices_agree(spark):
    left = spark.createDataFrame([(i, i % 3 if i % 7 else None, (i * 37) % 101 if i % 11 else None) for i in range(200)], "id int, k int, t int")
    right = spark.createDataFrame([(i, i % 3, (i * 53) % 101) for i in range(80)], "rid int, k int, t int").groupBy("k", "t").agg(F.min("rid").alias("rid"))
    right = right.unionByName(spark.createDataFrame([(None, 5, -1), (1, None, -2)], "k int, t int, rid int"))
    r = [x for x in right.collect() if x.k is not None and x.t is not None]
    for op, hit, pick in ((">=", lambda a, b: a >= b, max), (">", lambda a, b: a > b, max), ("<=", lambda a, b: a <= b, min), ("<", lambda a, b: a < b, min)):
        want = []
        for x in left.collect():
            found = [y for y in r if x.k is not None and x.t is not None and y.k == x.k and hit(x.t, y.t)]
            want.append((x.id, pick(found, key=lambda y: y.t).rid if found else None))
        for slices in (1, 4):
            got = joins.asof_join(left, right, "t", "t", ["k"], op, "left", slices=slices).select("id", "rid")
            assert rows(got) == sorted(want, key=str), (op, slices)
    assert joins.asof_join(left, right, "t", "t", ["k"], ">=", "inner").where("rid is null").count() == 0
    with pytest.raises(ValueError):
        joins.asof_join(left, right, "t", "t", ["k"], "=")


def test_exclusion_and_groups(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (2, 5), (3, 100)], "n int, v int")
    out = windows.groups_frame(df, [], "n", "s", lambda w: F.sum("v").over(w), -1, 0)
    assert sorted(r["s"] for r in out.collect()) == [10, 35, 35, 125]
    for agg, want in (("sum", {10: 125, 20: 115, 5: 130, 100: 35}), ("max", {10: 100, 20: 100, 5: 100, 100: 20}), ("count", {10: 3, 20: 3, 5: 3, 100: 3})):
        got = {r["v"]: r["x"] for r in windows.exclude(df, [], "n, v", "x", agg, "v").collect()}
        assert {k: int(v) for k, v in got.items()} == want
    ties = {r["v"]: r["x"] for r in windows.exclude(df, [], "n", "x", "sum", "v", what="GROUP").collect()}
    assert int(ties[20]) == int(ties[5]) == 110


def test_top_forms(spark):
    df = spark.createDataFrame([(v,) for v in (100, 90, 90, 90, 80, None)], "v int")
    assert windows.top_with_ties(df, "v DESC", 2).count() == 4
    assert windows.top_with_ties(df, "v", 1).first()[0] is None
    assert windows.top_percent(df, "v DESC", 34).count() == 3
    assert windows.sample_rows(df, 4, 1).count() == 4 and windows.sample_rows(df, 40).count() == 6


def test_greedy_patterns(spark):
    m = pattern.Matcher(pattern.parse_pattern("A B{2,3} C? "))
    out = []
    for flags in (1, 2, 1, 2, 2, 4, 1, 2, 2, 2, 2):
        out += m.feed(flags)
    out += m.feed(None)
    assert out == [(0, -1), (0, -1), (1, 0), (1, 1), (1, 1), (1, 2), (2, 0), (2, 1), (2, 1), (2, 1), (0, -1)]
    with pytest.raises(ValueError):
        pattern.match_recognize(spark.range(1), "id", "A", {"Z": "true"}, {})
    df = spark.createDataFrame([("a", 1, 100), ("a", 2, 99), ("a", 3, 98), ("a", 4, 102), ("b", 1, 5), ("b", 2, 4), ("b", 3, 6)], "s string, t int, p int")
    got = pattern.match_recognize(df, "t", "X D+ U+", {"D": "p < PREV(p)", "U": "p > PREV(p)"}, {"first": "FIRST(t)", "low": "MIN(D.p)", "n": "COUNT(*)", "no": "MATCH_NUMBER()"}, ["s"])
    assert rows(got) == [("a", 1, 98, 4, 1), ("b", 1, 4, 3, 2)]
    assert pattern.match_recognize(df.limit(0), "t", "X", {}, {"n": "COUNT(*)"}, ["s"]).count() == 0


def test_transforms(spark):
    d = spark.createDataFrame([("A", dt.date(2026, 1, 1), 10), ("A", dt.date(2026, 1, 3), 30)], "g string, d date, v int")
    assert [r["v"] for r in transforms.fill_dates(d, "d", ["g"], -1).orderBy("d").collect()] == [10, -1, 30]
    s = spark.createDataFrame([(1, None), (2, 10), (3, None), (4, None), (5, 40), (6, None)], "x int, v int")
    take = lambda df: [r["v"] for r in df.orderBy("x").collect()]
    assert take(transforms.interpolate(s, "v", "x")) == [10, 10, 20, 30, 40, 40] or take(transforms.interpolate(s, "v", "x")) == [None, 10, 20, 30, 40, None]
    assert take(transforms.interpolate(s, "v", "x", "FORWARD_FILL")) == [None, 10, 10, 10, 40, 40]
    t = spark.createDataFrame([("A", 10), ("B", 20), ("C", 5), ("D", 2), ("E", 1)], "c string, v int")
    assert rows(transforms.top_n_others(t, 2, "v", "c", "All Others")) == [("A", 10), ("All Others", 8), ("B", 20)]
    p = spark.createDataFrame([(dt.date(2026, 1, 1), 100), (dt.date(2026, 1, 2), 150), (dt.date(2026, 1, 3), 120)], "d date, v int")
    assert [(r["v_Diff"], None if r["v_Pct"] is None else float(r["v_Pct"])) for r in transforms.period_comparison(p, "d", "v", "DAY").orderBy("d").collect()] == [(None, None), (50, 50.0), (-30, -20.0)]
    z = spark.createDataFrame([(1, 10), (2, 10)], "i int, v int")
    assert [r["v_Normalized"] for r in transforms.normalize(z, "v", "Z_SCORE").collect()] == [0.0, 0.0]


def test_merge_guards_and_replace(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="several source rows"):
        dml.merge(t, s, "t.k = s.k", [dml.When("matched", "update", values={"v": "s.v"})]).table.collect()
    assert rows(dml.merge(t, s.limit(0), "t.k = s.k", [dml.When("not_matched_by_source", "delete", "t.k = 2")]).table) == [(1, "a")]


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, "a@b.c", 5), (1, None, 50), (2, "bad", -1), (None, "x@y.z", 7)], "id int, mail string, n int")
    rules = [Rule("id", "NOT NULL", (), "QUARANTINE"), Rule("mail", "MATCHES", ("@",), "QUARANTINE"), Rule("n", "BETWEEN", (0, 10), "WARN"), Rule("id", "UNIQUE", (), "WARN")]
    r = quality.route(df, rules)
    assert r.clean.count() == 2 and r.quarantine.count() == 2 and r.warned.count() == 2
    assert quality.route(df, rules, dry_run=True).clean.count() == 4
    with pytest.raises(Exception, match="data quality"):
        quality.route(df, [Rule("id", "NOT NULL", (), "THROW")]).clean.collect()
    released = r.quarantine.withColumn("__dq_status", F.lit("released")).withColumn("mail", F.lit("ok@ok")).withColumn("id", F.lit(9))
    again, marked = quality.replay(released, rules)
    assert again.clean.count() == 2 and {x["__dq_status"] for x in marked.collect()} == {"replayed"}
    with pytest.raises(QualityError):
        quality.assert_job({"ROW_COUNT": 5}, ["ROW_COUNT > 10"])
    assert quality.assert_job({"ROW_COUNT": 5}, ["ROW_COUNT WITHIN 0.1 OF HISTORICAL"], [{"ROW_COUNT": 100}]) == []
    assert quality.assert_job({"ROW_COUNT": 5}, ["ROW_COUNT WITHIN 0.1 OF HISTORICAL"], [{"ROW_COUNT": 100}] * 3, warn=True)
    a = spark.createDataFrame([(1, 1.0)], "k int, v double")
    quality.assert_table(a, spark.createDataFrame([(1, 1.004)], "k int, v double"), tolerance=0.01)
    with pytest.raises(QualityError):
        quality.assert_table(a, spark.createDataFrame([(1, 1.5)], "k int, v double"), tolerance=0.01)


def test_recursion_limits(spark):
    start = spark.range(1)
    assert recursion.recursive(start, lambda t: t.where("id < 3").select((F.col("id") + 1).alias("id"))).count() == 4
    with pytest.raises(RecursionError):
        recursion.recursive(start, lambda t: t, max_depth=2)


def test_reshape(spark):
    a, b = spark.createDataFrame([(1, "x")], "K int, v string"), spark.createDataFrame([(2, 5)], "k int, w int")
    assert reshape.union_by_name(a, b).columns == ["K", "v", "w"]
    assert rows(reshape.unnest(spark.createDataFrame([(1, [1, 2]), (2, None)], "i int, l array<int>"), "l").select("i", "Value")) == [(1, 1), (1, 2)]
    assert rows(reshape.flatten(spark.createDataFrame([([[1], [2, 3]],)], "l array<array<int>>"), "l").select("Value")) == [(1,), (2,), (3,)]


def test_functions(spark):
    library.register(spark)
    q = lambda name, *a: spark.range(1).select(library.call(name, *a).alias("x")).first()[0]
    assert q("MASK_EMAIL", "'jonathan@example.com'") == "j***n@example.com" and q("MASK_EMAIL", "'ab@example.com'") == "*@example.com" and q("MASK_EMAIL", "'nope'") == "***@***.com"
    assert q("MASK_PHONE", "'(555) 867-5309'") == "***-***-5309" and q("MASK_SSN", "'12'") == "***-**-****"
    assert q("DATEDIFF", "MONTH", "'2026-01-31'", "'2026-02-01'") == 1 and q("DATEDIFF", "week", "'2026-01-03'", "'2026-01-04'") == 1
    assert q("SOUNDEX", "'Robert'") == "R163" and q("METAPHONE", "'John Smith'") == "JNSM0"
    assert q("REGEXP_REPLACE", "'123-45-6789'", r"'([0-9]{3})-[0-9]{2}-([0-9]{4})'", r"'XXX-XX-\\2'") == "XXX-XX-6789"
    assert q("REGEXP_INSTR", "'hello world'", "'o'", 1, 2) == 8 and q("REGEXP_REPLACE", "'aaa'", "'a'", "'b'", 1, 2) == "aba"
    assert q("JSON_MODIFY", "'{\"a\": 1, \"b\": {\"c\": 2}}'", "'$.b.c'", "'z'") == '{"a": 1, "b": {"c": "z"}}'
    assert q("JSON_QUERY", "'{\"p\": {\"city\": \"Seattle\"}}'", "'$.p'") == '{"city": "Seattle"}' and q("JSON_QUERY", "'{\"p\": 1}'", "'$.p'") is None
    assert q("JSON_ARRAY", 1, "'a'", None) == '[1,"a",null]' and q("JSON_OBJECT", "'k'", 1) == '{"k":1}'
    assert q("XMLELEMENT", "'Emp'", "'J & K'") == "<Emp>J &amp; K</Emp>" and q("XMLFOREST", "'a'", 1, "'b'", None) == "<a>1</a>"
    assert q("XMLQUERY", "'<r><a><b>1</b></a></r>'", "'/r/a'") == "<a><b>1</b></a>"
    assert q("FORMAT", 1234567.891, "'N2'") == "1,234,567.89" and q("FORMAT", "date'2026-03-05'", "'yyyy-MM-dd'") == "2026-03-05"
    assert q("PATINDEX", "'%@%.%'", "'user@example.com'") == 5 and q("CHARINDEX", "'B'", "'abc'") == 2
    assert q("STUFF", "'Hello World'", 6, 0, "' Big'") == "Hello Big World" and q("STR", 1234.567, 8, 2) == " 1234.57"
    assert q("REMOVE_HTML_CHARACTERS", "'AT&amp;T it&#8217;s &mdash; done&hellip;'") == "AT&T it's - done..."
    assert q("PATH_FILENAME", "'a/b/c.txt'") == "c.txt" and q("PATH_EXTENSION", "'a.b/c.txt'") == ".txt" and q("PATH_FILENAME_NO_EXT", "'/x/c.tar.gz'") == "c.tar"
    assert q("MOD", 5, 0) is None and q("SAFE_DIVIDE", 1, 0, -1) == -1 and float(q("TRUNCATE", -3.999, 2)) == -3.99
    assert q("NORMALIZE", "'The Acme & Sons, Inc.'", "'COMPANY'") == "acme and sons"
    assert q("SIMILARITY", "'Smith John'", "'john smith'", "'TOKENSORT'") == 1.0
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def test_relative_dates():
    now = dt.datetime(2026, 5, 13, 10, 30)
    day = lambda *a: dt.datetime(*a)
    assert resolve("D-1", now) == day(2026, 5, 12) and resolve("M", now) == day(2026, 5, 1) and resolve("ME-1", now) == day(2026, 4, 30)
    assert resolve("Q", now) == day(2026, 4, 1) and resolve("W", now) == day(2026, 5, 11) and resolve("N-2H", now) == day(2026, 5, 13, 8, 30)
    assert resolve("2026-01-02", now) == day(2026, 1, 2)


def test_prepared_tables(spark):
    assert prep.calendar(spark, "2024-02-28", "2024-03-01").count() == 3 and prep.calendar(spark, "2024-03-02", "2024-03-01").count() == 0
    a, b = (prep.generate_rows(spark, 50, {"x": "RANDOM_INT(1,9)", "s": "RANDOM(5)"}, 3) for _ in range(2))
    assert rows(a) == rows(b)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("skip\nid;name\n1;'a;b'\n2;NULL\n2\n")
    df = readers.read(spark, "CSV", {"PATH": str(tmp_path / "a.csv"), "DELIMITER": ";", "QUALIFIER": "'", "NULL_AS": "NULL", "START_AT": 2, "COUNT_AT_END": True})
    assert rows(df) == [("1", "a;b"), ("2", None)]
    (tmp_path / "f.txt").write_text("001Ann  \n002Bob  \n\n")
    assert rows(readers.read(spark, "FLATFILE", {"PATH": str(tmp_path / "f.txt"), "FIXED": [("id", 1, 3), ("name", 4, 5)]})) == [("001", "Ann"), ("002", "Bob")]
    (tmp_path / "j.json").write_text('{"data": {"items": [{"a": 1}, {"a": 2}]}}')
    assert rows(readers.read(spark, "JSON", {"PATH": str(tmp_path / "j.json"), "ROOT_PATH": "$.data.items"})) == [(1,), (2,)]
    (tmp_path / "x.xml").write_text("<r><i><a>1</a></i><i><a>2</a></i></r>")
    assert rows(readers.read(spark, "XML", {"PATH": str(tmp_path / "x.xml"), "ROW_PATH": "/r/i"})) == [(1,), (2,)]
    out = {"PATH": str(tmp_path / "out")}
    for _ in range(2):
        writers.write(spark.range(3), "PARQUET", out, mode="append")
    assert readers.read(spark, "PARQUET", out).count() == 6
    writers.write(spark.range(2), "PARQUET", out)
    assert readers.read(spark, "PARQUET", out).count() == 2
    (tmp_path / "b.csv").write_text("1,x\nbad,y\n3,z\n")
    good, bad = readers.bulk_insert(spark, str(tmp_path / "b.csv"), spark.createDataFrame([], "id int, n string"))
    assert rows(good) == [(1, "x"), (3, "z")] and bad.count() == 1
    with pytest.raises(readers.SourceError):
        readers.bulk_insert(spark, str(tmp_path / "b.csv"), spark.createDataFrame([], "id int, n string"), max_errors=0)
    assert readers.jdbc_options("POSTGRES", {"HOST": "h", "DATABASE": "d"})["url"] == "jdbc:postgresql://h:5432/d"


def test_high_water_marks(spark, tmp_path):
    store = highwater.StateStore(str(tmp_path))
    df = spark.createDataFrame([(1, "2024-01-01"), (9, "2024-01-03"), (10, None)], "id int, d string")
    assert highwater.incremental(df, "id", store, "k").count() == 3 and store.get("k") == "10"
    assert highwater.incremental(df, "id", highwater.StateStore(str(tmp_path)), "k").count() == 0
    assert highwater.pending(df, "id", store, "new", initial=9, inclusive=True).count() == 2


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 5)), (1, dt.datetime(2024, 1, 1, 0, 50)), (2, dt.datetime(2024, 1, 1, 3))], "u int, ts timestamp")
    df.write.parquet(f"{tmp_path}/e.parquet")
    s = lambda: streams.read(spark, str(tmp_path), "e")
    assert rows(streams.run_available(streams.tumbling(s(), "ts", "1 hour", ["u"])).select("u", "n")) == [(1, 2), (2, 1)]
    assert streams.run_available(streams.sessions(s(), "ts", "10 minutes", ["u"])).count() == 3
    assert rows(streams.run_available(streams.latest(s(), "ts", ["u"], ["ts"])).select("u")) == [(1,), (2,)]


def test_fuzzy_join_deals_the_rows_of_one_text_to_many_tasks(spark, monkeypatch):
    names = spark.range(300).selectExpr("id", "case when id < 280 then 'red bolt' when id < 290 then 'red bolts' else 'zzz' end as n")
    want = 290 * 290 + 10 * 10
    monkeypatch.setattr(joins, "PAIR_ROWS", 10_000)
    out = joins.fuzzy_join(names, names, "n", "n", 0.8, digits=3)
    assert out.count() == want and {r[0] for r in out.select("__score").distinct().collect()} == {1.0, 0.978}
    parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == want and max(parts) < want / 4


def test_fuzzy_join_unrolls_packs_in_runs_of_right_rows(spark, monkeypatch):
    names = spark.range(1000).selectExpr("id", "'red bolt' as n")
    monkeypatch.setattr(joins, "PAIR_ROWS", 250_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = joins.fuzzy_join(names, names, "n", "n", 0.8).select("id", "id_right").toPandas()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert len(got) == 1_000_000 == len(got.drop_duplicates())
        assert (got["id_right"].diff() != 0).sum() < 1_000_000 / 50


def test_fuzzy_join_of_packs_equals_the_join_of_rows(spark, monkeypatch):
    text = "case when id % 10 < 6 then 'red bolt' when id % 10 = 6 then 'red bolts' when id % 10 = 7 then 'blue nut' when id % 20 = 8 then '' when id % 20 = 9 then 'lonely' end"
    left = spark.range(300).selectExpr("id", f"{text} as n", "struct(id % 7 as `a b`) as s")
    right = spark.range(170).selectExpr("id as rid", f"replace({text}, 'lonely', 'zz') as n", "if(id % 3 = 0, null, id) as v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for keep, how in ((None, "inner"), (None, "left"), (3, "inner"), (2, "left")):
        run = lambda k=keep, h=how: rows(joins.fuzzy_join(left, right, "n", "n", 0.8, keep_best=k, how=h))
        monkeypatch.setattr(joins, "PAIR_ROWS", 10**9)
        want = run()
        assert len(want) > 300 and (how == "inner" or any(r[-1] is None for r in want))
        monkeypatch.setattr(joins, "PAIR_ROWS", 500)
        for limit in ("10MB", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            try:
                assert run() == want
            finally:
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
