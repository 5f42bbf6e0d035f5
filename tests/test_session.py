"""The script language, statement by statement."""

import pytest

from quarry.lang.tokens import ParseError
from quarry.operators.quality import QualityError
from quarry.session import ScriptError, Session


@pytest.fixture()
def s(spark):
    return Session(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


CROPS = """
CREATE TABLE #crops (id INT, field STRING, tons INT, week INT);
INSERT INTO #crops VALUES (1,'North',12,1),(2,'North',31,2),(3,'North',7,3),(4,'South',25,1),(5,'South',18,2),(6,'South',44,3);
"""


def test_join_kinds(s):
    s.sql("""CREATE TABLE #ship (no INT, name STRING); INSERT INTO #ship VALUES (1,'Aurora'),(2,'Borealis'),(3,'Cygnus');
    CREATE TABLE #load (no INT, ship INT, tons INT); INSERT INTO #load VALUES (7,1,64),(8,1,16),(9,2,81),(6,5,90);""")
    assert rows(s.sql("SELECT a.name, b.tons FROM #ship a INNER JOIN #load b ON a.no = b.ship ORDER BY b.tons")) == [("Aurora", 16), ("Aurora", 64), ("Borealis", 81)]
    assert rows(s.sql("SELECT a.name, b.no FROM #ship a FULL OUTER JOIN #load b ON a.no = b.ship ORDER BY b.no")) == [("Cygnus", None), (None, 6), ("Aurora", 7), ("Aurora", 8), ("Borealis", 9)]
    assert rows(s.sql("SELECT a.name FROM #ship a SEMI JOIN #load b ON a.no = b.ship ORDER BY 1")) == [("Aurora",), ("Borealis",)]
    assert rows(s.sql("SELECT a.name FROM #ship a LEFT ANTI JOIN #load b ON a.no = b.ship")) == [("Cygnus",)]
    assert rows(s.sql("SELECT a.name, b.tons FROM #ship a, #load b WHERE a.no = b.ship AND b.tons > 70")) == [("Borealis", 81)]
    assert rows(s.sql("SELECT a.name FROM #ship a INNER HASH JOIN #load b ON a.no = b.ship AND b.tons = 16")) == [("Aurora",)]


def test_expressions(s):
    q = lambda e: s.sql(f"SELECT {e} AS x").first()[0]
    assert q("7 / 2") == 3 and q("-7 / 2") == -3 and float(q("7 / 2.0")) == 3.5
    assert q("'a' + 'b'") == "ab" and q("'n' || 1 + 2") == "n3"
    assert q("NULL ?? 5") == 5 and q("1 = 1 ?? 0") is True
    assert q("'ABC' = 'abc'") is True and q("'5' = 5") is True
    assert q("3 > 2 => 'yes' : 'no'") == "yes"
    assert q("1_000 + 1") == 1001
    assert q("CAST('3.9' AS INT)") == 3 and q("TRY_CAST('x' AS INT)") is None
    assert q("'{\"a\": [1, 2, 3]}' -> 'a' ->> -1") == "3" or q("'[1,2,3]' ->> -1") == "3"
    assert q("CASE WHEN 1 = 2 THEN 'a' WHEN NULL THEN 'b' ELSE 'c' END") == "c"
    assert q("5 << 2") == 20 and q("~5") == -6
    assert q("'abc' ~ '^a' AND 'ABC' ~* '^a'") is True
    assert q("DATE '2026-01-10' - DATE '2026-01-01'") == 9
    assert q("5 IN (1, 2, NULL)") is None and q("2 BETWEEN 1 AND 3") is True
    assert q("NULL IS NOT DISTINCT FROM NULL") is True
    with pytest.raises(ParseError):
        q("COUNT(DISTINCT *)")


def test_case_sensitivity_is_a_setting(s):
    s.sql("CREATE TABLE #t (n STRING); INSERT INTO #t VALUES ('a'), ('A'), ('b');")
    assert s.sql("SELECT n FROM #t WHERE n = 'A'").count() == 2
    s.sql("SET CASE_SENSITIVE ON")
    assert s.sql("SELECT n FROM #t WHERE n = 'A'").count() == 1


def test_star_modifiers_and_columns(s):
    s.sql("CREATE TABLE #i (id INT, name STRING, price INT); INSERT INTO #i VALUES (1, 'x', 10), (2, 'y', 20);")
    df = s.sql("SELECT * EXCLUDE (id) REPLACE (price * 2 AS price) RENAME (name AS label) FROM #i ORDER BY price")
    assert df.columns == ["label", "price"] and rows(df) == [("x", 20), ("y", 40)]
    assert s.sql("SELECT COLUMNS('^p') FROM #i").columns == ["price"]
    assert s.sql("SELECT COLUMNS(* EXCLUDE (price)) FROM #i").columns == ["id", "name"]
    with pytest.raises(ParseError):
        s.sql("SELECT * EXCLUDE (nope) FROM #i")


def test_grouping(s):
    s.sql(CROPS)
    assert rows(s.sql("SELECT field, SUM(tons) AS total FROM #crops GROUP BY ALL ORDER BY field")) == [("North", 50), ("South", 87)]
    assert rows(s.sql("SELECT field AS r, COUNT() AS n FROM #crops GROUP BY r HAVING n > 2 ORDER BY r")) == [("North", 3), ("South", 3)]
    assert s.sql("SELECT field, week, SUM(tons) FROM #crops GROUP BY CUBE (field, week)").count() == 12
    assert rows(s.sql("SELECT SUM(tons) FILTER (WHERE week = 1) AS a FROM #crops")) == [(37,)]
    assert rows(s.sql("SELECT STRING_AGG(field, ',') WITHIN GROUP (ORDER BY id DESC) AS a FROM #crops WHERE id < 3")) == [("North,North",)]


def test_windows(s):
    s.sql(CROPS)
    assert [r[1] for r in rows(s.sql("SELECT id, SUM(tons) OVER w AS t FROM #crops WINDOW w AS (PARTITION BY field ORDER BY id) ORDER BY id"))] == [12, 43, 50, 25, 43, 87]
    assert [r[1] for r in rows(s.sql("SELECT id, SUM(tons) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS t FROM #crops WINDOW w AS (PARTITION BY field ORDER BY id) ORDER BY id"))] == [12, 43, 38, 25, 43, 62]
    assert [int(r[1]) for r in rows(s.sql("SELECT id, SUM(tons) OVER (PARTITION BY field ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS t FROM #crops ORDER BY id"))] == [38, 19, 43, 62, 69, 43]
    s.sql("CREATE TABLE #g (n INT, v INT); INSERT INTO #g VALUES (1,3),(2,8),(2,11),(4,40);")
    assert sorted(r[0] for r in rows(s.sql("SELECT SUM(v) OVER (ORDER BY n GROUPS 1 PRECEDING) AS t FROM #g"))) == [3, 22, 22, 59]
    assert rows(s.sql("SELECT SUM(tons) FILTER (WHERE week > 1) OVER () AS t FROM #crops LIMIT 1")) == [(100,)]


def test_qualify_top_and_sample(s):
    s.sql(CROPS)
    assert rows(s.sql("SELECT field, tons FROM #crops QUALIFY ROW_NUMBER() OVER (PARTITION BY field ORDER BY tons DESC) = 1 ORDER BY field")) == [("North", 31), ("South", 44)]
    assert rows(s.sql("SELECT field, tons, RANK() OVER (ORDER BY tons DESC) AS r FROM #crops QUALIFY r <= 2 ORDER BY r LIMIT 1")) == [("South", 44, 1)]
    assert rows(s.sql("SELECT TOP 2 id FROM #crops ORDER BY tons DESC")) == [(6,), (2,)]
    assert s.sql("SELECT TOP 50 PERCENT id FROM #crops ORDER BY id").count() == 3
    s.sql("CREATE TABLE #sc (v INT); INSERT INTO #sc VALUES (64),(51),(51),(51),(20);")
    assert s.sql("SELECT TOP 2 WITH TIES v FROM #sc ORDER BY v DESC").count() == 4
    assert s.sql("SELECT id FROM #crops USING SAMPLE 4 ROWS REPEATABLE (1)").count() == 4
    with pytest.raises(ParseError):
        s.sql("SELECT id FROM #crops USING SAMPLE 4")
    with pytest.raises(ValueError):
        s.sql("SELECT id FROM #crops USING SAMPLE 200 PERCENT")
    assert rows(s.sql("SELECT id FROM #crops ORDER BY id OFFSET 2 ROWS FETCH NEXT 2 ROWS ONLY")) == [(3,), (4,)]


def test_set_operations_and_recursion(s):
    s.sql("CREATE TABLE #a (v INT); INSERT INTO #a VALUES (2),(4),(6),(8); CREATE TABLE #b (v INT); INSERT INTO #b VALUES (6),(8),(10),(12);")
    assert rows(s.sql("SELECT v FROM #a EXCEPT SELECT v FROM #b ORDER BY v")) == [(2,), (4,)]
    assert rows(s.sql("(SELECT v FROM #a) INTERSECT (SELECT v FROM #b) ORDER BY v DESC")) == [(8,), (6,)]
    assert s.sql("SELECT v FROM #a UNION SELECT v FROM #b").count() == 6
    df = s.sql("SELECT v, 1 AS x FROM #a UNION ALL BY NAME SELECT 2 AS y, v FROM #b")
    assert df.columns == ["v", "x", "y"] and df.count() == 8
    s.sql("CREATE TABLE #parts (no INT, inside INT); INSERT INTO #parts VALUES (10,NULL),(20,10),(30,20),(40,10);")
    q = "WITH RECURSIVE t(no, depth) AS (SELECT no, 1 FROM #parts WHERE inside IS NULL UNION ALL SELECT c.no, t.depth + 1 FROM #parts c JOIN t ON c.inside = t.no) SELECT no, depth FROM t ORDER BY no"
    assert rows(s.sql(q)) == [(10, 1), (20, 2), (30, 3), (40, 2)]
    s.sql("CREATE TABLE #e (a INT, b INT); INSERT INTO #e VALUES (1,2),(2,3),(3,1);")
    assert rows(s.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT b FROM #e JOIN r ON a = n) SELECT n FROM r ORDER BY n")) == [(1,), (2,), (3,)]
    assert rows(s.sql("SELECT * FROM (VALUES (1, 'a'), (2, 'b'),) AS t(x, y) ORDER BY x")) == [(1, "a"), (2, "b")]


def test_asof_join(s):
    s.sql("""CREATE TABLE #rides (ride INT, line STRING, at INT); INSERT INTO #rides VALUES (1,'A',5),(2,'A',10),(3,'B',7),(4,'C',1),(5,NULL,9);
    CREATE TABLE #fares (fare INT, line STRING, since INT); INSERT INTO #fares VALUES (1,'A',4),(2,'A',10),(3,'B',8),(4,NULL,1);""")
    q = "SELECT t.ride, q.fare FROM #rides t ASOF {}JOIN #fares q ON t.line = q.line AND t.at {} q.since ORDER BY t.ride"
    assert rows(s.sql(q.format("", ">="))) == [(1, 1), (2, 2)]
    assert rows(s.sql(q.format("LEFT ", ">"))) == [(1, 1), (2, 1), (3, None), (4, None), (5, None)]
    assert rows(s.sql(q.format("", "<="))) == [(1, 2), (2, 2), (3, 3)]
    with pytest.raises(ParseError):
        s.sql("SELECT 1 FROM #rides t ASOF JOIN #fares q ON t.line = q.line")


def test_fuzzy_join(s):
    s.sql("CREATE TABLE #l (id INT, name STRING); INSERT INTO #l VALUES (1,'Margaret Hill'),(2,'Zed'),(3,'Albert'); CREATE TABLE #r (rid INT, alias STRING); INSERT INTO #r VALUES (1,'Margret Hill'),(2,'Alberto'),(3,'Alb');")
    df = s.sql("SELECT l.id, r.rid, __score FROM #l l LEFT FUZZY JOIN #r r ON SIMILARITY(l.name, r.alias) > 0.8 KEEP BEST 1 ORDER BY l.id")
    got = rows(df)
    assert [(a, b) for a, b, _ in got] == [(1, 1), (2, None), (3, 2)] and got[1][2] is None


def test_lateral_and_apply(s):
    s.sql(CROPS + "CREATE TABLE #reg (name STRING); INSERT INTO #reg VALUES ('North'),('South'),('Valley');")
    q = "SELECT r.name, x.tons FROM #reg r {} (SELECT TOP 1 tons FROM #crops WHERE field = r.name ORDER BY tons DESC) x ORDER BY r.name"
    assert rows(s.sql(q.format("CROSS APPLY"))) == [("North", 31), ("South", 44)]
    assert rows(s.sql(q.format("OUTER APPLY"))) == [("North", 31), ("South", 44), ("Valley", None)]
    s.sql("CREATE TABLE #c (id INT, tags STRING); INSERT INTO #c VALUES (1,'a,b'),(2,'c');")
    assert rows(s.sql("SELECT c.id, t.Value FROM #c c CROSS APPLY STRING_SPLIT(c.tags, ',') t ORDER BY c.id, t.Value")) == [(1, "a"), (1, "b"), (2, "c")]
    assert rows(s.sql("SELECT value FROM GENERATE_SERIES(1, 7, 3) g ORDER BY value")) == [(1,), (4,), (7,)]
    assert s.sql("SELECT value FROM GENERATE_SERIES(5, 1) g").count() == 0


def test_pivot_and_unpivot(s):
    s.sql("CREATE TABLE #m (season INT, crop STRING, tons INT); INSERT INTO #m VALUES (7,'Oat',4),(7,'Rye',9),(8,'Oat',6),(8,'Oat',5);")
    assert rows(s.sql("SELECT season, Oat, Rye FROM #m PIVOT (SUM(tons) FOR crop IN ('Oat', 'Rye')) AS p ORDER BY season")) == [(7, 4, 9), (8, 11, None)]
    df = s.sql("PIVOT #m ON crop USING SUM(tons) GROUP BY season")
    assert sorted(df.columns) == ["Oat", "Rye", "season"]
    s.sql("CREATE TABLE #w (season INT, early INT, late INT); INSERT INTO #w VALUES (7, 6, NULL), (8, 2, 9);")
    assert rows(s.sql("SELECT season, part, v FROM #w UNPIVOT (v FOR part IN (early, late)) AS u ORDER BY season, part")) == [(7, "early", 6), (8, "early", 2), (8, "late", 9)]
    assert s.sql("UNPIVOT #w ON COLUMNS(* EXCLUDE (season)) INTO NAME n VALUE v").count() == 3


def test_match_recognize(s):
    s.sql("CREATE TABLE #st (well STRING, hour INT, depth INT); INSERT INTO #st VALUES ('K',1,9),('K',2,6),('K',3,4),('K',4,8),('K',5,12),('L',1,3),('L',2,7);")
    q = """SELECT * FROM #st MATCH_RECOGNIZE (PARTITION BY well ORDER BY hour
      MEASURES STRT.hour AS start_t, LAST(DOWN.hour) AS bottom_t, LAST(UP.hour) AS end_t
      ONE ROW PER MATCH PATTERN (STRT DOWN+ UP+) DEFINE DOWN AS depth < PREV(depth), UP AS depth > PREV(depth)) AS m"""
    assert rows(s.sql(q)) == [("K", 1, 3, 5)]
    df = s.sql(q.replace("ONE ROW", "ALL ROWS").replace("ROWS PER", "ROWS PER"))
    assert df.count() == 5 and "CLASSIFIER" in df.columns


def test_dml(s):
    s.sql("CREATE TABLE #o (id INT, v INT); INSERT INTO #o VALUES (1,10),(2,20),(3,30);")
    out = s.sql("UPDATE #o SET v = v + 1 OUTPUT DELETED.v AS was, INSERTED.v AS now WHERE id < 3")
    assert sorted(rows(out)) == [(10, 11), (20, 21)] and s.variables["@@rowcount"] == 2
    assert rows(s.sql("DELETE FROM #o OUTPUT DELETED.id WHERE v > 25")) == [(3,)]
    s.sql("CREATE TABLE #p (id INT, d INT); INSERT INTO #p VALUES (1, 5);")
    s.sql("UPDATE #o SET v = v + p.d FROM #p p WHERE #o.id = p.id")
    assert rows(s.sql("SELECT * FROM #o ORDER BY id")) == [(1, 16), (2, 21)]
    s.sql("CREATE TABLE #src (id INT, v INT); INSERT INTO #src VALUES (2, 99), (4, 40);")
    s.sql("MERGE INTO #o AS t USING #src AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET t.v = s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v) WHEN NOT MATCHED BY SOURCE THEN DELETE;")
    assert rows(s.sql("SELECT * FROM #o ORDER BY id")) == [(2, 99), (4, 40)]
    s.sql("TRUNCATE TABLE #o")
    assert s.sql("SELECT * FROM #o").count() == 0


def test_constraints_identity_and_replace(s):
    s.sql("CREATE TABLE #k (id INT IDENTITY(1,1), code VARCHAR(3) NOT NULL UNIQUE, n INT DEFAULT 7 CHECK (n > 0));")
    s.sql("INSERT INTO #k (code) VALUES ('a'), ('b')")
    assert rows(s.sql("SELECT id, code, n FROM #k ORDER BY id")) == [(1, "a", 7), (2, "b", 7)]
    for bad in ("('a', 1)", "(NULL, 1)", "('toolong', 1)", "('z', 0)"):
        with pytest.raises(ScriptError):
            s.sql(f"INSERT INTO #k (code, n) VALUES {bad}")
    s.sql("CREATE TABLE #r (id INT PRIMARY KEY, v STRING); INSERT INTO #r VALUES (1,'a'); INSERT OR REPLACE INTO #r VALUES (1,'b'),(2,'c');")
    assert rows(s.sql("SELECT * FROM #r ORDER BY id")) == [(1, "b"), (2, "c")]
    s.sql("ALTER TABLE #r ADD COLUMN x INT DEFAULT 3; ALTER TABLE #r RENAME COLUMN v TO w; ALTER TABLE #r DROP COLUMN x")
    assert s.table("#r").columns == ["id", "w"]


def test_transactions_and_what_if(s):
    s.sql("CREATE TABLE #t (v INT); INSERT INTO #t VALUES (1); BEGIN TRANSACTION; DELETE FROM #t; ROLLBACK;")
    assert s.table("#t").count() == 1
    s.sql("SET WHAT_IF ON; DELETE FROM #t; SET WHAT_IF OFF;")
    assert s.table("#t").count() == 1 and s.variables["@@rowcount"] == 1


def test_control_flow(s):
    s.sql("""DECLARE @i INT = 0, @t INT = 0;
    WHILE @i < 5 BEGIN SET @i = @i + 1; IF @i = 3 CONTINUE; SET @t = @t + @i; END
    FOREACH @x IN (10, 20) BEGIN SET @t = @t + @x; END
    FOR @k = 1 TO 3 BEGIN IF @k = 3 BREAK; SET @t = @t + 100; END
    BEGIN TRY THROW 51000, 'boom', 1; END TRY BEGIN CATCH PRINT ERROR_MESSAGE(); END CATCH
    IF @t > 1000 BEGIN PRINT 'big'; END ELSE BEGIN PRINT 'small ${@t}'; END""")
    assert s.variables["@t"] == 1 + 2 + 4 + 5 + 30 + 200
    assert s.printed == ["boom", "small 242"]


def test_functions_and_procedures(s):
    s.sql("""CREATE FUNCTION twice(@x INT) RETURNS INT AS BEGIN RETURN @x * 2; END;
    CREATE FUNCTION sign_of(@x INT) RETURNS STRING AS BEGIN IF @x < 0 BEGIN RETURN 'neg'; END RETURN 'pos'; END;
    CREATE PROCEDURE put(@a INT, @b INT OUTPUT) AS BEGIN SET @b = @a + 1; END;
    CREATE TABLE #t (v INT); INSERT INTO #t VALUES (1), (-2);
    DECLARE @o INT; EXEC put 4, @o OUTPUT;""")
    assert rows(s.sql("SELECT twice(v) AS a, sign_of(v) AS b FROM #t ORDER BY a")) == [(-4, "neg"), (2, "pos")]
    assert s.variables["@o"] == 5


def test_transform_generate_compare(s):
    s.sql("CREATE TABLE #fd (Grp STRING, Dt DATE, Val INT); INSERT INTO #fd VALUES ('A','2026-01-01',10),('A','2026-01-03',30); TRANSFORM #out FROM #fd USING FILL_DATES (DATE_COL = 'Dt', BY_GROUP = 'Grp', GAPS_FILL = -1);")
    assert [(str(a), b) for a, b in rows(s.sql("SELECT Dt, Val FROM #out ORDER BY Dt"))] == [("2026-01-01", 10), ("2026-01-02", -1), ("2026-01-03", 30)]
    s.sql("GENERATE 5 ROWS INTO #g AS (id = 'SEQUENCE(1,1)', r = 'RANDOM_INT(1,3)', c = 'RANDOM(North,South)')")
    assert s.sql("SELECT id FROM #g WHERE r BETWEEN 1 AND 3 AND c IN ('North','South')").count() == 5
    s.sql("GENERATE CALENDAR FROM '2024-02-28' TO '2024-03-01' INTO #cal")
    assert s.table("#cal").count() == 3 and len(s.table("#cal").columns) == 27
    s.sql("CREATE TABLE #old (k INT, v INT); INSERT INTO #old VALUES (1,1),(2,2),(3,3); CREATE TABLE #new (k INT, v INT); INSERT INTO #new VALUES (1,1),(2,5),(4,4); COMPARE DATASETS #new WITH #old KEY (k) INTO #diff;")
    assert sorted(rows(s.sql("SELECT _change_type, k FROM #diff"))) == [("DELETE", 3), ("INSERT", 4), ("UPDATE", 2)]


def test_quality_routing(s):
    s.sql("CREATE TABLE #in (id INT, email VARCHAR(100)); INSERT INTO #in (id, email) VALUES (5,'x@y.example'),(6,'no mail'),(NULL,'z@y.example'),(7,'w@y.example');")
    s.sql("""SELECT id EXPECT NOT NULL ON FAILURE QUARANTINE, email EXPECT MATCHES '^[^@]+@[^@]+\\.[^@]+$' ON FAILURE QUARANTINE
    INTO #clean FROM #in ON FAILURE QUARANTINE TO #bad;""")
    assert rows(s.sql("SELECT id FROM #clean ORDER BY id")) == [(5,), (7,)] and s.table("#bad").count() == 2
    with pytest.raises(QualityError):
        s.sql("EXPECT SCHEMA #in (id INT, missing STRING)")
    assert s.sql("EXPECT SCHEMA #in (id STRING) ON DRIFT WARN") is None and s.warnings
    s.sql("ASSERT TABLE #clean MATCHES #clean")
    with pytest.raises(QualityError):
        s.sql("ASSERT (SELECT COUNT(*) FROM #clean) = 3, 'three'")


def test_watermark_and_state(s):
    s.sql("CREATE TABLE #e (id INT, v INT); INSERT INTO #e VALUES (1,1),(2,2);")
    assert s.sql("SELECT * FROM #e WITH (WATERMARK = 'id') x").count() == 2
    s.sql("INSERT INTO #e VALUES (3,3)")
    assert rows(s.sql("SELECT id FROM #e WITH (WATERMARK = 'id') x")) == [(3,)]
    s.sql("SELECT SET_JOB_STATE('k', 'v')")
    assert s.sql("SELECT GET_JOB_STATE('k') AS x").first()[0] == "v"


def test_json_and_xml_output(s):
    s.sql("CREATE TABLE #d (id INT, n STRING); INSERT INTO #d VALUES (1,'a'),(2,NULL);")
    assert s.sql("SELECT id, n FROM #d ORDER BY id FOR JSON PATH, ROOT('r')").first()[0] == '{"r":[{"id":1,"n":"a"},{"id":2,"n":null}]}'
    assert s.sql("SELECT id FROM #d ORDER BY id FOR XML PATH('i'), ROOT('r')").first()[0] == "<r><i><id>1</id></i><i><id>2</id></i></r>"
    assert rows(s.sql("SELECT x.key, x.value FROM OPENJSON('{\"a\": 1, \"b\": \"z\"}') x ORDER BY x.key")) == [("a", "1"), ("b", "z")]


def test_views_metadata_and_unknown_names(s):
    s.sql("CREATE TABLE #t (v INT); INSERT INTO #t VALUES (1); CREATE VIEW big AS SELECT v + 1 AS w FROM #t;")
    assert rows(s.sql("SELECT w FROM big")) == [(2,)]
    assert ("#t", "v") in [(r[0], r[1]) for r in rows(s.sql("SELECT table_name, column_name FROM eng.columns"))]
    with pytest.raises(Exception, match="nope"):
        s.sql("SELECT nope FROM #t")
    with pytest.raises(ScriptError):
        s.sql("SELECT 1 FROM #missing")
    assert s.sql("EXPLAIN SELECT v FROM #t").count() > 1


def test_apply_ranks_the_rows_of_each_outer_row(spark, s):
    s.sql("CREATE TABLE #o (k INT, v INT, n STRING); INSERT INTO #o VALUES (1,5,'a'),(1,9,'b'),(1,7,'c'),(2,1,'d'); CREATE TABLE #c (k INT); INSERT INTO #c VALUES (1),(2),(3);")
    for q in ("SELECT c.k, x.n FROM #c c OUTER APPLY (SELECT TOP 1 n FROM #o o WHERE o.k = c.k ORDER BY v DESC) x", "SELECT c.k, (SELECT n FROM #o o WHERE o.k = c.k ORDER BY v DESC LIMIT 1) AS n FROM #c c"):
        df = s.sql(q)
        assert sorted(rows(df)) == [(1, "b"), (2, "d"), (3, None)]
        # a sort before the shuffle of the window does not order its rows: the window itself must
        window = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [row_number" in x)
        assert "DESC NULLS LAST" in window
    ordered = s.sql("SELECT c.k, x.a FROM #c c CROSS APPLY (SELECT TOP 2 v * 2 AS a FROM #o o WHERE o.k = c.k ORDER BY a DESC, n) x")
    assert ordered.columns == ["k", "a"] and sorted(rows(ordered)) == [(1, 14), (1, 18), (2, 2)]


def test_full_join_yields_the_pairs_of_a_key_one_by_one(spark, s):
    key = "spark.sql.codegen.join.fullOuterSortMergeJoin.enabled"
    spark.conf.unset(key)
    s.tables["#a"] = spark.range(1200).selectExpr("id % 2 as k", "id as v")
    s.tables["#b"] = spark.range(1201).selectExpr("id % 2 + 1 as k", "id as w")
    df = s.sql("SELECT a.v, b.w FROM #a a FULL JOIN #b b ON a.k = b.k AND a.v > b.w")
    got = {tuple(r) for r in df.collect()}
    pairs = {(v, w) for v in range(1, 1200, 2) for w in range(0, 1201, 2) if v > w}
    lone_v, lone_w = set(range(1200)) - {v for v, _ in pairs}, set(range(1201)) - {w for _, w in pairs}
    assert got == pairs | {(v, None) for v in lone_v} | {(None, w) for w in lone_w}
    # the generated code of this join holds all pairs of a key in memory
    assert spark.conf.get(key) == "false"
