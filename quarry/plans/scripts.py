"""Registered queries in the script language: functions by family, clauses and statements over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import Session
from .catalog import register, table


def script(name: str, text: str, oracle: str) -> None:
    """Register a script whose last query is the result; #t of a given table is that table."""
    used = sorted(set(re.findall(r"#(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|labels|conversations)\b", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Session(spark)
        for t in used:
            s.tables[f"#{t}"] = table(spark, sf_dir, t)
        return s.sql(text.replace("{sf_dir}", sf_dir))

    register(name, oracle)(run)


# --- dates -------------------------------------------------------------------------------------------------------------

script(
    "script_date_parts",
    """SELECT event_id, DATE_PART('month', ts) AS a, EXTRACT(YEAR FROM ts) AS b, DAY(ts) AS c, MONTH(ts) AS d, HOUR(ts) AS e, MINUTE(ts) AS f, SECOND(ts) AS g, DATEPART(dayofyear, ts) AS h,
       DATEPART(week, ts) AS i, DATEPART(weekday, ts) AS j, DATENAME(year, ts) AS k, DATEPART(quarter, ts) AS l FROM #events""",
    """SELECT event_id, CAST(month(ts) AS INT) AS a, CAST(year(ts) AS INT) AS b, CAST(day(ts) AS INT) AS c, CAST(month(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS e, CAST(minute(ts) AS INT) AS f, CAST(second(ts) AS INT) AS g,
       CAST(dayofyear(ts) AS INT) AS h, CAST(weekofyear(ts) AS INT) AS i, CAST(dayofweek(ts) + 1 AS INT) AS j, CAST(year(ts) AS VARCHAR) AS k, CAST(quarter(ts) AS INT) AS l FROM events""",
)
script(
    "script_date_edges",
    """SELECT o_orderkey, END_OF_MONTH(o_orderdate) AS a, END_OF_QUARTER(o_orderdate) AS b, END_OF_WEEK(o_orderdate) AS c, START_OF_MONTH(o_orderdate) AS d, SAME_PERIOD_LAST_YEAR(o_orderdate) AS e, EOMONTH(o_orderdate, 2) AS f,
       START_OF_MONTH(o_orderdate, -1) AS g, DATE_TRUNC('quarter', o_orderdate) AS h, DATETRUNC(year, o_orderdate) AS i, TRUNC(o_orderdate) AS j FROM #orders""",
    """SELECT o_orderkey, last_day(o_orderdate) AS a, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS b, CAST(o_orderdate AS DATE) + 6 - CAST(dayofweek(o_orderdate) AS INT) AS c,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(o_orderdate - INTERVAL 1 YEAR AS DATE) AS e, last_day(o_orderdate + INTERVAL 2 MONTH) AS f, CAST(date_trunc('month', o_orderdate - INTERVAL 1 MONTH) AS DATE) AS g,
       CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS h, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS i, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS j FROM orders""",
)
script(
    "script_date_arithmetic",
    """SELECT event_id, DATEADD(hour, 5, ts) AS a, DATEADD(quarter, -1, ts) AS b, DATEDIFF(hour, '2024-01-01', ts) AS c, DATEDIFF(quarter, '2023-05-05', ts) AS d, DATEDIFF(year, '2020-12-31', ts) AS e, DATEDIFF(minute, '2024-01-01', ts) AS f FROM #events""",
    """SELECT event_id, ts + INTERVAL 5 HOUR AS a, ts - INTERVAL 3 MONTH AS b, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INT) AS c, CAST(date_diff('quarter', TIMESTAMP '2023-05-05', ts) AS INT) AS d,
       CAST(date_diff('year', TIMESTAMP '2020-12-31', ts) AS INT) AS e, CAST(date_diff('minute', TIMESTAMP '2024-01-01', ts) AS INT) AS f FROM events""",
)
script(
    "script_date_make",
    """SELECT o_orderkey, DATETIMEFROMPARTS(YEAR(o_orderdate), MONTH(o_orderdate), DAY(o_orderdate), 1, 2, 3, 250) AS a, TIMEFROMPARTS(o_orderkey % 24, 5, 9, 7, 2) AS b, TO_DATE(CAST(o_orderdate AS STRING), 'yyyy-MM-dd HH:mm:ss') AS c,
       TO_DATE(o_orderpriority) AS d, TO_TIMESTAMP(o_orderkey * 1000) AS e, ISDATE(CAST(o_orderdate AS STRING)) AS f, ISDATE(o_orderpriority) AS g FROM #orders""",
    """SELECT o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 1, 2, 3.25) AS a, printf('%02d:05:09.07', o_orderkey % 24) AS b, CAST(o_orderdate AS DATE) AS c, CAST(NULL AS DATE) AS d,
       make_timestamp(CAST(o_orderkey * 1000 AS BIGINT) * 1000000) AS e, 1 AS f, 0 AS g FROM orders""",
)
script(
    "script_date_now",
    """SELECT r_regionkey, DATEDIFF(day, GETDATE(), SYSDATE()) AS a, DATEDIFF(day, CURRENT_DATE(), NOW()) AS b, LEN(CURRENT_TIME()) AS c, ABS(DATEDIFF(hour, CURRENT_TIMESTAMP(), GETDATE())) < 25 AS d, DATEDIFF(day, RELDATE('D-1'), RELDATE('D')) AS e FROM #region""",
    "SELECT r_regionkey, 0 AS a, 0 AS b, 8 AS c, true AS d, 1 AS e FROM region",
)
script(
    "script_date_offset",
    "SELECT n_nationkey, CAST(DATETIMEOFFSETSFROMPARTS(2024, 3, 5, 12, 30, 15, 0, 2, 0, 0) AS STRING) AS a FROM #nation",
    "SELECT n_nationkey, '2024-03-05 10:30:15' AS a FROM nation",
)

# --- text --------------------------------------------------------------------------------------------------------------

script(
    "script_text_shape",
    """SELECT p_partkey, ASCII(p_name) AS a, CHAR(65 + p_size % 26) AS b, CHAR_LENGTH(p_name) AS c, CHARACTER_LENGTH(p_brand) AS d, CONCAT(p_name, NULL, '-', p_size) AS e, CONCAT_WS('|', p_name, p_brand) AS f, DATALENGTH(p_name) AS g,
       OCTET_LENGTH(p_type) AS h, INITCAP(p_name) AS i, INSTR(p_name, 'ring') AS j, LEFT(p_name, 4) AS k, RIGHT(p_type, 5) AS l, LENGTH(p_type) AS m, LOWER(p_brand) AS n, POSITION('#' IN p_brand) AS o, REPEAT(p_brand, 2) AS p,
       RPAD(p_name, 20, '*') AS q, SPACE(p_size % 3) AS r, UNICODE(p_type) AS s FROM #part""",
    """SELECT p_partkey, ascii(p_name) AS a, chr(65 + p_size % 26) AS b, CAST(length(p_name) AS INT) AS c, CAST(length(p_brand) AS INT) AS d, p_name || '-' || p_size AS e, p_name || '|' || p_brand AS f, CAST(strlen(p_name) AS INT) AS g,
       CAST(strlen(p_type) AS INT) AS h, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS i, CAST(strpos(p_name, 'ring') AS INT) AS j, left(p_name, 4) AS k, right(p_type, 5) AS l,
       CAST(length(p_type) AS INT) AS m, lower(p_brand) AS n, CAST(strpos(p_brand, '#') AS INT) AS o, p_brand || p_brand AS p, rpad(p_name, 20, '*') AS q, repeat(' ', p_size % 3) AS r, ascii(p_type) AS s FROM part""",
)
script(
    "script_text_edit",
    """SELECT p_partkey, LTRIM('  ' + p_name) AS a, RTRIM(p_name + '  ') AS b, TRIM(' ' + p_name + ' ') AS c, OVERLAY(p_name PLACING '##' FROM 2 FOR 3) AS d, SUBSTR(p_name, 2, 3) AS e, SUBSTRING(p_type, 3, 4) AS f, TRANSLATE(p_name, 'aeiou', '12345') AS g,
       TO_STR(p_size) AS h, CLEAN_STRING('  ' + p_name + '   ' + p_brand + ' ') AS i, STRING_ESCAPE('<' + p_name + '>', 'xml') AS j, REMOVE_HTML_CHARACTERS('&lt;' + p_name + '&gt; &amp; more') AS k,
       STR(p_retailprice, 10, 1) AS l, PATINDEX('%ing%', p_name) AS m FROM #part""",
    """SELECT p_partkey, p_name AS a, p_name AS b, p_name AS c, left(p_name, 1) || '##' || substring(p_name, 5) AS d, substring(p_name, 2, 3) AS e, substring(p_type, 3, 4) AS f, translate(p_name, 'aeiou', '12345') AS g, CAST(p_size AS VARCHAR) AS h,
       p_name || ' ' || p_brand AS i, '&lt;' || p_name || '&gt;' AS j, '<' || p_name || '> & more' AS k, lpad(CAST(round(CAST(p_retailprice AS DECIMAL(38, 10)), 1)::DECIMAL(38, 1) AS VARCHAR), 10, ' ') AS l, CAST(strpos(p_name, 'ing') AS INT) AS m FROM part""",
)
script(
    "script_text_hidden",
    "SELECT p_partkey, REMOVE_HIDDEN_CHARACTERS(p_name + CHAR(9) + p_brand) AS a, FORMAT(p_retailprice, 'N2') AS b, FORMAT(p_size, '0000') AS c FROM #part",
    "SELECT p_partkey, p_name || ' ' || p_brand AS a, format('{:,.2f}', round(p_retailprice, 2)) AS b, lpad(CAST(p_size AS VARCHAR), 4, '0') AS c FROM part",
)
script(
    "script_regex_rows",
    "SELECT p.p_partkey, m.Value AS v FROM #part p CROSS APPLY REGEXP_MATCHES(p.p_name, '[aeiou]') m",
    "SELECT p_partkey, unnest(regexp_extract_all(p_name, '[aeiou]')) AS v FROM part",
)
script(
    "script_regex_split",
    "SELECT p.p_partkey, m.Value AS v FROM #part p CROSS APPLY REGEXP_SPLIT_TO_TABLE(p.p_type, '[ A]+') m",
    "SELECT p_partkey, unnest(regexp_split_to_array(p_type, '[ A]+')) AS v FROM part",
)
script(
    "script_ngram_tokens",
    "SELECT p.p_partkey, m.Value AS v FROM #part p CROSS APPLY NGRAM_TOKENS(p.p_name) m",
    """SELECT p_partkey, substring(' ' || t || ' ', CAST(i AS INT), 3) AS v FROM (SELECT p_partkey, t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS t FROM part))""",
)

# --- numbers -----------------------------------------------------------------------------------------------------------

script(
    "script_math_trigonometry",
    """SELECT p_partkey, ROUND(ACOS(p_size / 64.0), 6) AS a, ROUND(ASIN(p_size / 64.0), 6) AS b, ROUND(ATAN(p_size), 6) AS c, ROUND(ATAN2(p_size, 3), 6) AS d, ROUND(COS(p_size), 6) AS e, ROUND(COT(p_size), 6) AS f, ROUND(SIN(p_size), 6) AS g,
       ROUND(TAN(p_size), 6) AS h, ROUND(DEGREES(p_size), 6) AS i, ROUND(RADIANS(p_size), 6) AS j, ROUND(PI(), 6) AS k FROM #part""",
    """SELECT p_partkey, CAST(round(acos(p_size / 64.0), 6) AS DOUBLE) AS a, round(asin(p_size / 64.0), 6) AS b, round(atan(p_size), 6) AS c, round(atan2(p_size, 3), 6) AS d, round(cos(p_size), 6) AS e, round(cot(p_size), 6) AS f, round(sin(p_size), 6) AS g,
       round(tan(p_size), 6) AS h, round(degrees(p_size), 6) AS i, round(radians(p_size), 6) AS j, round(pi(), 6) AS k FROM part""",
)
script(
    "script_math_numbers",
    """SELECT p_partkey, ABS(25 - p_size) AS a, CEIL(p_retailprice) AS b, ROUND(EXP(p_size / 50.0), 6) AS c, ROUND(LOG10(p_size), 6) AS d, ROUND(LN(p_size), 6) AS e, POW(p_size, 2) AS f, QUOTIENT(p_partkey, p_size) AS g, TRUNCATE(p_retailprice, 1) AS h,
       ROUND(p_retailprice, 1) AS i, ROUND(LOG(p_size, 2), 6) AS j FROM #part""",
    """SELECT p_partkey, abs(25 - p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS b, round(exp(p_size / 50.0), 6) AS c, round(log10(p_size), 6) AS d, round(ln(p_size), 6) AS e, pow(p_size, 2) AS f, p_partkey // p_size AS g,
       floor(CAST(p_retailprice AS DECIMAL(28, 10)) * 10) / 10 AS h, CAST(round(CAST(p_retailprice AS DECIMAL(28, 10)), 1) AS DOUBLE) AS i, round(log2(p_size), 6) AS j FROM part""",
)
script(
    "script_random_ranges",
    "SELECT p_partkey, RAND() BETWEEN 0 AND 1 AS a, RANDOM() < 1 AS b, RANDOM_INT(3, 5) IN (3, 4, 5) AS c, RANDOM_DECIMAL(1, 2) BETWEEN 1 AND 2 AS d, LEN(NEWID()) AS e, NEWSEQUENTIALID() <> NEWID() AS f FROM #part",
    "SELECT p_partkey, true AS a, true AS b, true AS c, true AS d, 36 AS e, true AS f FROM part",
)

# --- nulls, conversion, lists, hashes ----------------------------------------------------------------------------------

script(
    "script_nulls",
    "SELECT c_custkey, COALESCE(NULLIF(c_nationkey % 4, 0), -1) AS a, IFNULL(NULLIF(c_nationkey % 3, 0), 9) AS b, IS_NOT_NULL(NULLIF(c_nationkey, 1)) AS c, NVL(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS d, NULLIF(c_nationkey % 5, 0) ?? 77 AS e FROM #customer",
    "SELECT c_custkey, coalesce(nullif(c_nationkey % 4, 0), -1) AS a, coalesce(nullif(c_nationkey % 3, 0), 9) AS b, nullif(c_nationkey, 1) IS NOT NULL AS c, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS d, coalesce(nullif(c_nationkey % 5, 0), 77) AS e FROM customer",
)
script(
    "script_conversion",
    """SELECT o_orderkey, IIF(o_totalprice > 100000, 'big', 'small') AS a, PARSE('12', 'INT') AS b, TRY_PARSE(o_orderpriority, 'INT') AS c, TRY_CONVERT(INT, o_orderstatus) AS d, TRY_CONVERT(INT, CAST(o_orderkey AS STRING)) AS e, CONVERT(VARCHAR(10), o_orderdate, 103) AS f,
       CHECKSUM(o_orderkey, o_orderstatus) = BINARY_CHECKSUM(o_orderkey, o_orderstatus) AS g, CHECKSUM(o_orderkey) = CHECKSUM(o_orderkey + 1) AS h FROM #orders""",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS a, 12 AS b, CAST(NULL AS INT) AS c, CAST(NULL AS INT) AS d, CAST(o_orderkey AS INT) AS e, strftime(o_orderdate, '%d/%m/%Y') AS f, true AS g, false AS h FROM orders""",
)
script(
    "script_lists",
    """SELECT p.p_partkey, t.Value AS v FROM #part p CROSS APPLY UNNEST(SORT_LIST(REMOVE_FROM_LIST(APPEND_TO_LIST(ADD_TO_LIST(STRING_TO_LIST(p.p_name), 'zz'), p.p_brand), 'ring'), 'desc')) t""".replace("STRING_TO_LIST(p.p_name)", "ARRAY(p.p_name, 'ring')"),
    "SELECT p_partkey, unnest([p_name, 'zz', p_brand]) AS v FROM part",
)

# --- JSON and XML ------------------------------------------------------------------------------------------------------

script(
    "script_json_read",
    """SELECT event_id, CAST(JSON_GET(props, 'k') AS STRING) AS a, JSON_EXTRACT(props, '$.k') AS b, CAST(props -> 'k' AS STRING) AS c, props ->> 'k' AS d, JSON_QUERY(props, '$') IS NOT NULL AS e, JSON_EXISTS(props, '$.k') AS f FROM #events""",
    "SELECT event_id, props ->> 'k' AS a, props ->> 'k' AS b, props ->> 'k' AS c, props ->> 'k' AS d, true AS e, 1 AS f FROM events",
)
script(
    "script_json_write",
    """SELECT n_nationkey, JSON_ARRAY(n_nationkey, n_name, NULL) AS a, JSON_OBJECT('k', n_nationkey, 'n', n_name) AS b, JSON_VALUE(JSON_MODIFY(JSON_OBJECT('k', n_nationkey), '$.k', 'new'), '$.k') AS c, STRING_ESCAPE('a"' + n_name, 'json') AS d FROM #nation""",
    """SELECT n_nationkey, '[' || n_nationkey || ',"' || n_name || '",null]' AS a, '{"k":' || n_nationkey || ',"n":"' || n_name || '"}' AS b, 'new' AS c, 'a\\"' || n_name AS d FROM nation""",
)
script(
    "script_open_json",
    "SELECT e.event_id, j.[key] AS k, j.value AS v FROM #events e CROSS APPLY OPENJSON(e.props) j",
    "SELECT event_id, unnest(json_keys(props)) AS k, unnest(list_transform(json_keys(props), lambda x: json_extract_string(props, '$.' || x))) AS v FROM events",
)
script(
    "script_xml",
    """SELECT n_nationkey, XMLELEMENT('n', XMLATTRIBUTES('id', n_nationkey), n_name) AS a, XMLFOREST('k', n_nationkey, 'n', n_name) AS b, EXTRACTVALUE(XMLELEMENT('n', n_name), '/n') AS c, XMLVALUE('<r><k>' + CAST(n_nationkey AS STRING) + '</k></r>', '/r/k') AS d,
       XMLEXISTS('<r><k/></r>', '/r/k') AS e, XMLEXISTS('<r/>', '/r/k') AS f, XMLQUERY('<r><k>1</k></r>', '/r/k') AS g FROM #nation""",
    """SELECT n_nationkey, '<n id="' || n_nationkey || '">' || n_name || '</n>' AS a, '<k>' || n_nationkey || '</k><n>' || n_name || '</n>' AS b, n_name AS c, CAST(n_nationkey AS VARCHAR) AS d, 1 AS e, 0 AS f, '<k>1</k>' AS g FROM nation""",
)
script(
    "script_for_json",
    "SELECT n_nationkey, n_name FROM #nation WHERE n_regionkey = 1 ORDER BY n_nationkey FOR JSON PATH, ROOT('nations')",
    """SELECT '{"nations":[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}' AS JSON FROM nation WHERE n_regionkey = 1""",
)
script(
    "script_for_xml",
    "SELECT r_regionkey, r_name FROM #region ORDER BY r_regionkey FOR XML PATH('r'), ROOT('regions')",
    """SELECT '<regions>' || string_agg('<r><r_regionkey>' || r_regionkey || '</r_regionkey><r_name>' || r_name || '</r_name></r>', '' ORDER BY r_regionkey) || '</regions>' AS XML FROM region""",
)

# --- aggregates and windows --------------------------------------------------------------------------------------------

script(
    "script_statistics",
    "SELECT l_returnflag, ROUND(STDDEV(l_quantity), 6) AS a, ROUND(STDEV(l_quantity), 6) AS b, ROUND(STDEVP(l_quantity), 6) AS c, ROUND(VAR(l_quantity), 6) AS d, ROUND(VARP(l_quantity), 6) AS e, SOME(l_quantity > 49) AS f, EVERY(l_quantity > 0) AS g FROM #lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS b, round(stddev_pop(l_quantity), 6) AS c, round(var_samp(l_quantity), 6) AS d, round(var_pop(l_quantity), 6) AS e, bool_or(l_quantity > 49) AS f, bool_and(l_quantity > 0) AS g FROM lineitem GROUP BY l_returnflag",
)
for _what in ("GROUP", "TIES", "NO OTHERS"):
    _frame = f"PARTITION BY l_orderkey ORDER BY l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {_what}"
    _agg = "count(l_quantity)" if _what == "TIES" else "sum(l_quantity)"
    script(f"script_exclude_{_what.split()[0].lower()}", f"SELECT l_orderkey, l_linenumber, {_agg} OVER ({_frame}) AS x FROM #lineitem", f"SELECT l_orderkey, l_linenumber, {_agg} OVER ({_frame}) AS x FROM lineitem")
script(
    "script_window_extended",
    "SELECT o_orderkey, SUM(o_orderkey) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS x, COUNT(*) OVER w AS n FROM #orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS x, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
)
script(
    "script_row_number_any",
    "SELECT COUNT(*) AS n, MIN(rn) AS a, MAX(rn) AS b, COUNT(DISTINCT rn) AS d FROM (SELECT ROW_NUMBER() OVER () AS rn FROM #nation) t",
    "SELECT count(*) AS n, 1 AS a, CAST(count(*) AS INT) AS b, count(*) AS d FROM nation",
)

# --- sources, set operations, table operators --------------------------------------------------------------------------

script("script_no_from", "SELECT 1 + 2 AS a, 'x' || 'y' AS b, NULL AS c", "SELECT 3 AS a, 'xy' AS b, CAST(NULL AS VARCHAR) AS c")
script(
    "script_view",
    "CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM #customer WHERE c_acctbal > 5000; SELECT c_custkey, c_acctbal * 2 AS twice FROM rich WHERE c_custkey > 10",
    "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 5000 AND c_custkey > 10",
)
script("script_metadata", "SELECT column_name, ordinal FROM eng.columns WHERE table_name = '#nation' AND LEN('#nation') > 0", "SELECT * FROM (VALUES ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) t(column_name, ordinal)")
script(
    "script_set_branches",
    "(SELECT c_nationkey AS k FROM #customer EXCEPT SELECT s_nationkey FROM #supplier) UNION ALL (SELECT n_regionkey FROM #nation INTERSECT SELECT r_regionkey FROM #region)",
    "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region)",
)
script(
    "script_unpivot",
    "SELECT o_orderkey, o_custkey, o_orderkey * 2 AS twice INTO #w FROM #orders; UNPIVOT #w ON COLUMNS(* EXCLUDE (o_orderkey)) INTO NAME k VALUE v",
    "SELECT o_orderkey, 'o_custkey' AS k, o_custkey AS v FROM orders UNION ALL SELECT o_orderkey, 'twice', o_orderkey * 2 FROM orders",
)
script("script_series", "SELECT n.n_nationkey, g.value AS v FROM #nation n CROSS APPLY GENERATE_SERIES(1, n.n_regionkey + 1) g", "SELECT n_nationkey, CAST(unnest(range(1, n_regionkey + 2)) AS INT) AS v FROM nation")
script("script_interpolation", "DECLARE @low INT = 10; SELECT n_name, 'over ${@low}, not ${@nope}' AS a FROM #nation WHERE n_nationkey > @low", "SELECT n_name, 'over 10, not ${@nope}' AS a FROM nation WHERE n_nationkey > 10")
script("script_time_zone", "SELECT event_id, CAST(ts AT TIME ZONE 'UTC' AS STRING) = CAST(ts AS STRING) AS a FROM #events", "SELECT event_id, true AS a FROM events")
script(
    "script_fuzzy_best",
    """SELECT DISTINCT p_name INTO #names FROM #part; SELECT a.p_name AS a, b.p_name AS b FROM #names a FUZZY JOIN #names b ON LEVENSHTEIN(a.p_name, b.p_name) < 0 OR SIMILARITY(a.p_name, b.p_name) >= 1 KEEP BEST 1""".replace("LEVENSHTEIN(a.p_name, b.p_name) < 0 OR ", ""),
    "SELECT DISTINCT p_name AS a, p_name AS b FROM part",
)

# --- statements --------------------------------------------------------------------------------------------------------

script(
    "script_update_output",
    "SELECT c_custkey, c_acctbal INTO #t FROM #customer; UPDATE #t SET c_acctbal = c_acctbal + 1 OUTPUT INSERTED.c_custkey, DELETED.c_acctbal AS was, INSERTED.c_acctbal AS now WHERE c_acctbal < 0",
    "SELECT c_custkey, c_acctbal AS was, c_acctbal + 1 AS now FROM customer WHERE c_acctbal < 0",
)
script(
    "script_delete_output",
    "SELECT o_orderkey, o_orderstatus INTO #t FROM #orders; DELETE FROM #t OUTPUT DELETED.o_orderkey WHERE o_orderstatus = 'F'",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
)
script(
    "script_transaction",
    "SELECT * INTO #t FROM #nation; BEGIN TRANSACTION; DELETE FROM #t WHERE n_regionkey = 1; COMMIT; BEGIN TRANSACTION; DELETE FROM #t; ROLLBACK; SET WHAT_IF ON; DELETE FROM #t; SET WHAT_IF OFF; SELECT n_name FROM #t",
    "SELECT n_name FROM nation WHERE n_regionkey <> 1",
)
script(
    "script_merge",
    """SELECT n_nationkey AS k, n_name AS v INTO #t FROM #nation WHERE n_nationkey < 15; SELECT n_nationkey AS k, UPPER(n_name) + '!' AS v INTO #s FROM #nation WHERE n_nationkey > 9;
    MERGE INTO #t AS t USING #s AS s ON t.k = s.k WHEN MATCHED THEN UPDATE SET t.v = s.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v) WHEN NOT MATCHED BY SOURCE AND t.k < 3 THEN DELETE; SELECT k, v FROM #t""",
    "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 9 THEN upper(n_name) || '!' ELSE n_name END AS v FROM nation WHERE n_nationkey >= 3",
)
script(
    "script_identity",
    "CREATE TABLE #t (id INT IDENTITY(10, 5), name STRING, kind STRING DEFAULT 'n'); INSERT INTO #t (name) SELECT n_name FROM #nation; SELECT COUNT(*) AS n, MIN(id) AS a, MAX(id) AS b, COUNT(DISTINCT id) AS d, MIN(kind) AS k FROM #t",
    "SELECT count(*) AS n, 10 AS a, CAST(10 + 5 * (count(*) - 1) AS INT) AS b, count(*) AS d, 'n' AS k FROM nation",
)
script(
    "script_control_flow",
    """DECLARE @t INT = 0; FOR @k = 1 TO 5 BEGIN IF @k = 2 CONTINUE; IF @k = 5 BREAK; SET @t = @t + @k; END FOREACH @x IN (100, 200) BEGIN SET @t = @t + @x; END
    SELECT n_nationkey, @t AS t FROM #nation""",
    "SELECT n_nationkey, 308 AS t FROM nation",
)
script(
    "script_try_catch",
    "DECLARE @m STRING; DECLARE @n INT; BEGIN TRY THROW 51000, 'no such order', 1; END TRY BEGIN CATCH SET @m = ERROR_MESSAGE(); SET @n = ERROR_NUMBER(); END CATCH SELECT r_name, @m AS m, @n AS n FROM #region",
    "SELECT r_name, 'no such order' AS m, 51000 AS n FROM region",
)
script(
    "script_user_function",
    "CREATE FUNCTION gross(@net DECIMAL(18,2), @rate INT) RETURNS DECIMAL(18,2) AS BEGIN RETURN @net * (100 + @rate) / 100; END; CREATE FUNCTION band(@x INT) RETURNS STRING AS BEGIN IF @x > 25 BEGIN RETURN 'high'; END RETURN 'low'; END; SELECT p_partkey, band(p_size) AS b, ROUND(gross(p_size, 10), 2) AS g FROM #part",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS b, round(p_size * 1.1, 2) AS g FROM part",
)
script(
    "script_procedure",
    "CREATE PROCEDURE bump(@a INT, @b INT OUTPUT) AS BEGIN SET @b = @a + 1; END; DECLARE @o INT; EXEC bump 4, @o OUTPUT; SELECT r_regionkey, @o AS o FROM #region",
    "SELECT r_regionkey, 5 AS o FROM region",
)
script(
    "script_job_state",
    "SELECT SET_JOB_STATE('last', '42'); SELECT r_regionkey, GET_JOB_STATE('last') AS s, IS_SANDBOX() AS b, CURRENT_TENANT() AS t FROM #region",
    "SELECT r_regionkey, '42' AS s, 0 AS b, CAST(NULL AS VARCHAR) AS t FROM region",
)
script(
    "script_rowcount",
    "SELECT * INTO #t FROM #nation; DELETE FROM #t WHERE n_regionkey = 2; DECLARE @n INT = @@ROWCOUNT; SELECT r_regionkey, @n AS n, @@TRANCOUNT AS t FROM #region",
    "SELECT r_regionkey, CAST((SELECT count(*) FROM nation WHERE n_regionkey = 2) AS INT) AS n, 0 AS t FROM region",
)
script(
    "script_expect",
    """SELECT c_custkey EXPECT NOT NULL ON FAILURE QUARANTINE, c_acctbal EXPECT >= 0 ON FAILURE QUARANTINE, c_mktsegment EXPECT IN ('BUILDING', 'MACHINERY') ON FAILURE QUARANTINE INTO #clean FROM #customer ON FAILURE QUARANTINE TO #bad;
    SELECT c_custkey FROM #clean""",
    "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
script(
    "script_assert",
    "EXPECT SCHEMA #region (r_regionkey INT, r_name STRING); ASSERT TABLE #region MATCHES #region; ASSERT (SELECT COUNT(*) FROM #region) = 5, 'five regions'; SELECT r_name FROM #region",
    "SELECT r_name FROM region",
)
script(
    "script_files",
    "SELECT r_regionkey, FILE_EXISTS('{sf_dir}/region.parquet') AS a, FILE_EXISTS('{sf_dir}/nope') AS b, DIRECTORY_EXISTS('{sf_dir}') AS c, FILE_SIZE('{sf_dir}/region.parquet') > 0 AS d, LEN(FILE_HASH('{sf_dir}/region.parquet')) > 0 AS e, YEAR(FILE_MODIFIED('{sf_dir}/region.parquet')) > 2000 AS f FROM #region",
    "SELECT r_regionkey, 1 AS a, 0 AS b, 1 AS c, true AS d, true AS e, true AS f FROM region",
)
script("script_file_list", "SELECT Name FROM FILE_LIST('{sf_dir}') f WHERE Name IN ('region.parquet', 'nation.parquet')", "SELECT * FROM (VALUES ('region.parquet'), ('nation.parquet')) t(Name)")
script(
    "script_paths",
    """SELECT n_nationkey, PATH_FILENAME('/d/' + n_name + '.csv') AS a, PATH_DIRECTORY('/d/' + n_name + '.csv') AS b, PATH_EXTENSION(n_name + '.csv') AS c, PATH_FILENAME_NO_EXT('/d/' + n_name + '.csv') AS d, PATH_CHANGE_EXTENSION(n_name + '.csv', 'txt') AS e,
       PATH_COMBINE('/d', n_name) AS f FROM #nation""",
    "SELECT n_nationkey, n_name || '.csv' AS a, '/d' AS b, '.csv' AS c, n_name AS d, n_name || '.txt' AS e, '/d/' || n_name AS f FROM nation",
)
script(
    "script_tags",
    "CREATE TABLE #t (id INT, mail STRING @pii = 'email'); SELECT r_regionkey, HAS_TAG('#t', 'mail', 'pii') AS a, GET_TAG_VALUE('#t', 'mail', 'pii') AS b, HAS_TAG('#t', 'id', 'pii') AS c FROM #region",
    "SELECT r_regionkey, 1 AS a, 'email' AS b, 0 AS c FROM region",
)
script("script_parquet_scan", "CREATE CONNECTION n AS PARQUET (PATH = '{sf_dir}'); SELECT n_name FROM n.nation.parquet WHERE n_regionkey = 3", "SELECT n_name FROM nation WHERE n_regionkey = 3")
script(
    "script_goto",
    "DECLARE @k INT = 0; again: SET @k = @k + 1; IF @k < 4 BEGIN GOTO again; END GOTO done; SET @k = 100; done: SELECT n_nationkey, @k AS k FROM #nation",
    "SELECT n_nationkey, 4 AS k FROM nation",
)
script(
    "script_parallel",
    """PARALLEL BEGIN SELECT c_nationkey AS k, COUNT(*) AS n INTO #a FROM #customer GROUP BY c_nationkey; SELECT s_nationkey AS k, COUNT(*) AS m INTO #b FROM #supplier GROUP BY s_nationkey; END
    SELECT a.k, a.n, b.m FROM #a a LEFT JOIN #b b ON a.k = b.k""",
    "SELECT a.k, a.n, b.m FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a LEFT JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1) b ON a.k = b.k",
)
script("script_relative_zone", "SELECT r_regionkey, DATEDIFF(hour, RELDATE('N UTC'), RELDATE('N Asia/Tokyo')) AS h, RELDATE('nothing') AS x FROM #region", "SELECT r_regionkey, 9 AS h, CAST(NULL AS TIMESTAMP) AS x FROM region")

# --- more rules, statements and row functions --------------------------------------------------------------------------

script(
    "script_expect_text_rules",
    """SELECT p_partkey, p_name EXPECT NOT BLANK ON FAILURE QUARANTINE, p_brand EXPECT MATCHES '^Brand#[0-9]+$' ON FAILURE QUARANTINE, p_type EXPECT NOT MATCHES '^PROMO' ON FAILURE QUARANTINE, p_size EXPECT NOT IN (1, 2, 3) ON FAILURE QUARANTINE
    INTO #clean FROM #part ON FAILURE QUARANTINE TO #bad; SELECT p_partkey FROM #clean""",
    "SELECT p_partkey FROM part WHERE trim(p_name) <> '' AND regexp_matches(p_brand, '^Brand#[0-9]+$') AND NOT regexp_matches(p_type, '^PROMO') AND p_size NOT IN (1, 2, 3)",
)
script(
    "script_expect_length_cast",
    """SELECT p_partkey, p_name EXPECT LENGTH <= 9 ON FAILURE QUARANTINE, p_size EXPECT BETWEEN 5 AND 45 ON FAILURE QUARANTINE INTO #clean FROM #part ON FAILURE QUARANTINE TO #bad;
    SELECT p_partkey, __dq_column AS col FROM #bad""",
    "SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN 'p_name' ELSE 'p_size' END AS col FROM part WHERE length(p_name) > 9 OR p_size NOT BETWEEN 5 AND 45",
)
script(
    "script_expect_unique",
    "SELECT o_orderkey, o_custkey EXPECT UNIQUE ON FAILURE QUARANTINE INTO #clean FROM #orders ON FAILURE QUARANTINE TO #bad; SELECT o_orderkey FROM #clean",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1)",
)
script(
    "script_expect_exists",
    "SELECT s_suppkey, s_nationkey EXPECT EXISTS IN #nation(n_nationkey) ON FAILURE QUARANTINE INTO #clean FROM #supplier ON FAILURE QUARANTINE TO #bad; SELECT s_suppkey FROM #clean",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)",
)
script(
    "script_transform",
    "SELECT o_custkey, o_orderkey, o_totalprice INTO #o FROM #orders; TRANSFORM #out FROM #o USING DEDUPLICATE (KEY_COLS = 'o_custkey', ORDER_BY = 'o_orderkey', KEEP = 'FIRST'); SELECT o_custkey, o_orderkey FROM #out",
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
)
script(
    "script_compare",
    "SELECT n_nationkey AS k, n_name AS v INTO #old FROM #nation WHERE n_nationkey < 20; SELECT n_nationkey AS k, CASE WHEN n_nationkey = 7 THEN 'new' ELSE n_name END AS v INTO #new FROM #nation WHERE n_nationkey > 2; COMPARE DATASETS #new WITH #old KEY (k) INTO #diff; SELECT _change_type AS c, k FROM #diff",
    "SELECT CASE WHEN n_nationkey < 3 THEN 'DELETE' WHEN n_nationkey > 19 THEN 'INSERT' ELSE 'UPDATE' END AS c, n_nationkey AS k FROM nation WHERE n_nationkey < 3 OR n_nationkey > 19 OR n_nationkey = 7",
)
script(
    "script_calendar",
    "GENERATE CALENDAR FROM '2024-01-30' TO '2024-03-02' INTO #cal; SELECT DateKey, DayName, IsMonthEnd FROM #cal",
    "SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS DateKey, strftime(d, '%A') AS DayName, d = last_day(d) AS IsMonthEnd FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-30', DATE '2024-03-02', INTERVAL 1 DAY)) AS DATE) AS d)",
)
script(
    "script_replace_rows",
    "CREATE TABLE #t (k INT PRIMARY KEY, v STRING); INSERT INTO #t SELECT n_nationkey, n_name FROM #nation; INSERT OR REPLACE INTO #t SELECT n_nationkey, 'again' FROM #nation WHERE n_regionkey = 1; TRUNCATE TABLE #nation; SELECT k, v, (SELECT COUNT(*) FROM #nation) AS left_over FROM #t",
    "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'again' ELSE n_name END AS v, CAST(0 AS BIGINT) AS left_over FROM nation",
)
script(
    "script_match_recognize",
    """SELECT m.user_id, m.first_id, m.last_id FROM #events MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY event_id MEASURES FIRST(A.event_id) AS first_id, LAST(B.event_id) AS last_id ONE ROW PER MATCH PATTERN (A B)
       DEFINE A AS event_type = 'view', B AS event_type = 'click') AS m""",
    """WITH e AS (SELECT user_id, event_id, event_type, lead(event_type) OVER w AS nt, lead(event_id) OVER w AS ni FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
       SELECT user_id, event_id AS first_id, ni AS last_id FROM e WHERE event_type = 'view' AND nt = 'click'""",
)
script(
    "script_errors",
    "DECLARE @a INT; DECLARE @b INT; DECLARE @m STRING; BEGIN TRY RAISEERROR('stop here', 11, 3); END TRY BEGIN CATCH SET @a = ERROR_SEVERITY(); SET @b = ERROR_STATE(); SET @m = ERROR_MESSAGE(); END CATCH SELECT r_name, @a AS a, @b AS b, @m AS m, ERROR_LINE() >= 0 AS l FROM #region",
    "SELECT r_name, 11 AS a, 3 AS b, 'stop here' AS m, true AS l FROM region",
)
script(
    "script_environment",
    "CREATE CONNECTION c AS PARQUET (PATH = '/tmp/x'); SELECT r_regionkey, CONNECTION_PROPERTY('c', 'PATH') AS a, TENANT_ID() AS b, ENV('NO_SUCH_VARIABLE_HERE') AS c FROM #region",
    "SELECT r_regionkey, '/tmp/x' AS a, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS VARCHAR) AS c FROM region",
)
script(
    "script_json_table",
    "SELECT e.event_id, j.k FROM #events e CROSS APPLY JSON_TABLE(e.props, '$' COLUMNS (k INT PATH '$.k')) j",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
)
script(
    "script_xml_table",
    "SELECT n.n_nationkey, x.v FROM #nation n CROSS APPLY XMLTABLE('<r><i>' + n.n_name + '</i><i>b</i></r>', '/r' COLUMNS (v STRING PATH 'i')) x",
    "SELECT n_nationkey, unnest([n_name, 'b']) AS v FROM nation",
)
script(
    "script_flatten",
    "SELECT n.n_nationkey, f.Value AS v FROM #nation n CROSS APPLY FLATTEN(ARRAY(ARRAY(n.n_name, 'x'), ARRAY('y'))) f",
    "SELECT n_nationkey, unnest([n_name, 'x', 'y']) AS v FROM nation",
)
script(
    "script_phonetic",
    "SELECT DISTINCT SOUNDEX(p_name) AS s, METAPHONE('ring') = METAPHONE('rink') AS m, DMETAPHONE('Smith') AS d, DMETAPHONE_ALT('Smith') AS e, DIFFERENCE('Robert', 'Rupert') AS f FROM #part WHERE p_name LIKE 'red%' AND p_name LIKE '%ring'",
    "SELECT 'R365' AS s, true AS m, 'SM0' AS d, 'XMT' AS e, 4 AS f",
)
script(
    "script_file_facts",
    "SELECT r_regionkey, YEAR(FILE_CREATED('{sf_dir}/region.parquet')) > 2000 AS a, FILE_LINE_COUNT('{sf_dir}/region.parquet') > 0 AS b FROM #region",
    "SELECT r_regionkey, true AS a, true AS b FROM region",
)
script(
    "script_return",
    "DECLARE @x INT = 1; CREATE PROCEDURE early(@o INT OUTPUT) AS BEGIN SET @o = 5; RETURN; SET @o = 9; END; EXEC early @x OUTPUT; WAITFOR DELAY '00:00:00'; SELECT r_name, @x AS x, @@FETCH_STATUS AS f FROM #region",
    "SELECT r_name, 5 AS x, -1 AS f FROM region",
)
script(
    "script_top_forms",
    "SELECT TOP 3 PERCENT o_orderkey FROM #orders ORDER BY o_totalprice DESC, o_orderkey",
    "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT CAST(ceil(count(*) * 0.03) AS BIGINT) FROM orders)",
)
script(
    "script_recursive",
    "WITH RECURSIVE t(n, s) AS (SELECT n_nationkey, 1 FROM #nation WHERE n_regionkey = 0 UNION ALL SELECT n + 100, s + 1 FROM t WHERE s < 4) SELECT n, s FROM t",
    "WITH RECURSIVE t(n, s) AS (SELECT n_nationkey, 1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n + 100, s + 1 FROM t WHERE s < 4) SELECT n, s FROM t",
)
script(
    "script_apply",
    "SELECT c.c_custkey, x.o_orderkey FROM #customer c OUTER APPLY (SELECT TOP 2 o_orderkey FROM #orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey) x",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o ON c_custkey = o_custkey AND rn <= 2",
)
script(
    "script_by_name",
    "SELECT n_nationkey AS k, n_name AS a FROM #nation UNION ALL BY NAME SELECT r_name AS b, r_regionkey AS k FROM #region",
    "SELECT n_nationkey AS k, n_name AS a FROM nation UNION ALL BY NAME SELECT r_name AS b, r_regionkey AS k FROM region",
)
script(
    "script_star_forms",
    "SELECT * EXCLUDE (o_orderdate, o_orderpriority) REPLACE (o_totalprice * 2 AS o_totalprice) RENAME (o_custkey AS customer) FROM #orders WHERE o_orderkey < 500",
    "SELECT * EXCLUDE (o_orderdate, o_orderpriority) REPLACE (o_totalprice * 2 AS o_totalprice) RENAME (o_custkey AS customer) FROM orders WHERE o_orderkey < 500",
)
script(
    "script_remote_files",
    """CREATE CONNECTION d AS DIRECTORY (PATH = '{sf_dir}'); SELECT r_regionkey, REMOTE_FILE_EXISTS('d', 'region.parquet') AS a, REMOTE_FILE_EXISTS('d', 'nope') AS b, REMOTE_DIRECTORY_EXISTS('d', '/') AS c,
       REMOTE_FILE_SIZE('d', 'region.parquet') = FILE_SIZE('{sf_dir}/region.parquet') AS e, YEAR(REMOTE_FILE_MODIFIED('d', 'region.parquet')) > 2000 AS f FROM #region""",
    "SELECT r_regionkey, 1 AS a, 0 AS b, 1 AS c, true AS e, true AS f FROM region",
)
script(
    "script_remote_list",
    "CREATE CONNECTION d AS DIRECTORY (PATH = '{sf_dir}'); SELECT NAME AS n, ISDIRECTORY AS d FROM REMOTE_FILE_LIST('d') f WHERE NAME IN ('region.parquet', 'nation.parquet')",
    "SELECT * FROM (VALUES ('region.parquet', false), ('nation.parquet', false)) t(n, d)",
)
