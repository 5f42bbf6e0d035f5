"""Registered queries: transforms, generated tables, functions, quality, data changes, increments, the script language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.library import call
from ..functions.fuzzy import difference, normalize as normalize_text, similarity
from ..operators import dml, pattern, prep, quality, transforms
from ..operators.quality import Rule
from ..streaming import highwater, streams
from .catalog import register, table

# --- transforms --------------------------------------------------------------------------------------------------------

_DAILY = "(SELECT CAST(ts AS DATE) AS d, event_type AS t, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("ts").cast("date").alias("d"), F.col("event_type").alias("t")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))


@register(
    "tf_fill_dates",
    f"""WITH s AS {_DAILY}, g AS (SELECT t, min(d) AS a, max(d) AS b FROM s GROUP BY t), days AS (SELECT t, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM g)
       SELECT days.d, days.t, coalesce(n, 0) AS n, coalesce(v, 0.0) AS v FROM days LEFT JOIN s USING (t, d)""",
)
def tf_fill_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.fill_dates(_daily(spark, sf_dir), "d", ["t"], 0)


_SERIES = "(SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice END AS p FROM orders)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 1, F.col("o_totalprice")).alias("p"))


@register("tf_interpolate_forward", f"SELECT o_custkey, o_orderkey, last_value(p IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM {_SERIES}")
def tf_interpolate_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.interpolate(_series(spark, sf_dir), "p", "o_orderkey", "FORWARD", ["o_custkey"])


@register("tf_interpolate_backward", f"SELECT o_custkey, o_orderkey, first_value(p IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM {_SERIES}")
def tf_interpolate_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.interpolate(_series(spark, sf_dir), "p", "o_orderkey", "BACKWARD", ["o_custkey"])


@register(
    "tf_interpolate_linear",
    f"""WITH w AS (SELECT *, last_value(p IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN p IS NOT NULL THEN o_orderkey END IGNORE NULLS) OVER a AS x0,
         first_value(p IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN p IS NOT NULL THEN o_orderkey END IGNORE NULLS) OVER b AS x1 FROM {_SERIES}
         WINDOW a AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT o_custkey, o_orderkey, round(coalesce(p, v0 + (v1 - v0) * (o_orderkey - x0) / (x1 - x0)), 4) AS p FROM w""",
)
def tf_interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.interpolate(_series(spark, sf_dir), "p", "o_orderkey", "LINEAR", ["o_custkey"]).withColumn("p", F.round("p", 4))


@register("tf_deduplicate", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey DESC) = 1")
def tf_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.deduplicate(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice DESC, o_orderkey", "LAST").select("o_custkey", "o_orderkey")


@register("tf_pivot", "SELECT l_linestatus, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS A, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2) AS N, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS R FROM lineitem GROUP BY l_linestatus")
def tf_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.pivot_table(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag", "l_quantity")
    return out.select("l_linestatus", *[F.round(c, 2).alias(c) for c in ("A", "N", "R")])


@register(
    "tf_top_n_others",
    """WITH s AS (SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority),
       t AS (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY total DESC, o_orderpriority) AS rn FROM s)
       SELECT o_orderstatus, CASE WHEN rn <= 2 THEN o_orderpriority ELSE 'Others' END AS o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice
       FROM orders JOIN t USING (o_orderstatus, o_orderpriority) GROUP BY 1, 2""",
)
def tf_top_n_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.top_n_others(table(spark, sf_dir, "orders"), 2, "o_totalprice", "o_orderpriority", by_group=["o_orderstatus"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@register(
    "tf_period_comparison",
    f"WITH s AS {_DAILY} SELECT s.d, s.t, s.n, s.n - p.n AS n_Diff, round((s.n - p.n) * 100.0 / p.n, 6) AS n_Pct FROM s LEFT JOIN s p ON p.t = s.t AND p.d = s.d - 1",
)
def tf_period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.period_comparison(_daily(spark, sf_dir).select("d", "t", "n"), "d", "n", "DAY", ["t"])
    return out.withColumn("n_Pct", F.round("n_Pct", 6))


@register("tf_share_of_total", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS s FROM orders")
def tf_share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.share_of_total(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"], "s").select("o_orderkey", F.round("s", 8).alias("s"))


@register("tf_normalize_min_max", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 8) AS x FROM customer")
def tf_normalize_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.normalize(table(spark, sf_dir, "customer"), "c_acctbal", norm_col="x").select("c_custkey", F.round("x", 8).alias("x"))


@register("tf_normalize_z_score", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment)) / stddev_pop(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS x FROM customer")
def tf_normalize_z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.normalize(table(spark, sf_dir, "customer"), "c_acctbal", "Z_SCORE", ["c_mktsegment"], "x").select("c_custkey", F.round("x", 6).alias("x"))


@register("tf_rolling", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS r FROM orders")
def tf_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.rolling_aggregate(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 3, "AVG", ["o_custkey"], "r").select("o_orderkey", F.round("r", 4).alias("r"))


@register(
    "calendar",
    """SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS DateKey, d AS Date, strftime(d, '%Y-%m-%d') AS FullDateISO, CAST(year(d) AS INT) AS Year, CAST(quarter(d) AS INT) AS Quarter, year(d) || '-Q' || quarter(d) AS YearQuarter,
       CAST(month(d) AS INT) AS Month, strftime(d, '%B') AS MonthName, strftime(d, '%b') AS MonthShortName, CAST(year(d) * 100 + month(d) AS INT) AS YearMonth, CAST(day(d) AS INT) AS Day, CAST(dayofweek(d) AS INT) AS DayOfWeek,
       strftime(d, '%A') AS DayName, strftime(d, '%a') AS DayShortName, CAST(dayofyear(d) AS INT) AS DayOfYear, CAST(weekofyear(d) AS INT) AS ISOWeek, dayofweek(d) IN (0, 6) AS IsWeekend, dayofweek(d) NOT IN (0, 6) AS IsWeekday,
       day(d) = 1 AS IsMonthStart, d = last_day(d) AS IsMonthEnd, day(d) = 1 AND month(d) IN (1, 4, 7, 10) AS IsQuarterStart, d = last_day(d) AND month(d) IN (3, 6, 9, 12) AS IsQuarterEnd,
       dayofyear(d) = 1 AS IsYearStart, month(d) = 12 AND day(d) = 31 AS IsYearEnd, CAST(year(d) AS INT) AS FiscalYear, 'FQ' || quarter(d) AS FiscalQuarter
       FROM (SELECT CAST(unnest(generate_series(DATE '2023-11-15', DATE '2024-03-05', INTERVAL 1 DAY)) AS DATE) AS d)""",
)
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.calendar(spark, "2023-11-15", "2024-03-05").drop("RelativeDays")


@register("generate_rows", "SELECT 1000 AS n, 10 AS first_id, true AS ranged, 3 AS regions")
def generate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = prep.generate_rows(spark, 1000, {"id": "SEQUENCE(10,5)", "k": "RANDOM_INT(1,6)", "region": "RANDOM(North,South,East)", "amount": "RANDOM_DECIMAL(1.00,9.99)"}, seed=4)
    return g.agg(F.count("*").cast("int").alias("n"), F.min("id").cast("int").alias("first_id"), F.min((F.col("k").between(1, 6)) & F.col("amount").between(1, 9.99)).alias("ranged"), F.countDistinct("region").cast("int").alias("regions"))


@register(
    "compare_datasets",
    """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 13 <> 0)
       SELECT CASE WHEN b.c_custkey IS NULL THEN 'INSERT' WHEN a.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS _change_type,
       CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL THEN 'c_acctbal' END AS _changed_columns, coalesce(a.c_custkey, b.c_custkey) AS c_custkey,
       b.c_acctbal AS c_acctbal_old, a.c_acctbal AS c_acctbal_new, b.c_mktsegment AS c_mktsegment_old, a.c_mktsegment AS c_mktsegment_new
       FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal IS DISTINCT FROM b.c_acctbal""",
)
def compare_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    a = c.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return prep.compare_datasets(a, c.where("c_custkey % 13 <> 0"), ["c_custkey"])


# --- row patterns ------------------------------------------------------------------------------------------------------


@register(
    "match_recognize_pair",
    """WITH e AS (SELECT user_id, event_id, event_type = 'view' AS v, event_type = 'click' AS c, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nid FROM events)
       SELECT user_id, event_id AS view_id, nid AS click_id FROM e WHERE v AND nxt = 'click'""",
)
def match_recognize_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view directly followed by a click: matches cannot overlap, so windows state the same."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return pattern.match_recognize(e, "event_id", "V C", {"V": "event_type = 'view'", "C": "event_type = 'click'"}, {"view_id": "FIRST(event_id)", "click_id": "C.event_id"}, ["user_id"])


@register(
    "match_recognize_all",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events)
       SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event_type, run) AS n FROM e WHERE event_type = 'click'""",
)
def match_recognize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of clicks, all rows: each row with its run's length."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    out = pattern.match_recognize(e, "event_id", "C+", {"C": "event_type = 'click'"}, {"n": "COUNT(*)"}, ["user_id"], all_rows=True)
    return out.select("user_id", "event_id", "n")


# --- functions ---------------------------------------------------------------------------------------------------------


@register(
    "fn_string",
    """SELECT p_partkey, upper(p_name) AS up, strpos(lower(p_name), 'ring') AS at, left(p_name, 3) || '*' || substring(p_name, 6) AS stuffed, length(p_name) AS n, lpad(p_brand, 12, '.') AS padded,
       reverse(p_brand) AS rev, replace(p_type, 'A', '_') AS rep, split_part(p_name, ' ', 2) AS part, '[' || p_brand || ']' AS quoted, repeat('x', p_size % 4) AS xs FROM part""",
)
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", call("UPPER", "p_name").alias("up"), call("CHARINDEX", "'ring'", "p_name").cast("bigint").alias("at"), call("STUFF", "p_name", 4, 2, "'*'").alias("stuffed"), call("LEN", "p_name").cast("bigint").alias("n"),
        call("LPAD", "p_brand", 12, "'.'").alias("padded"), call("REVERSE", "p_brand").alias("rev"), call("REPLACE", "p_type", "'A'", "'_'").alias("rep"), call("SPLIT_PART", "p_name", "' '", 2).alias("part"),
        call("QUOTENAME", "p_brand").alias("quoted"), call("REPLICATE", "'x'", "p_size % 4").alias("xs"),
    )


@register(
    "fn_math",
    """SELECT p_partkey, round(sqrt(p_size), 6) AS r, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey % (p_size % 5) END AS m, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE round(p_retailprice / (p_size % 3), 6) END AS d,
       CAST(sign(p_size - 25) AS INT) AS s, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(ln(p_size), 6) AS l, round(power(p_size, 2), 2) AS pw,
       CASE WHEN p_size <= 10 THEN 'S' WHEN p_size <= 30 THEN 'M' ELSE 'L' END AS bucket, CASE WHEN p_size * 4 - 20 < 0 THEN 'Current' WHEN p_size * 4 - 20 <= 30 THEN '0-30' WHEN p_size * 4 - 20 <= 60 THEN '31-60' WHEN p_size * 4 - 20 <= 90 THEN '61-90' WHEN p_size * 4 - 20 <= 120 THEN '91-120' ELSE '120+' END AS age FROM part""",
)
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.round(call("SQRT", "p_size"), 6).alias("r"), call("MOD", "p_partkey", "p_size % 5").alias("m"), F.round(call("SAFE_DIVIDE", "p_retailprice", "p_size % 3"), 6).alias("d"),
        call("SIGN", "p_size - 25").cast("int").alias("s"), call("CEILING", "p_retailprice").cast("double").alias("c"), call("FLOOR", "p_retailprice").cast("double").alias("f"), F.round(call("LOG", "p_size"), 6).alias("l"),
        F.round(call("POWER", "p_size", 2), 2).alias("pw"), call("VALUE_BUCKET", "p_size", "'10,30'", "'S,M,L'").alias("bucket"), call("AGE_BUCKET", "p_size * 4 - 20").alias("age"),
    )


@register(
    "fn_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, strftime(o_orderdate, '%B') AS mon, strftime(o_orderdate, '%A') AS wd, CAST(last_day(o_orderdate) AS DATE) AS eom,
       CAST(date_diff('month', o_orderdate, TIMESTAMP '1998-08-02') AS INT) AS months, CAST(date_diff('day', o_orderdate, TIMESTAMP '1998-08-02') AS INT) AS days, o_orderdate + INTERVAL 2 MONTH AS later,
       CAST(date_trunc('quarter', o_orderdate) AS DATE) AS soq, CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT) AS sow FROM orders""",
)
def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    end = "timestamp_ntz'1998-08-02 00:00:00'"
    return o.select(
        "o_orderkey", call("YEAR", "o_orderdate").alias("y"), call("DATEPART", "quarter", "o_orderdate").alias("q"), call("DATENAME", "month", "o_orderdate").alias("mon"), call("DATENAME", "weekday", "o_orderdate").alias("wd"),
        call("EOMONTH", "o_orderdate").alias("eom"), call("DATEDIFF", "month", "o_orderdate", end).cast("int").alias("months"), call("DATEDIFF", "day", "o_orderdate", end).alias("days"),
        call("DATEADD", "month", 2, "o_orderdate").alias("later"), call("START_OF_QUARTER", "o_orderdate").alias("soq"), call("START_OF_WEEK", "o_orderdate").alias("sow"),
    )


@register("fn_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') AS t, 1 AS valid, 0 AS missing, json_extract_string(props, '$.zz') AS none FROM events")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", call("JSON_VALUE", "props", "'$.k'").cast("int").alias("k"), call("JSON_GET_TEXT", "props", "'k'").alias("t"), call("ISJSON", "props").alias("valid"), call("JSON_EXISTS", "props", "'$.zz'").alias("missing"), call("JSON_VALUE", "props", "'$.zz'").alias("none"))


@register(
    "fn_regex",
    """SELECT p_partkey, CAST(regexp_matches(p_name, '^[a-m]') AS INT) AS has, len(regexp_extract_all(p_name, '[aeiou]')) AS n, nullif(regexp_extract(p_name, '[a-z]+$'), '') AS tail, regexp_replace(p_brand, '#([0-9]+)', '-\\1') AS rep,
       strpos(p_name, ' ') AS at FROM part""",
)
def fn_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", call("REGEXP_LIKE", "p_name", "'^[a-m]'").alias("has"), call("REGEXP_COUNT", "p_name", "'[aeiou]'").cast("bigint").alias("n"), call("REGEXP_SUBSTR", "p_name", "'[a-z]+$'").alias("tail"),
        call("REGEXP_REPLACE", "p_brand", "'#([0-9]+)'", "'-\\\\1'").alias("rep"), call("REGEXP_INSTR", "p_name", "' '").cast("bigint").alias("at"),
    )


@register("fn_null", "SELECT c_custkey, coalesce(x, -1) AS a, CASE WHEN x IS NULL THEN 'none' ELSE 'some' END AS b, nullif(c_nationkey, 3) AS c, x IS NULL AS d, greatest(x, 5) AS g, least(x, 5) AS l FROM (SELECT *, nullif(c_nationkey % 4, 0) AS x FROM customer)")
def fn_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("x", F.expr("nullif(c_nationkey % 4, 0)"))
    return c.select("c_custkey", call("ISNULL", "x", -1).alias("a"), call("NVL2", "x", "'some'", "'none'").alias("b"), call("NULLIF", "c_nationkey", 3).alias("c"), call("IS_NULL", "x").alias("d"), call("GREATEST", "x", 5).alias("g"), call("LEAST", "x", 5).alias("l"))


@register("fn_conversion", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INT) AS i, TRY_CAST(o_orderpriority AS INT) AS bad, strftime(o_orderdate, '%Y%m%d') AS d112, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE '?' END AS st FROM orders")
def fn_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.library import cast

    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.expr(cast("o_totalprice", "INT")).alias("i"), F.expr(cast("o_orderpriority", "INT", True)).alias("bad"), call("CONVERT", "VARCHAR(8)", "o_orderdate", "112").alias("d112"), call("DECODE", "o_orderstatus", "'F'", "'done'", "'O'", "'open'", "'?'").alias("st"))


@register("fn_bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS o, xor(o_orderkey, 9) AS x, ~o_orderkey AS n, o_orderkey << 3 AS l, o_orderkey >> 2 AS r, CAST(bit_count(o_orderkey) AS INT) AS c FROM orders")
def fn_bitwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "o_orderkey"
    return table(spark, sf_dir, "orders").select(k, call("BITAND", k, 12).alias("a"), call("BITOR", k, 5).alias("o"), call("BITXOR", k, 9).alias("x"), call("BITNOT", k).alias("n"), call("BITSHIFTLEFT", k, 3).alias("l"), call("BITSHIFTRIGHT", k, 2).alias("r"), call("BIT_COUNT", k).alias("c"))


@register("fn_mask", "SELECT c_custkey, left(m, 1) || '***' || substring(m, strpos(m, '@') - 1) AS mail, '***-***-' || right(lpad(CAST(c_custkey AS VARCHAR), 10, '5'), 4) AS phone, '***-**-' || right(lpad(CAST(c_custkey AS VARCHAR), 9, '1'), 4) AS ssn FROM (SELECT *, 'user' || c_custkey || '@example.com' AS m FROM customer)")
def fn_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("m", F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.com")))
    return c.select("c_custkey", call("MASK_EMAIL", "m").alias("mail"), call("MASK_PHONE", "lpad(cast(c_custkey as string), 10, '5')").alias("phone"), call("MASK_SSN", "lpad(cast(c_custkey as string), 9, '1')").alias("ssn"))


@register("fn_hash", "SELECT c_custkey, upper(md5(c_name)) AS m, upper(sha256(c_name)) AS s FROM customer")
def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.hex(call("HASHBYTES", "'MD5'", "c_name")).alias("m"), F.hex(call("HASHBYTES", "'SHA256'", "c_name")).alias("s"))


@register(
    "fn_fuzzy",
    """SELECT a.p_partkey, levenshtein(a.p_name, 'red ring') AS lev, round(jaro_winkler_similarity(lower(a.p_name), 'red ring'), 8) AS jw, round(1 - levenshtein(lower(a.p_name), 'red ring') / greatest(length(a.p_name), 8), 8) AS ls,
       trim(regexp_replace(lower(a.p_type), '\\s+', ' ', 'g')) AS norm FROM part a""",
)
def fn_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = table(spark, sf_dir, "part"), F.lit("red ring")
    return p.select("p_partkey", call("LEVENSHTEIN", "p_name", "'red ring'").cast("bigint").alias("lev"), F.round(similarity(F.col("p_name"), r), 8).alias("jw"), F.round(similarity(F.col("p_name"), r, "LEVENSHTEIN"), 8).alias("ls"), normalize_text(F.col("p_type")).alias("norm"))


@register("fn_soundex", "SELECT 4 AS same, 'R163' AS code")
def fn_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(difference(F.lit("Robert"), F.lit("Rupert")).alias("same"), call("SOUNDEX", "'Robert'").alias("code"))


@register("fn_table_valued", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS Value FROM part")
def fn_table_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.library import TABLE_FUNCTIONS

    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.expr(TABLE_FUNCTIONS["STRING_SPLIT"](["p_name", "' '"]))).alias("Value"))


@register("fn_ngrams", "SELECT p_partkey, substring(p_brand, CAST(i AS INT), 3) AS g FROM part, range(1, 20) r(i) WHERE i <= length(p_brand) - 2")
def fn_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.library import TABLE_FUNCTIONS

    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.expr(TABLE_FUNCTIONS["NGRAMS"](["p_brand", "3"]))).alias("g"))


# --- data quality ------------------------------------------------------------------------------------------------------

_RULES = [
    Rule("o_orderkey", "NOT NULL", (), "QUARANTINE"),
    Rule("o_totalprice", "BETWEEN", (1000, 250000), "QUARANTINE"),
    Rule("o_orderpriority", "MATCHES", ("^[1-4]-",), "QUARANTINE"),
    Rule("o_custkey", "UNIQUE", (), "WARN"),
]
_OK = "o_totalprice BETWEEN 1000 AND 250000 AND regexp_matches(o_orderpriority, '^[1-4]-')"


@register("dq_clean", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_OK}")
def dq_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.route(table(spark, sf_dir, "orders"), _RULES, ["o_orderkey", "o_totalprice"]).clean


@register("dq_quarantine", f"SELECT o_orderkey, CASE WHEN NOT o_totalprice BETWEEN 1000 AND 250000 THEN 'o_totalprice' ELSE 'o_orderpriority' END AS __dq_column, 'quarantined' AS __dq_status FROM orders WHERE NOT ({_OK})")
def dq_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.route(table(spark, sf_dir, "orders"), _RULES).quarantine.select("o_orderkey", "__dq_column", "__dq_status")


@register("dq_warned", f"SELECT o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1 AND {_OK}")
def dq_warned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.route(table(spark, sf_dir, "orders"), _RULES).warned.select("o_orderkey")


@register("dq_exists", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def dq_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return quality.route(table(spark, sf_dir, "supplier"), [Rule("s_nationkey", "EXISTS IN", (nation, "n_nationkey"), "QUARANTINE")], ["s_suppkey"]).clean


@register("dq_job_metrics", "SELECT count(*) AS row_count, round(avg(CAST(x IS NULL AS INT)), 8) AS nulls FROM (SELECT nullif(c_nationkey % 5, 0) AS x FROM customer)")
def dq_job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.expr("nullif(c_nationkey % 5, 0)").alias("x"))
    m = quality.job_metrics(c, null_columns=["x"])
    quality.assert_job(m, ["ROW_COUNT > 0", "NULL_PERCENT(x) < 1"])
    return spark.createDataFrame([(m["ROW_COUNT"], round(m["NULL_PERCENT(x)"], 8))], "row_count long, nulls double")


# --- data changes ------------------------------------------------------------------------------------------------------


@register(
    "merge_upsert",
    """WITH t AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey AS k, c_acctbal * 2 AS v FROM customer WHERE c_custkey % 2 = 0)
       SELECT coalesce(s.k, t.k) AS k, coalesce(s.v, t.v) AS v FROM t FULL JOIN s ON t.k = s.k WHERE s.k IS NOT NULL OR t.v >= 0""",
)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    t = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 2).alias("v"))
    clauses = [dml.When("matched", "update", values={"v": "s.v"}), dml.When("not_matched", "insert", values={"k": "s.k", "v": "s.v"}), dml.When("not_matched_by_source", "delete", "t.v < 0")]
    return dml.merge(t, s, "t.k = s.k", clauses).table


@register("update_from", "SELECT c_custkey, round(CASE WHEN n_regionkey = 1 THEN c_acctbal + n_nationkey ELSE c_acctbal END, 2) AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = dml.update(c, {"c_acctbal": "t.c_acctbal + s.n_nationkey"}, source=nation, on="t.c_nationkey = s.n_nationkey").table
    return out.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@register("delete_where", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 200000 AND o_orderstatus = 'F')")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(table(spark, sf_dir, "orders"), "o_totalprice > 200000 and o_orderstatus = 'F'").table.select("o_orderkey")


@register("insert_defaults", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, 'unknown' FROM nation WHERE n_regionkey = 2")
def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").where("n_regionkey = 2").select((F.col("n_nationkey") + 100).alias("k"))
    return dml.insert(table(spark, sf_dir, "region"), rows, ["r_regionkey"], defaults={"r_name": "'unknown'"}).table


@register("replace_rows", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name FROM nation")
def replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return dml.replace_rows(n, n.where("n_nationkey < 5").select("n_nationkey", F.lit("new").alias("n_name")), ["n_nationkey"]).table


# --- increments and streams --------------------------------------------------------------------------------------------


@register("highwater_delta", "SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id % 3 = 0 AND event_id < 500)")
def highwater_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    store = highwater.StateStore()
    highwater.commit(e.where("event_id % 3 = 0 and event_id < 500"), "event_id", store, "events:event_id")
    return highwater.pending(e, "event_id", store, "events:event_id")


@register("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.tumbling(streams.read(spark, sf_dir, "events"), "ts", "1 day", ["event_type"]))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register(
    "stream_session",
    """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_available(streams.sessions(streams.read(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"]))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.read(spark, sf_dir, "events")
    twice = streams.deduplicate(s.union(streams.read(spark, sf_dir, "events")), "ts", "40 days", ["event_id"])
    return streams.run_available(twice.select("event_id"), mode="append").agg(F.count("*").alias("n"))


# --- the script language -----------------------------------------------------------------------------------------------


def _session(spark: SparkSession, sf_dir: str, *names: str):
    from ..session import Session

    s = Session(spark)
    for n in names:
        s.tables[f"#{n}"] = table(spark, sf_dir, n)
    return s


@register("lang_qualify", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 2")
def lang_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "customer").sql("SELECT c_mktsegment, c_custkey, c_acctbal FROM #customer QUALIFY ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 2")


@register("lang_asof", "SELECT c.event_id, p.event_id AS bought FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.event_id > p.event_id")
def lang_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "events").sql("SELECT c.event_id, p.event_id AS bought FROM (SELECT * FROM #events WHERE event_type = 'CLICK') c ASOF LEFT JOIN (SELECT * FROM #events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.event_id > p.event_id")


@register("lang_script", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey >= 3 GROUP BY n_regionkey HAVING count(*) > 4")
def lang_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "nation").sql(
        """DECLARE @low INT = 1; WHILE @low < 3 BEGIN SET @low = @low + 1; END
        SELECT * INTO #kept FROM #nation WHERE n_nationkey >= @low; DELETE FROM #kept WHERE n_nationkey < 3;
        SELECT n_regionkey, COUNT() AS n FROM #kept GROUP BY ALL HAVING n > 4"""
    )


@register("lang_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def lang_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "orders").sql("PIVOT #orders ON o_orderstatus USING COUNT(o_orderkey) GROUP BY o_orderpriority").na.fill(0)


@register("lang_expressions", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderstatus || '-' || o_orderpriority AS s, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders WHERE o_orderpriority LIKE '%HIGH%' OR lower(o_orderstatus) = 'f'")
def lang_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "orders").sql("SELECT o_orderkey, o_orderkey / 7 AS d, o_orderstatus + '-' + o_orderpriority AS s, o_totalprice > 100_000 => 'big' : 'small' AS size FROM #orders WHERE o_orderpriority LIKE '%high%' OR o_orderstatus = 'f'")
