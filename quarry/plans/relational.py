"""Registered queries: TPC-H-like queries, joins, aggregation, windows, set operations, top-n forms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, recursion, reshape, windows
from ..session import Session
from .catalog import register, table

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_query(name: str, text: str, duck_sql: str | None = None) -> None:
    """Register a query of the script language over the tables it names; duck_sql defaults to the same text."""
    used = [t for t in _TABLES if re.search(rf"\b{t}\b", text)]
    own = re.sub(rf"\b({'|'.join(used)})\b(?!\s*\.)", r"#\1", text) if used else text

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        for t in used:
            session.tables[f"#{t}"] = table(spark, sf_dir, t)
        return session.sql(own)

    register(name, duck_sql or text)(run)


# --- benchmark queries on the columns there are ------------------------------------------------------------------------

sql_query(
    "q3_shipping_priority",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1995-03-15' AND l_shipdate > '1995-03-15'
       GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
sql_query(
    "q5_local_supplier",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name = 'ASIA' GROUP BY n_name""",
)
sql_query(
    "q6_forecast_revenue",
    "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate >= '1994-01-01' AND l_shipdate < '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
)
sql_query(
    "q12_priority_count",
    """SELECT l_returnflag, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count,
       count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '1997-01-01' GROUP BY l_returnflag""",
)
sql_query(
    "q14_promo_share",
    """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= '1995-01-01'""",
)

# --- joins -------------------------------------------------------------------------------------------------------------

for kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    sql_query(
        f"join_{kind.lower()}",
        f"""SELECT c_custkey, s_suppkey, c_name, s_name FROM (SELECT * FROM customer WHERE c_nationkey < 12) c {kind} JOIN (SELECT * FROM supplier WHERE s_nationkey > 6) s
            ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal""",
    )
sql_query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
sql_query("join_theta", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey")
sql_query("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
sql_query("join_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql_query("join_hint_hash", "SELECT o_orderstatus, count(*) AS n FROM customer INNER HASH JOIN orders ON c_custkey = o_custkey GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY o_orderstatus")
sql_query("filter_not_in", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
sql_query("filter_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n.n_regionkey = 0)")
sql_query("filter_distinct_from", "SELECT event_id, user_id FROM events WHERE event_type IS DISTINCT FROM 'click' AND value IS NOT DISTINCT FROM value")
sql_query("filter_like_any", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE ANY ('%BRASS', 'PROMO%')", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%BRASS' OR p_type LIKE 'PROMO%'")
sql_query("filter_ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' AND p_name NOT LIKE '%z%'")
sql_query("filter_regex", "SELECT p_partkey FROM part WHERE p_name ~ '^[a-m]' OR p_brand ~* 'BRAND#1'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m]') OR regexp_matches(p_brand, 'BRAND#1', 'i')")
sql_query("filter_bits", "SELECT o_orderkey, o_orderkey << 2 AS shl, shiftright(o_orderkey, 1) AS shr, ~o_orderkey AS inv, o_orderkey & 6 AS band FROM orders WHERE (o_orderkey & 3) = 1", "SELECT o_orderkey, o_orderkey << 2 AS shl, o_orderkey >> 1 AS shr, ~o_orderkey AS inv, o_orderkey & 6 AS band FROM orders WHERE (o_orderkey & 3) = 1")
sql_query("scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top_price FROM customer c")
sql_query(
    "project_case",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
)
sql_query("project_lateral_alias", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, twice + 1 AS more FROM lineitem WHERE l_linenumber = 1")
sql_query("project_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")


def _asof(name: str, op: str, how: str) -> None:
    duck_op, kind = op, "ASOF LEFT JOIN" if how == "left" else "ASOF JOIN"
    # one right row per user and time, so that ties cannot differ
    right = "(SELECT user_id AS ruid, ts AS rts, min(event_id) AS rid FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)"

    @register(f"asof_{name}", f"SELECT l.event_id, l.user_id, l.ts, r.rid, r.rts FROM (SELECT * FROM events WHERE event_type = 'click') l {kind} {right} r ON l.user_id = r.ruid AND l.ts {duck_op} r.rts")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events")
        r = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("ruid"), F.col("ts").alias("rts")).agg(F.min("event_id").alias("rid"))
        left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
        return joins.asof_join(left, r, "ts", "rts", [("user_id", "ruid")], op, how).select("event_id", "user_id", "ts", "rid", "rts")


for _name, _op, _how in (("backward", ">=", "inner"), ("backward_strict", ">", "inner"), ("forward", "<=", "inner"), ("forward_strict", "<", "inner"), ("left", ">=", "left"), ("forward_left", "<=", "left")):
    _asof(_name, _op, _how)


# distinct names are compared, so that the SQL is not a comparison of all pairs of rows
@register(
    "fuzzy_join",
    """WITH names AS (SELECT DISTINCT p_name AS t FROM part WHERE length(p_name) > 0),
       grams AS (SELECT t, lower(substring(' ' || t || ' ', CAST(i AS BIGINT), 3)) AS g FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM names)),
       scored AS (SELECT a.t AS ta, b.t AS tb, jaro_winkler_similarity(lower(a.t), lower(b.t)) AS s FROM names a, names b
         WHERE jaro_winkler_similarity(lower(a.t), lower(b.t)) > 0.8 AND EXISTS (SELECT 1 FROM grams x JOIN grams y USING (g) WHERE x.t = a.t AND y.t = b.t))
       SELECT p1.p_partkey AS lid, p2.p_partkey AS rid, round(s, 6) AS score FROM part p1 JOIN scored ON p1.p_name = ta JOIN part p2 ON p2.p_name = tb""",
)
def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    out = joins.fuzzy_join(p, p, "p_name", "p_name", 0.8, digits=6)
    return out.select(F.col("p_partkey").alias("lid"), F.col("p_partkey_right").alias("rid"), F.col("__score").alias("score"))


@register(
    "lateral_top_n",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o
       ON c_custkey = o_custkey AND rn <= 3""",
)
def lateral_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.lateral_top_n(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], "o_totalprice DESC, o_orderkey", 3)
    return out.select("c_custkey", "o_orderkey", "o_totalprice")


@register(
    "outer_apply",
    """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) o
       ON c_custkey = o_custkey AND rn <= 1""",
)
def outer_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.lateral_top_n(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], "o_orderdate DESC, o_orderkey", 1, how="left")
    return out.select("c_custkey", "o_orderkey")


sql_query("lateral_join", "SELECT n_name, t.total FROM nation, LATERAL (SELECT count(*) AS total FROM customer WHERE c_nationkey = n_nationkey) t")


@register("semi_join_pushdown", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_join_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    return joins.semi_join_filter(table(spark, sf_dir, "supplier"), local, "s_nationkey", "n_nationkey").select("s_suppkey", "s_name")


# --- aggregation -------------------------------------------------------------------------------------------------------

sql_query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
sql_query("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus")
sql_query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")
sql_query("group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
sql_query("group_by_ordinal", "SELECT upper(o_orderstatus) AS st, count(*) AS n FROM orders GROUP BY 1")
sql_query("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql_query("agg_string_agg", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_median", "SELECT o_orderstatus, round(median(o_totalprice), 4) AS med FROM orders GROUP BY o_orderstatus")
sql_query("agg_percentile_cont", "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS p FROM orders GROUP BY o_orderstatus")
sql_query("agg_percentile_disc", "SELECT o_orderstatus, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_disc(o_totalprice, 0.5), 4) AS p FROM orders GROUP BY o_orderstatus")
sql_query("agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs FROM lineitem GROUP BY l_returnflag")
sql_query("agg_bool", "SELECT o_orderpriority, every(o_totalprice > 1000) AS all_big, any(o_totalprice > 300000) AS some_big FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 300000) AS some_big FROM orders GROUP BY o_orderpriority")
sql_query("agg_window_over_aggregate", "SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS place FROM orders GROUP BY o_custkey", "SELECT o_custkey, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS INT) AS place FROM orders GROUP BY o_custkey")


@register("agg_approx_distinct", "SELECT o_orderstatus, true AS near FROM orders GROUP BY o_orderstatus")
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APPROX_COUNT_DISTINCT lies within 15 percent of the exact count."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey").alias("a"), F.countDistinct("o_custkey").alias("b"))
    return o.select("o_orderstatus", (F.abs(F.col("a") - F.col("b")) <= F.col("b") * 0.15).alias("near"))


# --- windows -----------------------------------------------------------------------------------------------------------

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
for _f in ("row_number()", "rank()", "dense_rank()", "ntile(4)"):
    _n = _f.split("(")[0]
    sql_query(f"win_{_n}", f"SELECT o_orderkey, {_f} OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS x FROM orders", f"SELECT o_orderkey, CAST({_f} OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS INT) AS x FROM orders")
for _f in ("percent_rank()", "cume_dist()"):
    _n = _f.split("(")[0]
    sql_query(f"win_{_n}", f"SELECT o_orderkey, round({_f} OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority), 8) AS x FROM orders")
sql_query("win_rank_ties", "SELECT o_orderkey, rank() OVER (ORDER BY o_orderpriority) AS r, dense_rank() OVER (ORDER BY o_orderpriority) AS d FROM orders", "SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_orderpriority) AS INT) AS r, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INT) AS d FROM orders")
sql_query("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER ({_W}) AS before, lead(o_orderkey, 2) OVER ({_W}) AS later FROM orders")
sql_query("win_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_W}) AS f, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_W}) AS n FROM orders")
sql_query("win_rows", f"SELECT o_orderkey, round(avg(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m, count(*) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM orders")
sql_query("win_range", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM lineitem")
sql_query("win_default_frame", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_returnflag), 2) AS s FROM lineitem")
sql_query("win_named", f"SELECT o_orderkey, sum(o_totalprice) OVER w > 100000 AS over, row_number() OVER w AS n FROM orders WINDOW w AS ({_W})", f"SELECT o_orderkey, sum(o_totalprice) OVER w > 100000 AS over, CAST(row_number() OVER w AS INT) AS n FROM orders WINDOW w AS ({_W})")


@register("win_groups", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_returnflag NULLS FIRST GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM lineitem")
def win_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return windows.groups_frame(li, ["l_suppkey"], "l_returnflag", "s", lambda w: F.round(F.sum("l_quantity").over(w), 2), -1, 0).select("l_orderkey", "l_linenumber", "s")


def _excluding(name: str, what: str, agg: str) -> None:
    frame = "ORDER BY l_linenumber, l_quantity ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING" if what == "CURRENT ROW" else "ORDER BY l_returnflag, l_quantity ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"
    order = "l_linenumber, l_quantity" if what == "CURRENT ROW" else "l_returnflag, l_quantity"
    n = 2 if what == "CURRENT ROW" else 3

    @register(name, f"SELECT l_orderkey, l_linenumber, round({agg}(l_quantity) OVER (PARTITION BY l_orderkey {frame} EXCLUDE {what}), 4) AS x FROM lineitem")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = windows.exclude(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, "x", agg, "l_quantity", (-n, n), what)
        return out.select("l_orderkey", "l_linenumber", F.round("x", 4).alias("x"))


_excluding("win_exclude_current", "CURRENT ROW", "sum")
_excluding("win_exclude_current_max", "CURRENT ROW", "max")


@register("win_filter", f"SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER ({_W}) AS n FROM orders")
def win_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count(windows.filtered(F.lit(1), F.col("o_orderstatus") == "F")).over(w).alias("n"))


@register("qualify_latest", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def qualify_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return windows.qualify(table(spark, sf_dir, "orders"), F.row_number().over(w), lambda q: q == 1).select("o_custkey", "o_orderkey", "o_orderdate")


# --- order, limits, set operations, recursion --------------------------------------------------------------------------


@register("top_percent", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT CAST(ceil(count(*) * 0.05) AS BIGINT) FROM orders)")
def top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_percent(table(spark, sf_dir, "orders"), "o_totalprice DESC, o_orderkey", 5).select("o_orderkey", "o_totalprice")


@register("top_with_ties", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY rank() OVER (ORDER BY l_quantity DESC, l_returnflag) <= 10")
def top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_with_ties(table(spark, sf_dir, "lineitem"), "l_quantity DESC, l_returnflag", 10).select("l_orderkey", "l_linenumber", "l_quantity")


@register("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_n(table(spark, sf_dir, "orders"), "o_totalprice, o_orderkey", 10, 5).select("o_orderkey")


sql_query("order_nulls", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 ORDER BY o_orderkey NULLS LAST, c_custkey LIMIT 50")
sql_query("order_by_all", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY ALL LIMIT 20", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 20")


@register("sample_rows", "SELECT CAST(100 AS BIGINT) AS n")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sample_rows(table(spark, sf_dir, "orders"), 100, seed=7).agg(F.count("*").alias("n"))


@register("sample_percent", "SELECT true AS near")
def sample_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return windows.sample_percent(o, 20, seed=7).agg(F.count("*").alias("n")).crossJoin(o.agg(F.count("*").alias("m"))).select(F.abs(F.col("n") / F.col("m") - 0.2).between(0, 0.05).alias("near"))


sql_query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("set_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
sql_query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")


@register("set_union_by_name", "SELECT n_nationkey, n_name FROM nation UNION BY NAME SELECT r_name, r_regionkey AS n_nationkey FROM region")
def set_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.union_by_name(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").alias("n_nationkey")))


sql_query("recursive_series", "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")


@register(
    "recursive_union_graph",
    """WITH RECURSIVE edges AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), t(n) AS (SELECT 3 AS n UNION SELECT b FROM t JOIN edges ON a = n) SELECT n FROM t""",
)
def recursive_union_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    start = spark.range(1).select(F.lit(3).alias("n"))
    return recursion.recursive(start, lambda t: t.join(edges, t["n"] == edges["a"]).select(F.col("b").alias("n")), distinct=True)


sql_query("with_nested", "WITH a AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey), b AS (SELECT max(n) AS m FROM a) SELECT r_name, n FROM a JOIN region ON n_regionkey = r_regionkey JOIN b ON n <= m")
sql_query("values_constructor", "SELECT column1 + 1 AS x, column2 AS y FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(column1, column2)")

# --- reshaping ---------------------------------------------------------------------------------------------------------


@register("pivot_static", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def pivot_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.pivot(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), "l_linestatus", {"n": F.count(F.lit(1))}, ["l_returnflag"], ["F", "O"])
    return out.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("F"), F.coalesce("O", F.lit(0)).alias("O"))


@register("pivot_dynamic", "SELECT o_orderpriority, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O, max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def pivot_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pivot(table(spark, sf_dir, "orders"), "o_orderstatus", {"top": F.max("o_orderkey")}, ["o_orderpriority"])


@register("unpivot", "UNPIVOT (SELECT o_orderkey, o_custkey, o_orderkey * 2 AS twice FROM orders) ON o_custkey, twice INTO NAME k VALUE v")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 2).alias("twice"))
    return reshape.unpivot(o, ["o_custkey", "twice"], "k", "v")


@register("unnest", "SELECT vec_id, unnest(embedding) AS Value FROM embeddings")
def unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unnest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "Value")


@register("star_modifiers", "SELECT * EXCLUDE (c_mktsegment) REPLACE (upper(c_name) AS c_name) RENAME (c_nationkey AS nation) FROM customer")
def star_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.star(table(spark, sf_dir, "customer"), ["c_mktsegment"], {"c_name": "upper(c_name)"}, {"c_nationkey": "nation"})


@register("columns_regex", "SELECT COLUMNS('l_.*key') FROM lineitem")
def columns_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(*reshape.select_columns(li, "l_.*key"))
