"""Every query of the engine's own operators, each with the SQL that a second engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import compat, workloads
from ..operators import access, joins, ranking
from ..sources import table
from ..streaming import sessions, tumbling

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

col, lit = F.col, F.lit


def query(sql: str | None):
    """Registers fn(t), where t(name) is a table, under its own name."""

    def put(fn):
        name = fn.__name__
        PLANS[name] = lambda spark, sf_dir: fn(lambda n: table(spark, sf_dir, n))
        if sql:
            ORACLE[name] = sql
        return fn

    return put


# scans, projection, filters
@query("SELECT * FROM region")
def scan_all(t):
    return t("region")


@query("SELECT n_name, n_regionkey FROM nation")
def project_cols(t):
    return t("nation").select("n_name", "n_regionkey")


@query("SELECT p_partkey, p_retailprice * 2 AS twice, p_size + 1 AS size1, p_size - 3 AS less, p_retailprice / 4 AS quarter, p_size % 7 AS rest FROM part")
def expr_arith(t):
    return t("part").select("p_partkey", (col("p_retailprice") * 2).alias("twice"), (col("p_size") + 1).alias("size1"), (col("p_size") - 3).alias("less"), (col("p_retailprice") / 4).alias("quarter"), (col("p_size") % 7).alias("rest"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 15")
def filter_eq(t):
    return t("part").filter("p_size = 15").select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000")
def filter_range(t):
    return t("orders").filter((col("o_totalprice") > 100000) & (col("o_totalprice") <= 200000)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND p_retailprice < 1500")
def filter_and(t):
    return t("part").filter("p_size > 20 AND p_retailprice < 1500").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR p_size > 45")
def filter_or(t):
    return t("part").filter("p_size < 5 OR p_size > 45").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def filter_not(t):
    return t("orders").filter(~(col("o_orderstatus") == "F")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey NOT IN (1, 2, 3)")
def filter_neq_not_in(t):
    return t("orders").filter((col("o_orderstatus") != "O") & ~col("o_orderkey").isin(1, 2, 3)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
def filter_in(t):
    return t("part").filter(col("p_size").isin(1, 5, 9)).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%'")
def filter_like(t):
    return t("part").filter(col("p_name").like("blue%")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%widget' AND p_name ILIKE '%L%' AND regexp_matches(p_name, '^[a-m]')")
def filter_like_more(t):
    return t("part").filter(~col("p_name").like("%widget") & col("p_name").ilike("%L%") & col("p_name").rlike("^[a-m]")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
def filter_between(t):
    return t("orders").filter(col("o_totalprice").between(50000, 60000)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = -1")
def filter_none(t):
    return t("orders").filter("o_orderkey = -1").select("o_orderkey")


_SMALL = "SELECT o_orderkey, l_partkey FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON o_orderkey = l_orderkey"


def _small(t):
    o, l = t("orders"), t("lineitem").filter("l_quantity > 45")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").select("o_orderkey", "l_partkey")


@query(f"SELECT o_orderkey FROM ({_SMALL}) WHERE l_partkey IS NULL")
def filter_is_null(t):
    return _small(t).filter(col("l_partkey").isNull()).select("o_orderkey")


@query(f"SELECT o_orderkey, l_partkey FROM ({_SMALL}) WHERE l_partkey IS NOT NULL")
def filter_is_not_null(t):
    return _small(t).filter(col("l_partkey").isNotNull())


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00'")
def filter_timestamp(t):
    return t("orders").filter("o_orderdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00'").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE TRY_CAST(o_orderpriority AS INTEGER) IS NULL AND TRY_CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) = o_orderkey")
def filter_type_mismatch(t):
    return t("orders").filter(compat.safe_cast(col("o_orderpriority"), "int").isNull() & (compat.safe_cast(col("o_orderkey").cast("string"), "bigint") == col("o_orderkey"))).select("o_orderkey")


# order, limit
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey")
def order_asc(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(col("o_totalprice").asc_nulls_last(), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey")
def order_desc(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(col("o_totalprice").desc_nulls_last(), "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey DESC")
def order_multi(t):
    return t("orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", col("o_orderkey").desc())


@query(f"SELECT o_orderkey, l_partkey FROM ({_SMALL}) ORDER BY l_partkey ASC NULLS FIRST, o_orderkey")
def order_nulls(t):
    return _small(t).orderBy(col("l_partkey").asc_nulls_first(), "o_orderkey")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7")
def limit_k(t):
    return t("nation").select("n_nationkey").orderBy("n_nationkey").limit(7)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def limit_offset(t):
    return t("orders").select("o_orderkey").orderBy("o_orderkey").offset(40).limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(col("o_totalprice").desc(), "o_orderkey").limit(10)


# aggregates
@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_vals(t):
    return t("part").select("p_brand", "p_type").distinct()


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def count_distinct(t):
    return t("events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_extendedprice), 2) AS amount, round(avg(l_quantity), 6) AS qty FROM lineitem")
def agg_global(t):
    return t("lineitem").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.round(F.avg("l_quantity"), 6).alias("qty"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(col("l_extendedprice") * (1 - col("l_discount"))), 4).alias("revenue"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def agg_where(t):
    return t("orders").filter("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT min(p_size) AS lo, max(p_size) AS hi, min(p_name) AS first_name, max(p_name) AS last_name FROM part")
def agg_min_max(t):
    return t("part").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 6) AS mean, round(avg(CAST(o_totalprice AS REAL)::DOUBLE), 3) AS mean_real FROM orders GROUP BY o_orderstatus")
def agg_avg(t):
    return t("orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 6).alias("mean"), F.round(F.avg(col("o_totalprice").cast("float").cast("double")), 3).alias("mean_real"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS still_open FROM orders")
def agg_filter(t):
    return t("orders").agg(F.count_if(col("o_orderstatus") == "F").alias("done"), F.round(F.sum(F.when(col("o_orderstatus") == "O", col("o_totalprice")).otherwise(0)), 2).alias("still_open"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def agg_grouping_sets(t):
    return t("lineitem").groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var FROM lineitem GROUP BY l_returnflag")
def agg_stddev(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("var"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(t):
    """The estimate is held against the exact count: within five of its standard errors of 1 %.

    A distinct count beside a sketch would make Spark keep a sketch of 13 KB for each pair of flag and part.
    Repeats don't change a sketch, so it is filled from the distinct pairs, one sketch a flag and task.
    """
    pairs = t("lineitem").select("l_returnflag", "l_partkey").distinct()
    g = pairs.groupBy("l_returnflag").agg(F.count("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.01).alias("about"))
    return g.select("l_returnflag", "exact", (F.abs(col("about") - col("exact")) <= 0.05 * col("exact")).alias("near"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def agg_by_timestamp(t):
    return t("events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"))


# joins
@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(t):
    n, r = t("nation"), t("region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("SELECT o_orderkey, l_partkey, l_quantity FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) l ON o_orderkey = l_orderkey")
def join_left(t):
    o, l = t("orders"), t("lineitem").filter("l_quantity > 49")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").select("o_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, l_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 400000) o RIGHT JOIN lineitem ON o_orderkey = l_orderkey")
def join_right(t):
    o, l = t("orders").filter("o_totalprice > 400000"), t("lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey, "right").select("o_orderkey", "l_orderkey")


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c FULL JOIN supplier ON c_custkey = s_suppkey")
def join_full(t):
    c, s = t("customer").filter("c_acctbal > 9000"), t("supplier")
    return c.join(s, c.c_custkey == s.s_suppkey, "full").select("c_custkey", "s_suppkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def join_semi_in(t):
    c, o = t("customer"), t("orders").filter("o_totalprice > 450000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(t):
    o, l = t("orders"), t("lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_anti").select("o_orderkey")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def join_group(t):
    c, o = t("customer"), t("orders")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t):
    n = t("nation")
    a, b = n.select("n_regionkey", col("n_name").alias("a"), col("n_nationkey").alias("ak")), n.select("n_regionkey", col("n_name").alias("b"), col("n_nationkey").alias("bk"))
    return a.join(b, "n_regionkey").filter("ak < bk").select("a", "b")


@query("SELECT p_partkey, lo FROM part JOIN (SELECT unnest([0, 10, 25]) AS lo, unnest([5, 12, 40]) AS hi) s ON p_size >= lo AND p_size < hi")
def join_range(t):
    spans = t("region").sparkSession.createDataFrame([(0, 5), (10, 12), (25, 40)], "lo int, hi int")
    return joins.range_join(t("part"), spans, "p_size", "lo", "hi", 8).select("p_partkey", "lo")


@query("SELECT e.event_id, p.value AS paid FROM events e ASOF LEFT JOIN (SELECT user_id, ts AS pts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.pts")
def join_as_of(t):
    e = t("events")
    p = e.filter("event_type = 'purchase'").groupBy("user_id", col("ts").alias("pts")).agg(F.max("value").alias("paid"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "pts", ["paid"], bucket=lambda ts: F.trunc(ts, "week")).select("event_id", "paid")


# set operations
_CN, _SN = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


def _keys(t):
    return t("customer").select(col("c_nationkey").alias("k")), t("supplier").select(col("s_nationkey").alias("k"))


@query(f"{_CN} UNION ALL {_SN}")
def union_all(t):
    a, b = _keys(t)
    return a.unionAll(b)


@query(f"{_CN} UNION {_SN}")
def union_distinct(t):
    a, b = _keys(t)
    return a.union(b).distinct()


@query(f"{_CN} INTERSECT {_SN}")
def intersect_vals(t):
    a, b = _keys(t)
    return a.intersect(b)


@query(f"SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")
def except_vals(t):
    return t("nation").select(col("n_nationkey").alias("k")).subtract(t("supplier").filter("s_acctbal > 5000").select(col("s_nationkey").alias("k")))


@query(f"{_CN} INTERSECT ALL {_SN}")
def intersect_all(t):
    a, b = _keys(t)
    return a.intersectAll(b)


@query(f"{_CN} EXCEPT ALL {_SN}")
def except_all(t):
    a, b = _keys(t)
    return a.exceptAll(b)


# subqueries, CTEs
@query("SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) s WHERE n > 10")
def subquery_from(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).filter("n > 10")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def subquery_in(t):
    o, c = t("orders"), t("customer").filter("c_mktsegment = 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def subquery_scalar(t):
    o = t("orders")
    return o.sparkSession.sql("SELECT o_orderkey FROM {o} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {o})", o=o)


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT o_orderkey FROM big WHERE o_orderstatus = 'O'")
def cte_basic(t):
    return t("orders").filter("o_totalprice > 300000").filter("o_orderstatus = 'O'").select("o_orderkey")


@query("WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE s > 1000000) SELECT count(*) AS n FROM b")
def cte_chain(t):
    return t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).filter("s > 1000000").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT max(n) AS hi, min(n) AS lo FROM s")
def cte_agg(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).agg(F.max("n").alias("hi"), F.min("n").alias("lo"))


@query("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 10) SELECT n, n * n AS sq FROM r")
def cte_recursive(t):
    return t("region").sparkSession.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 10) SELECT n, n * n AS sq FROM r")


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def pivot_vals(t):
    p = t("orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(lit(1)))
    return p.select("o_orderstatus", F.coalesce("1-URGENT", lit(0)).cast("bigint").alias("urgent"), F.coalesce("5-LOW", lit(0)).cast("bigint").alias("low"))


# windows
def _by_c():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, row_number() {_OVER} AS rn FROM orders")
def win_row_number(t):
    return t("orders").select("o_orderkey", F.row_number().over(_by_c()).cast("bigint").alias("rn"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
def win_rank(t):
    return t("part").select("p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy("p_size")).cast("bigint").alias("r"))


@query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
def win_dense_rank(t):
    return t("part").select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")).cast("bigint").alias("r"))


@query(f"SELECT o_orderkey, lag(o_totalprice) {_OVER} AS before FROM orders")
def win_lag(t):
    return t("orders").select("o_orderkey", F.lag("o_totalprice", 1).over(_by_c()).alias("before"))


@query(f"SELECT o_orderkey, lead(o_totalprice) {_OVER} AS after FROM orders")
def win_lead(t):
    return t("orders").select("o_orderkey", F.lead("o_totalprice", 1).over(_by_c()).alias("after"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders")
def win_sum_partition(t):
    return t("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 2).alias("total"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS mean FROM orders")
def win_avg_partition(t):
    return t("orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(Window.partitionBy("o_custkey")), 6).alias("mean"))


@query("SELECT n_name, count(*) OVER () AS n FROM nation")
def win_count_all(t):
    """COUNT(*) OVER () as a joined one-row aggregate: no window that gathers all rows in a task."""
    n = t("nation")
    return n.crossJoin(F.broadcast(n.agg(F.count("*").alias("n")))).select("n_name", "n")


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) s WHERE rn <= 3")
def win_topn_per_group(t):
    return ranking.top_n(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [col("o_totalprice").desc(), col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rn")


@query(f"SELECT o_orderkey, ntile(4) {_OVER} AS q FROM orders")
def win_ntile(t):
    return t("orders").select("o_orderkey", F.ntile(4).over(_by_c()).cast("bigint").alias("q"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
def win_frame_rows(t):
    return t("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(_by_c().rowsBetween(-2, 0)), 2).alias("s"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part")
def win_frame_range(t):
    return t("part").select("p_partkey", F.count("*").over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 3)).alias("n"))


@query("SELECT o_orderkey, first_value(o_totalprice) OVER w AS first, last_value(o_totalprice) OVER w AS last, nth_value(o_totalprice, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(t):
    w = _by_c().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t("orders").select("o_orderkey", F.first("o_totalprice").over(w).alias("first"), F.last("o_totalprice").over(w).alias("last"), F.nth_value("o_totalprice", 2).over(w).alias("second"))


@query("SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS cd FROM part")
def win_percent(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t("part").select("p_partkey", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


# strings
@query("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l FROM part")
def str_upper_lower(t):
    return t("part").select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"))


@query("SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n FROM part")
def str_length(t):
    return t("part").select("p_partkey", F.length("p_name").cast("bigint").alias("n"))


@query("SELECT p_partkey, p_brand || '-' || p_type AS c FROM part")
def str_concat(t):
    return t("part").select("p_partkey", F.concat("p_brand", lit("-"), "p_type").alias("c"))


@query("SELECT p_partkey, substring(p_name, 1, 4) AS s, replace(p_name, 'blue', 'red') AS r FROM part")
def str_substring(t):
    return t("part").select("p_partkey", F.substring("p_name", 1, 4).alias("s"), F.replace("p_name", lit("blue"), lit("red")).alias("r"))


@query("SELECT n_name, replace(n_name, 'A', '*') AS r FROM nation")
def str_replace(t):
    return t("nation").select("n_name", F.replace("n_name", lit("A"), lit("*")).alias("r"))


@query("SELECT n_name, '[' || trim('  ' || n_name || ' ') || ']' AS t, '[' || ltrim('  ' || n_name || ' ') || ']' AS l, '[' || rtrim(' ' || n_name || '  ') || ']' AS r, CAST(length(trim('  ' || n_name)) AS BIGINT) AS n FROM nation")
def str_trim(t):
    pad = lambda a, b: F.concat(lit(a), "n_name", lit(b))
    box = lambda c: F.concat(lit("["), c, lit("]"))
    return t("nation").select("n_name", box(F.trim(pad("  ", " "))).alias("t"), box(F.ltrim(pad("  ", " "))).alias("l"), box(F.rtrim(pad(" ", "  "))).alias("r"), F.length(F.trim(pad("  ", ""))).cast("bigint").alias("n"))


@query("SELECT r_name, repeat(r_name, 2) AS twice FROM region")
def str_repeat(t):
    return t("region").select("r_name", F.repeat("r_name", 2).alias("twice"))


@query("SELECT n_name, left(n_name, 3) AS l, right(n_name, 3) AS r FROM nation")
def str_left_right(t):
    return t("nation").select("n_name", F.left("n_name", lit(3)).alias("l"), F.right("n_name", lit(3)).alias("r"))


@query("SELECT p_partkey, starts_with(p_name, 'blue') AS s, ends_with(p_name, 'widget') AS e FROM part")
def str_starts_ends(t):
    return t("part").select("p_partkey", F.startswith("p_name", lit("blue")).alias("s"), F.endswith("p_name", lit("widget")).alias("e"))


# numbers
@query("SELECT c_custkey, abs(c_acctbal) AS a FROM customer")
def math_abs(t):
    return t("customer").select("c_custkey", F.abs("c_acctbal").alias("a"))


@query("SELECT c_custkey, ceil(c_acctbal)::DOUBLE AS c, floor(c_acctbal)::DOUBLE AS f FROM customer")
def math_ceil_floor(t):
    return t("customer").select("c_custkey", compat.ceil(col("c_acctbal")).alias("c"), compat.floor(col("c_acctbal")).alias("f"))


@query("SELECT p_partkey, round(p_retailprice) AS r0, round(p_retailprice, 1) AS r1 FROM part")
def math_round(t):
    return t("part").select("p_partkey", F.round("p_retailprice").alias("r0"), F.round("p_retailprice", 1).alias("r1"))


@query("SELECT p_partkey, CAST(pow(p_size, 2) AS BIGINT) AS sq, round(sqrt(p_retailprice), 6) AS rt, round(pow(p_retailprice, 0.5), 6) AS pw FROM part")
def math_power_sqrt(t):
    p = t("part")
    return p.select("p_partkey", compat.power(col("p_size"), lit(2), p.schema["p_size"].dataType, p.schema["p_size"].dataType).alias("sq"), F.round(F.sqrt("p_retailprice"), 6).alias("rt"), F.round(F.pow("p_retailprice", lit(0.5)), 6).alias("pw"))


@query("SELECT p_partkey, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(log2(p_retailprice), 6) AS l2 FROM part")
def math_ln(t):
    return t("part").select("p_partkey", F.round(F.ln("p_retailprice"), 6).alias("l"), F.round(F.log10("p_retailprice"), 6).alias("l10"), F.round(F.log2("p_retailprice"), 6).alias("l2"))


@query("SELECT c_custkey, CAST(sign(c_acctbal) AS DOUBLE) AS s FROM customer")
def math_signum(t):
    return t("customer").select("c_custkey", F.signum("c_acctbal").alias("s"))


@query("SELECT c_custkey, c_custkey % 7 AS m FROM customer")
def math_mod(t):
    return t("customer").select("c_custkey", (col("c_custkey") % 7).alias("m"))


# conditionals, casts, dates
@query(f"SELECT o_orderkey, coalesce(l_partkey, -1) AS part FROM ({_SMALL})")
def cond_coalesce(t):
    return _small(t).select("o_orderkey", F.coalesce("l_partkey", lit(-1)).alias("part"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders")
def cond_nullif(t):
    return t("orders").select("o_orderkey", F.nullif("o_orderstatus", lit("F")).alias("s"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def cond_case(t):
    return t("orders").select("o_orderkey", F.when(col("o_totalprice") > 300000, "high").when(col("o_totalprice") > 100000, "mid").otherwise("low").alias("band"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS i, CAST(p_size AS DOUBLE) AS d FROM part")
def cast_types(t):
    return t("part").select("p_partkey", col("p_size").cast("string").alias("s"), col("p_size").cast("string").cast("int").alias("i"), col("p_size").cast("double").alias("d"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS mon FROM orders")
def date_parts(t):
    return t("orders").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").cast("bigint").alias("m"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("mon"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS minute, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, last_day(CAST(o_orderdate AS DATE)) AS last, CAST(extract(DOW FROM o_orderdate) AS BIGINT) AS dow FROM orders")
def date_text(t):
    d = col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("minute"), F.date_diff(d, lit("1992-01-01").cast("date")).cast("bigint").alias("days"), F.last_day(d).alias("last"), (F.dayofweek(d) - 1).cast("bigint").alias("dow"))


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '-', 'g') AS plain, regexp_extract(p_name, '(\\w+)', 1) AS word, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels FROM part")
def str_regex(t):
    return t("part").select("p_partkey", F.regexp_replace("p_name", "[aeiou]+", "-").alias("plain"), F.regexp_extract("p_name", r"(\w+)", 1).alias("word"), F.size(F.regexp_extract_all("p_name", lit("[aeiou]"), lit(0))).cast("bigint").alias("vowels"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS sq FROM embeddings")
def array_norm(t):
    return t("embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("n"), F.round(F.aggregate("embedding", lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("sq"))


# index-style access
@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def index_eq(t):
    return access.equal(t("orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey")


@query("SELECT p_name, p_partkey FROM part WHERE starts_with(p_name, 'blue') ORDER BY p_name")
def index_prefix(t):
    return access.prefix(t("part").select("p_name", "p_partkey"), "p_name", "blue")


@query("SELECT p_name, p_partkey FROM part WHERE starts_with(p_name, 'blue') ORDER BY p_name DESC")
def index_prefix_reverse(t):
    return access.prefix(t("part").select("p_name", "p_partkey"), "p_name", "blue", reverse=True)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def index_range(t):
    return access.in_range(t("orders").select("o_orderkey"), "o_orderkey", 100, 200)


@query("SELECT min(p_name) AS p_name FROM part WHERE starts_with(p_name, 'large')")
def index_min_prefix(t):
    return access.min_with_prefix(t("part"), "p_name", "large")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey > 10 OR (o_custkey = 10 AND o_orderkey >= 5) ORDER BY o_custkey, o_orderkey LIMIT 25")
def index_cursor(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    c = access.Cursor(o, "o_custkey", "o_orderkey")
    c.seek(10, 5)
    return o.sparkSession.createDataFrame([*c.next(), *c.next(10), *c.next(14)], o.schema)


@query("SELECT p_partkey, p_name FROM part WHERE lower(substring(p_name, 1, 5)) = 'large'")
def expr_index_lower(t):
    return access.equal(t("part"), F.lower(F.substring("p_name", 1, 5)), "large").select("p_partkey", "p_name")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(t):
    return access.duplicates(t("lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", col("l_linenumber").cast("bigint").alias("line"), "n")


# change of data as projections
@query("SELECT * FROM nation UNION ALL SELECT 99, 'NOWHERE', 0")
def dml_insert(t):
    n = t("nation")
    return n.unionByName(n.sparkSession.createDataFrame([(99, "NOWHERE", 0)], n.schema))


@query("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000)")
def dml_delete(t):
    return t("orders").filter(~F.coalesce((col("o_orderstatus") == "F") & (col("o_totalprice") < 50000), lit(False)))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(t):
    return t("customer").select("c_custkey", F.when(col("c_acctbal") < 0, lit(0.0)).otherwise(col("c_acctbal")).alias("c_acctbal"))


# workload
@query("SELECT o_custkey, o_orderkey, o_orderstatus, coalesce(n_lines, 0) AS n_lines, round(coalesce(amount, 0.0), 2) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS amount FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey WHERE rn = 1")
def order_status(t):
    return workloads.order_status(t("orders"), t("lineitem"))


@query("SELECT count(*) AS low_stock FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20)) x JOIN part ON l_partkey = p_partkey WHERE p_size < 15")
def stock_level(t):
    return workloads.stock_level(t("orders"), t("lineitem"), t("part"), 20, 15)


@query("SELECT o_orderpriority, o_orderkey, round(coalesce(sum(l_extendedprice), 0.0), 2) AS total FROM (SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority) f LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def delivery_min_order(t):
    return workloads.delivery(t("orders"), t("lineitem"))


@query("SELECT n_name, round(sum(l_quantity * p_retailprice * (1 - l_discount) * (1 + l_tax)), 4) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def new_order_lookup(t):
    return workloads.new_order(t("lineitem"), t("part"), t("supplier"), t("nation"))


@query("SELECT c_custkey, round(c_acctbal - coalesce(paid, 0.0), 2) AS balance, coalesce(n, 0) AS payments FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS paid, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) p ON c_custkey = o_custkey")
def payment_balance(t):
    return workloads.payment(t("customer"), t("orders"))


# extensions
@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    return tumbling(t("events"), "ts", "1 hour", ["event_type"]).select(col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(t):
    return sessions(t("events"), "ts", "30 minutes", ["user_id"]).select("user_id", col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


_FLAGSHIP = "SELECT c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount > 0.02 GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 3"


@query(_FLAGSHIP)
def flagship_revenue(t):
    c, o, l = t("customer"), t("orders"), t("lineitem").filter("l_discount > 0.02")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    g = j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(col("l_extendedprice") * (1 - col("l_discount"))), 4).alias("revenue"))
    return g.filter("n > 10").orderBy(col("revenue").desc()).limit(3)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLANS["flagship_revenue"](spark, sf_dir)
