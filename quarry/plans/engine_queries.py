"""Registered queries that go through the engine's own SQL and row API, on warehouses made for them."""

from __future__ import annotations

import atexit
import shutil
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import Engine
from ..errors import ConstraintViolation, TableExists, WriteConflict
from ..sources import read, table, write

PLANS: dict = {}
ORACLE: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; where it is a local one it goes when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path.removeprefix("file:"), True)
    return path


def query(sql: str):
    """Registers fn(engine, t, n): t(name) is a table of the data, n(name) a name for a table of the engine that is nobody else's. What it returns is read before the engine closes."""

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            e, mark = Engine(spark, _folder(spark)), uuid.uuid4().hex[:8]
            try:
                return fn(e, lambda name: table(spark, sf_dir, name), lambda name: f"{name}_{mark}")
            finally:
                e.close()

        PLANS[fn.__name__], ORACLE[fn.__name__] = run, sql
        return fn

    return put


def _orders(e: Engine, t, n) -> str:
    name = n("o")
    e.sql(f"CREATE TABLE {name} (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_orderstatus TEXT, o_totalprice DOUBLE)")
    e.sql(f"INSERT INTO {name} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {{orders}}", orders=t("orders"))
    return name


_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@query("SELECT 1::SMALLINT AS a, 2 AS b, 3::BIGINT AS c, 1.5::DOUBLE AS d, 'x' AS e, true AS f, TIMESTAMP '2024-01-02 03:04:05' AS g, DATE '2024-01-02' AS h, 12.25 AS i")
def ddl_types(e, t, n):
    e.sql(f"CREATE TABLE {n('k')} (a SMALLINT, b INT, c BIGINT NOT NULL, d DOUBLE PRECISION, e VARCHAR(10), f BOOLEAN, g TIMESTAMP, h DATE, i DECIMAL(10, 2))")
    e.sql(f"INSERT INTO {n('k')} VALUES (1, 2, 3, 1.5, 'x', true, TIMESTAMP_NTZ '2024-01-02 03:04:05', DATE '2024-01-02', 12.25)")
    return e.sql(f"SELECT a, b, c, d, e, f, g, h, CAST(i AS DOUBLE) AS i FROM {n('k')}")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 99, 'NOWHERE' UNION ALL SELECT 100, NULL")
def engine_insert(e, t, n):
    e.create_table(n("n"), T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType())]))
    e.sql(f"INSERT INTO {n('n')} SELECT n_nationkey, n_name FROM {{nation}}", nation=t("nation"))
    e.sql(f"INSERT INTO {n('n')} VALUES (99, 'NOWHERE')")
    e.insert(n("n"), [(100, None)])
    return e.table(n("n"))


@query("SELECT r_regionkey, r_name FROM region")
def engine_insert_arrow(e, t, n):
    rows = t("region").select("r_regionkey", "r_name").toArrow()
    e.create_table(n("r"), t("region").select("r_regionkey", "r_name").schema)
    e.insert(n("r"), e.spark.createDataFrame(rows))
    return e.spark.createDataFrame(e.table(n("r")).toArrow())


@query(f"{_O} WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 50000)")
def engine_delete(e, t, n):
    o = _orders(e, t, n)
    e.sql(f"DELETE FROM {o} WHERE o_orderstatus = 'F' AND o_totalprice < 50000")
    return e.sql(f"SELECT * FROM {o}")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def engine_update(e, t, n):
    o = _orders(e, t, n)
    e.sql(f"UPDATE {o} SET o_totalprice = o_totalprice * 2, o_orderstatus = 'X' WHERE o_orderkey % 7 = 0")
    return e.table(o)


@query(f"{_O} WHERE o_orderkey > 100")
def engine_savepoint(e, t, n):
    o = _orders(e, t, n)
    e.delete(o, "o_orderkey <= 100")
    point = e.savepoint(o)
    e.sql(f"DELETE FROM {o}")
    e.rollback_to(o, point)
    return e.table(o)


@query(f"SELECT 'now' AS at, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS top FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'before', count(*), CAST(max(o_orderkey) AS BIGINT) FROM orders")
def engine_snapshot_scan(e, t, n):
    o = _orders(e, t, n)
    point = e.savepoint(o)
    e.sql(f"DELETE FROM {o} WHERE o_orderstatus <> 'O'")
    of = lambda at, df: df.agg(F.lit(at).alias("at"), F.count("*").alias("n"), F.max("o_orderkey").alias("top"))
    return of("now", e.table(o)).unionByName(of("before", e.catalog.frame(o, point)))


@query(f"{_O} WHERE o_orderkey % 2 = 0")
def engine_transaction(e, t, n):
    o = _orders(e, t, n)
    with suppress(ZeroDivisionError), e.transaction(o):
        e.sql(f"DELETE FROM {o}")
        1 / 0  # noqa: B018
    with e.transaction(o):
        e.sql(f"UPDATE {o} SET o_orderkey = -o_orderkey WHERE o_orderkey % 2 = 1")
        e.sql(f"DELETE FROM {o} WHERE o_orderkey < 0")
    return e.table(o)


@query("SELECT 1 AS id, true AS refused UNION ALL SELECT 2, true")
def engine_write_conflict(e, t, n):
    name = n("w")
    e.sql(f"CREATE TABLE {name} (id INT)")
    e.insert(name, [(1,)])
    other = Engine(e.spark, e.catalog.warehouse)
    refused = False
    try:
        with e.transaction(name):
            e.insert(name, [(3,)])
            other.insert(name, [(2,)])
    except WriteConflict:
        refused = True
    return e.table(name).withColumn("refused", F.lit(refused))


@query(f"SELECT o_orderstatus, count(*) AS n, 2 AS gone FROM orders GROUP BY o_orderstatus HAVING o_orderstatus <> 'F'")
def engine_vacuum(e, t, n):
    o = _orders(e, t, n)
    e.sql(f"DELETE FROM {o} WHERE o_orderstatus = 'F'")
    gone = e.vacuum(o)
    return e.sql(f"SELECT o_orderstatus, count(*) AS n FROM {o} GROUP BY o_orderstatus").withColumn("gone", F.lit(gone))


@query(f"{_O} WHERE o_orderkey = 77")
def engine_index_find(e, t, n):
    o = _orders(e, t, n)
    e.sql(f"CREATE INDEX by_key ON {o} (o_orderkey)")
    return e.find(o, o_orderkey=77)


@query("SELECT count(*) AS n, true AS twice, true AS missing, true AS bad FROM orders")
def engine_constraints(e, t, n):
    o = _orders(e, t, n)
    e.sql(f"CREATE TABLE {n('c')} (k BIGINT REFERENCES {o}(o_orderkey), v INT CHECK (v > 0))")

    def refused(sql: str) -> bool:
        try:
            e.sql(sql)
        except ConstraintViolation:
            return True
        return False

    got = {"twice": refused(f"INSERT INTO {o} SELECT o_orderkey, 1, 'O', 1.0 FROM {o}"), "missing": refused(f"INSERT INTO {n('c')} VALUES (-5, 1)"), "bad": refused(f"INSERT INTO {n('c')} VALUES (NULL, 0)")}
    return e.sql(f"SELECT count(*) AS n FROM {o}").withColumns({k: F.lit(v) for k, v in got.items()})


@query("SELECT 'a' AS name, true AS again UNION ALL SELECT 'c', true")
def ddl_create_drop_list(e, t, n):
    for name in "abc":
        e.sql(f"CREATE TABLE {n(name)} (id INT)")
    e.sql(f"DROP TABLE {n('b')}")
    e.sql(f"DROP TABLE IF EXISTS {n('b')}")
    again = False
    try:
        e.sql(f"CREATE TABLE {n('a')} (id INT)")
    except TableExists:
        again = True
    names = [(x.rpartition("_")[0],) for x in e.list_tables()]
    return e.spark.createDataFrame(names, "name string").withColumn("again", F.lit(again))


@query("SELECT 'k' AS name, 'bigint' AS type, false AS nullable UNION ALL SELECT 'v', 'string', true")
def catalog_schema(e, t, n):
    e.sql(f"CREATE TABLE {n('s')} (k BIGINT, v TEXT, PRIMARY KEY (k))")
    return e.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in e.schema(n("s"))], "name string, type string, nullable boolean")


@query("SELECT r_regionkey + 1 AS id, upper(r_name) AS name FROM region WHERE r_regionkey < 3")
def temp_table(e, t, n):
    e.sql(f"CREATE TEMP TABLE {n('t')} (id BIGINT, name TEXT)")
    e.sql(f"INSERT INTO {n('t')} SELECT r_regionkey + 1, upper(r_name) FROM {{region}} WHERE r_regionkey < 3", region=t("region"))
    # a temporary table ends with its engine; five rows at most
    return e.spark.createDataFrame(e.table(n("t")).collect(), e.table(n("t")).schema)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def tablespace_view(e, t, n):
    e.sql(f"CREATE TABLESPACE far LOCATION '{_folder(e.spark)}'")
    e.sql(f"CREATE TABLE {n('n')} (n_nationkey BIGINT, n_name TEXT, n_regionkey BIGINT) TABLESPACE far")
    e.sql(f"INSERT INTO {n('n')} SELECT n_nationkey, n_name, n_regionkey FROM {{nation}}", nation=t("nation"))
    e.sql(f"CREATE VIEW {n('v')} AS SELECT n_nationkey, n_name FROM {n('n')} WHERE n_regionkey = 1")
    return e.sql(f"SELECT * FROM {n('v')}")


@query("SELECT r_regionkey AS id, r_name AS title, r_regionkey * 10 AS tens FROM region")
def alter_truncate(e, t, n):
    e.sql(f"CREATE TABLE {n('a')} (id BIGINT, name TEXT, spare INT)")
    e.sql(f"INSERT INTO {n('a')} VALUES (7, 'old', 1)")
    e.sql(f"TRUNCATE TABLE {n('a')}")
    e.sql(f"ALTER TABLE {n('a')} DROP COLUMN spare")
    e.sql(f"ALTER TABLE {n('a')} RENAME COLUMN name TO title")
    e.sql(f"INSERT INTO {n('a')} SELECT r_regionkey, r_name FROM {{region}}", region=t("region"))
    e.sql(f"ALTER TABLE {n('a')} ADD COLUMN tens BIGINT")
    e.sql(f"UPDATE {n('a')} SET tens = id * 10")
    return e.table(n("a"))


@query("SELECT kind, c_mktsegment, count(*) AS n FROM customer, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS kind) GROUP BY ALL")
def copy_formats(e, t, n):
    src, out = t("customer").select("c_custkey", "c_mktsegment"), None
    e.create_table(n("c"), src.schema)
    e.insert(n("c"), src)
    for kind in ("csv", "json", "orc", "parquet"):
        path = _folder(e.spark)
        if kind == "parquet":
            write(e.table(n("c")), path, kind, partition_by=["c_mktsegment"])
            back = read(e.spark, path, kind, src.schema)
        else:
            e.sql(f"COPY {n('c')} TO '{path}' (FORMAT {kind})")
            e.create_table(n(kind), src.schema)
            e.sql(f"COPY {n(kind)} FROM '{path}' (FORMAT {kind})")
            back = e.table(n(kind))
        one = back.groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS v(id, name) UNION ALL SELECT 1 + 1, 'x'")
def values_select(e, t, n):
    return e.sql("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS v(id, name) UNION ALL SELECT 1 + 1, 'x'")


@query("SELECT event_id FROM events WHERE ts >= make_timestamp(1704844800000000)")
def arrow_cast_filter(e, t, n):
    return e.sql("SELECT event_id FROM {events} WHERE ts >= arrow_cast(1704844800000000, 'Timestamp(Microsecond, None)')", events=t("events"))


@query("SELECT p_partkey, CAST(power(p_size, 2) AS BIGINT) AS sq, power(p_size, 0.5) AS root, ceil(p_retailprice / 7) AS up, floor(p_retailprice / 7) AS down FROM part")
def power_types(e, t, n):
    return e.sql("SELECT p_partkey, POWER(p_size, 2) AS sq, POWER(p_size, 0.5) AS root, CEIL(p_retailprice / 7) AS up, FLOOR(p_retailprice / 7) AS down FROM {part}", part=t("part"))


@query("SELECT true AS aggregates, true AS scans, true AS shuffles")
def explain_plan(e, t, n):
    plan = e.sql("EXPLAIN SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus", orders=t("orders"))
    return plan.select(F.col("plan").contains("HashAggregate").alias("aggregates"), F.col("plan").contains("FileScan parquet").alias("scans"), F.col("plan").contains("Exchange hashpartitioning").alias("shuffles"))


def _plain(name: str, sql: str, tables: str, oracle: str | None = None) -> None:
    """A query whose text both engines take, but for the tables' names in braces."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{x: table(spark, sf_dir, x) for x in tables.split()})

    PLANS[name], ORACLE[name] = run, oracle or sql.replace("{", "").replace("}", "")


_plain("sql_exists_correlated", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", "customer orders")
_plain("sql_not_in_nulls", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey < 9 THEN r_regionkey END FROM {region}) AND n_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)", "nation region")
_plain("sql_not_in_a_null", "SELECT count(*) AS n FROM {nation} WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 0 THEN r_regionkey END FROM {region})", "nation region")
_plain("sql_subquery_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", "orders")
_plain("sql_lateral", "SELECT r_name, x.n_name FROM {region} r, LATERAL (SELECT min(n_name) AS n_name FROM {nation} n WHERE n.n_regionkey = r.r_regionkey) x", "region nation")
_plain("sql_theta", "SELECT a.r_name AS a, b.n_name AS b FROM {region} a JOIN {nation} b ON a.r_regionkey * 5 < b.n_nationkey AND a.r_regionkey * 5 + 4 > b.n_nationkey", "region nation")
_plain("sql_intervals", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS next, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q FROM {orders}", "orders")
_plain("sql_hash_encode", "SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s, hex(p_name) AS h, base64(CAST(p_name AS BINARY)) AS b FROM {part}", "part", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s, hex(p_name) AS h, base64(encode(p_name)) AS b FROM part")
_plain("sql_cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE s > 500000) SELECT c_mktsegment, count(*) AS n FROM b JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment", "orders customer")
