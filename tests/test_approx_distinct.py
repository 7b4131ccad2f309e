"""agg_approx_distinct on awkward groups, and that its plan keeps one sketch a group."""

import re

import duckdb
from pyspark.sql import functions as F

from compare import same
from quarry.plans import ORACLE, PLANS

NAME = "agg_approx_distinct"


def test_a_sketch_a_group(spark, sf):
    plan = PLANS[NAME](spark, sf)._jdf.queryExecution().executedPlan().toString()
    keys = [re.search(r"keys=\[([^\]]*)\]", x)[1] for x in plan.splitlines() if "approx_count_distinct" in x and "keys=" in x]
    assert keys and not [k for k in keys if "l_partkey" in k]


def test_nulls_repeats_and_empty(spark, tmp_path):
    many = spark.range(60_000).select(F.lit("A").alias("l_returnflag"), (F.col("id") % 20_000).alias("l_partkey"))
    odd = spark.createDataFrame([(None, 1), (None, 1), (None, None), ("N", None), ("N", None), ("R", 7), ("R", -7), ("", 7), ("A", None)], "l_returnflag string, l_partkey long")
    for i, t in enumerate((many.union(odd), odd.limit(0))):
        t.write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/{i}/lineitem.parquet/*.parquet'")
        same(PLANS[NAME](spark, f"{tmp_path}/{i}"), con, ORACLE[NAME])


def test_repeats_do_not_change_the_estimate(spark):
    t = spark.range(100_000).select(F.col("id") % 3, F.when(F.col("id") % 11 > 0, F.xxhash64(F.col("id") % 30_000)).alias("k")).toDF("g", "k")
    about = lambda x: sorted(map(tuple, x.groupBy("g").agg(F.approx_count_distinct("k", 0.01)).collect()))
    assert about(t) == about(t.distinct())
