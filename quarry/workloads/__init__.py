"""The read side of an order-entry workload on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import latest


def order_status(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Each customer's latest order, with the number and value of its lines."""
    last = latest(orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    # only the latest orders' lines are added up
    own = lineitem.join(last.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    lines = own.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_extendedprice").alias("amount"))
    return last.join(lines, last.o_orderkey == lines.l_orderkey, "left").select("o_custkey", "o_orderkey", "o_orderstatus", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.round(F.coalesce("amount", F.lit(0.0)), 2).alias("amount"))


def stock_level(orders: DataFrame, lineitem: DataFrame, part: DataFrame, last: int, threshold: int) -> DataFrame:
    """How many distinct parts of the `last` newest orders have a size below the threshold."""
    newest = orders.select("o_orderkey").orderBy(F.col("o_orderkey").desc()).limit(last)
    return lineitem.join(newest, lineitem.l_orderkey == newest.o_orderkey, "left_semi").select("l_partkey").distinct().join(part.filter(F.col("p_size") < threshold), F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.count(F.lit(1)).alias("low_stock"))


def delivery(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """For each priority the oldest open order, and the sum of its lines."""
    first = orders.filter("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))
    return first.join(lineitem, first.o_orderkey == lineitem.l_orderkey, "left").groupBy("o_orderpriority", "o_orderkey").agg(F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("total"))


def new_order(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Line totals with the item's price and the supplier's nation looked up, by nation."""
    j = lineitem.join(part, lineitem.l_partkey == part.p_partkey).join(supplier, lineitem.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 4).alias("amount"))


def payment(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Balances after paying for all fulfilled orders: an update written as a projection."""
    paid = orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("paid"), F.count(F.lit(1)).alias("n"))
    return customer.join(paid, customer.c_custkey == paid.o_custkey, "left").select("c_custkey", F.round(F.col("c_acctbal") - F.coalesce("paid", F.lit(0.0)), 2).alias("balance"), F.coalesce("n", F.lit(0)).cast("bigint").alias("payments"))
