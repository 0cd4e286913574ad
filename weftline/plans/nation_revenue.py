"""Revenue and order count per customer nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import exact_product, exact_sum, money


def nation_revenue(
    lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame
) -> DataFrame:
    """Discounted revenue and number of distinct orders, by nation name.

    Both sides of the order-key join are summed per order before they are shuffled, so
    an order key holding much of either table reaches the join as a few rows per map
    task. That also leaves (order, nation) unique after the join: counting rows counts
    distinct orders. Neither the order key nor the customer key needs to be unique,
    because repeated rows are carried as ``copies``.

    A hot customer key is left to adaptive execution. The orders-customer join feeds
    another shuffle, so splitting its skewed partition is allowed there.

    No side is broadcast by hint. Spark broadcasts what its size estimate, or the
    measured shuffle size, puts under ``spark.sql.autoBroadcastJoinThreshold`` and
    sort-merge joins the rest.

    No amount is lost without an error: see ``money``. An order without an amount still counts.
    """
    revenue_per_order = lineitem.groupBy("l_orderkey").agg(
        exact_sum(exact_product(money("l_extendedprice"), 1 - money("l_discount"))).alias("order_revenue")
    )
    customer_nation = customer.join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "n_name")
    order_nation = (
        orders.join(customer_nation, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_orderkey", "n_name")
        .agg(F.count("*").alias("copies"))
    )
    return (
        order_nation.join(revenue_per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("n_name")
        .agg(
            exact_sum(exact_product(F.col("order_revenue"), F.col("copies"))).alias("revenue"),
            F.count("*").alias("n_orders"),
        )
    )
