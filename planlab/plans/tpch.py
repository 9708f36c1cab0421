"""The six workload queries, as DataFrames and as SQL text.

Rows that a small side rules out go before anything is shuffled; what is left is aggregated with
partial rows, so the shuffle of a key that repeats a lot carries one row per map task, not every row of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planlab.session import broadcast_if_small
from planlab.sources.tables import Tables


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def pricing_summary(t: Tables) -> DataFrame:
    """T1: shipped lines up to a date minus an interval, grouped by flag and status."""
    charge = revenue() * (1 + F.col("l_tax"))
    cutoff = F.expr("date'2001-08-01' - interval 90 days")
    sums = (
        t.lineitem.where(F.col("l_shipdate") <= cutoff)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_base"),
            F.sum(revenue()).alias("sum_disc"),
            F.sum(charge).alias("sum_chg"),
            F.sum("l_discount").alias("sum_d"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )
    n = F.col("count_order")
    return sums.select(
        "l_returnflag",
        "l_linestatus",
        F.round("sum_qty", 2).alias("sum_qty"),
        F.round("sum_base", 2).alias("sum_base_price"),
        F.round("sum_disc", 2).alias("sum_disc_price"),
        F.round("sum_chg", 2).alias("sum_charge"),
        F.round(F.col("sum_qty") / n, 6).alias("avg_qty"),
        F.round(F.col("sum_base") / n, 6).alias("avg_price"),
        F.round(F.col("sum_d") / n, 6).alias("avg_disc"),
        n,
    ).orderBy("l_returnflag", "l_linestatus")


def shipping_priority(t: Tables, limit: int | None = None) -> DataFrame:
    """T3: revenue of open orders of one segment. Lines collapse per order before the join."""
    day = F.expr("date'1998-03-15'")
    buyers = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    orders = (
        t.orders.where(F.col("o_orderdate") < day)
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    )
    lines = (
        t.lineitem.where(F.col("l_shipdate") > day)
        .groupBy("l_orderkey")
        .agg(F.sum(revenue()).alias("revenue"))
    )
    out = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey",
        F.round("revenue", 4).alias("revenue"),
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
    )
    if limit is None:
        return out.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey")
    return out.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(limit)


def important_stock(t: Tables, nation: str = "NATION_7", share: float = 0.001) -> DataFrame:
    """T11: parts above a share of one nation's stock value.

    The total is a scalar subquery inside the plan; nothing visits the driver.
    """
    home = t.nation.where(F.col("n_name") == nation).select("n_nationkey")
    suppliers = t.supplier.join(
        F.broadcast(home), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi"
    ).select("s_suppkey")
    value = (
        t.lineitem.join(broadcast_if_small(suppliers), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
        .groupBy("l_partkey")
        .agg(F.sum(F.col("l_extendedprice") * F.col("l_quantity")).alias("value"))
    )
    total = value.agg(F.sum("value") * share)
    return (
        value.where(F.col("value") > total.scalar())
        .select(F.col("l_partkey").alias("partkey"), F.round("value", 2).alias("value"))
        .orderBy(F.desc("value"), "partkey")
    )


def customer_distribution(t: Tables) -> DataFrame:
    """T13: how many customers have how many matching orders, zero included."""
    day = F.expr("date'1997-01-01'")
    per_customer = (
        t.orders.where(
            ~F.col("o_orderpriority").rlike("NOT.*SPECIFIED") & (F.col("o_orderdate") < day)
        )
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        t.customer.select("c_custkey")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy(F.coalesce("n", F.lit(0)).alias("c_count"))
        .agg(F.count(F.lit(1)).alias("custdist"))
        .orderBy(F.desc("custdist"), F.desc("c_count"))
    )


def small_quantity_revenue(t: Tables) -> DataFrame:
    """T17: yearly revenue of lines below a fifth of their part's average quantity.

    Lines of other parts go first; the others collapse to one row per part and quantity, which know
    their part's average by a window over those few rows.
    """
    parts = t.part.where(
        (F.col("p_brand") == "Brand#23") & F.col("p_size").between(1, 25)
    ).select("p_partkey")
    lines = (
        t.lineitem.join(broadcast_if_small(parts), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .groupBy("l_partkey", "l_quantity")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"))
    )
    of_part = W.partitionBy("l_partkey")
    average = F.sum(F.col("l_quantity") * F.col("n")).over(of_part) / F.sum("n").over(of_part)
    return (
        lines.withColumn("below", 0.2 * average)
        .where(F.col("l_quantity") < F.col("below"))
        .agg(F.round(F.sum("price") / 7.0, 4).alias("avg_yearly"))
    )


def waiting_suppliers(t: Tables, nation: str = "NATION_7", limit: int | None = 100) -> DataFrame:
    """T21: suppliers who alone kept a multi-supplier order waiting.

    Whether another supplier, or another late supplier, is in an order follows from the least
    and greatest supplier key of the order, so both EXISTS tests need one row per order
    instead of every pair of its lines.
    """
    late = F.col("l_returnflag") == "R"
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("lo"),
        F.max("l_suppkey").alias("hi"),
        F.min(F.when(late, F.col("l_suppkey"))).alias("late_lo"),
        F.max(F.when(late, F.col("l_suppkey"))).alias("late_hi"),
    )
    home = t.nation.where(F.col("n_name") == nation).select("n_nationkey")
    suppliers = t.supplier.join(
        F.broadcast(home), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi"
    ).select("s_suppkey", "s_name")
    failed = t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    waiting = per_order.where(
        (F.col("lo") != F.col("hi")) & (F.col("late_lo") == F.col("late_hi"))
    ).join(failed, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    lines = (
        t.lineitem.where(late)
        .groupBy(F.col("l_orderkey").alias("k"), "l_suppkey")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(waiting, F.col("k") == F.col("l_orderkey"))
    )
    out = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_name")
        .agg(F.sum("n").alias("numwait"))
    )
    out = out.orderBy(F.desc("numwait"), "s_name")
    return out if limit is None else out.limit(limit)


# SQL forms. Spark and the checking engine run the same text.
SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus,
               ROUND(SUM(l_quantity), 2) AS sum_qty,
               ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
               ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
               ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
               ROUND(AVG(l_quantity), 6) AS avg_qty,
               ROUND(AVG(l_extendedprice), 6) AS avg_price,
               ROUND(AVG(l_discount), 6) AS avg_disc,
               COUNT(*) AS count_order
        FROM lineitem
        WHERE l_shipdate <= DATE '2001-08-01' - INTERVAL '90' DAY
        GROUP BY l_returnflag, l_linestatus
        ORDER BY l_returnflag, l_linestatus""",
    "shipping_priority": """
        SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue,
               CAST(o_orderdate AS DATE) AS o_orderdate
        FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
          AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, CAST(o_orderdate AS DATE)
        ORDER BY revenue DESC, o_orderdate, l_orderkey""",
    "important_stock": """
        SELECT l_partkey AS partkey, ROUND(SUM(l_extendedprice * l_quantity), 2) AS value
        FROM lineitem, supplier, nation
        WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7'
        GROUP BY l_partkey
        HAVING SUM(l_extendedprice * l_quantity) > (
            SELECT SUM(l_extendedprice * l_quantity) * 0.001
            FROM lineitem, supplier, nation
            WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')
        ORDER BY value DESC, partkey""",
    "customer_distribution": """
        SELECT c_count, COUNT(*) AS custdist
        FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count
              FROM customer LEFT OUTER JOIN orders
                ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%NOT%SPECIFIED%'
               AND o_orderdate < DATE '1997-01-01'
              GROUP BY c_custkey) c
        GROUP BY c_count
        ORDER BY custdist DESC, c_count DESC""",
    "small_quantity_revenue": """
        SELECT ROUND(SUM(l_extendedprice) / 7.0, 4) AS avg_yearly
        FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 25
          AND l_quantity < (SELECT 0.2 * AVG(l2.l_quantity) FROM lineitem l2
                            WHERE l2.l_partkey = p_partkey)""",
    "waiting_suppliers": """
        SELECT s_name, COUNT(*) AS numwait
        FROM supplier, lineitem l1, orders, nation
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
          AND l1.l_returnflag = 'R'
          AND EXISTS (SELECT * FROM lineitem l2
                      WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT * FROM lineitem l3
                          WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey
                            AND l3.l_returnflag = 'R')
          AND s_nationkey = n_nationkey AND n_name = 'NATION_7'
        GROUP BY s_name
        ORDER BY numwait DESC, s_name""",
}


def run_sql(t: Tables, name: str) -> DataFrame:
    """Register the base tables as views and run the SQL form."""
    return t.register("customer", "orders", "lineitem", "supplier", "nation", "part").sql(SQL[name])


def _frame(build):
    return lambda spark, directory: build(Tables(spark, directory))


def _text(name):
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return run_sql(Tables(spark, directory), name)

    return run


QUERIES = {
    "t1": (_frame(pricing_summary), SQL["pricing_summary"]),
    "t1_sql": (_text("pricing_summary"), SQL["pricing_summary"]),
    "t3": (_frame(shipping_priority), SQL["shipping_priority"]),
    "t3_sql": (_text("shipping_priority"), SQL["shipping_priority"]),
    "t3_top20": (_frame(lambda t: shipping_priority(t, 20)), SQL["shipping_priority"] + " LIMIT 20"),
    "t11": (_frame(important_stock), SQL["important_stock"]),
    "t11_sql": (_text("important_stock"), SQL["important_stock"]),
    "t13": (_frame(customer_distribution), SQL["customer_distribution"]),
    "t13_sql": (_text("customer_distribution"), SQL["customer_distribution"]),
    "t17": (_frame(small_quantity_revenue), SQL["small_quantity_revenue"]),
    "t17_sql": (_text("small_quantity_revenue"), SQL["small_quantity_revenue"]),
    "t21": (_frame(waiting_suppliers), SQL["waiting_suppliers"] + " LIMIT 100"),
    "t21_sql": (_text("waiting_suppliers"), SQL["waiting_suppliers"]),
}
