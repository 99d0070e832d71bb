"""Warehouse queries over the star schema (ten shapes of the usual decision-support set)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.plans.registry import query

def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money(c, name):
    return F.round(F.sum(c), 2).alias(name)


def day(d):
    return F.lit(d).cast("timestamp_ntz")


@query(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
       round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def q1(t):
    return (
        t("lineitem")
        .where(F.col("l_shipdate") <= day("1998-09-02"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(money("l_quantity", "sum_qty"), money("l_extendedprice", "sum_base_price"), money(revenue(), "sum_disc_price"), money(revenue() * (1 + F.col("l_tax")), "sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("count_order"))
    )


@query(
    "q2_cheapest_supplier",
    """WITH offers AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY 1, 2),
       best AS (SELECT l_partkey, min(cost) AS cost FROM offers GROUP BY 1)
       SELECT p_partkey, s_suppkey, s_name, n_name, o.cost AS cost
       FROM part JOIN best b ON p_partkey = b.l_partkey JOIN offers o ON o.l_partkey = b.l_partkey AND o.cost = b.cost
       JOIN supplier ON s_suppkey = o.l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE p_size <= 15""",
)
def q2(t):
    """Only offers of the parts asked for are aggregated, once; the least of a part is a window over that."""
    wanted = t("part").where("p_size <= 15").select("p_partkey")
    offers = t("lineitem").join(wanted, F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"))
    best = offers.withColumn("at", F.rank().over(Window.partitionBy("l_partkey").orderBy("cost"))).where("at = 1")
    suppliers = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return best.join(suppliers, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_partkey").alias("p_partkey"), "s_suppkey", "s_name", "n_name", "cost")


@query(
    "q3_shipping_priority",
    """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-06-15' AND l_shipdate > TIMESTAMP '1996-06-15'
       GROUP BY o_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderkey LIMIT 10""",
)
def q3(t):
    return (
        t("customer").where("c_mktsegment = 'BUILDING'").join(t("orders").where(F.col("o_orderdate") < day("1996-06-15")), F.col("c_custkey") == F.col("o_custkey"))
        .join(t("lineitem").where(F.col("l_shipdate") > day("1996-06-15")), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderkey", "o_orderdate", "o_orderpriority").agg(money(revenue(), "revenue"))
        .orderBy(F.desc("revenue"), "o_orderkey").limit(10)
    )


@query(
    "q4_order_priority",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders
       WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'
       AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
)
def q4(t):
    late = t("lineitem").where("l_returnflag = 'R'")
    return t("orders").where((F.col("o_orderdate") >= day("1995-01-01")) & (F.col("o_orderdate") < day("1996-01-01"))).join(late, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("order_count"))


@query(
    "q5_local_supplier_volume",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
       JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
)
def q5(t):
    """The region cuts suppliers and customers before anything of lineitem and orders is shuffled."""
    nations = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    suppliers = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    customers = t("customer").join(nations.select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_nationkey")
    bought = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = t("lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return sold.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).groupBy("n_name").agg(money(revenue(), "revenue"))


@query(
    "q6_forecast_revenue",
    """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
def q6(t):
    return t("lineitem").where((F.col("l_shipdate") >= day("1994-01-01")) & (F.col("l_shipdate") < day("1995-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)).agg(money(F.col("l_extendedprice") * F.col("l_discount"), "revenue"))


@query(
    "q7_volume_shipping",
    """SELECT sn.n_name AS supp_nation, cn.n_name AS cust_nation, cast(year(l_shipdate) AS int) AS l_year,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey
       JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation sn ON s_nationkey = sn.n_nationkey
       JOIN nation cn ON c_nationkey = cn.n_nationkey WHERE sn.n_regionkey = 1 AND cn.n_regionkey = 2 GROUP BY 1, 2, 3""",
)
def q7(t):
    sn = t("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("supp_nation"))
    cn = t("nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("cust_nation"))
    bought = t("orders").join(t("customer").join(cn, F.col("c_nationkey") == F.col("ck")), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "cust_nation")
    sold = t("lineitem").join(t("supplier").join(sn, F.col("s_nationkey") == F.col("sk")), F.col("s_suppkey") == F.col("l_suppkey"))
    return sold.join(bought, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year")).agg(money(revenue(), "revenue"))


@query(
    "q8_market_share",
    """SELECT cast(year(o_orderdate) AS int) AS o_year,
       round(sum(CASE WHEN sn.n_regionkey = 1 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
       JOIN nation sn ON sn.n_nationkey = s_nationkey WHERE p_size < 25 GROUP BY 1""",
)
def q8(t):
    rows = t("lineitem").join(t("part").where("p_size < 25"), F.col("p_partkey") == F.col("l_partkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.groupBy(F.year("o_orderdate").alias("o_year")).agg(F.round(F.sum(F.when(F.col("n_regionkey") == 1, revenue()).otherwise(0.0)) / F.sum(revenue()), 6).alias("mkt_share"))


@query(
    "q9_product_profit",
    """SELECT n_name AS nation, cast(year(o_orderdate) AS int) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity * 0.5), 2) AS profit
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
       JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""",
)
def q9(t):
    rows = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation"), F.year("o_orderdate").alias("o_year")).agg(money(revenue() - F.col("p_retailprice") * F.col("l_quantity") * 0.5, "profit"))


@query(
    "q10_returned_items",
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
       WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
def q10(t):
    return (
        t("lineitem").where("l_returnflag = 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(money(revenue(), "revenue"))
        .orderBy(F.desc("revenue"), "c_custkey").limit(20)
    )
