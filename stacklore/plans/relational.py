"""Relational coverage on the star schema: joins, grouping sets, windows, set operations, top-k for each group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, table


def _sum(column, name):
    return F.round(F.sum(column), 2).alias(name)


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def star_pricing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(_sum("l_quantity", "qty"), _sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), "revenue"), F.count("*").alias("n"))


@query("""
SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_region_sales(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    # customers are counted before the join: one row for each, with its orders' sum
    by_customer = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("c"))
    joined = by_customer.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(_sum("s", "total"), F.sum("c").alias("orders"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def star_semi_join(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def star_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT coalesce(c_nationkey, s_nationkey) AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers
FROM (SELECT * FROM customer WHERE c_acctbal > 9000) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON c_nationkey = s_nationkey GROUP BY ALL""")
def star_full_join(spark, sf_dir):
    count = lambda n, k, o: table(spark, sf_dir, n).where(f"{n[0]}_acctbal > 9000").groupBy(F.col(k).alias("nation")).agg(F.count("*").alias(o))
    both = count("customer", "c_nationkey", "customers").join(count("supplier", "s_nationkey", "suppliers"), "nation", "full_outer")
    return both.select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


_GROUPED = "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY {}"


@query(_GROUPED.format("ROLLUP (o_orderstatus, o_orderpriority)"))
def star_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(_sum("o_totalprice", "total"), F.count("*").alias("n"))


@query(_GROUPED.format("CUBE (o_orderstatus, o_orderpriority)"))
def star_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(_sum("o_totalprice", "total"), F.count("*").alias("n"))


@query(_GROUPED.format("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
def star_grouping_sets(spark, sf_dir):
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return table(spark, sf_dir, "orders").groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(_sum("o_totalprice", "total"), F.count("*").alias("n"))


@query("""
SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def star_topk_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("""
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def star_running_total(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier")
def star_intersect(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    return rich.intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def star_except(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).subtract(rich)


@query("SELECT c_custkey AS id, 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier")
def star_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    return customers.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance")))


@query("""
SELECT p_brand, count(DISTINCT l_orderkey) AS orders, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY p_brand""")
def star_part_orders(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size < 10")
    joined = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.count_distinct("l_orderkey").alias("orders"), _sum("l_quantity", "qty"))


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type""")
def events_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def star_pivot(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return wide.select("o_orderpriority", *[F.col(x).alias(x.lower()) for x in "FOP"])
