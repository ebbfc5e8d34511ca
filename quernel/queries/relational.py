"""Generic relational coverage: star joins, grouping sets, semi-joins and top-k reports over the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.session import small, table

CENTS = 100


def cents(c):
    """Money in whole cents, so that sums are exact."""
    return F.round(F.col(c) * CENTS).cast("long")


QUERIES = {
    "rel_pricing_summary": (
        lambda s, d: table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz'2001-01-01 00:00:00'").groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("quantity"), F.sum(cents("l_extendedprice")).alias("cents"), F.count(F.lit(1)).alias("n")),
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01' GROUP BY ALL",
    ),
    "rel_region_revenue": (
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", cents("l_extendedprice").alias("c"))
        .join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")).join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
        .join(small(table(s, d, "nation")), F.expr("c_nationkey = n_nationkey")).join(small(table(s, d, "region")), F.expr("n_regionkey = r_regionkey"))
        .groupBy("r_name", "n_name").agg(F.sum("c").alias("cents")),
        """SELECT r_name, n_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    ),
    "rel_top_orders": (
        lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("cents")).orderBy(F.desc("cents"), "l_orderkey").limit(10),
        "SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY l_orderkey ORDER BY cents DESC, l_orderkey LIMIT 10",
    ),
    "rel_late_priorities": (
        lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")),
        "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL",
    ),
    "rel_idle_customers": (
        lambda s, d: table(s, d, "customer").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("c_acctbal")).alias("cents")),
        "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY ALL",
    ),
    "rel_grouping_sets": (
        lambda s, d: table(s, d, "part").rollup("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("largest")),
        "SELECT p_brand, p_type, count(*) AS n, max(p_size) AS largest FROM part GROUP BY ROLLUP (p_brand, p_type)",
    ),
    "rel_best_supplier_per_nation": (
        lambda s, d: table(s, d, "supplier").withColumn("r", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))).where("r = 1").select("s_nationkey", "s_suppkey", "s_acctbal"),
        "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1",
    ),
    "rel_event_props": (
        lambda s, d: table(s, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")),
        "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL",
    ),
}
