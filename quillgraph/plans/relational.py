"""Plain relational shapes over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Query, table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of line items by flag and status."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def top_customers(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The customers with the largest orders in each market segment."""
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rows = table(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"))
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("spent"), "c_custkey"))
    return rows.select("c_mktsegment", "c_custkey", "spent", place.alias("place")).where(F.col("place") <= k)


def regional_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of suppliers' line items by region and nation."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    per = li.groupBy("l_suppkey").agg(F.sum("revenue").alias("revenue"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = per.join(s, per.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("suppliers"))


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of 1997 or later, by segment."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (pricing_summary, top_customers, regional_revenue, idle_customers)}
SQL = {
    "pricing_summary": """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
      from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
    "top_customers": """with s as (select o_custkey, round(sum(o_totalprice), 2) as spent from orders group by 1)
      select * from (select c_mktsegment, c_custkey, spent, row_number() over (partition by c_mktsegment order by spent desc, c_custkey)::int as place from customer join s on c_custkey = o_custkey) where place <= 5""",
    "regional_revenue": """with p as (select l_suppkey, sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem group by 1)
      select r_name, n_name, round(sum(revenue), 2) as revenue, count(*) as suppliers from p join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""",
    "idle_customers": "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '1997-01-01') group by 1",
}
