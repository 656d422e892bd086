"""Measures, running measures and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.operators import windows
from starfold.plans.model import Measure
from starfold.operators.visuals import Visual, visual_frame
from starfold.queries import query
from starfold.queries.retail import REVENUE, SQL_REVENUE, as_double, retail_model, table

_BY_REGION = """
    from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey group by r_name"""
_BY_BRAND = "from lineitem join part on l_partkey = p_partkey group by p_brand"


def _by_region(spark, sf_dir, *measures):
    return retail_model(spark, sf_dir).query(["region.r_name"], measures, use=["supplier_nation"])


def _by_brand(spark, sf_dir, *measures):
    return retail_model(spark, sf_dir).query(["part.p_brand"], measures)


@query(f"""
    select r_name, cast(sum({SQL_REVENUE}) as double) as revenue, count(distinct l_orderkey) as n_orders,
           round(avg(l_quantity), 6) as avg_quantity {_BY_REGION}""")
def region_revenue(spark, sf_dir):
    """Flagship: revenue, orders and average quantity by region of the supplier."""
    df = _by_region(spark, sf_dir, "revenue", "n_orders", "avg_quantity")
    return as_double(df, "revenue").withColumn("avg_quantity", F.round("avg_quantity", 6))


@query(f"select r_name, cast(sum({SQL_REVENUE}) as double) as revenue, sum(l_quantity) as quantity {_BY_REGION}")
def measure_sum(spark, sf_dir):
    return as_double(_by_region(spark, sf_dir, "revenue", "quantity"), "revenue")


@query(f"select p_brand, round(avg(l_quantity), 6) as avg_quantity {_BY_BRAND}")
def measure_avg(spark, sf_dir):
    return _by_brand(spark, sf_dir, "avg_quantity").withColumn("avg_quantity", F.round("avg_quantity", 6))


@query(f"select p_brand, min(l_extendedprice) as lowest, min(l_shipdate) as first_shipped {_BY_BRAND}")
def measure_min(spark, sf_dir):
    return _by_brand(spark, sf_dir, Measure("lowest", "lineitem", "min", "l_extendedprice"),
                     Measure("first_shipped", "lineitem", "min", "l_shipdate"))


@query(f"select p_brand, max(l_extendedprice) as highest, max(l_shipdate) as last_shipped {_BY_BRAND}")
def measure_max(spark, sf_dir):
    return _by_brand(spark, sf_dir, Measure("highest", "lineitem", "max", "l_extendedprice"),
                     Measure("last_shipped", "lineitem", "max", "l_shipdate"))


@query(f"select p_brand, count(nullif(l_returnflag, 'N')) as n_returned {_BY_BRAND}")
def measure_count(spark, sf_dir):
    return _by_brand(spark, sf_dir, Measure("n_returned", "lineitem", "count", "nullif(l_returnflag, 'N')"))


@query(f"""
    select r_name, count(distinct l_orderkey) as n_orders, count(distinct nullif(l_returnflag, 'N')) as n_flags
    {_BY_REGION}""")
def measure_distinct(spark, sf_dir):
    return _by_region(spark, sf_dir, "n_orders",
                      Measure("n_flags", "lineitem", "countdistinct", "nullif(l_returnflag, 'N')"))


@query(f"""
    select p_brand, cast(sum(cast(l_extendedprice as decimal(12,2))) - sum(cast(l_discount as decimal(12,2))) as double)
           as net {_BY_BRAND}""")
def measure_arith(spark, sf_dir):
    return as_double(_by_brand(spark, sf_dir, Measure("net", "lineitem", "sum", "price - discount")), "net")


@query(f"""
    select p_brand, round(cast(sum(cast(l_extendedprice as decimal(12,2))) as double)
                          / nullif(sum(l_quantity), 0), 6) as unit_price {_BY_BRAND}""")
def measure_ratio(spark, sf_dir):
    """A ratio of sums, not a sum of ratios."""
    df = _by_brand(spark, sf_dir, Measure("unit_price", "lineitem", "sum", "price / l_quantity"))
    return df.withColumn("unit_price", F.round("unit_price", 6))


@query(f"""
    select p_brand, cast(sum(case when l_returnflag = 'R' then {SQL_REVENUE} else 0 end) as double) as returned,
           round(avg(l_extendedprice / nullif(l_quantity, 0)), 6) as mean_unit_price {_BY_BRAND}""")
def measure_row_expr(spark, sf_dir):
    df = _by_brand(
        spark, sf_dir,
        Measure("returned", "lineitem", "sum", f"case when l_returnflag = 'R' then {REVENUE} else 0 end"),
        Measure("mean_unit_price", "lineitem", "average", "try_divide(l_extendedprice, l_quantity)", per_row=True))
    return as_double(df, "returned").withColumn("mean_unit_price", F.round("mean_unit_price", 6))


@query(f"""
    select p_brand, sum(l_quantity) as l_quantity, round(avg(l_discount), 6) as l_discount, max(l_tax) as l_tax,
           count(distinct l_suppkey) as l_suppkey {_BY_BRAND}""")
def summarize_by(spark, sf_dir):
    """Plain columns in a value role are aggregated by their own default."""
    visual = Visual("column", {"categories": ["part.p_brand"], "values": [
        "lineitem.l_quantity", "lineitem.l_discount", "lineitem.l_tax", "lineitem.l_suppkey"]})
    return visual_frame(retail_model(spark, sf_dir), visual).withColumn("l_discount", F.round("l_discount", 6))


@query(f"""
    select p_brand, cast(sum({SQL_REVENUE}) as double) / nullif(count(distinct l_orderkey), 0) as revenue_per_order
    {_BY_BRAND}""".replace("cast(sum", "round(cast(sum").replace(" as revenue_per", ", 6) as revenue_per"))
def measure_calculated(spark, sf_dir):
    df = _by_brand(spark, sf_dir, Measure(
        "revenue_per_order", "lineitem", "calculated",
        f"try_divide(cast(sum({REVENUE}) as double), count(distinct l_orderkey))"))
    return df.withColumn("revenue_per_order", F.round("revenue_per_order", 6))


def _line_brands(spark, sf_dir):
    return retail_model(spark, sf_dir).rows("lineitem", ["part.p_brand", "lineitem.l_extendedprice"])


@query(f"select p_brand, round(median(l_extendedprice), 6) as median_price {_BY_BRAND}")
def measure_median(spark, sf_dir):
    df = windows.percentiles(_line_brands(spark, sf_dir), "l_extendedprice", {"median_price": 0.5}, ["p_brand"])
    return df.withColumn("median_price", F.round("median_price", 6))


@query(f"""
    select p_brand, round(quantile_cont(l_extendedprice, 0.9), 6) as p90, round(quantile_cont(l_extendedprice, 0.25), 6)
           as p25 {_BY_BRAND}""")
def measure_percentile(spark, sf_dir):
    df = windows.percentiles(_line_brands(spark, sf_dir), "l_extendedprice", {"p90": 0.9, "p25": 0.25}, ["p_brand"])
    return df.withColumns({"p90": F.round("p90", 6), "p25": F.round("p25", 6)})


@query(f"select p_brand, round(stddev_samp(l_quantity), 6) as spread {_BY_BRAND}")
def measure_stddev(spark, sf_dir):
    df = _by_brand(spark, sf_dir, Measure("spread", "lineitem", "stddev", "l_quantity"))
    return df.withColumn("spread", F.round("spread", 6))


@query(f"select p_brand, round(var_samp(l_quantity), 6) as variance {_BY_BRAND}")
def measure_variance(spark, sf_dir):
    df = _by_brand(spark, sf_dir, Measure("variance", "lineitem", "variance", "l_quantity"))
    return df.withColumn("variance", F.round("variance", 6))


@query(f"select p_brand, count(*) as n_lines {_BY_BRAND}")
def measure_rowcount(spark, sf_dir):
    return _by_brand(spark, sf_dir, "n_lines")


@query("""
    select c_custkey, order_value, rank() over (order by order_value desc) as value_rank
    from (select c_custkey, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as order_value
          from orders join customer on o_custkey = c_custkey group by c_custkey)""")
def measure_rank(spark, sf_dir):
    by_customer = retail_model(spark, sf_dir).query(["customer.c_custkey"], ["order_value"])
    return windows.rank(as_double(by_customer, "order_value"), "order_value", "value_rank")


@query("""
    select o_orderkey, o_orderstatus,
           count(nullif(o_orderpriority, '5-LOW')) over (order by o_orderkey rows unbounded preceding) as n_so_far,
           count(*) over (partition by o_orderstatus order by o_orderkey rows unbounded preceding) as n_in_status
    from orders""")
def running_count(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    df = windows.running(orders, ["o_orderkey"], counts={"n_so_far": "priority"})
    df = windows.running(df, ["o_orderkey"], counts={"n_in_status": "o_orderkey"}, partition_by=["o_orderstatus"])
    return df.drop("priority")


@query("""
    select r_name, day, cast(value as double) as value,
           cast(sum(value) over (partition by r_name order by day rows unbounded preceding) as double) as to_date
    from (select r_name, cast(o_orderdate as date) as day, sum(cast(o_totalprice as decimal(12,2))) as value
          from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
          join region on n_regionkey = r_regionkey group by 1, 2)""")
def running_total(spark, sf_dir):
    daily = retail_model(spark, sf_dir).query([("dim_date.date", "day"), "region.r_name"], ["order_value"])
    daily = daily.withColumnRenamed("order_value", "value")
    df = windows.running(daily, ["day"], totals={"to_date": "value"}, partition_by=["r_name"])
    return as_double(df, "value", "to_date").select("r_name", "day", "value", "to_date")


@query("""
    select c_custkey, c_name, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as order_value
    from orders join customer on o_custkey = c_custkey group by c_custkey, c_name
    order by order_value desc, c_custkey limit 10""")
def top_k(spark, sf_dir):
    df = retail_model(spark, sf_dir).query(["customer.c_custkey", "customer.c_name"], ["order_value"])
    return as_double(df.orderBy(F.desc("order_value"), "c_custkey").limit(10), "order_value")
