"""Scans, projections and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from starfold.functions.names import clean_label, safe_names as unique_names
from starfold.functions.types import cast_to
from starfold.plans.model import Measure, Table, with_calculated
from starfold.queries import query
from starfold.queries.retail import as_double, retail_model, table
from starfold.session import shared_folder
from starfold.sources import tables as sources


@query("select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("""
    select p_brand, cast(0 as double) as budget, 0 as n_budget_rows
    from part group by p_brand""")
def scan_empty(spark, sf_dir):
    """A table without a source yet joins as a typed table without rows."""
    empty = sources.EmptySource({"budget": [("brand", "varchar(20)"), ("amount", "decimal(18,2)")]})
    budget = empty.read(spark, "budget")
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    joined = brands.join(budget, F.col("p_brand") == F.col("brand"), "left")
    return joined.groupBy("p_brand").agg(
        F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("budget"),
        F.count("brand").cast("int").alias("n_budget_rows"))


@query("select n_nationkey, n_name, n_regionkey, r_name from nation join region on n_regionkey = r_regionkey")
def refresh_snapshot(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    flat = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}/nation"
    sources.refresh_snapshot(nation, path)  # an older snapshot, replaced by the next line
    return sources.refresh_snapshot(flat.select("n_nationkey", "n_name", "n_regionkey", "r_name"), path)


@query("select p_partkey as part_key, p_name as product_name, p_retailprice as list_price from part")
def project_rename(spark, sf_dir):
    return sources.project_model_columns(table(spark, sf_dir, "part"), [
        ("p_partkey", "part_key"), ("p_name", "product_name"), ("p_retailprice", "list_price")])


@query("select o_orderdate, o_orderkey, o_totalprice from orders")
def project_list(spark, sf_dir):
    shown = ["o_orderdate", "o_orderkey", "no_such_column", "o_orderdate", "o_totalprice"]
    return sources.project_list(table(spark, sf_dir, "orders"), shown)


@query("""
    select l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
    from lineitem""")
def project_visible(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return Table(lineitem, hidden=["l_orderkey", "l_partkey", "l_suppkey"]).visible()


@query("""
    select o_orderkey, cast(o_orderdate as date) as order_day, cast(o_totalprice as bigint) as whole_price,
           cast(o_orderkey as varchar) as order_text, try_cast(left(o_orderpriority, 1) as bigint) as priority,
           try_cast(o_orderpriority as bigint) as not_a_number,
           cast(cast(o_totalprice as decimal(18,1)) as double) as rounded_price
    from (select o_orderkey, o_orderdate, floor(o_totalprice) as floor_price, o_totalprice, o_orderpriority
          from orders)""".replace("cast(o_totalprice as bigint)", "cast(floor_price as bigint)"))
def cast_columns(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        cast_to(F.col("o_orderdate"), "date").alias("order_day"),
        cast_to(F.col("o_totalprice"), "int64").alias("whole_price"),
        cast_to(F.col("o_orderkey"), "nvarchar(20)").alias("order_text"),
        cast_to(F.substring("o_orderpriority", 1, 1), "integer").alias("priority"),
        cast_to(F.col("o_orderpriority"), "integer").alias("not_a_number"),
        cast_to(F.col("o_totalprice"), "decimal(18,1)").cast("double").alias("rounded_price"),
    )


@query("""
    select o_orderkey, upper(o_orderpriority) as priority_name, year(o_orderdate) as order_year,
           o_orderstatus, o_orderstatus as kept_status
    from orders""")
def calc_column(spark, sf_dir):
    """The last calculation is not understood: its physical column stays, and there is one finding."""
    orders = table(spark, sf_dir, "orders").withColumn("kept_status", F.col("o_orderstatus"))
    calculated, findings = with_calculated(orders, {
        "priority_name": "upper(o_orderpriority)",
        "order_year": "cast(year(o_orderdate) as bigint)",
        "kept_status": "no_such_function(o_orderstatus)",
    })
    assert [f["code"] for f in findings] == ["calculation-needs-review"]
    return calculated.select("o_orderkey", "priority_name", "order_year", "o_orderstatus", "kept_status")


@query("""
    select l_returnflag, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as price, count(*) as n_lines
    from lineitem where l_linestatus = 'F' and l_shipdate >= date '1998-01-01' group by l_returnflag""")
def detail_filter(spark, sf_dir):
    model = retail_model(spark, sf_dir)
    price = Measure("price", "lineitem", "sum", "price")
    df = model.query(["lineitem.l_returnflag"], [price, "n_lines"],
                     {"lineitem": "l_linestatus = 'F' and l_shipdate >= timestamp_ntz'1998-01-01'"})
    return as_double(df, "price")


@query("""
    select o_orderkey, o_totalprice > 250000 as is_big, o_orderstatus <> 'F' as is_open,
           o_totalprice >= 1000 and o_totalprice <= 50000 as is_small,
           not (o_orderstatus = 'O' or o_orderpriority < '3') as is_other,
           o_totalprice < 100000 and true as is_cheap
    from orders""")
def predicates(spark, sf_dir):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (price > 250000).alias("is_big"),
        (status != "F").alias("is_open"),
        ((price >= 1000) & (price <= 50000)).alias("is_small"),
        (~((status == "O") | (F.col("o_orderpriority") < "3"))).alias("is_other"),
        ((price < 100000) & F.lit(True)).alias("is_cheap"),
    )


@query("""
    select c_mktsegment, count(*) as n_customers, cast(sum(spent) as double) as spent
    from (select o_custkey, sum(cast(o_totalprice as decimal(12,2))) as spent from orders group by o_custkey) q
    join customer on o_custkey = c_custkey where spent > 2000000 group by c_mktsegment""")
def derived_query(spark, sf_dir):
    """A query over the result of another query."""
    spent = (table(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("spent")))
    customer = table(spark, sf_dir, "customer")
    joined = spent.filter("spent > 2000000").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers"),
                                              F.sum("spent").cast("double").alias("spent"))


@query("""
    select p_partkey as PartNo, p_name as Name, p_brand as Name2, p_type as _1stType, p_size as Name3, p_retailprice as _
    from part""")
def safe_names(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return part.toDF(*unique_names(["Part No.", "Name", "Na-me", "1st Type", "N a m e", "%"]))


@query(r"""
    select p_partkey, case when p_partkey % 7 = 0 then 'Unnamed' else p_name || ' ' || p_type end as label
    from part""")
def clean_labels(spark, sf_dir):
    messy = F.when(F.col("p_partkey") % 14 == 0, F.lit(" \t\n ")).when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("  "), F.regexp_replace("p_name", " ", " \n\t "), F.lit("\t \n"), "p_type", F.lit("\n")))
    return table(spark, sf_dir, "part").select("p_partkey", clean_label(messy).alias("label"))


@query("""
    select 'customer' as table_name, count(*) as n_rows from customer
    union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem
    union all select 'events', count(*) from events""")
def table_counts(spark, sf_dir):
    return sources.table_counts({name: table(spark, sf_dir, name)
                                 for name in ("customer", "orders", "lineitem", "events")})
