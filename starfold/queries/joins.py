"""Relationship joins and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.operators import joins as J
from starfold.operators.profile import date_dimension
from starfold.plans.model import Measure
from starfold.queries import query
from starfold.queries.retail import SQL_REVENUE, as_double, retail_model, table


@query("""
    select l_orderkey, l_linenumber, l_quantity, l_partkey, p_name, p_brand
    from lineitem left join (select * replace (case when p_size <= 25 then p_partkey else -p_partkey end as p_partkey) from part)
      on l_partkey = p_partkey""")
def join_m2o(spark, sf_dir):
    """Fact rows without their dimension row are kept."""
    fact = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    # The keys of large parts are changed, so that they match nothing.
    dim = table(spark, sf_dir, "part").select(
        F.expr("case when p_size <= 25 then p_partkey else -p_partkey end").alias("p_partkey"), "p_name", "p_brand")
    return J.many_to_one(fact, dim, [("l_partkey", "p_partkey")]).drop("p_partkey")


@query("""
    select c_custkey, c_name, o_custkey, n_orders
    from (select * replace (case when c_nationkey <> 3 then c_custkey else -1 - c_custkey end as c_custkey) from customer)
    full join (select o_custkey, count(*) as n_orders from orders group by o_custkey) on c_custkey = o_custkey""")
def join_1to1(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.expr("case when c_nationkey <> 3 then c_custkey else -1 - c_custkey end").alias("c_custkey"), "c_name")
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return J.one_to_one(customers, totals, [("c_custkey", "o_custkey")])


@query("""
    with offers as (select l_partkey as part, l_suppkey as supp, max(l_discount) as best_discount
                    from lineitem group by 1, 2)
    select l_linestatus, count(*) as n_lines, count(best_discount) as n_matched,
           sum(case when l_discount = best_discount then 1 else 0 end)::bigint as n_best
    from lineitem left join offers on l_partkey = part and l_suppkey = supp group by l_linestatus""")
def join_composite(spark, sf_dir):
    """All key pairs take part."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_linestatus")
    offers = lines.groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(
        F.max("l_discount").alias("best_discount"))
    joined = J.many_to_one(lines, offers, [("l_partkey", "part"), ("l_suppkey", "supp")])
    return joined.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count("best_discount").alias("n_matched"),
        F.count_if(F.col("l_discount") == F.col("best_discount")).alias("n_best"))


@query("""
    select year(o_orderdate) as order_year, case when l_shipdate <= (select max(o_orderdate) from orders)
           and l_shipdate >= (select min(o_orderdate) from orders) then year(l_shipdate) end as ship_year,
           count(*) as n_lines
    from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""")
def join_role_playing(spark, sf_dir):
    """One date dimension, once as order date and once as ship date."""
    model = retail_model(spark, sf_dir)
    days = date_dimension(table(spark, sf_dir, "orders"), "o_orderdate").select("date", "year")
    sales = model.rows("lineitem", ["lineitem.l_shipdate", "orders.o_orderdate"])
    played = J.role_playing(sales, days, {"order": [("o_orderdate", "date")], "ship": [("l_shipdate", "date")]})
    return played.groupBy("order_year", "ship_year").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""
    select c_custkey, c_name, n_name, r_name
    from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def join_snowflake(spark, sf_dir):
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    flat = J.flatten_dimension(customer, [(nation, [("c_nationkey", "n_nationkey")]),
                                          (region, [("n_regionkey", "r_regionkey")])])
    return flat.select("c_custkey", "c_name", "n_name", "r_name")


@query("""
    with sold as (select n_name, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as order_value
                  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
                  group by n_name),
    used as (select n_name, count(*) as n_events, cast(sum(cast(value as decimal(12,2))) as double) as event_value
             from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey
             group by n_name)
    select coalesce(sold.n_name, used.n_name) as n_name, order_value, n_events, event_value
    from sold full join used on sold.n_name is not distinct from used.n_name""")
def join_drill_across(spark, sf_dir):
    """Two facts through one dimension: each is aggregated before they meet."""
    df = retail_model(spark, sf_dir).query(["nation.n_name"], ["order_value", "n_events", "event_value"])
    return as_double(df, "order_value", "event_value")


@query(f"""
    select cast((select sum({SQL_REVENUE}) from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F')
                as double) as revenue,
           cast((select sum(cast(o_totalprice as decimal(12,2))) from orders where o_orderstatus = 'F') as double) as order_value""")
def filter_across_facts(spark, sf_dir):
    """A filter on one of two facts restricts the other too."""
    df = retail_model(spark, sf_dir).query((), ["revenue", "order_value"], {"orders": "o_orderstatus = 'F'"})
    return as_double(df, "revenue", "order_value")


@query("""
    select p_brand, count(*) as n_parts
    from part where exists (select 1 from lineitem join supplier on l_suppkey = s_suppkey
                            where l_partkey = p_partkey and s_acctbal > 8000)
    group by p_brand""")
def join_bridge(spark, sf_dir):
    """Parts of well-funded suppliers, through the part-supplier bridge; a part counts once."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    bridge = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    reached = J.through_bridge(part, bridge, supplier.filter("s_acctbal > 8000"), [("p_partkey", "l_partkey")],
                               [("l_suppkey", "s_suppkey")])
    return reached.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"))


@query(f"""
    select l_returnflag, cast(sum({SQL_REVENUE}) as double) as revenue, count(*) as n_lines
    from lineitem where l_orderkey in (
        select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING'))
    group by l_returnflag""")
def filter_semi(spark, sf_dir):
    """A dimension filter two steps away restricts the fact."""
    df = retail_model(spark, sf_dir).query(["lineitem.l_returnflag"], ["revenue", "n_lines"],
                                           {"customer": "c_mktsegment = 'BUILDING'"})
    return as_double(df, "revenue")


@query("""
    select c_custkey, c_name from customer where c_custkey in (
        select o_custkey from orders where o_totalprice > 450000)""")
def filter_semi_both(spark, sf_dir):
    """A fact filter restricts the dimension."""
    return retail_model(spark, sf_dir).members("customer", ["c_custkey", "c_name"],
                                               ("orders", "o_totalprice > 450000"))


@query("""
    with recursive tree(node, parent, path, level, root) as (
        select c_custkey, cast(null as bigint), cast(c_custkey as varchar), 1, c_custkey
        from customer where c_custkey // 10 = c_custkey
        union all
        select c_custkey, c_custkey // 10, path || '|' || cast(c_custkey as varchar), level + 1, root
        from customer join tree on c_custkey // 10 = node where c_custkey // 10 <> c_custkey)
    select node, parent, path, level, root from tree""")
def hierarchy_path(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_custkey div 10").alias("parent_key"))
    return J.hierarchy_paths(customers, "c_custkey", "parent_key")


@query("""
    with bands as (select p_brand, min(p_retailprice) as low, max(p_retailprice) as high from part group by p_brand)
    select p_brand, count(*) as n_customers, sum(cast(c_acctbal as decimal(12,2)))::double as balance
    from customer join bands on c_acctbal >= low and c_acctbal < high group by p_brand""")
def join_theta(spark, sf_dir):
    """Customers whose balance lies in the price band of a brand."""
    bands = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    rows = table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)").alias("exact"))
    found = J.band_totals(rows, bands, "c_acctbal", "low", "high", {"balance": "exact"}).filter("n_rows > 0")
    return found.select("p_brand", F.col("n_rows").alias("n_customers"), F.col("balance").cast("double").alias("balance"))


@query("""
    select o_orderpriority, count(*) as n_pairs, count(distinct p_brand) as n_brands
    from orders join (select p_brand, min(p_retailprice) * 100 as low, avg(p_retailprice) * 100 as high from part group by 1)
      on o_totalprice >= low and o_totalprice < high group by 1""")
def join_band(spark, sf_dir):
    """Orders and the brands whose price band they lie in, pair by pair."""
    bands = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        (F.min("p_retailprice") * 100).alias("low"), (F.avg("p_retailprice") * 100).alias("high"))
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    joined = J.band_join(orders, bands, "o_totalprice", "low", "high")
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("p_brand").alias("n_brands"))


@query("""
    select o_orderpriority, count(*) as n_late
    from lineitem join orders on l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval 90 day
    group by o_orderpriority""")
def join_theta_keyed(spark, sf_dir):
    """An equality and an inequality: lines shipped more than 90 days after their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    late = J.theta_join(lines, orders, [("l_orderkey", "o_orderkey")], "l_shipdate > o_orderdate + interval 90 days")
    return late.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_late"))


@query(f"""
    select r_name, year(o_orderdate) as year, cast(sum({SQL_REVENUE}) as double) as revenue
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def join_path(spark, sf_dir):
    """Five hops, found along the active relationships; supplier and part are never touched."""
    df = retail_model(spark, sf_dir).query(["region.r_name", "dim_date.year"], ["revenue"])
    return as_double(df, "revenue")


@query("""
    select year(o_orderdate) as o_year, year(l_shipdate) as s_year, count(*) as n_lines, sum(l_quantity) as quantity
    from lineitem left join orders on l_orderkey = o_orderkey
    where year(l_shipdate) <> 1995 and l_shipdate between (select min(o_orderdate) from orders) and (select max(o_orderdate) from orders)
    group by 1, 2""")
def role_years(spark, sf_dir):
    """One dimension in two roles in one query: the year of the order by the year of shipping."""
    return retail_model(spark, sf_dir).query(
        [("dim_date@order_date.year", "o_year"), ("dim_date@ship_date.year", "s_year")], ["n_lines", "quantity"],
        {"dim_date@ship_date": "year <> 1995"})


@query("""
    select b.n_name as customer_nation_n_name, s.n_name as supplier_nation_n_name, r.r_name, count(distinct l_partkey) as n_parts
    from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
    left join nation b on c_nationkey = b.n_nationkey left join supplier on l_suppkey = s_suppkey
    left join nation s on s_nationkey = s.n_nationkey left join region r on s.n_regionkey = r.r_regionkey group by 1, 2, 3""")
def role_nations(spark, sf_dir):
    """A dimension in two roles, one of them with the table above it; equal names get their role before them."""
    return retail_model(spark, sf_dir).query(
        ["nation@customer_nation.n_name", "nation@supplier_nation.n_name", "region@supplier_nation.r_name"],
        [Measure("n_parts", "lineitem", "countdistinct", "l_partkey")])


_TREE = """
    with recursive tree(node, top) as (
        select c_custkey, c_custkey from customer
        union all select c_custkey, top from customer join tree on c_custkey // 10 = node where c_custkey // 10 <> c_custkey)
"""


@query(_TREE + """
    select top as node, any_value(case when top // 10 <> top and exists (select 1 from customer where c_custkey = top // 10) then top // 10
        when top // 10 <> top then top // 10 end) as parent, count(*) as n_members, sum(c_acctbal::decimal(12,2))::double as balance
    from tree join customer on c_custkey = node group by top""")
def hierarchy_rollup(spark, sf_dir):
    """A measure summed over every customer and all below, in a parent-child hierarchy."""
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("c_custkey div 10").alias("parent_key"), F.col("c_acctbal").cast("decimal(12,2)").alias("own"))
    return as_double(J.hierarchy_totals(customers, "c_custkey", "parent_key", {"balance": "own"}), "balance")


@query("""
    select s_nationkey, count(*) as n_pairs, count(distinct p_partkey) as n_parts, sum(p_size)::bigint as sizes
    from supplier join part on s_acctbal / 5 > p_retailprice and s_suppkey <= p_partkey group by 1""")
def join_inequality(spark, sf_dir):
    """Two inequalities and no equality: suppliers and the parts that they could pay for five of, of no smaller number."""
    suppliers = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") / 5).alias("budget"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    joined = J.inequality_join(suppliers, parts, [("budget", ">", "p_retailprice"), ("s_suppkey", "<=", "p_partkey")])
    return joined.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("p_partkey").alias("n_parts"),
                                             F.sum("p_size").alias("sizes"))


@query("""
    with b as (select p_brand, min(p_retailprice) as low, avg(p_retailprice) as high from part group by 1),
    n as (select c_nationkey, avg(c_acctbal) / 4 as low, avg(c_acctbal) / 4 + count(*) as high from customer group by 1)
    select p_brand, c_nationkey from b join n on b.low < n.high and n.low < b.high""")
def join_intervals(spark, sf_dir):
    """Price bands of brands and balance bands of nations that overlap."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.avg("p_retailprice").alias("high"))
    least = F.avg("c_acctbal") / 4
    nations = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(least.alias("n_low"), (least + F.count(F.lit(1))).alias("n_high"))
    return J.interval_join(brands, nations, ("low", "high"), ("n_low", "n_high")).select("p_brand", "c_nationkey")
