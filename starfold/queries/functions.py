"""Scalar functions over whole tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from starfold.functions import scalars as S
from starfold.queries import query
from starfold.queries.retail import table


@query("select p_partkey, substring(p_name, 1, 3) as head, substring(p_name, 3, 100) as tail from part")
def fn_substring(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.substring(F.col("p_name"), 1, 3).alias("head"),
                                               S.substring(F.col("p_name"), 3, 100).alias("tail"))


@query("select doc_id, length(text) as n_chars_counted from documents")
def fn_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.length(F.col("text")).alias("n_chars_counted"))


@query("select p_partkey, upper(p_name) as upper_name from part")
def fn_upper(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.SCALARS["upper"](F.col("p_name")).alias("upper_name"))


@query("select o_orderkey, lower(o_orderpriority) as lower_priority from orders")
def fn_lower(spark, sf_dir):
    priority = S.SCALARS["lower"](F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", priority.alias("lower_priority"))


@query("select p_partkey, trim('  ' || p_name || ' ') as trimmed from part")
def fn_trim(spark, sf_dir):
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", S.SCALARS["trim"](padded).alias("trimmed"))


@query("select c_custkey, abs(c_acctbal) as balance, abs(c_nationkey - 12) as distance from customer")
def fn_abs(spark, sf_dir):
    absolute = S.SCALARS["abs"]
    return table(spark, sf_dir, "customer").select("c_custkey", absolute(F.col("c_acctbal")).alias("balance"),
                                                   absolute(F.col("c_nationkey") - 12).alias("distance"))


@query("select o_orderkey, round(o_totalprice, 0) as whole, round(o_totalprice, 1) as tenth from orders")
def fn_round(spark, sf_dir):
    price, rounded = F.col("o_totalprice"), S.SCALARS["round"]
    return table(spark, sf_dir, "orders").select("o_orderkey", rounded(price, 0).alias("whole"),
                                                 rounded(price, 1).alias("tenth"))


@query("select o_orderkey, cast(ceil(o_totalprice) as bigint) as up from orders")
def fn_ceiling(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.ceiling(F.col("o_totalprice")).alias("up"))


@query("select o_orderkey, cast(floor(o_totalprice) as bigint) as down from orders")
def fn_floor(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.floor(F.col("o_totalprice")).alias("down"))


@query("select p_partkey, sqrt(p_retailprice) as root from part")
def fn_sqrt(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.SCALARS["sqrt"](F.col("p_retailprice")).alias("root"))


@query("""
    select p_partkey, coalesce(nullif(p_type, 'ECONOMY'), nullif(p_brand, 'Brand#2'), 'none') as first_known
    from part""")
def fn_coalesce(spark, sf_dir):
    known = S.SCALARS["coalesce"](F.nullif(F.col("p_type"), F.lit("ECONOMY")),
                                  F.nullif(F.col("p_brand"), F.lit("Brand#2")), F.lit("none"))
    return table(spark, sf_dir, "part").select("p_partkey", known.alias("first_known"))


@query("select o_orderkey, nullif(o_orderstatus, 'F') as open_status from orders")
def fn_nullif(spark, sf_dir):
    status = S.SCALARS["nullif"](F.col("o_orderstatus"), F.lit("F"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("open_status"))


@query("select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d from orders")
def fn_extract(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.extract("year", day).alias("y"), S.extract("month", day).alias("m"),
        S.extract("DAY", day).alias("d"))


@query("select o_orderkey, case when nullif(o_orderstatus, 'P') = 'F' then 1 else 0 end as is_final from orders")
def fn_if(spark, sf_dir):
    final = F.nullif(F.col("o_orderstatus"), F.lit("P")) == "F"
    return table(spark, sf_dir, "orders").select("o_orderkey",
                                                 S.if_then_else(final, F.lit(1), F.lit(0)).alias("is_final"))


@query("""
    select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' end as size_class,
           case when p_size < 10 then 's' else 'l' end as size_letter
    from part""")
def fn_case(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.case([(size < 10, F.lit("small")), (size < 30, F.lit("medium"))]).alias("size_class"),
        S.case([(size < 10, F.lit("s"))], F.lit("l")).alias("size_letter"))


@query("""
    select l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) as unit_price,
           l_extendedprice / nullif(l_linenumber - 1, 0) as maybe, (l_quantity + 2) * 1.5 - l_tax as mixed
    from lineitem""")
def fn_arith(spark, sf_dir):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.divide(price, quantity).alias("unit_price"),
        S.divide(price, F.col("l_linenumber") - 1).alias("maybe"), ((quantity + 2) * 1.5 - F.col("l_tax")).alias("mixed"))


@query("select o_orderkey, nullif(o_orderstatus, 'P') || '-' || o_orderpriority as code from orders")
def fn_concat(spark, sf_dir):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return table(spark, sf_dir, "orders").select("o_orderkey",
                                                 S.concat(status, F.lit("-"), F.col("o_orderpriority")).alias("code"))


@query("""
    select o_orderkey, cast(o_orderdate + interval 1 year as date) as next_year,
           cast(o_orderdate - interval 4 year as date) as four_back
    from orders""")
def fn_add_years(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.add_years(day, 1).alias("next_year"),
                                                 S.add_years(day, -4).alias("four_back"))


@query("select o_orderkey, cast(date '2002-01-01' - cast(o_orderdate as date) as bigint) as age_days from orders")
def fn_today(spark, sf_dir):
    as_of = S.today(datetime.date(2002, 1, 1))
    age = F.date_diff(as_of, F.col("o_orderdate").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("age_days"))


@query("""
    select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'final' else 'other' end as status_name
    from orders""")
def fn_switch(spark, sf_dir):
    name = S.switch(F.col("o_orderstatus"), [("O", "open"), ("F", "final")], "other")
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("status_name"))


@query("""
    select o_orderkey, format('{:,.2f}', o_totalprice) as price_text, strftime(o_orderdate, '%Y-%m') as month_text
    from orders""")
def fn_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.format_value(F.col("o_totalprice"), "#,##0.00").alias("price_text"),
        S.format_value(F.col("o_orderdate"), "yyyy-MM").alias("month_text"))
