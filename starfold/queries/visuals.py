"""Report visuals over the retail model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from starfold.operators.visuals import Visual, matrix_cells, page_frames, paginated_list as detail_list, visual_frame
from starfold.queries import query
from starfold.queries.retail import SQL_REVENUE, as_double, retail_model

_SEGMENT_YEAR = """
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"""


@query(f"""
    select c_mktsegment, n_name, cast(sum({SQL_REVENUE}) as double) as revenue, count(*) as n_lines
    {_SEGMENT_YEAR} join nation on c_nationkey = n_nationkey group by 1, 2""")
def visual_table(spark, sf_dir):
    visual = Visual("list", {"columns": ["customer.c_mktsegment", "nation.n_name", "revenue", "n_lines"]})
    return as_double(visual_frame(retail_model(spark, sf_dir), visual), "revenue")


_YEARS = range(1995, 2002)  # all that the tables hold


@query(f"""
    select c_mktsegment, {', '.join(f'cast(sum({SQL_REVENUE}) filter (where year(o_orderdate) = {y}) as double) as "{y}"' for y in _YEARS)}
    {_SEGMENT_YEAR} group by 1""")
def visual_matrix(spark, sf_dir):
    """The years of the data become columns."""
    visual = Visual("crosstab", {"rows": ["customer.c_mktsegment"], "columns": ["dim_date.year"], "values": ["revenue"]})
    matrix = visual_frame(retail_model(spark, sf_dir), visual)
    return as_double(matrix, *[c for c in matrix.columns if c != "c_mktsegment"])


_STATES = {f"{a} | {b}": (a, b) for a in "ANR" for b in "FO"} | {f"{a} | total": (a, None) for a in "ANR"} | {"total": (None, None)}


def _state_sql(flag, status) -> str:
    told = [f"{c} = '{v}'" for c, v in (("l_returnflag", flag), ("l_linestatus", status)) if v]
    return f"(where {' and '.join(told) or 'true'})"


@query("select r_name, n_name, (grouping(r_name) + grouping(n_name))::int as row_level, " + ", ".join(
    f'round(avg(l_quantity) filter {_state_sql(*s)}, 6) as "{n}_avg_quantity", nullif(count(distinct l_orderkey) filter {_state_sql(*s)}, 0) as "{n}_n_orders"'
    for n, s in _STATES.items()) + """
    from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    group by grouping sets ((r_name, n_name), (r_name), ())""")
def visual_matrix_levels(spark, sf_dir):
    """Two fields in rows and two in columns, with subtotals of measures that cannot be added up."""
    visual = Visual("crosstab", {"rows": ["region.r_name", "nation.n_name"], "columns": ["lineitem.l_returnflag", "lineitem.l_linestatus"],
                                 "values": ["avg_quantity", "n_orders"]}, use=["supplier_nation"], totals=True)
    matrix = visual_frame(retail_model(spark, sf_dir), visual)
    return matrix.withColumns({f"{n}_avg_quantity": F.round(F.col(f"`{n}_avg_quantity`"), 6) for n in _STATES})


@query(f"""
    select r_name, grouping(r_name)::int as row_level, cast(sum({SQL_REVENUE}) as double) as revenue
    from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    group by grouping sets ((r_name), ())""")
def visual_matrix_rows(spark, sf_dir):
    """A matrix without fields in columns."""
    visual = Visual("crosstab", {"rows": ["region.r_name"], "values": ["revenue"]}, use=["supplier_nation"], totals=True)
    return as_double(visual_frame(retail_model(spark, sf_dir), visual), "revenue")


def _with_unlabelled(spark, sf_dir):
    """The retail model with a label on lines that is null for one of its values."""
    model = retail_model(spark, sf_dir)
    lines = model.tables["lineitem"]
    model.tables["lineitem"] = replace(lines, calculated={**lines.calculated, "flag": "nullif(l_returnflag, 'R')"})
    return model


@query(f"""
    select l_linestatus, cast(sum({SQL_REVENUE}) filter (where l_returnflag = 'A') as double) as "A",
           cast(sum({SQL_REVENUE}) filter (where l_returnflag = 'N') as double) as "N",
           cast(sum({SQL_REVENUE}) filter (where l_returnflag = 'R') as double) as "null"
    from lineitem group by 1""")
def visual_matrix_null(spark, sf_dir):
    """Null is a column like any other."""
    visual = Visual("crosstab", {"rows": ["lineitem.l_linestatus"], "columns": ["lineitem.flag"], "values": ["revenue"]})
    return as_double(visual_frame(_with_unlabelled(spark, sf_dir), visual), "A", "N", "null")


@query(f"""
    select l_linestatus, nullif(l_returnflag, 'R') as flag, cast(sum({SQL_REVENUE}) as double) as revenue
    from lineitem group by 1, 2""")
def visual_matrix_cells(spark, sf_dir):
    """A matrix in long form."""
    visual = Visual("crosstab", {"rows": ["lineitem.l_linestatus"], "columns": ["lineitem.flag"], "values": ["revenue"]})
    return as_double(matrix_cells(_with_unlabelled(spark, sf_dir), visual), "revenue")


@query("select c_name, o_orderkey from orders left join customer on o_custkey = c_custkey")
def visual_list_any_order(spark, sf_dir):
    """A list whose first column is of the dimension: rows are those of the table that reaches all others."""
    return visual_frame(retail_model(spark, sf_dir), Visual("list", {"columns": ["customer.c_name", "orders.o_orderkey"]}))


@query("""
    select o_orderpriority, o_custkey, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as o_totalprice
    from orders group by 1, 2""")
def visual_default_aggregates(spark, sf_dir):
    """Of plain columns in values, numbers are summed, but neither keys nor text."""
    model = retail_model(spark, sf_dir)
    orders = model.tables["orders"]
    model.tables["orders"] = replace(orders, source=orders.rows().withColumn("o_totalprice", F.expr("cast(o_totalprice as decimal(12,2))")))
    visual = Visual("bar", {"values": ["orders.o_totalprice", "orders.o_custkey", "orders.o_orderpriority"]})
    return as_double(visual_frame(model, visual), "o_totalprice")


@query("select cast(null as double) as revenue, 0::bigint as n_lines, 0::bigint as n_orders")
def visual_card_empty(spark, sf_dir):
    """Nothing selected: counts are 0, sums null."""
    visual = Visual("kpi", {"values": ["revenue", "n_lines", "n_orders"]}, filters={"customer": "c_custkey < 0"})
    return as_double(visual_frame(retail_model(spark, sf_dir), visual), "revenue")


@query(f"""
    select p_type, l_returnflag, cast(sum({SQL_REVENUE}) as double) as revenue
    from lineitem join part on l_partkey = p_partkey group by 1, 2""")
def visual_column(spark, sf_dir):
    visual = Visual("stacked_column", {"categories": ["part.p_type"], "color": ["lineitem.l_returnflag"],
                                       "values": ["revenue"]})
    return as_double(visual_frame(retail_model(spark, sf_dir), visual), "revenue")


@query("""
    select year(o_orderdate) * 100 + month(o_orderdate) as year_month,
           cast(sum(cast(o_totalprice as decimal(12,2))) as double) as order_value
    from orders group by 1 order by 1""")
def visual_line(spark, sf_dir):
    visual = Visual("line", {"x": ["dim_date.year_month"], "y": ["order_value"]})
    return as_double(visual_frame(retail_model(spark, sf_dir), visual), "order_value")


@query("""
    select event_type, count(*) as n_events from events group by 1""")
def visual_pie(spark, sf_dir):
    return visual_frame(retail_model(spark, sf_dir),
                        Visual("donut", {"category": ["events.event_type"], "size": ["n_events"]}))


@query(f"""
    select cast(sum({SQL_REVENUE}) as double) as revenue, count(*) as n_lines,
           count(distinct l_orderkey) as n_orders from lineitem""")
def visual_card(spark, sf_dir):
    visual = Visual("kpi", {"values": ["revenue", "n_lines", "n_orders"]})
    return as_double(visual_frame(retail_model(spark, sf_dir), visual), "revenue")


@query(f"""
    select p_brand, p_type, l_linestatus, cast(sum({SQL_REVENUE}) as double) as revenue, sum(l_quantity) as l_quantity
    from lineitem join part on l_partkey = p_partkey group by 1, 2, 3""")
def visual_slots(spark, sf_dir):
    """Slots of many names end up as category, series and values; a plain value column is summed."""
    visual = Visual("bar", {"ordinal": ["part.p_brand"], "rows": ["part.p_type"], "series": ["lineitem.l_linestatus"],
                            "length": ["revenue"], "size": ["lineitem.l_quantity"]})
    return as_double(visual_frame(retail_model(spark, sf_dir), visual), "revenue")


@query("""
    select o_orderdate, o_orderkey, c_name, o_totalprice from orders left join customer on o_custkey = c_custkey
    where o_orderstatus = 'P' order by o_orderdate, o_orderkey""")
def paginated_list(spark, sf_dir):
    return detail_list(retail_model(spark, sf_dir), "orders",
                       ["orders.o_orderdate", "orders.o_orderkey", "customer.c_name", "orders.o_totalprice"],
                       {"orders": "o_orderstatus = 'P'"}, ["o_orderdate", "o_orderkey"])


@query(f"""
    select 'sales_by_region' as visual, r_name as label, cast(sum({SQL_REVENUE}) as double) as value
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name
    union all
    select 'events_by_segment', c_mktsegment, count(*)::double from events join customer on user_id = c_custkey
    group by c_mktsegment
    union all
    select 'total_quantity', '', sum(l_quantity) from lineitem""")
def dashboard_page(spark, sf_dir):
    """Three visuals of one page, stacked to be compared."""
    frames = page_frames(retail_model(spark, sf_dir), {
        "sales_by_region": Visual("column", {"categories": ["region.r_name"], "values": ["revenue"]}),
        "events_by_segment": Visual("pie", {"categories": ["customer.c_mktsegment"], "values": ["n_events"]}),
        "total_quantity": Visual("summary", {"values": ["quantity"]}),
    })
    stacked = None
    for name, df in frames.items():
        label = F.col(df.columns[0]) if len(df.columns) > 1 else F.lit("")
        rows = df.select(F.lit(name).alias("visual"), label.alias("label"), F.col(df.columns[-1]).cast("double").alias("value"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked


@query(f"""
    select 'by_brand_and_flag' as visual, p_brand || l_returnflag as label, cast(sum({SQL_REVENUE}) as double) as value
    from lineitem join part on l_partkey = p_partkey group by p_brand, l_returnflag
    union all select 'by_brand', p_brand, round(avg(l_quantity), 6) from lineitem join part on l_partkey = p_partkey group by p_brand
    union all select 'by_flag', l_returnflag, count(*) from lineitem group by l_returnflag
    union all select 'all', '', cast(sum({SQL_REVENUE}) as double) from lineitem
    union all select 'orders', '', count(distinct l_orderkey) from lineitem""")
def dashboard_shared(spark, sf_dir):
    """Five visuals of one fact; the four that can be merged share one scan of it."""
    frames = page_frames(retail_model(spark, sf_dir), {
        "by_brand_and_flag": Visual("column", {"categories": ["part.p_brand"], "series": ["lineitem.l_returnflag"], "values": ["revenue"]}),
        "by_brand": Visual("pie", {"categories": ["part.p_brand"], "values": ["avg_quantity"]}),
        "by_flag": Visual("table", {"rows": ["lineitem.l_returnflag"], "values": ["n_lines"]}),
        "all": Visual("kpi", {"values": ["revenue"]}), "orders": Visual("kpi", {"values": ["n_orders"]})})
    stacked = None
    for name, df in frames.items():
        label = F.concat_ws("", *df.columns[:-1]) if len(df.columns) > 1 else F.lit("")
        rows = df.select(F.lit(name).alias("visual"), label.alias("label"), F.round(F.col(df.columns[-1]).cast("double"), 6).alias("value"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked
