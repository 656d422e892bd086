"""Report definitions run: read from files, bound to the retail model, their visuals over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from starfold.operators import extract as E
from starfold.plans.definitions import read_definition, report_of
from starfold.queries import query
from starfold.queries.retail import retail_model, table
from starfold.session import materialize_all

# One report for each region; its name fills the placeholder.
_REPORT = """<report xmlns="http://www.example.com/schemas/report/16.2/"><queries>
<query name="Shipments"><source><model/></source><selection>
<dataItem name="Segment" aggregate="none"><expression>[Retail].[customer].[c_mktsegment]</expression></dataItem>
<dataItem name="Ordered" aggregate="none"><expression>extract(year, [Retail].[orders].[o_orderdate])</expression></dataItem>
<dataItem name="Large" aggregate="none"><expression>if ([lineitem].[l_quantity] > 25) then ('large') else ('small')</expression></dataItem>
<dataItem name="Quantity" aggregate="total"><expression>[Retail].[lineitem].[l_quantity]</expression></dataItem>
<dataItem name="Unit price" aggregate="total"><expression>[lineitem].[l_extendedprice] / [lineitem].[l_quantity]</expression></dataItem>
<dataItem name="Orders" aggregate="countDistinct"><expression>[lineitem].[l_orderkey]</expression></dataItem>
<dataItem name="Above" aggregate="total"><expression>if ([lineitem].[l_quantity] > average([lineitem].[l_quantity] for [customer].[c_mktsegment])) then (1) else (0)</expression></dataItem>
<dataItem name="Share" aggregate="calculated"><expression>total([lineitem].[l_quantity]) / maximum(total([lineitem].[l_quantity] for report))</expression></dataItem>
<dataItem name="Gone" aggregate="none"><expression>[Retail].[lineitem].[l_nothing]</expression></dataItem>
<dataItem name="Ranked" aggregate="calculated"><expression>rank([lineitem].[l_quantity])</expression></dataItem></selection>
<detailFilters><detailFilter><filterExpression>[Retail].[region].[r_name] = '@REGION@'</filterExpression></detailFilter>
<detailFilter><filterExpression>[Segment] &lt;> 'MACHINERY'</filterExpression></detailFilter></detailFilters></query>
<query name="Large ones"><source><queryRef refQuery="Shipments"/></source><selection>
<dataItem name="Year" aggregate="none"><expression>[Shipments].[Ordered]</expression></dataItem>
<dataItem name="Lines" aggregate="count"><expression>[Segment]</expression></dataItem></selection>
<detailFilters><detailFilter><filterExpression>[Large] = 'large'</filterExpression></detailFilter></detailFilters></query></queries>
<layouts><layout><reportPages><page name="First"><contents><list refQuery="Shipments"><listColumns>
<listColumn><dataItemValue refDataItem="Segment"/></listColumn><listColumn><dataItemValue refDataItem="Nowhere"/></listColumn>
<listColumn><dataItemValue refDataItem="Unit price"/></listColumn><listColumn><dataItemValue refDataItem="Quantity"/></listColumn>
<listColumn><dataItemValue refDataItem="Orders"/></listColumn><listColumn><dataItemValue refDataItem="Above"/></listColumn>
<listColumn><dataItemValue refDataItem="Share"/></listColumn></listColumns></list>
<crosstab refQuery="Large ones"/><list/></contents></page></reportPages></layout></layouts></report>"""


def _reports(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("/reports/region-"), F.col("r_regionkey"), F.lit(".xml")).alias("path"),
        F.replace(F.lit(_REPORT), F.lit("@REGION@"), F.col("r_name")).alias("content"))


def _opened(spark, sf_dir):
    """The reports of all files, by path."""
    files = _reports(spark, sf_dir)
    queries = E.report_queries(files)
    corpus = {"items": E.report_items(queries), "joins": E.report_joins(queries), "sources": E.report_sources(queries),
              "visuals": E.report_visuals(files)}
    corpus = materialize_all(corpus, "report")
    package = retail_model(spark, sf_dir)
    return {r.path: report_of(read_definition(corpus, r.path), package) for r in files.select("path").orderBy("path").collect()}


_LINES = """
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_mktsegment <> 'MACHINERY'"""


@query(f"""
    with rows as (select '/reports/region-' || r_regionkey || '.xml' as path, * {_LINES}),
    scoped as (select l.*, a.q as segment_average, t.q as everything from rows l
        join (select c_mktsegment, avg(l_quantity) as q from lineitem left join orders on l_orderkey = o_orderkey
              left join customer on o_custkey = c_custkey group by 1) a using (c_mktsegment)
        cross join (select sum(l_quantity) as q from lineitem) t)
    select path, 'table' as kind, c_mktsegment as label, round(sum(l_extendedprice) / sum(l_quantity), 6) as unit_price,
           sum(l_quantity) as quantity, count(distinct l_orderkey) as n_orders,
           sum(case when l_quantity > segment_average then 1 else 0 end)::bigint as n_above, round(sum(l_quantity) / max(everything), 9) as share
    from scoped group by 1, 3
    union all
    select path, 'matrix', year(o_orderdate)::varchar, null, null, count(*), null, null from rows where l_quantity > 25 group by 1, 3""")
def report_to_result(spark, sf_dir):
    """Reports read from their files, made models of, and their visuals run over the given tables."""
    frames = []
    for path, report in _opened(spark, sf_dir).items():
        shown = report.frames()
        listing, matrix = shown[1, 1], shown[1, 2]
        none = lambda kind: F.lit(None).cast(kind)
        frames.append(listing.select(
            F.lit(path).alias("path"), F.lit("table").alias("kind"), F.col("Segment").alias("label"), F.round("Unit price", 6).alias("unit_price"),
            F.col("Quantity").alias("quantity"), F.col("Orders").alias("n_orders"), F.col("Above").alias("n_above"), F.round("Share", 9).alias("share")))
        frames.append(matrix.select(
            F.lit(path).alias("path"), F.lit("matrix").alias("kind"), F.col("Year").cast("string").alias("label"), none("double").alias("unit_price"),
            none("double").alias("quantity"), F.col("Lines").alias("n_orders"), none("long").alias("n_above"), none("double").alias("share")))
    return reduce(DataFrame.unionByName, frames)


@query("""
    select '/reports/region-' || r_regionkey || '.xml' as path, query, code, source_ref from region, (values
        ('Shipments', 'reference-unbound', '[Retail].[lineitem].[l_nothing]'), ('Shipments', 'measure-needs-review', 'rank([lineitem].[l_quantity])'),
        ('', 'visual-unbound', 'First')) f(query, code, source_ref)""")
def report_to_findings(spark, sf_dir):
    """What of the reports could not be bound, or is not understood."""
    rows = [(path, f["query"], f["code"], f["source_ref"]) for path, report in _opened(spark, sf_dir).items() for f in report.findings]
    return spark.createDataFrame(rows, "path string, query string, code string, source_ref string")
