"""Definition files: scan, classify, extract, rewrite and cover.

The files are derived from the given tables: a data module per part, a framework model per supplier, a
report and a dashboard per customer, and a few unreadable files per nation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from starfold.functions import expressions as X, names as N
from starfold.functions.types import normalize_type
from starfold.operators import coverage as C, extract as E, rules as R
from starfold.queries import query
from starfold.queries.retail import spread, table
from starfold.session import materialize, shared_folder
from starfold.sources import artifacts as A
from starfold.sources.tables import read_snapshot

# ------------------------------------------------------------------ derived artifacts

_AGGREGATES = ["total", "average", "countDistinct", "automatic", ""]


def _modules(spark, sf_dir) -> DataFrame:
    def item(label, datatype, usage, aggregate="cast(null as string)", expression="cast(null as string)"):
        return (f"named_struct('queryItem', named_struct('label', {label}, 'datatype', '{datatype}', 'usage', '{usage}', "
                f"'regularAggregate', {aggregate}, 'expression', {expression}))")

    link = lambda column: f"""named_struct('leftRef', '[Lines].[{column}]', 'rightRef', array(p_brand, '{column}'))"""
    aggregate = f"element_at(array({', '.join(map(repr, _AGGREGATES))}), cast(p_size % 5 + 1 as int))"
    ratio = "case when p_size % 10 = 0 then '[Lines].[Paid] / [Lines].[Pieces]' end"
    text = f"""to_json(named_struct(
        'label', concat('Module ', p_partkey),
        'querySubject', array(
            named_struct('label', 'Lines', 'item', array(
                {item("'Line ID'", "INTEGER", "identifier")},
                {item("concat('  ', replace(p_name, ' ', '   '))", "DECIMAL(18,2)", "fact", aggregate, ratio)})),
            named_struct('label', p_brand, 'item', array(
                {item("'Part ID'", "bigint", "key")}, {item("p_type", "NVARCHAR(50)", "attribute")}))),
        'relationship', array(named_struct(
            'label', 'Lines to parts',
            'left', named_struct('ref', '[Lines]', 'maxcard', case when p_size % 2 = 0 then 'many' else 'one' end),
            'right', named_struct('ref', case when p_size % 4 = 0 then array('Elsewhere') else array(p_brand) end),
            'link', case when p_size % 3 = 0 then array({link("Part ID")}, {link("Site ID")})
                    else array({link("Part ID")}) end))))"""
    broken = """concat('{"querySubject": [', p_name)"""
    return spread(table(spark, sf_dir, "part")).selectExpr(
        "concat('/corpus/modules/part-', p_partkey, '.module') as path",
        f"case when p_partkey % 100 = 99 then {broken} else {text} end as content")


_MODEL_XML = """<?xml version="1.0" encoding="UTF-8"?>
<!-- supplier model <querySubject><name>commented out</name></querySubject> -->
<P:project xmlns:P="http://www.example.com/schemas/bmt/60/12"><P:name>Model</P:name><P:namespace><P:name locale="en">model</P:name>
<P:querySubject><P:name locale="en">@NAME@</P:name><P:definition><P:queryItem><P:name>Supplier  ID</P:name>
<P:datatype>int32</P:datatype><P:usage>identifier</P:usage></P:queryItem><P:queryItemFolder><P:name>Folder</P:name>
<P:queryItem name="Balance &amp; credit" datatype="decimal(18,2)" usage="fact"/></P:queryItemFolder></P:definition></P:querySubject>
<P:namespace><P:querySubject name="Nation"><P:queryItem><P:name>Nation ID</P:name><P:dataType>interval</P:dataType>
<P:usage>attribute</P:usage></P:queryItem></P:querySubject></P:namespace>
<P:relationship><P:name>To nation</P:name><P:expression>@CONDITION@</P:expression></P:relationship></P:namespace></P:project>"""

_CONDITION = """case when s_suppkey % 5 = 0 then '[model].[Nation] = 1'
    when s_suppkey % 3 = 0 then concat('[model].[', s_name, '].[Nation ID] = [model].[Nation].[Nation ID] and [model].[', s_name,
                                       '].[Region ID] &lt;= [model].[Nation].[Region ID]')
    else concat('[model].[', s_name, '].[Nation ID] = [model].[Nation].[Nation ID]') end"""


def _models(spark, sf_dir) -> DataFrame:
    xml = F.replace(F.replace(F.lit(_MODEL_XML), F.lit("@NAME@"), F.col("s_name")), F.lit("@CONDITION@"), F.expr(_CONDITION))
    plain = F.regexp_replace(xml, "P:|:P", "")
    return spread(table(spark, sf_dir, "supplier")).select(
        F.expr("concat('/corpus/models/supplier-', s_suppkey, '.xml')").alias("path"),
        F.when(F.col("s_suppkey") % 2 == 0, plain).otherwise(xml).alias("content"))


# Account statements by branch; one customer's values fill the placeholders.
_REPORT_XML = """<report xmlns="http://www.example.com/schemas/report/16.2/"><queries>
<query name="Balances &amp; limits"><source><model/></source><selection>
<dataItem name="Branch > desk"><expression>[Bank].[Branch].[@SEGMENT@]</expression><XMLAttributes>
<XMLAttribute name="RS_dataType" value="@CODE@" output="no"/></XMLAttributes></dataItem>
<dataItem name='Since "opening"' aggregate="none"><expression>cast([Bank].[Branch].[Opened] ; timestamp)</expression></dataItem>
<dataItem name="Limit" aggregate="average" dataType="decimal(12,2)"><expression>@MEASURE@</expression></dataItem>
<dataItem name="Trend" aggregate="none"><expression>@CALC@</expression></dataItem>
<dataItem name="Note" aggregate="none"><expression>trim([Bank].[Desk].[Memo]) @RAW@ [Bank].[Desk].[Tag]</expression></dataItem></selection></query>
<query name="Desk"><selection><dataItem name="Desk   Code"><expression><![CDATA[[Bank].[Desk].[Code]]]></expression></dataItem>
</selection><source><queryRef refQuery="Balances &amp; limits"/></source><detailFilters><detailFilter>
<filterExpression>[Code] > @BALANCE@</filterExpression></detailFilter><detailFilter><filterExpression>[Memo] is not null</filterExpression>
</detailFilter></detailFilters></query>
<query name="Statement"><source><joinOperation><joinOperands><joinOperand cardinality="@LEFT@"><queryRef refQuery="Balances &amp; limits"/>
</joinOperand><joinOperand cardinality="1:1"><queryRef refQuery="Desk"/></joinOperand></joinOperands>
<joinFilter><filterExpression>[Balances &amp; limits].[Branch] @OP@ [Desk].[Branch]</filterExpression></joinFilter>
<joinFilter><filterExpression>[Balances &amp; limits].[Trend] = [Desk].[Desk Code]</filterExpression></joinFilter></joinOperation>
<joinOperation><joinOperands><joinOperand cardinality="1:1"><queryRef refQuery="Desk"/></joinOperand>
<joinOperand cardinality="0..n"><queryRef refQuery="Balances &amp; limits"/></joinOperand></joinOperands>
<joinFilter><filterExpression>[Desk].[Memo] = [Balances &amp; limits].[Note]</filterExpression></joinFilter></joinOperation></source></query>
</queries><layouts><layout><reportPages><page name="By &lt;branch&gt;"><contents><list refQuery="Balances &amp; limits"><listColumns>
<listColumn><b><dataItemLabel refDataItem="Trend"/></b></listColumn>
<listColumn><t><dataItemLabel refDataItem="Limit"/></t><b><dataItemValue refDataItem="Branch > desk"/></b></listColumn></listColumns></list>
<crosstab@BIND@/></contents></page></reportPages></layout></layouts></report>"""

_REPORT_VALUES = {
    "@CODE@": "cast(c_nationkey % 12 as string)",
    "@SEGMENT@": "c_mktsegment",
    "@CALC@": """case c_custkey % 4 when 0 then 'running-total([Bank].[Branch].[Turnover])'
        when 1 then 'case when [Bank].[Branch].[Risk] &lt; 3 then 1 else 0 end'
        when 2 then 'stddev([Bank].[Branch].[Turnover])' else '_add_years([Bank].[Branch].[Opened], 2)' end""",
    "@MEASURE@": """case c_custkey % 3 when 0 then '[Bank].[Branch].[Credit]'
        when 1 then '[Bank].[Branch].[Credit] / [Bank].[Branch].[Risk]' else 'percent-of-total([Bank].[Branch].[Credit])' end""",
    "@BALANCE@": "cast(c_nationkey as string)",
    "@LEFT@": "element_at(array('1:n', '0..1', '1..n', '1:1'), cast(c_nationkey % 4 + 1 as int))",
    "@OP@": "case when c_custkey % 6 = 0 then '&lt;>' else '=' end",
    "@RAW@": "case when c_custkey % 7 = 0 then '<' else '||' end",
    "@BIND@": "case when c_custkey % 5 = 0 then '' else ' refQuery=\"Desk\"' end",
}


def _reports(spark, sf_dir) -> DataFrame:
    xml = F.lit(_REPORT_XML)
    for placeholder, value in _REPORT_VALUES.items():
        xml = F.replace(xml, F.lit(placeholder), F.expr(value))
    return spread(table(spark, sf_dir, "customer")).select(
        F.expr("concat('/corpus/reports/customer-', c_custkey, '.xml')").alias("path"), xml.alias("content"))


def _dashboards(spark, sf_dir) -> DataFrame:
    items = lambda *refs: "array(" + ", ".join(f"named_struct('id', 'd{i}', 'itemId', {r})" for i, r in enumerate(refs)) + ")"
    chart = f"""named_struct('id', 'w1', 'type', 'live', 'name', 'Clustered_Column', 'data', named_struct('dataViews', array(
        named_struct('dataItems', {items("concat('[Lines].[', c_mktsegment, ']')", "'Lines.Paid'", "'Outlay'")}))),
        'slotmapping', named_struct('slots', array(named_struct('name', 'Categories', 'dataItems', array('d0')),
                                                   named_struct('name', 'y', 'dataItems', array('d1')))))"""
    listing = f"""named_struct('id', 'w2', 'type', 'live', 'name', 'list', 'data', named_struct('dataViews', array(
        named_struct('dataItems', {items("concat('[Module].[Customer].[Nation ', c_nationkey, ']')")}))),
        'slotmapping', named_struct('slots', array(named_struct('name', 'rows', 'dataItems', array('d0')))))"""
    note = "named_struct('id', 'w3', 'type', 'text', 'text', c_name)"
    body = lambda widgets, layout: f"to_json(named_struct('widgets', {widgets}, 'layout', {layout}))"
    as_map = f"named_struct('w1', {chart}, 'w2', {listing}, 'w3', {note})"
    flat = """named_struct('name', 'Over  view', 'items', array(named_struct('id', 'w1'), named_struct('id', 'w2'),
                                                               named_struct('id', 'w3'), named_struct('id', 'gone')))"""
    tabs = """named_struct('items', array(
        named_struct('title', 'First', 'items', array(named_struct('id', 'box', 'items', array(
            named_struct('id', 'inner', 'items', array(named_struct('id', 'w2'))))))),
        named_struct('title', 'Second', 'items', array(named_struct('id', 'w1', 'items', array())))))"""
    nested = body(as_map, tabs)
    # Variant text keeps the pieces apart that have no common struct type.
    as_list = f"""concat('{{"widgets": [', to_json({chart}), ',', to_json({listing}), ',', to_json({note}), '], "title": "no layout"}}')"""
    return spread(table(spark, sf_dir, "customer")).selectExpr(
        "concat('/corpus/dashboards/customer-', c_custkey, '.json') as path",
        f"case c_custkey % 3 when 0 then {body(as_map, flat)} when 1 then {nested} else {as_list} end as content")


def _unreadable(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('/corpus/other/nation-', n_nationkey, element_at(array('.JSON', '.xml', '.md', '.json'), cast(n_nationkey % 4 + 1 as int))) as path",
        "case when n_nationkey % 4 = 3 then '[1, 2]' else n_name end as content")


def artifacts(spark, sf_dir) -> DataFrame:
    parts = [_modules(spark, sf_dir), _models(spark, sf_dir), _reports(spark, sf_dir), _dashboards(spark, sf_dir),
             _unreadable(spark, sf_dir)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# ------------------------------------------------------------------- scan and classify

_KINDS = """
    select '/corpus/modules/part-' || p_partkey || '.module' as path, 'module' as kind,
           case when p_partkey % 100 = 99 then 'not valid JSON' end as error from part
    union all select '/corpus/models/supplier-' || s_suppkey || '.xml', 'model', null from supplier
    union all select '/corpus/reports/customer-' || c_custkey || '.xml', 'report', null from customer
    union all select '/corpus/dashboards/customer-' || c_custkey || '.json', 'dashboard', null from customer
    union all select '/corpus/other/nation-' || n_nationkey || ['.JSON', '.xml', '.md', '.json'][n_nationkey % 4 + 1],
        ['module', 'report', 'unknown', 'module'][n_nationkey % 4 + 1],
        ['not valid JSON', 'not an XML document', 'the kind of definition could not be determined',
         'the JSON is not an object'][n_nationkey % 4 + 1] from nation"""


@query(f"select path from ({_KINDS}) where not regexp_matches(path, '[.]md$') order by path")
def corpus_scan(spark, sf_dir):
    return A.candidates(artifacts(spark, sf_dir)).select("path").orderBy("path")


@query(f"select path, kind from ({_KINDS})")
def artifact_kind(spark, sf_dir):
    return artifacts(spark, sf_dir).select("path", A.artifact_kind(F.col("path"), F.col("content")).alias("kind"))


@query(f"select path, kind, case when error is null then 'ok' else 'failed' end as status, error from ({_KINDS})")
def corpus_status(spark, sf_dir):
    return A.with_status(artifacts(spark, sf_dir)).select("path", "kind", "status", "error")


# ---------------------------------------------------------------------------- extract

_REPORT_PATH = "'/corpus/reports/customer-' || c_custkey || '.xml'"
_CALC_SQL = """['running-total([Bank].[Branch].[Turnover])', 'case when [Bank].[Branch].[Risk] < 3 then 1 else 0 end',
    'stddev([Bank].[Branch].[Turnover])', '_add_years([Bank].[Branch].[Opened], 2)'][c_custkey % 4 + 1]"""
_MEASURE_SQL = """['[Bank].[Branch].[Credit]', '[Bank].[Branch].[Credit] / [Bank].[Branch].[Risk]',
    'percent-of-total([Bank].[Branch].[Credit])'][c_custkey % 3 + 1]"""
_ITEMS = f"""
    select {_REPORT_PATH} as path, query, item_no, item, aggregate, expression, type, item_class, source_column, broken from (
        select c_custkey, 'Balances & limits' as query, 1 as item_no, 'Branch > desk' as item, 'none' as aggregate,
               '[Bank].[Branch].[' || c_mktsegment || ']' as expression,
               case when c_nationkey % 12 in (1, 2) then 'int64' when c_nationkey % 12 in (4, 5, 7, 8) then 'dateTime'
                    when c_nationkey % 12 = 9 then 'decimal' when c_nationkey % 12 = 10 then 'double' else 'string' end as type,
               'physical' as item_class, c_mktsegment as source_column, false as broken from customer
        union all select c_custkey, 'Balances & limits', 2, 'Since "opening"', 'none', 'cast([Bank].[Branch].[Opened] ; timestamp)',
               'dateTime', 'physical', 'Opened', false from customer
        union all select c_custkey, 'Balances & limits', 3, 'Limit', 'average', {_MEASURE_SQL}, 'decimal', 'measure',
               case when c_custkey % 3 = 0 then 'Credit' else 'Limit' end, false from customer
        union all select c_custkey, 'Balances & limits', 4, 'Trend', 'none', {_CALC_SQL},
               ['int64', 'string', 'double', 'string'][c_custkey % 4 + 1],
               ['unmapped', 'calculated', 'calculated', 'calculated'][c_custkey % 4 + 1], 'Trend', false from customer
        union all select c_custkey, 'Balances & limits', 5, 'Note', 'none',
               case when c_custkey % 7 <> 0 then 'trim([Bank].[Desk].[Memo]) || [Bank].[Desk].[Tag]' end, 'string',
               case when c_custkey % 7 = 0 then 'physical' else 'calculated' end, 'Note', c_custkey % 7 = 0 from customer
        union all select c_custkey, 'Desk', 1, 'Desk Code', 'none', '[Bank].[Desk].[Code]', 'string', 'physical', 'Code', false
               from customer)"""


def _queries(spark, sf_dir):
    return E.report_queries(_reports(spark, sf_dir))


@query(f"select path, query, item_no, item, aggregate, expression, broken from ({_ITEMS})")
def extract_report_items(spark, sf_dir):
    return E.report_items(_queries(spark, sf_dir)).select(
        "path", "query", "item_no", "item", "aggregate", "expression", "broken")


@query(f"select path, query, item, item_class, source_column from ({_ITEMS})")
def classify_items(spark, sf_dir):
    return E.report_items(_queries(spark, sf_dir)).select("path", "query", "item", "item_class", "source_column")


@query(f"select path, query, item, type from ({_ITEMS})")
def infer_item_type(spark, sf_dir):
    return E.report_items(_queries(spark, sf_dir)).select("path", "query", "item", "type")


@query("""
    select p_partkey, type_name, case when p_partkey % 8 in (0, 4) then 'int64' when p_partkey % 8 = 1 then 'decimal'
           when p_partkey % 8 = 2 then 'dateTime' when p_partkey % 8 = 3 then 'boolean' when p_partkey % 8 = 5 then 'double'
           else 'string' end as type
    from (select p_partkey, [' BigInt', 'Decimal(' || p_size || ',2)', 'timestamp(' || p_size || ')', 'bit', 'INTEGER',
                             'real ', 'interval', p_type][p_partkey % 8 + 1] as type_name from part)""")
def normalize_types(spark, sf_dir):
    names = table(spark, sf_dir, "part").selectExpr("p_partkey", """element_at(array(
        ' BigInt', concat('Decimal(', p_size, ',2)'), concat('timestamp(', p_size, ')'), 'bit', 'INTEGER', 'real ', 'interval',
        p_type), cast(p_partkey % 8 + 1 as int)) as type_name""")
    return names.withColumn("type", normalize_type(F.col("type_name")))


_JOINS = f"""
    select {_REPORT_PATH} as path, 'Statement' as query, join_no, join_no > 1 or c_custkey % 6 <> 0 as mapped,
           '[' || a || '].[' || x || '] ' || case when join_no = 1 and c_custkey % 6 = 0 then '<>' else '=' end || ' [' || b || '].['
           || y || ']' as condition,
           case when mapped then case when swapped then b else a end end as from_table,
           case when mapped then case when swapped then y else x end end as from_column,
           case when mapped then case when swapped then a else b end end as to_table,
           case when mapped then case when swapped then x else y end end as to_column,
           case when mapped and (join_no = 3 or c_nationkey % 4 in (0, 2)) then 'n:1' else '1:1' end as cardinality
    from customer, (values (1, 'Balances & limits', 'Branch', 'Desk', 'Branch', false),
                           (2, 'Balances & limits', 'Trend', 'Desk', 'Desk Code', false),
                           (3, 'Desk', 'Memo', 'Balances & limits', 'Note', true)) j(join_no, a, x, b, y, swapped)"""


@query(_JOINS)
def extract_report_joins(spark, sf_dir):
    return E.report_joins(_queries(spark, sf_dir)).drop("query_no")


@query(f"""
    select {_REPORT_PATH} as path, query, source, derived_from, n_filters from customer, (
        values ('Balances & limits', 'package', null, 0), ('Desk', 'derived', 'Balances & limits', 2), ('Statement', 'join', null, 0)
    ) q(query, source, derived_from, n_filters)""")
def extract_report_sources(spark, sf_dir):
    return E.report_sources(_queries(spark, sf_dir)).select(
        "path", "query", "source", "derived_from", F.size("detail_filters").alias("n_filters"))


@query(f"""
    select {_REPORT_PATH} as path, 'By <branch>' as page, 1 as visual_no, 'table' as kind, 'Balances & limits' as query,
           'Trend, Branch > desk' as shown from customer
    union all select {_REPORT_PATH}, 'By <branch>', 2, 'matrix', case when c_custkey % 5 <> 0 then 'Desk' end, '' from customer""")
def extract_report_visuals(spark, sf_dir):
    visuals = E.report_visuals(_reports(spark, sf_dir))
    return visuals.select("path", "page", "visual_no", "kind", "query", F.array_join("shown", ", ").alias("shown"))


_MODEL_PATH = "'/corpus/models/supplier-' || s_suppkey || '.xml'"


@query(f"""
    select {_MODEL_PATH} as path, case when c = 'Nation ID' then 'Nation' else s_name end as "table", ordinal,
           c as "column", type, usage, usage = 'identifier' as is_key, usage = 'fact' as is_fact
    from supplier, (values (1, 'Supplier ID', 'int64', 'identifier'), (2, 'Balance & credit', 'decimal', 'fact'),
                           (1, 'Nation ID', 'string', 'attribute')) items(ordinal, c, type, usage)""")
def extract_model_columns(spark, sf_dir):
    return E.model_columns(_models(spark, sf_dir)).drop("table_no")


@query(f"""
    select {_MODEL_PATH} as path, 'To nation' as name, pair_no,
           case when s_suppkey % 5 <> 0 then s_name end as from_table, case when s_suppkey % 5 <> 0 then 'Nation' end as to_table,
           case when s_suppkey % 5 <> 0 then col end as from_column, case when s_suppkey % 5 <> 0 then col end as to_column,
           case when s_suppkey % 5 <> 0 then op end as operator
    from supplier, (values (1, 'Nation ID', '='), (2, 'Region ID', '<=')) pairs(pair_no, col, op)
    where pair_no = 1 or (s_suppkey % 3 = 0 and s_suppkey % 5 <> 0)""")
def extract_model_rels(spark, sf_dir):
    return E.model_relationships(_models(spark, sf_dir)).drop("seq", "expression")


_MODULE_PATH = "'/corpus/modules/part-' || p_partkey || '.module'"


@query(f"""
    select {_MODULE_PATH} as path, table_no, case table_no when 1 then 'Lines' else p_brand end as "table", ordinal,
           case when table_no = 1 and ordinal = 2 then p_name when table_no = 2 and ordinal = 2 then p_type else col end as "column",
           type, usage, is_key, is_fact,
           case when is_key then 'none' when is_fact then ['sum', 'average', 'distinctCount', 'none', 'sum'][p_size % 5 + 1] end
           as summarize_by,
           case when is_fact and p_size % 10 = 0 then '[Lines].[Paid] / [Lines].[Pieces]' end as expression
    from part, (values (1, 1, 'Line ID', 'int64', 'identifier', true, false), (1, 2, '', 'decimal', 'fact', false, true),
                       (2, 1, 'Part ID', 'int64', 'key', true, false), (2, 2, '', 'string', 'attribute', false, false))
         items(table_no, ordinal, col, type, usage, is_key, is_fact)
    where p_partkey % 100 <> 99""")
def extract_module_columns(spark, sf_dir):
    return E.module_columns(_modules(spark, sf_dir))


@query(f"""
    select {_MODULE_PATH} as path, 1 as seq, 'Lines to parts' as name, pair_no,
           case when p_size % 2 = 0 then 'Lines' else far end as from_table, col as from_column,
           case when p_size % 2 = 0 then far else 'Lines' end as to_table, col as to_column
    from (select *, case when p_size % 4 = 0 then 'Elsewhere' else p_brand end as far from part where p_partkey % 100 <> 99),
         (values (1, 'Part ID'), (2, 'Site ID')) links(pair_no, col)
    where pair_no = 1 or p_size % 3 = 0""")
def extract_module_rels(spark, sf_dir):
    return E.module_relationships(_modules(spark, sf_dir))


_FIELDS = """
    select '/corpus/dashboards/customer-' || c_custkey || '.json' as path,
           case c_custkey % 3 when 0 then 1 when 1 then case when kind = 'table' then 1 else 2 end else 1 end as page_no,
           case c_custkey % 3 when 0 then 'Over view' when 1 then case when kind = 'table' then 'First' else 'Second' end
                else 'Page1' end as page,
           case when c_custkey % 3 = 1 or kind = 'column' then 1 else 2 end as visual_no,
           kind, field_no, tab as "table",
           case when tab = 'Customer' then 'Nation ' || c_nationkey when col = '' then c_mktsegment else col end as "column", role
    from customer, (values ('column', 1, 'Lines', '', 'category'), ('column', 2, 'Lines', 'Paid', 'values'),
                           ('column', 3, 'Data', 'Outlay', 'values'), ('table', 1, 'Customer', '', 'rows'))
         fields(kind, field_no, tab, col, role)"""


@query(_FIELDS)
def extract_dashboard_fields(spark, sf_dir):
    return E.dashboard_fields(E.dashboard_widgets(_dashboards(spark, sf_dir)))


@query(f"""select distinct path, "table", "column" from ({_FIELDS})""")
def synth_tables(spark, sf_dir):
    return E.synthesized_tables(E.dashboard_fields(E.dashboard_widgets(_dashboards(spark, sf_dir))))


@query("""
    select p_partkey, case when p_partkey % 4 = 3 then 'Data' else p_brand end as "table",
           case when p_partkey % 4 = 2 then p_type else p_name end as "column"
    from part""")
def split_refs(spark, sf_dir):
    reference = F.expr("""case p_partkey % 4 when 0 then concat('[Model].[', p_brand, '].[', p_name, ']')
        when 1 then concat(p_brand, '. ', replace(p_name, ' ', '  ')) when 2 then concat('[', p_brand, '].[', p_type, ']')
        else concat('[', p_name, ']') end""")
    split = table(spark, sf_dir, "part").select("p_partkey", N.split_reference(reference).alias("reference"))
    return split.select("p_partkey", "reference.table", "reference.column")


# ------------------------------------------------------------------------- expressions

# Expression, aggregate, Spark SQL text (None where it is not understood). @ stands for a column name.
_CASES = [
    ("[DB].[Lines].[@]", "total", "sum(`@`)"),
    ("[DB].[Lines].[@] / [DB].[Lines].[Pieces]", "total", "sum(`@`) / nullif(sum(`Pieces`), 0)"),
    ("if ([Lines].[@] > 10) then (upper([Lines].[@])) else (''none'')", "none", "if((`@` > 10), (upper(`@`)), (''none''))"),
    ("case when [@] = 1 then 2 end", "none", "case when `@` = 1 then 2 end"),
    ("extract(Year, [Lines].[@])", "none", "Year(`@`)"),
    ("rank([Lines].[@])", "calculated", None),
    ("running-count([Lines].[@])", "none", None),
    ("round([@] * ([Tax] + 1), 2)", "average", "avg(round(`@` * (`Tax` + 1), 2))"),
    ("[Lines].[@]", "countDistinct", "count(distinct `@`)"),
    ("substring([@], 1, 3) || ''-'' || lower([Name])", "none", "substring(`@`, 1, 3) || ''-'' || lower(`Name`)"),
    ("cast([Lines].[@] ; decimal(9, 2)) / ([Tax] / [Rate])", "none",
     "cast(`@` as decimal(9, 2)) / nullif((`Tax` / nullif(`Rate`, 0)), 0)"),
    ("_add_years([Lines].[Day], 1 + [Years])", "none", "add_months(`Day`, 12 * (1 + `Years`))"),
    ("_round(variance([@]), 1) + rowcount([@])", "calculated", "round(var_samp(`@`), 1) + count(*)"),
    ("if (" + "(" * 12 + "[@]" + ")" * 12 + " > 1) then (1) else (if ([Tax] = 1) then (2) else (3))", "none",
     "if((" + "(" * 12 + "`@`" + ")" * 12 + " > 1), (1), (if((`Tax` = 1), (2), (3))))"),
    ("''[no] reference; (none'' || [@]", "none", "''[no] reference; (none'' || `@`"),
    ("if ([@] > 1) then [Tax] else 0", "none", None),
    ("sum([@]) / sum([Tax])", "total", "sum(`@`) / nullif(sum(`Tax`), 0)"),
    ("[@] / total([@] for report)", "none", "`@` / nullif(`scoped_1`, 0)"),
    ("total(average([@] for [Line], [Site]))", "none", "sum(`scoped_1`)"),
    ("maximum(sum([@]))", "total", None), ("sum([@]) + [Tax]", "none", None), ("substring([@])", "none", None),
    ("[@] [Tax]", "none", None), ("[@] * -[Tax]", "maximum", "max(`@`) * -max(`Tax`)"),
]
_UNKNOWN = {i: n for i, n in enumerate(["", "", "", "", "", "rank", "running-count"]) if n}


def _case_sql(position: int, aliased: str) -> str:
    texts = ", ".join("null" if c[position] is None else f"'{c[position]}'" for c in _CASES)
    return f"replace([{texts}][(p_partkey % {len(_CASES)} + 1)::int], '@', p_name) as {aliased}"


def _expressions(spark, sf_dir):
    pick = lambda i: "element_at(array(" + ", ".join(
        "'" + c[i].replace("''", "\\'") + "'" for c in _CASES) + f"), cast(p_partkey % {len(_CASES)} + 1 as int))"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"replace({pick(0)}, '@', p_name) as expression", f"{pick(1)} as aggregate")


@query("select p_partkey, spark_sql is not null as understood, case "
       + " ".join(f"when p_partkey % {len(_CASES)} = {i} then '{n}'" for i, n in _UNKNOWN.items())
       + " else '' end as unknown from (select p_partkey, " + _case_sql(2, "spark_sql") + " from part)")
def expr_coverage(spark, sf_dir):
    expression = F.col("expression")
    return _expressions(spark, sf_dir).select("p_partkey", X.is_understood(expression).alias("understood"),
                                              F.array_join(X.unknown_calls(expression), ", ").alias("unknown"))


@query(f"select p_partkey, {_case_sql(0, 'expression')}, {_case_sql(2, 'spark_sql')} from part")
def expr_rewrite(spark, sf_dir):
    return _expressions(spark, sf_dir).select(
        "p_partkey", "expression", X.to_spark_sql(F.col("expression"), F.col("aggregate")).alias("spark_sql"))


@query(f"""
    select p_partkey, case p_partkey % {len(_CASES)} when 17 then 'scoped_1: sum(`' || p_name || '`) over ()'
        when 18 then 'scoped_1: avg(`' || p_name || '`) over (partition by `Line`, `Site`)' else '' end as columns,
        p_partkey % {len(_CASES)} in ({', '.join(str(i) for i, c in enumerate(_CASES) if c[2] and (c[1] in X.AGGREGATES or c[1].lower() in X.AGGREGATES or i in (12, 18)))}) as is_aggregate
    from part""")
def expr_scopes(spark, sf_dir):
    """The columns that scoped aggregates become, and whether the rest of a text is an aggregate."""
    read = _expressions(spark, sf_dir).withColumn("read", X.read(F.col("expression"), F.col("aggregate")))
    texts = F.transform("read.columns", lambda c: F.concat_ws(": ", c.getField("name"), c.getField("sql")))
    return read.select("p_partkey", F.array_join(texts, "; ").alias("columns"), F.col("read.is_aggregate").alias("is_aggregate"))


# ---------------------------------------------------------------------------- coverage

_CORPUS_FINDINGS = f"""
    select {_REPORT_PATH} as path, 'package-source' as code, 'warning' as severity, cast(null as varchar) as source_ref from customer
    union all select {_REPORT_PATH}, 'derived-query', 'info', 'Balances & limits' from customer
    union all select {_REPORT_PATH}, 'detail-filter', 'warning', '[Code] > ' || c_nationkey from customer
    union all select {_REPORT_PATH}, 'detail-filter', 'warning', '[Memo] is not null' from customer
    union all select {_REPORT_PATH}, 'element-needs-review', 'warning', 'Balances & limits.Note' from customer where c_custkey % 7 = 0
    union all select {_REPORT_PATH}, 'calculation-needs-review', 'warning', {_CALC_SQL} from customer where c_custkey % 4 = 0
    union all select {_REPORT_PATH}, 'measure-needs-review', 'warning', 'percent-of-total([Bank].[Branch].[Credit])' from customer
        where c_custkey % 3 = 2
    union all select path, case when mapped then 'join-relationship' else 'join-needs-review' end,
        case when mapped then 'info' else 'warning' end, case when not mapped then condition end from ({_JOINS})
    union all select {_REPORT_PATH}, 'visual-unbound', 'warning', null from customer where c_custkey % 5 = 0
    union all select {_MODEL_PATH}, 'relationship-needs-review', 'warning', 'relationship To nation' from supplier where s_suppkey % 5 = 0
    union all select {_MODEL_PATH}, 'relationship-composite-key', 'warning', 'relationship To nation' from supplier
        where s_suppkey % 5 <> 0 and s_suppkey % 3 = 0
    union all select {_MODULE_PATH}, 'calculation-needs-review', 'info', '[Lines].[Paid] / [Lines].[Pieces]' from part
        where p_size % 10 = 0 and p_partkey % 100 <> 99
    union all select {_MODULE_PATH}, 'relationship-unbound', 'warning', 'relationship Lines to parts' from part
        where p_size % 4 = 0 and p_partkey % 100 <> 99
    union all select {_MODULE_PATH}, 'relationship-composite-key', 'warning', 'relationship Lines to parts' from part
        where p_size % 3 = 0 and p_partkey % 100 <> 99"""


@query(_CORPUS_FINDINGS)
def corpus_flags(spark, sf_dir):
    return C.corpus_findings(C.extract_corpus(artifacts(spark, sf_dir)))


_COVERAGE = f"""
    select k.path, kind, case when error is null then 'ok' else 'failed' end as status, error,
           case when error is not null then 0 when kind = 'dashboard' then 3 else 2 end as n_tables,
           case when error is null and kind = 'report' then 1 else 0 end as n_measures,
           case when error is not null then 0 when kind = 'report' then 1
                when kind = 'dashboard' and regexp_extract(k.path, '([0-9]+)[.]', 1)::int % 3 = 1 then 2
                when kind = 'dashboard' then 1 else 0 end as n_pages,
           coalesce(n_rels, 0) as n_relationships, coalesce(n_findings, 0) as n_findings
    from ({_KINDS}) k
    left join (select path, count(*) as n_findings from ({_CORPUS_FINDINGS}) group by 1) f on f.path = k.path
    left join (select path, count(*) as n_rels from (
        select path from ({_JOINS}) where mapped union all select {_MODEL_PATH} from supplier where s_suppkey % 5 <> 0
        union all select {_MODULE_PATH} from part where p_partkey % 100 <> 99) group by 1) r on r.path = k.path"""
_N = ["n_tables", "n_measures", "n_pages", "n_relationships", "n_findings"]
_COVERAGE = "select path, kind, status, error, " + ", ".join(f"{n}::bigint as {n}" for n in _N) + f" from ({_COVERAGE})"


def _coverage(spark, sf_dir):
    corpus = C.extract_corpus(artifacts(spark, sf_dir))
    findings = materialize(C.corpus_findings(corpus), "corpus-findings")
    return C.coverage(corpus, findings), findings


@query(_COVERAGE)
def coverage_report(spark, sf_dir):
    return _coverage(spark, sf_dir)[0]


@query("select count(*) filter (where status = 'ok') as n_ok, count(*) filter (where status = 'failed') as n_failed, "
       + ", ".join(f"sum({n})::bigint as {n}" for n in _N) + f" from ({_COVERAGE})")
def batch_totals(spark, sf_dir):
    return C.totals(_coverage(spark, sf_dir)[0])


@query(_COVERAGE)
def coverage_write(spark, sf_dir):
    """Written, then read back."""
    rows, findings = _coverage(spark, sf_dir)
    folder = f"{shared_folder(spark)}/coverage-{uuid.uuid4().hex}"
    C.write_coverage(rows, findings, folder)
    return read_snapshot(spark, f"{folder}/coverage", "json", rows.schema)


@query("select code, severity, count(*) as n_findings, count(source_ref) as n_texts from (" + _CORPUS_FINDINGS + """
    union all select '/corpus/other/empty-' || n_nationkey || '.xml', 'no-queries', 'error', null from nation
    union all select '/corpus/other/empty-' || n_nationkey || '.xml', 'no-pages', 'warning', null from nation) group by 1, 2""")
def review_list(spark, sf_dir):
    """The list of what is to be reviewed, written with the coverage and read back; a file per nation has no queries."""
    empty = table(spark, sf_dir, "nation").selectExpr("concat('/corpus/other/empty-', n_nationkey, '.xml') as path", "'<report/>' as content")
    corpus = C.extract_corpus(artifacts(spark, sf_dir).unionByName(empty))
    findings = materialize(C.corpus_findings(corpus), "corpus-findings")
    folder = f"{shared_folder(spark)}/coverage-{uuid.uuid4().hex}"
    C.write_coverage(C.coverage(corpus, findings), findings, folder)
    return read_snapshot(spark, f"{folder}/findings").groupBy("code", "severity").agg(
        F.count(F.lit(1)).alias("n_findings"), F.count("source_ref").alias("n_texts"))


@query("""
    select 'reports' as folder, 'report' as kind, 'read' as status, count(*) as n_files, sum(length(r_name))::bigint as n_chars from region
    union all select 'modules', 'module', 'read', count(*), sum(length(n_name))::bigint from nation
    union all select '.older', null, 'skipped', count(*), null from region""")
def folder_scan(spark, sf_dir):
    """Definition files written to folders, one for each region and nation, then listed and read; hidden ones are reported."""
    folder = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    region = table(spark, sf_dir, "region").selectExpr("r_regionkey as key", "r_name as name").repartition("key")
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey as key", "n_name as name").repartition("key")
    region.write.partitionBy("key").format("xml").option("rootTag", "report").option("rowTag", "query").save(f"{folder}/reports")
    nation.write.partitionBy("key").json(f"{folder}/modules")
    region.write.partitionBy("key").json(f"{folder}/.older")
    of_folder = lambda path: F.regexp_extract(path, r"scan-\w+/([^/]+)/", 1).alias("folder")
    read = A.scan_folder(spark, folder).select(
        of_folder(F.col("path")), A.artifact_kind(F.col("path"), F.col("content")).alias("kind"), F.lit("read").alias("status"),
        F.regexp_extract("content", r"""name(?:>|":")([^<"]+)""", 1).alias("name"))
    skipped = A.skipped_files(spark, folder).select(
        of_folder(F.col("path")), F.lit(None).cast("string").alias("kind"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("name"))
    return read.unionByName(skipped).groupBy("folder", "kind", "status").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.length("name")).alias("n_chars"))


@query(f"""
    select kind, code, count(*) as n_findings from (
        select {_MODULE_PATH} as path, 'table-orphan' as code from part where p_size % 4 = 0 and p_partkey % 100 <> 99
        union all select {_MODULE_PATH}, 'fact-no-dimension' from part where p_size % 4 = 0 and p_partkey % 100 <> 99
        union all select {_MODULE_PATH}, 'relationship-unbound' from part where p_size % 4 = 0 and p_partkey % 100 <> 99
        union all select path, 'relationship-role-playing' from (
            select path, row_number() over (partition by path order by join_no) as n from ({_JOINS}) where mapped) where n > 1)
    join ({_KINDS}) using (path) group by 1, 2""")
def corpus_models(spark, sf_dir):
    """The model rules over all extracted definitions, with one model per file."""
    corpus = C.extract_corpus(artifacts(spark, sf_dir))
    as_model = lambda df: df.withColumnRenamed("path", "model_id")
    result = R.analyze(as_model(C.corpus_tables(corpus)), as_model(C.corpus_columns(corpus)),
                       as_model(C.corpus_relationships(corpus)))
    kinds = corpus["files"].select(F.col("path").alias("model_id"), "kind")
    return result["findings"].join(kinds, "model_id").groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n_findings"))
