"""Metadata tables from definition files, for a whole corpus at once.

Input is a table of artifacts (path, content). XML is cut into the elements of interest, at any depth and
under any namespace prefix, and each element is read with a schema: a broken element costs its own row
only. JSON is read as variants, which tolerate missing and oddly typed fields.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from starfold.functions import expressions as X
from starfold.functions.names import clean_label, segments, split_reference
from starfold.functions.types import normalize_type, type_of_code
from starfold.operators.rules import FACT_USAGES, KEY_USAGES
from starfold.operators.visuals import SLOT_ROLES, SUMMARIZE_BY, VISUAL_KINDS


# What follows the name of a tag, up to its end. Quoted values may hold any character.
_ATTRIBUTES = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""


# ------------------------------------------------------------------------ reading


def xml_text(content: Column) -> Column:
    """Without comments and namespace prefixes."""
    return F.regexp_replace(F.regexp_replace(content, r"(?s)<!--.*?-->", ""), r"<(/?)[A-Za-z_][\w.\-]*:", "<$1")


def elements(xml: Column, tag: str) -> Column:
    """Texts of all elements of a tag that does not nest in itself, in document order."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?=[\s/>]){_ATTRIBUTES}(?:(?<=/)>|>.*?</{tag}\s*>)"), F.lit(0))


def attribute(xml: Column, name: str, tag: str = r"[\w.\-]+") -> Column:
    """An attribute of the first element of a tag, read as XML, so that entities are decoded; null where it has none."""
    held = F.regexp_extract(xml, rf"(?s)<{tag}(?=[\s/>])({_ATTRIBUTES})>", 1)
    element = F.concat(F.lit("<e "), F.regexp_replace(held, r"/\s*$", ""), F.lit("/>"))
    return F.nullif(read_element(element, f"_{name} string").getField(f"_{name}"), F.lit(""))


def read_element(xml: Column, schema: str) -> Column:
    return F.from_xml(xml, schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})


def _numbered(array: Column, number: str, value: str) -> list[Column]:
    """Elements with their 1-based position, as two output columns of one generator."""
    return [F.posexplode(array).alias(number, value)]


def _xml_rows(artifacts: DataFrame, tag: str, number: str, value: str) -> DataFrame:
    rows = artifacts.select("path", *_numbered(elements(xml_text(F.col("content")), tag), number, value))
    return rows.withColumn(number, F.col(number) + 1)


def _text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _name(struct: str, default: Column) -> Column:
    """The ``name`` attribute, or the first ``name`` child."""
    own = F.coalesce(_text(F.col(f"{struct}._name")), _text(F.try_element_at(F.col(f"{struct}.name"), F.lit(1))))
    return F.when(own.isNull(), default).otherwise(clean_label(own))


def _numbered_name(prefix: str, number: str) -> Column:
    return F.concat(F.lit(prefix), F.col(number).cast("string"))


def _get(variant: Column, path: str, data_type: str) -> Column:
    return F.try_variant_get(variant, path, data_type)


def _first_of(variant: Column, fields: list[str], data_type: str) -> Column:
    return F.coalesce(*[_get(variant, f"$.{name}", data_type) for name in fields])


def _label(variant: Column, default: Column) -> Column:
    texts = [_text(_get(variant, f"$.{name}", "string")) for name in ("label", "identifier", "name")]
    own = F.coalesce(*texts)
    return F.when(own.isNull(), default).otherwise(clean_label(own))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in mapping.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


# ------------------------------------------------------------------------ reports


def report_queries(reports: DataFrame) -> DataFrame:
    """Queries of reports, with the text of each: the input of the functions below."""
    rows = _xml_rows(reports, "query", "query_no", "xml")
    return rows.withColumn("query", clean_label(F.coalesce(attribute(F.col("xml"), "name"), F.lit("")), "Query"))


def report_items(queries: DataFrame) -> DataFrame:
    """Data items: name, aggregate, expression, inferred type and class of every item of every query.

    An item that is no well-formed XML is ``broken``; it keeps its place, and what of it can be read.
    """
    rows = queries.select(
        "path", "query_no", "query", *_numbered(elements(F.col("xml"), "dataItem"), "item_no", "xml"))
    # One spelling of the type attribute, as columns do not differ by case alone.
    xml = F.regexp_replace("xml", r"^(<dataItem(?![^>]*\sdatatype=)[^>]*?\s)dataType=", "$1datatype=")
    schema = ("_name string, _aggregate string, _datatype string, _type string, expression string, "
              "XMLAttributes struct<XMLAttribute: array<struct<_name: string, _value: string>>>")
    rows = rows.withColumn("item", read_element(xml, schema))
    codes = F.filter(F.col("item.XMLAttributes.XMLAttribute"), lambda a: a.getField("_name") == "RS_dataType")
    aggregate = F.lower(F.trim(F.coalesce("item._aggregate", F.lit("none"))))
    items = rows.select(
        "path", "query_no", "query", (F.col("item_no") + 1).alias("item_no"),
        clean_label(F.col("item._name"), "Item").alias("item"),
        F.when(aggregate == "", "none").otherwise(aggregate).alias("aggregate"),
        _text(F.col("item.expression")).alias("expression"),
        F.coalesce(F.nullif(F.col("item._datatype"), F.lit("")), F.nullif(F.col("item._type"), F.lit(""))
                   ).alias("declared_type"),
        F.try_element_at(codes, F.lit(1)).getField("_value").alias("type_code"),
        F.col("item._corrupt").isNotNull().alias("broken"))
    items = items.withColumn("read", X.read(F.col("expression")))
    return items.withColumns({"type": infer_item_type(), "item_class": item_class(),
                              "source_column": source_column()}).drop("declared_type", "type_code", "read")


# Called names that give whole numbers, and names that give floating numbers.
COUNTING = ["running-count", "running_count", "running-total", "running_total", "count", "rowcount", "_rowcount"]
FLOATING = ["average", "avg", "median", "stddev", "std-dev", "std_dev", "variance", "percentile", "ratio"]


def _calls_any(expression: Column, names: list[str]) -> Column:
    called = F.regexp_extract_all(F.lower(expression), F.lit(r"(?<![\w\-])([a-z_][\w\-]*)\s*\("), F.lit(1))
    return F.arrays_overlap(called, F.array(*[F.lit(n) for n in names]))


def _cast_target(expression: Column) -> Column:
    """What a cast as a whole is a cast to: the name between its last semicolon and its end."""
    text = F.trim(expression)
    target = F.regexp_extract(F.substring_index(text, ";", -1), r"^\s*([A-Za-z0-9_]+)\s*\)$", 1)
    return F.when(F.lower(text).rlike(r"^cast\s*\(") & text.contains(";"), F.nullif(target, F.lit("")))


def infer_item_type() -> Column:
    """Declared type, else type code, else cast target, else what the function returns, else string."""
    cast_type = _cast_target(F.col("expression"))
    return F.coalesce(
        F.when(F.col("declared_type").isNotNull(), normalize_type(F.col("declared_type"))),
        type_of_code(F.col("type_code")),
        F.when(cast_type.isNotNull(), normalize_type(cast_type)),
        F.when(_calls_any(F.col("expression"), COUNTING), "int64"),
        F.when(_calls_any(F.col("expression"), FLOATING), "double"),
        F.lit("string"))


def item_class() -> Column:
    """measure, physical (a reference), calculated (understood), or unmapped."""
    return (F.when(F.col("aggregate") != "none", "measure").when(F.col("read.reference_like"), "physical")
            .when(F.col("read.understood"), "calculated").otherwise("unmapped"))


def source_column() -> Column:
    """Physical column behind a reference or a cast of one, else the item's own name."""
    expression = F.col("expression")
    last = F.try_element_at(segments(expression), F.lit(-1))
    return F.when(F.col("read.reference_like") & last.isNotNull(), clean_label(last)).otherwise(F.col("item"))


def _is_many(cardinality: Column) -> Column:
    """``1:n``, ``n``, ``*``, ``0..n`` are many; ``1:1``, ``1``, ``0..1`` and nothing are not."""
    text = F.lower(F.trim(F.coalesce(cardinality, F.lit(""))))
    upper = F.trim(F.try_element_at(F.split(text, r":|\.\."), F.lit(-1)))
    return (text != "") & ~upper.isin("0", "1")


def report_joins(queries: DataFrame) -> DataFrame:
    """Join filters of report queries, from the many side to the one side.

    A filter that is not one equality of two references is kept as it is, with ``mapped`` false.
    """
    # The filters of all operations of a query in one sequence, so that join_no is their declared order.
    filters = F.flatten(F.transform(elements(F.col("xml"), "joinOperation"), lambda operation: F.transform(
        elements(operation, "joinFilter"), lambda f: F.struct(operation.alias("xml"), f.alias("filter")))))
    joins = queries.select("path", "query_no", "query", F.posexplode(filters).alias("join_no", "join"))
    operands = F.transform(elements(F.col("join.xml"), "joinOperand"), lambda x: read_element(
        x, "_cardinality string, queryRef struct<_refQuery: string>"))
    rows = joins.select("path", "query_no", "query", operands.alias("operands"), "join_no", F.col("join.filter").alias("filter"))
    condition = _text(read_element(F.col("filter"), "filterExpression string").getField("filterExpression"))
    rows = rows.withColumn("condition", condition).filter("condition is not null")
    rows = rows.withColumn("mapped", F.col("condition").rlike(rf"^\s*+{X.REFERENCE}\s*+=\s*+{X.REFERENCE}\s*+$"))
    sides = F.split("condition", "=")
    for i, side in enumerate(("left", "right")):
        parts = segments(F.get(sides, F.lit(i)))
        rows = rows.withColumns({
            f"{side}_table": F.when(F.col("mapped") & (F.size(parts) >= 2), clean_label(F.get(parts, F.lit(0)))),
            f"{side}_column": F.when(F.col("mapped") & (F.size(parts) >= 2), clean_label(F.try_element_at(parts, F.lit(-1))))})
        own = F.filter("operands", lambda o: clean_label(o.getField("queryRef").getField("_refQuery")) == F.col(f"{side}_table"))
        rows = rows.withColumn(f"{side}_many", F.coalesce(_is_many(F.try_element_at(own, F.lit(-1)).getField("_cardinality")), F.lit(False)))
    swapped = F.col("right_many") & ~F.col("left_many")
    pick = lambda name, a, b: F.when(swapped, F.col(f"{b}_{name}")).otherwise(F.col(f"{a}_{name}"))
    return rows.select(
        "path", "query_no", "query", (F.col("join_no") + 1).alias("join_no"), "condition", "mapped",
        pick("table", "left", "right").alias("from_table"), pick("column", "left", "right").alias("from_column"),
        pick("table", "right", "left").alias("to_table"), pick("column", "right", "left").alias("to_column"),
        F.when(F.col("left_many") | F.col("right_many"), "n:1").otherwise("1:1").alias("cardinality"))


def report_sources(queries: DataFrame) -> DataFrame:
    """How each query is sourced: join, derived (from another query), package, or none; and its filters."""
    source = F.try_element_at(elements(F.col("xml"), "source"), F.lit(1))
    derived = attribute(source, "refQuery", "queryRef")
    kind = (F.when(source.rlike(r"<joinOperation[\s/>]"), "join").when(source.rlike(r"<queryRef[\s/>]"), "derived")
            .when(source.rlike(r"<model[\s/>]"), "package").otherwise("none"))
    details = F.array_join(elements(F.col("xml"), "detailFilters"), "")
    filters = F.transform(elements(details, "detailFilter"), lambda x: _text(
        read_element(x, "filterExpression string").getField("filterExpression")))
    return queries.select(
        "path", "query_no", "query", kind.alias("source"),
        F.when(kind == "derived", clean_label(derived)).alias("derived_from"),
        F.filter(filters, lambda f: f.isNotNull()).alias("detail_filters"))


# Layout elements that are visuals, and their kind.
LAYOUT_VISUALS = {"list": "table", "crosstab": "matrix", "vizColumn": "column", "vizBar": "bar", "vizLine": "line",
                  "vizPie": "pie", "barChart": "bar", "columnChart": "column", "lineChart": "line", "pieChart": "pie"}


def report_visuals(reports: DataFrame) -> DataFrame:
    """Pages and visuals of reports: kind, query, and for lists the shown columns in order.

    A page without visuals has one row with a null kind.
    """
    pages = _xml_rows(reports, "page", "page_no", "xml")
    name = attribute(F.col("xml"), "name", "page")
    tags = "|".join(LAYOUT_VISUALS)
    visual = rf"(?s)<(?:{tags})(?=[\s/>]){_ATTRIBUTES}(?:(?<=/)>|>(?:.*?(?=<(?:{tags})[\s/>])|.*))"
    pages = pages.select("path", "page_no", clean_label(F.coalesce(name, _numbered_name("Page", "page_no"))).alias("page"),
                         F.posexplode_outer(F.regexp_extract_all("xml", F.lit(visual), F.lit(0))).alias("visual_no", "xml"))
    shown = F.transform(elements(F.col("xml"), "listColumn"), lambda x: F.coalesce(*[
        attribute(x, "refDataItem", tag) for tag in ("dataItemValue", "dataItemLabel")]))
    query = attribute(F.col("xml"), "refQuery")
    return pages.select(
        "path", "page_no", "page", (F.col("visual_no") + 1).alias("visual_no"),
        _lookup(LAYOUT_VISUALS, F.regexp_extract("xml", r"^<(\w+)", 1)).alias("kind"),
        F.when(query.isNotNull(), clean_label(query)).alias("query"),
        F.array_distinct(F.filter(shown, lambda c: c.isNotNull())).alias("shown"))


# -------------------------------------------------------------------- framework models


def model_columns(models: DataFrame) -> DataFrame:
    """Query items of framework models: table, column, type and usage."""
    subjects = _xml_rows(models, "querySubject", "table_no", "xml")
    header = F.regexp_replace("xml", r"(?s)<queryItem(?=[\s/>])[^>]*?(?:/>|>.*?</queryItem\s*>)", "")
    subjects = subjects.withColumn("subject", read_element(header, "_name string, name array<string>"))
    rows = subjects.select("path", "table_no", _name("subject", _numbered_name("QuerySubject", "table_no")).alias("table"),
                           *_numbered(elements(F.col("xml"), "queryItem"), "ordinal", "xml"))
    schema = ("_name string, name array<string>, datatype string, dataTypeChild string, _datatype string, "
              "usage string, _usage string")
    xml = F.regexp_replace("xml", r"<(/?)dataType\s*>", "<$1dataTypeChild>")
    rows = rows.withColumn("item", read_element(xml, schema))
    declared = F.coalesce(_text(F.col("item.datatype")), _text(F.col("item.dataTypeChild")), F.col("item._datatype"))
    usage = F.lower(F.trim(F.coalesce(_text(F.col("item.usage")), F.col("item._usage"), F.lit(""))))
    return rows.select(
        "path", "table_no", "table", (F.col("ordinal") + 1).alias("ordinal"), _name("item", F.lit("Item")).alias("column"),
        normalize_type(declared).alias("type"), usage.alias("usage"), usage.isin(KEY_USAGES).alias("is_key"),
        usage.isin(FACT_USAGES).alias("is_fact"))


def model_relationships(models: DataFrame) -> DataFrame:
    """All column pairs of framework relationships, with the operator that compares them.

    Pair 1 is the relationship's own pair; further pairs make it a composite key. A relationship whose
    condition has two references but no readable comparison keeps them, with a null operator; one with
    fewer references has null tables.
    """
    rows = _xml_rows(models, "relationship", "seq", "xml")
    rows = rows.withColumn("rel", read_element(F.col("xml"), "_name string, name array<string>, expression string"))
    rows = rows.withColumn("expression", _text(F.col("rel.expression"))).filter("expression is not null")
    name = _name("rel", _numbered_name("Relationship", "seq"))
    qualified = r"\[[^\[\]]+\](?:\.\[[^\[\]]+\])+"
    comparison = rf"({qualified})\s*(<=|>=|<>|=|<|>)\s*({qualified})"
    part = lambda i: F.regexp_extract_all("expression", F.lit(comparison), F.lit(i))
    compared = F.arrays_zip(part(1).alias("left"), part(2).alias("operator"), part(3).alias("right"))
    references = F.regexp_extract_all("expression", F.lit(qualified), F.lit(0))
    bare = F.array(F.struct(F.get(references, F.lit(0)).alias("left"), F.lit(None).cast("string").alias("operator"),
                            F.get(references, F.lit(1)).alias("right")))
    usable = F.when(F.size(compared) > 0, compared).otherwise(bare)
    rows = rows.select("path", "seq", name.alias("name"), "expression", F.posexplode(usable).alias("pair_no", "pair"))
    both = F.col("pair.left").isNotNull() & F.col("pair.right").isNotNull()
    end = lambda side, i: F.when(both, clean_label(F.try_element_at(segments(F.col(f"pair.{side}")), F.lit(i))))
    return rows.select(
        "path", "seq", "name", (F.col("pair_no") + 1).alias("pair_no"), end("left", -2).alias("from_table"),
        end("left", -1).alias("from_column"), F.col("pair.operator").alias("operator"),
        end("right", -2).alias("to_table"), end("right", -1).alias("to_column"), "expression")


# ------------------------------------------------------------------------- data modules


def _parsed(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("path", F.try_parse_json("content").alias("doc"))


def module_columns(modules: DataFrame) -> DataFrame:
    """Query items of data modules: table, column, type, usage, default aggregate and expression."""
    subjects = _parsed(modules).select("path", F.posexplode(
        _first_of(F.col("doc"), ["querySubject", "querysubject"], "array<variant>")).alias("table_no", "subject"))
    subjects = subjects.withColumn("table_no", F.col("table_no") + 1)
    rows = subjects.select(
        "path", "table_no", _label(F.col("subject"), _numbered_name("QuerySubject", "table_no")).alias("table"),
        F.posexplode(_get(F.col("subject"), "$.item", "array<variant>")).alias("ordinal", "entry"))
    item = _get(F.col("entry"), "$.queryItem", "variant")
    rows = rows.withColumn("item", item).filter(F.schema_of_variant("item").startswith("OBJECT"))
    usage = F.lower(F.trim(F.coalesce(_get(F.col("item"), "$.usage", "string"), F.lit(""))))
    aggregate = F.lower(F.coalesce(_first_of(F.col("item"), ["regularAggregate", "aggregate"], "string"), F.lit("")))
    is_key, is_fact = usage.isin(KEY_USAGES), usage.isin(FACT_USAGES)
    return rows.select(
        "path", "table_no", "table", (F.col("ordinal") + 1).alias("ordinal"),
        _label(F.col("item"), F.lit("Item")).alias("column"),
        normalize_type(_first_of(F.col("item"), ["datatype", "dataType"], "string")).alias("type"),
        usage.alias("usage"), is_key.alias("is_key"), is_fact.alias("is_fact"),
        F.when(is_key, "none").when(is_fact, F.coalesce(_lookup(SUMMARIZE_BY, aggregate), F.lit("sum"))).alias("summarize_by"),
        F.when(F.trim(_get(F.col("item"), "$.expression", "string")) != "", _get(F.col("item"), "$.expression", "string")
               ).alias("expression"))


def _reference_parts(reference: Column) -> Column:
    """Segments of a reference that is a list, or a dotted text with or without brackets."""
    plain = F.regexp_replace(_get(reference, "$", "string"), r"[\[\]]", "")
    dotted = F.filter(F.split(plain, r"\."), lambda part: F.trim(part) != "")
    return F.transform(F.coalesce(_get(reference, "$", "array<string>"), dotted), lambda part: clean_label(part))


def _part(reference: Column, position: int) -> Column:
    return F.try_element_at(_reference_parts(reference), F.lit(position))


def module_relationships(modules: DataFrame) -> DataFrame:
    """All column pairs of data module relationships, from the many side to the one side.

    Pair 1 is the relationship's own pair. A relationship without usable links has one row with nulls.
    """
    rows = _parsed(modules).select("path", F.posexplode(
        _first_of(F.col("doc"), ["relationship", "relationships"], "array<variant>")).alias("seq", "rel"))
    rows = rows.withColumn("seq", F.col("seq") + 1).filter(F.schema_of_variant("rel").startswith("OBJECT"))
    rows = rows.select(
        "path", "seq", _label(F.col("rel"), _numbered_name("Relationship", "seq")).alias("name"),
        _get(F.col("rel"), "$.left.ref", "variant").alias("left_ref"),
        _get(F.col("rel"), "$.right.ref", "variant").alias("right_ref"),
        F.lower(_get(F.col("rel"), "$.left.maxcard", "string")).isin("many", "n", "*").alias("left_many"),
        F.posexplode_outer(_first_of(F.col("rel"), ["link", "links"], "array<variant>")).alias("pair_no", "link"))
    for side in ("left", "right"):
        link_ref = _get(F.col("link"), f"$.{side}Ref", "variant")
        item_ref = _get(F.col("link"), f"$.{side}ItemRef", "variant")
        rows = rows.withColumns({
            f"{side}_table": F.coalesce(_part(F.col(f"{side}_ref"), 1), _part(link_ref, 1)),
            f"{side}_column": F.coalesce(_part(link_ref, -1), _part(item_ref, -1))})
    names = ["left_table", "left_column", "right_table", "right_column"]
    usable = F.lit(True)
    for n in names:
        usable = usable & F.col(n).isNotNull()
    many = F.coalesce("left_many", F.lit(False))
    pick = lambda if_many, otherwise: F.when(usable, F.when(many, F.col(if_many)).otherwise(F.col(otherwise)))
    return rows.select(
        "path", "seq", "name", (F.coalesce("pair_no", F.lit(0)) + 1).alias("pair_no"),
        pick("left_table", "right_table").alias("from_table"), pick("left_column", "right_column").alias("from_column"),
        pick("right_table", "left_table").alias("to_table"), pick("right_column", "left_column").alias("to_column"))


# --------------------------------------------------------------------------- dashboards

# Widget types without data.
DECORATIVE = ["text", "image", "media", "shape", "webpage"]

_PLACES = T.ArrayType(T.StructType([
    T.StructField("page_no", T.IntegerType()), T.StructField("page", T.StringType()),
    T.StructField("visual_no", T.IntegerType()), T.StructField("widget", T.StringType())]))


def _layout_places() -> Callable:
    """Places of the widgets of a layout. Layouts nest to any depth, which no fixed schema can follow.

    Everything the workers run is defined in here, so that they need nothing but pandas.
    """

    def widget_places(layout: dict) -> list[tuple]:
        """Widgets of one layout, by page, in order. Top-level containers are pages; deeper ones just nest."""
        items = layout.get("items")
        top = [i for i in items if isinstance(i, dict)] if isinstance(items, list) else []
        if not top:
            return []
        pages = top if any(isinstance(i.get("items"), list) for i in top) else [layout]
        places = []
        for number, page in enumerate(pages, 1):
            label = next((str(page[k]) for k in ("name", "title", "label") if page.get(k)), f"Page{number}")
            stack = [i for i in reversed(page["items"] if isinstance(page.get("items"), list) else []) if isinstance(i, dict)]
            position = 0
            while stack:
                node = stack.pop()
                nested = node.get("items")
                if isinstance(nested, list) and nested:
                    stack.extend(i for i in reversed(nested) if isinstance(i, dict))
                elif node.get("id"):
                    position += 1
                    places.append((number, " ".join(label.split()) or "Unnamed", position, str(node["id"])))
            if position == 0:
                places.append((number, " ".join(label.split()) or "Unnamed", None, None))
        return places

    @F.pandas_udf(_PLACES)
    def layout_places(layouts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in layouts:
            parsed = (json.loads(text) if text else None for text in batch)
            yield pd.Series([widget_places(layout) if isinstance(layout, dict) else [] for layout in parsed], dtype=object)

    return layout_places


def dashboard_widgets(dashboards: DataFrame) -> DataFrame:
    """Widgets with the page they are on. Without a usable layout all widgets share page 1.

    A page without widgets has one row with a null widget.
    """
    docs = _parsed(dashboards)
    listed = _get(F.col("doc"), "$.widgets", "array<variant>")
    by_id = F.map_entries(_get(F.col("doc"), "$.widgets", "map<string, variant>"))
    numbered = F.transform(listed, lambda w, i: F.struct(
        F.coalesce(_get(w, "$.id", "string"), i.cast("string")).alias("key"), w.alias("value")))
    widgets = F.filter(F.coalesce(by_id, numbered), lambda e: F.schema_of_variant(e.getField("value")).startswith("OBJECT"))
    layout = F.to_json(_get(F.col("doc"), "$.layout", "variant"))
    docs = docs.select("path", widgets.alias("widgets"), _layout_places()(layout).alias("places"))
    ids = F.transform("widgets", lambda e, i: F.struct(
        F.lit(1).alias("page_no"), F.lit("Page1").alias("page"), (i + 1).alias("visual_no"), e.getField("key").alias("widget")))
    places = F.when(F.size("places") > 0, F.col("places")).otherwise(ids)
    own = lambda p: F.filter("widgets", lambda e: e.getField("key") == p.getField("widget"))
    placed = F.transform(places, lambda p: F.struct(
        *[p.getField(name).alias(name) for name in ("page_no", "page", "visual_no", "widget")],
        F.try_element_at(own(p), F.lit(-1)).getField("value").alias("definition")))
    rows = docs.select("path", F.inline(placed))
    # Places that name no widget are dropped; empty pages stay.
    rows = rows.filter("widget is null or definition is not null")
    kinds = [F.lower(F.regexp_replace(_get(F.col("definition"), f"$.{name}", "string"), "[_\\- ]", ""))
             for name in ("name", "visTipId", "visId", "visualization", "subType", "type")]
    kind = F.coalesce(*[_lookup(VISUAL_KINDS, k) for k in kinds], F.lit("table"))
    decorative = F.lower(F.trim(_get(F.col("definition"), "$.type", "string"))).isin(DECORATIVE)
    decorative = F.coalesce(decorative, F.lit(False))
    return rows.withColumn("kind", F.when(F.col("widget").isNotNull(), F.when(decorative, "decorative").otherwise(kind)))


def dashboard_fields(widgets: DataFrame) -> DataFrame:
    """Fields of every visual: table, column and role."""
    shown = widgets.filter("kind <> 'decorative'")
    views = _first_of(F.col("definition"), ["data.dataViews", "data.datasets"], "array<variant>")
    of_view = F.flatten(F.transform(views, lambda v: F.coalesce(
        _get(v, "$.dataItems", "array<variant>"), _get(v, "$.modelItems", "array<variant>"), F.expr("array()"))))
    slots = _first_of(F.col("definition"), ["slotmapping.slots", "slotMapping.slots"], "array<variant>")
    roles = F.flatten(F.transform(slots, lambda s: F.transform(
        F.coalesce(_get(s, "$.dataItems", "array<string>"), _get(s, "$.dataItemIds", "array<string>"), F.expr("array()")),
        lambda item: F.struct(item.alias("item"), F.coalesce(
            _lookup(SLOT_ROLES, F.lower(F.trim(_get(s, "$.name", "string")))), F.lit("values")).alias("role")))))
    rows = shown.withColumn("roles", roles).select(
        "path", "page_no", "page", "visual_no", "kind", "widget", "roles", F.posexplode(of_view).alias("field_no", "item"))
    reference = F.coalesce(*[_text(_get(F.col("item"), f"$.{n}", "string")) for n in ("itemId", "itemLabel", "ref", "id")])
    item_id = F.coalesce(_get(F.col("item"), "$.id", "string"), F.col("field_no").cast("string"))
    rows = rows.withColumns({"reference": reference, "item_id": item_id}).filter("reference is not null")
    own = F.filter("roles", lambda r: r.getField("item") == F.col("item_id"))
    role = F.coalesce(F.try_element_at(own, F.lit(-1)).getField("role"), F.lit("values"))
    return rows.select("path", "page_no", "page", "visual_no", "kind", (F.col("field_no") + 1).alias("field_no"),
                       split_reference(F.col("reference")).alias("field"), role.alias("role")).select(
        "path", "page_no", "page", "visual_no", "kind", "field_no", "field.table", "field.column", "role")


def synthesized_tables(fields: DataFrame) -> DataFrame:
    """The tables and columns that the visuals of each dashboard need."""
    return fields.select("path", "table", "column").distinct()
