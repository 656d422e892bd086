"""One pass over a corpus of definition files: metadata, findings, and how much was understood."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.functions import expressions as X
from starfold.operators import extract as E
from starfold.operators.rules import SEVERITY
from starfold.session import materialize, materialize_all
from starfold.sources.artifacts import with_status
from starfold.sources.tables import refresh_snapshot

_COUNTS = ["n_tables", "n_measures", "n_pages", "n_relationships", "n_findings"]


def extract_corpus(artifacts: DataFrame) -> dict[str, DataFrame]:
    """Metadata tables of all readable artifacts. Each is written once, as several results use it.

    The files are written by kind, so that each extraction reads the files of its own kind only. Then the queries and the
    widgets are cut out, and at last everything in them, each time all kinds at once.
    """
    files = materialize(with_status(artifacts), "corpus-files", partition_by=["kind", "status"])
    of_kind = lambda kind: files.filter((F.col("status") == "ok") & (F.col("kind") == kind)).select("path", "content")
    reports, models, modules = of_kind("report"), of_kind("model"), of_kind("module")
    cut = materialize_all({"queries": E.report_queries(reports), "widgets": E.dashboard_widgets(of_kind("dashboard"))}, "corpus")
    queries, widgets = cut["queries"], cut["widgets"]
    extracted = {
        "items": E.report_items(queries), "joins": E.report_joins(queries), "sources": E.report_sources(queries),
        "visuals": E.report_visuals(reports),
        "model_columns": E.model_columns(models), "model_rels": E.model_relationships(models),
        "module_columns": E.module_columns(modules), "module_rels": E.module_relationships(modules),
        "fields": E.dashboard_fields(widgets),
    }
    written = materialize_all(extracted, "corpus")
    return {"files": files.select("path", "kind", "status", "error"), "widgets": widgets.drop("definition"), **written}


def corpus_tables(c: Mapping[str, DataFrame]) -> DataFrame:
    """Tables of all artifacts, with the number of measures and whether a column is a fact."""
    by_item = c["items"].groupBy("path", F.col("query").alias("table")).agg(
        F.count_if(F.col("item_class") == "measure").alias("n_measures"))
    from_columns = c["model_columns"].select("path", "table", "is_fact").unionByName(
        c["module_columns"].select("path", "table", "is_fact"))
    by_column = from_columns.groupBy("path", "table").agg(F.max("is_fact").alias("is_fact"))
    synthesized = c["fields"].select("path", "table").distinct()
    hint = lambda is_fact: F.when(is_fact, "fact").alias("role_hint")
    none, zero = F.lit(None).cast("string").alias("role_hint"), F.lit(0).cast("long").alias("n_measures")
    return (by_item.select("path", "table", none, "n_measures")
            .unionByName(by_column.select("path", "table", hint(F.col("is_fact")), zero))
            .unionByName(synthesized.select("path", "table", none, zero)))


def corpus_columns(c: Mapping[str, DataFrame]) -> DataFrame:
    """Columns of all artifacts as model metadata."""
    items = c["items"].filter("item_class <> 'measure'").select(
        "path", F.col("query").alias("table"), F.col("item_no").alias("ordinal"), F.col("item").alias("column"), "type",
        F.lit("").alias("usage"))
    declared = [c[name].select("path", "table", "ordinal", "column", "type", "usage") for name in ("model_columns", "module_columns")]
    shown = c["fields"].groupBy("path", "table", "column").agg(F.min(F.struct("page_no", "visual_no", "field_no")).alias("first"))
    shown = shown.select("path", "table", F.col("first.field_no").alias("ordinal"), "column", F.lit("string").alias("type"),
                         F.lit("").alias("usage"))
    return reduce(DataFrame.unionByName, [items, *declared, shown])


def corpus_relationships(c: Mapping[str, DataFrame]) -> DataFrame:
    """First column pair of every relationship, in declared order."""
    ends = ["from_table", "from_column", "to_table", "to_column"]
    declared = Window.partitionBy("path").orderBy("query_no", "join_no")  # the joins of one file
    joins = c["joins"].filter("mapped").select("path", F.row_number().over(declared).cast("long").alias("seq"), *ends)
    others = [c[name].filter("pair_no = 1 and from_table is not null").select("path", F.col("seq").cast("long").alias("seq"), *ends)
              for name in ("model_rels", "module_rels")]
    return reduce(DataFrame.unionByName, [joins, *others])


def _finding(rows: DataFrame, code: str, source_ref: Column | None = None, severity: str | None = None) -> DataFrame:
    reference = F.lit(None).cast("string") if source_ref is None else source_ref
    return rows.select("path", F.lit(code).alias("code"), F.lit(severity or SEVERITY[code]).alias("severity"),
                       reference.alias("source_ref"))


def corpus_findings(c: Mapping[str, DataFrame]) -> DataFrame:
    """All findings of the extraction rules."""
    readable = c["files"].filter("status = 'ok'")
    of = lambda kind: readable.filter(F.col("kind") == kind).select("path")
    without = lambda paths, rows: paths.join(rows.select("path").distinct(), "path", "left_anti")
    items, sources, visuals = c["items"], c["sources"], c["visuals"]
    filters = sources.select("path", F.explode("detail_filters").alias("condition"))
    measures = items.filter("item_class = 'measure' and expression is not null").filter(~X.is_understood(F.col("expression")))
    findings = [
        _finding(without(of("report"), items), "no-queries"),
        _finding(without(of("report"), visuals), "no-pages"),
        _finding(sources.filter("source = 'derived'"), "derived-query", F.col("derived_from")),
        _finding(sources.filter("source = 'package'").select("path").distinct(), "package-source"),
        _finding(filters, "detail-filter", F.col("condition")),
        _finding(items.filter("item_class = 'unmapped'"), "calculation-needs-review", F.col("expression")),
        _finding(measures, "measure-needs-review", F.col("expression")),
        _finding(items.filter("broken"), "element-needs-review", F.concat(F.col("query"), F.lit("."), F.col("item"))),
        _finding(c["joins"].filter("not mapped"), "join-needs-review", F.col("condition")),
        _finding(c["joins"].filter("mapped"), "join-relationship"),
        _finding(visuals.filter("kind is not null and query is null"), "visual-unbound"),
        _finding(without(of("model"), c["model_columns"]), "no-query-subjects"),
        _finding(without(of("module"), c["module_columns"]), "no-query-subjects"),
        _finding(c["module_columns"].filter("expression is not null and not is_key"), "calculation-needs-review",
                 F.col("expression"), "info"),
        _finding(without(of("dashboard"), c["widgets"]), "no-pages"),
        _finding(without(of("dashboard"), c["fields"]), "dashboard-no-data"),
    ]
    tables = corpus_tables(c).select("path", "table")
    for name in ("model_rels", "module_rels"):
        rels = c[name].withColumn("source_ref", F.concat(F.lit("relationship "), F.col("name")))
        first = rels.filter("pair_no = 1")
        bound = first.filter("from_table is not null")
        ends = bound.select("path", "seq", "source_ref", F.explode(F.array("from_table", "to_table")).alias("table"))
        missing = ends.join(tables, ["path", "table"], "left_anti").select("path", "seq", "source_ref").distinct()
        findings += [
            _finding(first.filter("from_table is null"), "relationship-needs-review", F.col("source_ref")),
            _finding(missing, "relationship-unbound", F.col("source_ref")),
            _finding(rels.filter("pair_no = 2"), "relationship-composite-key", F.col("source_ref")),
        ]
    return reduce(DataFrame.unionByName, findings)


def coverage(c: Mapping[str, DataFrame], findings: DataFrame) -> DataFrame:
    """One row per artifact: kind, status, error, and how many things were found in it."""
    one = lambda df, name: df.select("path", F.lit(name).alias("what"))
    pages = c["visuals"].select("path", "page_no").unionByName(c["widgets"].select("path", "page_no")).distinct()
    found = reduce(DataFrame.unionByName, [
        one(corpus_tables(c), "n_tables"), one(c["items"].filter("item_class = 'measure'"), "n_measures"),
        one(pages, "n_pages"), one(corpus_relationships(c), "n_relationships"), one(findings, "n_findings")])
    counted = found.groupBy("path").agg(*[F.count_if(F.col("what") == name).alias(name) for name in _COUNTS])
    return c["files"].join(counted, "path", "left").na.fill(0, _COUNTS)


def totals(rows: DataFrame) -> DataFrame:
    """Totals of a coverage table, in one row."""
    return rows.agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        *[F.sum(name).alias(name) for name in _COUNTS])


def write_coverage(rows: DataFrame, findings: DataFrame, folder: str) -> str:
    """Write the coverage rows and the findings as snapshots; return a short text about the totals.

    Without findings, a list without rows is written, so that an older list does not stay behind.
    """
    spark = rows.sparkSession
    written = refresh_snapshot(rows, f"{folder}/coverage", "json")
    refresh_snapshot(findings, f"{folder}/findings")
    total = totals(written).first()
    lines = ["# Coverage", "", f"Read {total.n_ok} of {total.n_ok + total.n_failed} files; {total.n_failed} failed.", "",
             f"- Tables: {total.n_tables}", f"- Measures: {total.n_measures}", f"- Pages: {total.n_pages}",
             f"- Relationships: {total.n_relationships}", f"- Items to review: {total.n_findings}", ""]
    text = "\n".join(lines)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    return text
