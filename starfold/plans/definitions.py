"""From the definition of a report to DataFrames: its queries become tables of a model, its visuals run over them.

The metadata of one report is small and read to the driver; the data never is. What cannot be bound to the package,
or is refused by Spark, is a finding, and costs no other item.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Row, functions as F

from starfold.functions import parser
from starfold.operators.visuals import Visual, detail_table, visual_frame
from starfold.plans.model import Measure, Model, Relationship, Table

_AGGREGATE_OF = {"sum": "sum", "avg": "average", "min": "min", "max": "max", "count": "count", "count distinct": "countdistinct"}
_VISUAL_NAME = {"matrix": "crosstab"}


@dataclass(frozen=True)
class Definition:
    """The extracted metadata of one report."""

    items: Sequence[Row]
    joins: Sequence[Row]
    sources: Sequence[Row]
    visuals: Sequence[Row]


@dataclass(frozen=True)
class Report:
    """A report's queries as models, its visuals by (page number, visual number), and what is left to review."""

    models: Mapping[str, Model]
    visuals: Mapping[tuple[int, int], tuple[str, Visual]]
    findings: Sequence[Mapping[str, str]]

    def frames(self) -> dict[tuple[int, int], DataFrame]:
        return {place: visual_frame(self.models[query], visual) for place, (query, visual) in self.visuals.items()}


def read_definition(corpus: Mapping[str, DataFrame], path: str) -> Definition:
    """The metadata of one file of an extracted corpus, in its declared order."""
    order = {"items": ["query_no", "item_no"], "joins": ["query_no", "join_no"], "sources": ["query_no"], "visuals": ["page_no", "visual_no"]}
    return Definition(**{name: corpus[name].filter(F.col("path") == path).orderBy(*by).collect() for name, by in order.items()})


def with_scoped(df: DataFrame, columns: Sequence[parser.Scoped]) -> DataFrame:
    """Add aggregates over the rows of equal keys, each by a grouping that is joined back; nulls are keys like others.

    A window would bring all rows of a key together; here a hot key is aggregated in every task first.
    """
    for column in columns:
        keys = [F.expr(k) for k in column.keys]
        totals = df.groupBy(*[k.alias(f"scope_{i}") for i, k in enumerate(keys)]).agg(F.expr(column.aggregate).alias(column.name))
        match = F.lit(True)  # without keys, one row meets all
        for i, key in enumerate(keys):
            match = match & key.eqNullSafe(F.col(f"scope_{i}"))
        df = df.join(totals, match, "left").drop(*[f"scope_{i}" for i in range(len(keys))])
    return df


class _QueryTable:
    """One query of a report while its rows are put together."""

    def __init__(self, name: str, package: Model, findings: list) -> None:
        self.name, self.package, self.findings = name, package, findings
        self.physical: dict[tuple[str, str], str] = {}
        self.columns: list[str] = []
        self.measures: list[Measure] = []
        self._width: dict[str, list[str]] = {}

    def review(self, code: str, text: str | None) -> None:
        self.findings.append({"query": self.name, "code": code, "source_ref": text or ""})

    def column_of(self, segments: list[str]) -> str | None:
        """An item of this query, or a column of the package under a name of its own; None where there is neither."""
        if len(segments) == 1:
            return segments[0] if segments[0] in self.columns else None
        table, column = segments[-2:]
        if table not in self.package.tables:
            return None
        if table not in self._width:
            self._width[table] = self.package.tables[table].rows().columns
        if column not in self._width[table]:
            return None
        return self.physical.setdefault((table, column), f"{table}__{column}")

    def build(self, items: Sequence[Row], filters: Sequence[str]) -> Table | None:
        """The table of the query; None where nothing of it can be bound.

        Texts are bound first, which tells the columns of the package that are needed.
        """
        texts, named = [], set()
        for item in items:
            text = parser.bound(item.expression, self.column_of) if item.expression else None
            if item.broken or text is None:
                self.review("element-needs-review" if item.broken else "reference-unbound", item.expression)
                continue
            if item.item.lower() in named:  # Spark's columns do not differ by case alone
                self.review("name-repeated", item.item)
                continue
            named.add(item.item.lower())
            texts.append((item, text))
            if item.item_class != "measure":
                self.columns.append(item.item)
        conditions = []
        for condition in filters:
            text = parser.bound(condition, self.column_of)
            found = parser.rewrite(text) if text is not None else None
            if found is None or found.is_aggregate or found.columns:
                self.review("detail-filter", condition)
            else:
                conditions.append(found.sql)
        if not self.physical:
            return None
        columns = [f"{t}.{c}" for t, c in self.physical]
        start = detail_table(self.package, columns, {}, ())
        df = self.package.rows(start, [(f"{t}.{c}", name) for (t, c), name in self.physical.items()])
        for item, text in texts:
            df = self._measure(df, item, text) if item.item_class == "measure" else self._column(df, item, text)
        for condition in conditions:
            try:
                df = df.filter(condition)
            except AnalysisException:
                self.review("detail-filter", condition)
        shown = [c for c in self.columns if c in df.columns]
        return Table(df, hidden=[c for c in df.columns if c not in shown], summarize_by={c: "none" for c in shown}, is_fact=True)

    def _own(self, found: parser.Rewritten, item: Row) -> tuple[str, list[parser.Scoped]]:
        """The text with the scoped columns under names that no other item has."""
        rename = lambda sql: re.sub(r"`(scoped_\d+)`", rf"`item_{item.item_no}_\1`", sql)
        return rename(found.sql), [parser.Scoped(f"item_{item.item_no}_{c.name}", rename(c.aggregate), c.keys) for c in found.columns]

    def _column(self, df: DataFrame, item: Row, text: str) -> DataFrame:
        found = parser.rewrite(text)
        try:
            if found is None or found.is_aggregate:
                raise ValueError
            sql, scoped = self._own(found, item)
            return with_scoped(df, scoped).withColumn(item.item, F.expr(sql))
        except (AnalysisException, ParseException, ValueError):
            self.columns.remove(item.item)
            self.review("calculation-needs-review", item.expression)
            return df

    def _measure(self, df: DataFrame, item: Row, text: str) -> DataFrame:
        """A measure that folds where it can: the row expression and its aggregate apart."""
        row, whole = parser.rewrite(text), parser.rewrite(text, item.aggregate)
        try:
            if whole is None or not whole.is_aggregate:
                raise ValueError
            sql, scoped = self._own(whole, item)
            df = with_scoped(df, scoped)
            df.agg(F.expr(sql)).schema  # noqa: B018  refused here, if at all
            how = _AGGREGATE_OF.get(parser.AGGREGATES.get(item.aggregate, ""))
            per_row = not re.fullmatch(r"(?:\[[^\[\]]+\]|[\s\d.+\-*/()])*", text)
            if row is None or row.is_aggregate or how is None:
                self.measures.append(Measure(item.item, self.name, "calculated", sql))
            elif per_row or scoped:
                self.measures.append(Measure(item.item, self.name, how, self._own(row, item)[0], per_row=per_row))
            else:
                self.measures.append(Measure(item.item, self.name, how, re.sub(r"\[([^\[\]]+)\]", r"`\1`", text)))
        except (AnalysisException, ParseException, ValueError):
            self.review("measure-needs-review", item.expression)
        return df


def report_of(definition: Definition, package: Model) -> Report:
    """A report over the tables of ``package``, a model whose table and column names its references end in.

    A query reads the package, the query it is derived from, or the queries that it joins; joins go from the many side to
    the one side, as declared. A visual shows the items of its query that the layout names, in that order and as far as
    they exist; where it names none, all columns and then all measures. Measures are values, columns rows.
    """
    findings: list[dict] = []
    tables: dict[str, Table] = {}
    measures: dict[str, list[Measure]] = {}
    relationships: list[Relationship] = []
    for source in definition.sources:
        items = [i for i in definition.items if i.query_no == source.query_no]
        joins = [j for j in definition.joins if j.query_no == source.query_no and j.mapped]
        for j in joins:
            if j.from_table in tables and j.to_table in tables and j.from_column and j.to_column:
                name = f"join_{source.query_no}_{j.join_no}"
                relationships.append(Relationship(name, j.from_table, j.to_table, [(j.from_column, j.to_column)]))
            else:
                findings.append({"query": source.query, "code": "relationship-unbound", "source_ref": j.condition})
        own = package if source.source in ("package", "none") else Model(tables, _composite(relationships))
        table = _QueryTable(source.query, own, findings)
        if source.source == "derived" and source.derived_from in tables:
            base = source.derived_from
            # Items of a derived query may name items of the query below it without its name.
            direct = table.column_of
            table.column_of = lambda segments, base=base, direct=direct: direct(segments) or direct([base, segments[-1]])
        built = table.build(items, source.detail_filters or [])
        if built is None:
            findings.append({"query": source.query, "code": "query-unbound", "source_ref": ""})
            continue
        tables[source.query] = built
        measures[source.query] = table.measures
    visuals: dict[tuple[int, int], tuple[str, Visual]] = {}
    for v in definition.visuals:
        if v.kind is None:
            continue
        if v.query not in tables:
            findings.append({"query": v.query or "", "code": "visual-unbound", "source_ref": v.page})
            continue
        shown = tables[v.query].visible().columns
        of_query = [m.name for m in measures[v.query]]
        named = [n for n in v.shown or [] if n in shown or n in of_query]
        named = named or shown + of_query
        visuals[v.page_no, v.visual_no] = v.query, Visual(_VISUAL_NAME.get(v.kind, v.kind), {
            "rows": [f"{v.query}.{n}" for n in named if n in shown], "values": [n for n in named if n in of_query]})
    return Report({q: Model({q: t}, (), measures[q]) for q, t in tables.items()}, visuals, findings)


def _composite(relationships: Sequence[Relationship]) -> list[Relationship]:
    """Several joins of the same two tables in the same direction are one with a composite key."""
    keys: dict[tuple[str, str], Relationship] = {}
    for r in relationships:
        known = keys.get((r.from_table, r.to_table))
        keys[r.from_table, r.to_table] = r if known is None else Relationship(known.name, r.from_table, r.to_table, [*known.keys, *r.keys])
    return list(keys.values())
