"""Report visuals as DataFrames: fields in roles become groups, pivots and aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from starfold.plans.model import MERGE, Measure, Model, fields_of, output_names
from starfold.session import materialize

# Slot name -> role. Other slots hold values.
SLOT_ROLES = {
    "categories": "category", "category": "category", "ordinal": "category", "x": "category",
    "values": "values", "value": "values", "y": "values", "length": "values", "size": "values",
    "series": "series", "color": "series", "rows": "rows", "columns": "columns",
}

# Visualization name (no dashes, lower case) -> kind of visual. Others are tables.
VISUAL_KINDS = {
    "column": "column", "clusteredcolumn": "column", "stackedcolumn": "column",
    "bar": "bar", "clusteredbar": "bar", "stackedbar": "bar",
    "line": "line", "spline": "line", "area": "line",
    "pie": "pie", "donut": "pie",
    "list": "table", "table": "table", "datatable": "table",
    "crosstab": "matrix", "pivot": "matrix",
    "summary": "card", "kpi": "card", "singleton": "card", "kpisparkline": "card",
}

# Aggregate name of a column -> how it is summarised by default.
SUMMARIZE_BY = {
    "total": "sum", "sum": "sum", "average": "average", "avg": "average", "minimum": "min", "min": "min",
    "maximum": "max", "max": "max", "count": "count", "countdistinct": "distinctCount",
    "calculated": "none", "automatic": "none", "none": "none",
}


@dataclass(frozen=True)
class Visual:
    """``slots`` maps a slot name to fields: "table.column" or the name of a measure."""

    name: str
    slots: Mapping[str, Sequence[str]]
    filters: Mapping[str, str] = field(default_factory=dict)
    use: Sequence[str] = ()
    totals: bool = False

    @property
    def kind(self) -> str:
        return VISUAL_KINDS.get(self.name.replace("_", "").replace("-", "").strip().lower(), "table")

    def roles(self) -> dict[str, list[str]]:
        roles: dict[str, list[str]] = {}
        for slot, fields in self.slots.items():
            roles.setdefault(SLOT_ROLES.get(slot.strip().lower(), "values"), []).extend(fields)
        return roles


def implicit_measure(model: Model, reference: str) -> Measure | None:
    """The default aggregate of a column in a value role; None for columns that are not summarised.

    By default, numbers of a fact are summed, unless they are a key of some relationship or hidden. Everything else is
    shown as it is. ``summarize_by`` of the table goes first.
    """
    name, _, column = reference.partition(".")
    table = model.tables[name]
    how = table.summarize_by.get(column)
    if how is None:
        keys = {many for r in model.relationships if r.from_table == name for many, _ in r.keys}
        keys |= {one for r in model.relationships if r.to_table == name for _, one in r.keys}
        number = isinstance(table.rows().schema[column].dataType, NumericType)
        how = "sum" if table.is_fact and number and column not in keys and column not in table.hidden else "none"
    if how == "none":
        return None
    return Measure(column, name, {"distinctCount": "countdistinct"}.get(how, how), column)


def detail_table(model: Model, columns: Sequence[str], filters: Mapping[str, str], use: Sequence[str]) -> str:
    """The table whose rows a list without measures shows: the one that reaches all others."""
    named = list(dict.fromkeys([c.partition(".")[0] for c in columns] + list(filters)))
    if not columns:
        raise ValueError("a visual needs a column or a measure")

    def reaches(start: str) -> bool:
        try:
            return all(model.path(start, t, use) is not None for t in named)
        except ValueError:
            return False

    for start in [*named, *model.tables]:
        if reaches(start):
            return start
    raise ValueError(f"no table reaches all of {named}")


def _split(model: Model, fields: Sequence[str], in_values: bool) -> tuple[list[str], list]:
    """Group columns and measures among fields."""
    columns, measures = [], []
    for name in dict.fromkeys(fields):
        if name in model.measures:
            measures.append(name)
        elif in_values and (measure := implicit_measure(model, name)):
            measures.append(measure)
        else:
            columns.append(name)
    return columns, measures


def visual_frame(model: Model, visual: Visual) -> DataFrame:
    """The rows that a visual shows."""
    roles = visual.roles()
    if visual.kind == "matrix":
        return _matrix(model, visual, roles)
    group: list[str] = []
    measures: list = []
    for role in ("category", "rows", "series", "columns", "values"):
        in_values = role == "values" and (visual.kind != "table" or "columns" not in roles)
        columns, own = _split(model, roles.get(role, []), in_values)
        group += columns
        measures += own
    if not measures:
        return model.rows(detail_table(model, group, visual.filters, visual.use), group, visual.filters, visual.use)
    df = model.query(group, measures, visual.filters, visual.use)
    if visual.kind == "line":
        axis = roles.get("category") or roles.get("rows")
        if not axis:
            raise ValueError("a line needs a category")
        return df.orderBy(output_names(group)[group.index(axis[0])])
    return df


def _label(fields: Sequence[str], summed: Sequence[Column]) -> Column:
    """The name of a column of a matrix: its values, or ``total`` where they are summed. No two columns share a name.

    Text that reads like null or total is put in quotes; several values are joined by bars, and bars in them doubled.
    """
    label = F.lit(None).cast("string")
    for i in range(len(fields), -1, -1):
        parts = []
        for name in fields[:i]:
            text = F.col(name).cast("string")
            text = F.when(text.rlike("^'*(null|total)'*$"), F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)
            parts.append(F.coalesce(F.replace(text, F.lit("|"), F.lit("||")) if len(fields) > 1 else text, F.lit("null")))
        own = F.concat_ws(" | ", *parts, *([F.lit("total")] if i < len(fields) else []))
        here = summed[i] if i < len(fields) else F.lit(True)
        earlier = summed[i - 1] if i else F.lit(False)
        label = F.when(here & ~earlier, own).otherwise(label)
    return label


def _matrix(model: Model, visual: Visual, roles: Mapping[str, list[str]]) -> DataFrame:
    """Rows by the fields in rows, and a column for each combination of the fields in columns, null included.

    With ``totals``, the measures are also taken with the last fields summed away, on either side: such rows have nulls
    there and say in ``row_level`` how many fields that is; such columns are named ``total``. The measures are grouped once,
    at all these grains, and written; only the names of the columns come to the driver.
    """
    rows, row_measures = _split(model, roles.get("category", []) + roles.get("rows", []), False)
    columns, column_measures = _split(model, roles.get("series", []) + roles.get("columns", []), False)
    extra, measures = _split(model, roles.get("values", []), True)
    measures = row_measures + column_measures + measures
    rows = rows + extra
    if not measures:
        raise ValueError("a matrix needs a measure")
    names = output_names(rows + columns)
    n, across = len(rows), names[len(rows):]
    sets = [[*range(r), *range(n, n + c)] for r in range(n, -1, -1) for c in range(len(columns), -1, -1)]
    df = model.query(rows + columns, measures, visual.filters, visual.use, sets if visual.totals else None)
    measure_names = [m if isinstance(m, str) else m.name for m in measures]
    bit = lambda i: F.col("grouping_level").bitwiseAND(1 << (len(names) - 1 - i)) != 0
    summed = [bit(i) if visual.totals else F.lit(False) for i in range(len(names))]
    level = [sum([s.cast("int") for s in summed[:n]], F.lit(0)).alias("row_level")] if visual.totals else []
    if not columns:
        return df.select(*names, *level, *measure_names)
    keys = names[:n] + ["row_level"] * visual.totals
    cells = df.select(*names, *level, *measure_names, _label(across, summed[n:]).alias("matrix_column"),
                      sum([s.cast("int") for s in summed[n:]], F.lit(0)).alias("matrix_level"))
    cells = materialize(cells, "matrix")
    # One row for each column of the result, which a table has to name.
    order = [F.col(c).asc_nulls_last() for c in across]
    labels = [r[0] for r in cells.select("matrix_column", "matrix_level", *across).distinct().orderBy("matrix_level", *order).collect()]
    pivoted = cells.groupBy(*keys).pivot("matrix_column", labels) if labels else cells.groupBy(*keys)
    return pivoted.agg(*[F.first(m).alias(m) for m in measure_names])


def matrix_cells(model: Model, visual: Visual) -> DataFrame:
    """A matrix in long form, one row for each cell: rows, column and measures. Has no limit on the columns."""
    roles = visual.roles()
    fields = [f for role in ("category", "rows", "series", "columns") for f in roles.get(role, [])]
    group, measures = _split(model, fields, False)
    extra, own = _split(model, roles.get("values", []), True)
    return model.query(group + extra, measures + own, visual.filters, visual.use)


def page_frames(model: Model, visuals: Mapping[str, Visual]) -> dict[str, DataFrame]:
    """One lazy DataFrame per visual of a page.

    Visuals of one fact with the same filters share one scan: their measures are folded once, at the grain of all their
    fields together, and written; each visual is then merged from the smallest of what is written that has its fields.
    A visual whose measures cannot be merged (a distinct count) reads the fact itself.
    """
    shared: dict[tuple, list[str]] = {}
    plans: dict[str, tuple[list, list[Measure]]] = {}
    for name, visual in visuals.items():
        plan = _page_plan(model, visual)
        if plan is not None:
            plans[name] = plan
            key = (plan[1][0].table, tuple(sorted(visual.filters.items())), tuple(visual.use))
            shared.setdefault(key, []).append(name)
    frames = {}
    for (fact, filters, use), members in shared.items():
        if len(members) > 1:
            frames |= _from_one_base(model, fact, dict(filters), use, {m: plans[m] for m in members})
    return {name: frames[name] if name in frames else visual_frame(model, visual) for name, visual in visuals.items()}


def _page_plan(model: Model, visual: Visual) -> tuple[list, list[Measure]] | None:
    """Group fields and measures of a visual that can be merged from a finer grain; None for others."""
    roles = visual.roles()
    if visual.kind in ("matrix", "line"):
        return None
    group, measures = [], []
    for role in ("category", "rows", "series", "columns", "values"):
        columns, own = _split(model, roles.get(role, []), role == "values" and (visual.kind != "table" or "columns" not in roles))
        group += columns
        measures += [model.measures[m] if isinstance(m, str) else m for m in own]
    one_fact = len({m.table for m in measures}) == 1
    return (group, measures) if one_fact and model.mergeable(measures) else None


def _from_one_base(model: Model, fact: str, filters: Mapping[str, str], use: Sequence[str], plans: Mapping[str, tuple[list, list[Measure]]]
                   ) -> dict[str, DataFrame]:
    """Visuals of one fact by merging partial results, finest first."""
    every = list(dict.fromkeys(f for group, _ in plans.values() for f in group))
    measures = list({m.name: m for _, own in plans.values() for m in own}.values())
    number = {f: i for i, f in enumerate(every)}
    base_fields = fields_of([(f, f"page_{i}") for i, f in enumerate(every)])
    held = [(set(every), materialize(model.partials(fact, base_fields, measures, filters, use), "page"))]
    columns = model.part_columns(measures)
    frames: dict[str, DataFrame] = {}
    for name, (group, own) in sorted(plans.items(), key=lambda item: -len(set(item[1][0]))):
        _, source = min((h for h in held if set(group) <= h[0]), key=lambda h: len(h[0]))
        merged = source.groupBy(*[f"field_{number[f]}" for f in group]).agg(
            *[F.expr(MERGE[function].format(column)).alias(column) for (function, _), column in columns.items()])
        if set(group) != set(every) and any(set(g) < set(group) for g, _ in plans.values()):
            merged = materialize(merged, "page")
            held.append((set(group), merged))
        shown = [F.col(f"field_{number[f]}").alias(alias) for f, alias in zip(group, output_names(group))]
        frames[name] = merged.select(*shown, *[F.expr(m.result_sql(columns)).alias(m.name) for m in own])
    return frames


def paginated_list(model: Model, fact: str, columns: Sequence[str], filters: Mapping[str, str] | None = None,
                   order_by: Sequence[str] = (), use: Sequence[str] = ()) -> DataFrame:
    """Detail rows of a list, without grouping. Write the result; do not collect it."""
    df = model.rows(fact, columns, filters, use)
    return df.orderBy(*order_by) if order_by else df
