"""The semantic model: tables, measures and relationships, and the DataFrames of its queries.

Everything here is small metadata on the driver. A query only builds a lazy DataFrame: it joins the
tables that the query names, along the active many-to-one edges that lead to them from the fact. Distinct counts at
several grains at once are the exception: what is folded for them is written first.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from starfold.functions.parser import guarded
from starfold.session import materialize, shuffle_partitions

_IDENTIFIER = re.compile(r"`[^`]+`|\b[A-Za-z_]\w*\b")
_ARITHMETIC = re.compile(r"[\s\d.+\-*/()]*")

# Spark SQL of an aggregate over raw rows, and how partial results of it merge.
_FIRST = {"sum": "sum({})", "count": "count({})", "min": "min({})", "max": "max({})",
          "distinct": "count(distinct {})", "stddev": "stddev_samp({})", "variance": "var_samp({})", "calculated": "{}"}
MERGE = {"sum": "sum({})", "count": "coalesce(sum({}), 0)", "min": "min({})", "max": "max({})"}
_DEALT = 4  # tasks for each shuffle partition where a row is counted at several grains


@dataclass(frozen=True)
class Measure:
    """A named aggregate of one fact table.

    ``aggregate`` is sum, average, min, max, count, countdistinct, rowcount, stddev, variance, or
    calculated, where the expression already is a full aggregate, such as ``approx_count_distinct(x)``.
    Medians and percentiles of large groups are in ``operators.windows``. Arithmetic of columns is aggregated per operand, so
    ``a / b`` is a ratio of sums; ``per_row`` aggregates the row value instead. Any other row
    expression is aggregated as a whole.
    """

    name: str
    table: str
    aggregate: str
    expression: str = "1"
    per_row: bool = False

    def __post_init__(self):
        if self.aggregate not in {"average", "rowcount", "countdistinct", *_FIRST}:
            raise ValueError(f"measure {self.name}: no aggregate {self.aggregate}")

    def operands(self) -> list[str]:
        arithmetic = _ARITHMETIC.fullmatch(_IDENTIFIER.sub("", self.expression))
        names = list(dict.fromkeys(_IDENTIFIER.findall(self.expression)))
        as_whole = self.per_row or self.aggregate == "calculated"
        return names if arithmetic and names and not as_whole else [self.expression]

    def parts(self) -> list[tuple[str, str]]:
        """The (aggregate, row expression) pairs that the measure is computed from."""
        functions = {"average": ["sum", "count"], "rowcount": ["count"], "countdistinct": ["distinct"]}
        return [(f, x) for x in self.operands() for f in functions.get(self.aggregate, [self.aggregate])]

    def result_sql(self, part_columns: Mapping[tuple[str, str], str]) -> str:
        """The measure over its part columns; a zero divisor gives null."""
        names = [part_columns[part] for part in self.parts()]
        if self.aggregate == "average":
            names = [f"try_divide({names[i]}, {names[i + 1]})" for i in range(0, len(names), 2)]
        operands = dict(zip(self.operands(), names))
        if self.expression in operands:
            return names[0]
        return _IDENTIFIER.sub(lambda m: operands.get(m.group(0), m.group(0)), guarded(self.expression))


@dataclass(frozen=True)
class Table:
    """A named relation. Calculated columns are Spark SQL; hidden columns stay out of default lists.

    ``source`` is a DataFrame, or a function that opens it when a query first needs it.
    """

    source: DataFrame | Callable[[], DataFrame]
    calculated: Mapping[str, str] = field(default_factory=dict)
    hidden: Sequence[str] = ()
    summarize_by: Mapping[str, str] = field(default_factory=dict)
    is_fact: bool = False

    def rows(self) -> DataFrame:
        df = self.source if isinstance(self.source, DataFrame) else self.source()
        return with_calculated(df, self.calculated)[0]

    def visible(self) -> DataFrame:
        return self.rows().drop(*self.hidden)


@dataclass(frozen=True)
class Relationship:
    """Equi-join edge from the many side to the one side, on one or more column pairs."""

    name: str
    from_table: str
    to_table: str
    keys: Sequence[tuple[str, str]]
    active: bool = True


def with_calculated(df: DataFrame, calculated: Mapping[str, str]) -> tuple[DataFrame, list[dict]]:
    """Add the calculated columns that Spark understands.

    One that it does not understand leaves the physical column of that name as it is, and is
    returned as a finding.
    """
    findings = []
    for name, expression in calculated.items():
        try:
            df = df.withColumn(name, F.expr(expression))
        except AnalysisException:
            findings.append({"code": "calculation-needs-review", "severity": "warning", "source_ref": expression})
    return df, findings


def first_active_edges(edges: Iterable[tuple[str, str]]) -> list[str]:
    """Status of each edge of one model, in declared order.

    The first edge between two tables, and the first path around a loop, stay active.
    """
    leader: dict[str, str] = {}

    def find(table: str) -> str:
        while leader.get(table, table) != table:
            table = leader[table]
        return table

    pairs: set[frozenset] = set()
    status = []
    for left, right in edges:
        if left == right:
            status.append("self-join")
        elif frozenset((left, right)) in pairs:
            status.append("role-playing")
        elif find(left) == find(right):
            status.append("ambiguous-loop")
        else:
            leader[find(left)] = find(right)
            pairs.add(frozenset((left, right)))
            status.append("active")
    return status


@dataclass(frozen=True)
class _Field:
    """A column in a query: where it comes from, its output name, and its name while tables are joined."""

    table: str
    column: str
    alias: str
    name: str


def fields_of(items: Sequence) -> list[_Field]:
    """Fields of "table.column", "table@role.column" or ("table.column", output name).

    A role is the name of the relationship that leads to the table or to one below it. Columns that share a name get that
    of their role, or else of their table, before it.
    """
    parsed = []
    for item in items:
        text, alias = (item, None) if isinstance(item, str) else item
        table, _, column = text.partition(".")
        parsed.append((table, column, alias))
    plain = Counter(alias or column for _, column, alias in parsed)
    fields = []
    for i, (table, column, alias) in enumerate(parsed):
        if alias is None:
            alias = column if plain[column] == 1 else f"{table.rpartition('@')[2]}_{column}"
        fields.append(_Field(table, column, alias, f"field_{i}"))
    twice = [a for a, n in Counter(f.alias for f in fields).items() if n > 1]
    if twice:
        raise ValueError(f"two columns would be named {twice[0]}: name them in the query")
    return fields


def output_names(items: Sequence) -> list[str]:
    """The columns that fields have in a result."""
    return [f.alias for f in fields_of(items)]


def _outputs(fields: Sequence[_Field]) -> list[Column]:
    return [F.col(f.name).alias(f.alias) for f in fields]


class Model:
    """Tables, relationships in declared order, and measures."""

    def __init__(self, tables: Mapping[str, Table], relationships: Sequence[Relationship] = (),
                 measures: Sequence[Measure] = ()):
        self.tables = dict(tables)
        self.measures = {m.name: m for m in measures}
        status = first_active_edges((r.from_table, r.to_table) for r in relationships)
        self.relationships = [
            Relationship(r.name, r.from_table, r.to_table, r.keys, r.active and s == "active")
            for r, s in zip(relationships, status)
        ]

    # ------------------------------------------------------------- paths

    def edges(self, use: Sequence[str] = ()) -> list[Relationship]:
        """Active edges. An edge named in ``use`` replaces every other edge into its one side."""
        chosen = [r for r in self.relationships if r.name in use]
        missing = set(use) - {r.name for r in chosen}
        if missing:
            raise ValueError(f"no such relationship: {sorted(missing)}")
        replaced = {r.to_table for r in chosen}
        return chosen + [r for r in self.relationships if r.active and r not in chosen and r.to_table not in replaced]

    def path(self, start: str, target: str, use: Sequence[str] = ()) -> list[Relationship]:
        """Many-to-one edges from ``start`` to ``target``.

        The way to ``table@role`` leads over the relationship of that name, active or not, and from there on over tables
        of that role, so a table may occur once for each role beside itself.
        """
        table, _, role = target.partition("@")
        if role:
            edge = next((r for r in self.relationships if r.name == role), None)
            if edge is None:
                raise ValueError(f"no such relationship: {role}")
            as_role = lambda e, source: Relationship(f"{e.name}_as_{role}", source, f"{e.to_table}@{role}", e.keys)
            below = self.path(edge.to_table, table, [u for u in use if u != role])
            return [*self.path(start, edge.from_table, [u for u in use if u != role]), as_role(edge, edge.from_table),
                    *[as_role(e, f"{e.from_table}@{role}") for e in below]]
        edges = self.edges(use)
        reached: dict[str, list[Relationship]] = {start: []}
        queue = deque([start])
        while queue:
            table = queue.popleft()
            for edge in edges:
                if edge.from_table == table and edge.to_table not in reached:
                    reached[edge.to_table] = reached[table] + [edge]
                    queue.append(edge.to_table)
        if target not in reached:
            raise ValueError(f"no active path from {start} to {target}")
        return reached[target]

    def _children(self, start: str, targets: Iterable[str], use: Sequence[str]) -> dict[str, list[Relationship]]:
        children: dict[str, list[Relationship]] = {}
        for target in targets:
            for edge in self.path(start, target, use):
                siblings = children.setdefault(edge.from_table, [])
                if edge not in siblings:
                    siblings.append(edge)
        return children

    # ----------------------------------------------------------- queries

    def query(self, group: Sequence = (), measures: Sequence[str | Measure] = (),
              filters: Mapping[str, str] | None = None, use: Sequence[str] = (),
              sets: Sequence[Sequence[int]] | None = None) -> DataFrame:
        """Measures by group columns.

        ``group`` holds "table.column", "table@role.column" or ("table.column", output name). ``filters`` maps a table, or
        a table in a role, to a predicate; a filter on a dimension restricts the fact. Measures of several facts are
        aggregated to the shared grain first and joined there, so no fact row is ever multiplied. A filter that has no path
        from a queried fact is refused.

        With ``sets``, measures are taken at several grains at once, each given by positions in ``group``; a last column
        ``grouping_level`` has a bit for each column that is summed away, the last one lowest.
        """
        group = fields_of(group)
        measures = [self.measures[m] if isinstance(m, str) else m for m in measures]
        by_fact: dict[str, list[Measure]] = {}
        for m in measures:
            by_fact.setdefault(m.table, []).append(m)
        if not by_fact:
            raise ValueError("a query needs a measure; detail rows come from rows()")
        # Every filter restricts every fact: one that does not reach a fact would leave its total unfiltered.
        results = [self.finish(self.partials(fact, group, own, filters or {}, use, sets), group, own, sets)
                   for fact, own in by_fact.items()]
        names = [f.alias for f in group] + (["grouping_level"] if sets is not None else [])
        joined = reduce(lambda left, right: full_join(left, right, names), results)
        return joined.select(*names[:len(group)], *[m.name for m in measures], *names[len(group):])

    @staticmethod
    def part_columns(measures: Sequence[Measure]) -> dict[tuple[str, str], str]:
        """The columns that partial results of measures are held in."""
        parts = dict.fromkeys(part for m in measures for part in m.parts())
        return {part: f"part_{i}" for i, part in enumerate(parts)}

    @staticmethod
    def mergeable(measures: Sequence[Measure]) -> bool:
        """Whether results at a finer grain can be merged to coarser ones."""
        return all(function in MERGE for m in measures for function, _ in m.parts())

    def partials(self, fact, group, measures, filters, use, sets=None) -> DataFrame:
        """Partial results of measures of one fact by group fields."""
        children = self._children(fact, {f.table for f in group} | set(filters), use)
        columns = self.part_columns(measures)
        # A distinct count folds to pairs of key and value, so its value is one of the keys until the end.
        values = {x: f"value_{i}" for i, x in enumerate(dict.fromkeys(x for function, x in columns if function == "distinct"))}
        foldable = all(function in MERGE or function == "distinct" for function, _ in columns)
        folded = False

        def fold(df: DataFrame, by: Sequence[str], last: bool = False) -> DataFrame:
            nonlocal folded
            aggregates = []
            for (function, x), name in columns.items():
                if function == "distinct":
                    if last:
                        aggregates.append(F.expr(f"count(distinct {values[x] if folded else x})").alias(name))
                else:
                    aggregates.append(F.expr((MERGE if folded else _FIRST)[function].format(name if folded else x)).alias(name))
            if not last:
                by = [*by, *values.values()] if folded else [*by, *[F.expr(x).alias(name) for x, name in values.items()]]
                folded = True
                return df.groupBy(*by).agg(*aggregates) if aggregates else df.select(*by).distinct()
            if sets is None:
                return df.groupBy(*by).agg(*aggregates)
            wanted = [[F.col(by[i]) for i in s] for s in sets]
            return df.groupingSets(wanted, *[F.col(c) for c in by]).agg(*aggregates, F.grouping_id().cast("int").alias("grouping_level"))

        if foldable and children:
            df = self._fold_along(fact, group, children, filters, fold)
        else:
            df = self._join_along(fact, group, children, filters)
        names = [f.name for f in group]
        if sets is not None and values and foldable and names:
            widened = folded
            return _at_grains(df if folded else fold(df, names), names, sets, columns, values, widened)
        return fold(df, names, last=True)

    def finish(self, partials: DataFrame, group, measures, sets=None) -> DataFrame:
        """Measures from their partial results, under their own names."""
        columns = self.part_columns(measures)
        level = [] if sets is None else ["grouping_level"]
        return partials.select(*_outputs(group), *[F.expr(m.result_sql(columns)).alias(m.name) for m in measures], *level)

    def _source(self, node: str) -> Table:
        """The table of a node, which may stand for it in a role."""
        return self.tables[node.partition("@")[0]]

    def _start(self, table, fields, children, filters) -> DataFrame:
        """Rows of a table with its fields, and the keys of the edges that leave it."""
        own = [F.col(f.column).alias(f.name) for f in fields if f.table == table]
        return self._filtered(table, filters).select("*", *own, *self._foreign_keys(children.get(table, [])))

    def _join_along(self, table, fields, children, filters) -> DataFrame:
        """Rows of a table with the fields of the tables it reaches.

        Each one side is flattened first, so that the rows are joined once per edge of their own.
        """
        df = self._start(table, fields, children, filters)
        for edge in children.get(table, []):
            below = self._below(edge, children)
            names = [f.name for f in fields if f.table in below]
            if names:
                one_side = self._join_along(edge.to_table, fields, children, filters)
                df = self._join_edge(df, edge, one_side, names, "inner" if below & set(filters) else "left")
            else:
                df = self._join_edge(df, edge, self._restricted(edge.to_table, children, filters), [], "left_semi")
        return df

    def _fold_along(self, fact, fields, children, filters, fold) -> DataFrame:
        """The same for mergeable measures, which are folded to the key when one edge is left to join.

        A hot key then shrinks to one row per task before anything is shuffled, and joins move keys, not
        fact rows. The next edge is joined and folded after that.
        """
        df = self._start(fact, fields, children, filters)
        names = [f.name for f in fields if f.table == fact]
        pending = deque(children[fact])
        while pending:
            edge = pending.popleft()
            if not pending:
                df = fold(df, names + self._key_names(edge))
            below = self._below(edge, children)
            if any(f.table in below for f in fields):
                further = children.get(edge.to_table, [])
                own = [f.name for f in fields if f.table == edge.to_table]
                one_side = self._start(edge.to_table, fields, children, filters)
                carried = own + [name for e in further for name in self._key_names(e)]
                df = self._join_edge(df, edge, one_side, carried, "inner" if below & set(filters) else "left")
                names = names + own
                pending.extend(further)
            else:
                df = self._join_edge(df, edge, self._restricted(edge.to_table, children, filters), [], "left_semi")
        return df

    def _join_edge(self, df, edge, one_side, carried, how) -> DataFrame:
        key_names = self._key_names(edge)
        keys = [F.col(one).alias(f"{name}_one") for name, (_, one) in zip(key_names, edge.keys)]
        match = reduce(Column.__and__, [F.col(name) == F.col(f"{name}_one") for name in key_names])
        return df.join(one_side.select(*keys, *carried), match, how)

    def _filtered(self, table: str, filters: Mapping[str, str]) -> DataFrame:
        rows = self._source(table).rows()
        return rows.filter(filters[table]) if table in filters else rows

    def _restricted(self, table, children, filters) -> DataFrame:
        """Rows of a table that its own filter and the filters above it let through."""
        df = self._filtered(table, filters)
        for edge in children.get(table, []):
            above = self._restricted(edge.to_table, children, filters)
            df = semi_filter(df, above, edge.keys)
        return df

    def _below(self, edge, children) -> set[str]:
        below = {edge.to_table}
        for child in children.get(edge.to_table, []):
            below |= self._below(child, children)
        return below

    @staticmethod
    def _key_names(edge: Relationship) -> list[str]:
        return [f"key_{edge.name}_{i}" for i in range(len(edge.keys))]

    def _foreign_keys(self, edges: Iterable[Relationship]) -> list[Column]:
        return [F.col(many).alias(name) for edge in edges
                for name, (many, _) in zip(self._key_names(edge), edge.keys)]

    def rows(self, fact: str, columns: Sequence, filters: Mapping[str, str] | None = None,
             use: Sequence[str] = ()) -> DataFrame:
        """Detail rows of a fact with columns of the tables it reaches, at the fact's grain."""
        fields, filters = fields_of(columns), filters or {}
        children = self._children(fact, {f.table for f in fields} | set(filters), use)
        return self._join_along(fact, fields, children, filters).select(*_outputs(fields))

    def members(self, table: str, columns: Sequence[str], fact_filter: tuple[str, str],
                use: Sequence[str] = ()) -> DataFrame:
        """Rows of a dimension that have a matching fact row: a filter in the other direction."""
        fact, predicate = fact_filter
        keys = self.tables[fact].rows().filter(predicate)
        for edge in self.path(fact, table, use):
            one_side = self._source(edge.to_table).rows()
            keys = semi_filter(one_side, keys, [(to, many) for many, to in edge.keys])
        return keys.select(*columns)


def _at_grains(df: DataFrame, by: Sequence[str], sets: Sequence[Sequence[int]], columns: Mapping[tuple[str, str], str],
               values: Mapping[str, str], widened: bool) -> DataFrame:
    """Rows that are folded to groups and values, at several grains at once, with distinct counts.

    All but the distinct counts is merged from the finest groups; sums get the type of one aggregation, or if ``widened``
    of two. Rows are dealt by value, so that a task has all groups of its values and finds by itself which are new: groups
    are numbers there, and no value is shuffled once for each grain.
    """
    df = materialize(df, "folded")
    parts = [(name, F.expr(MERGE[function].format(name))) for (function, _), name in columns.items() if function != "distinct"]
    merged = [(part if widened else part.cast(df.schema[name].dataType)).alias(name) for name, part in parts]
    finest = df.groupBy(*by).agg(*merged) if merged else df.select(*by).distinct()
    cells = materialize(finest.withColumn("cell", F.monotonically_increasing_id()), "cells")
    bits = [1 << (len(by) - 1 - i) for i in range(len(by))]
    levels = F.array(*[F.lit(sum(bit for i, bit in enumerate(bits) if i not in s)) for s in sets])
    masked = [F.when(F.col("grouping_level").bitwiseAND(bit) == 0, F.col(name)).alias(name) for name, bit in zip(by, bits)]
    held = [c for c in cells.columns if c not in by]
    spread = cells.select("*", F.explode(levels).alias("grouping_level")).select(*held, "grouping_level", *masked)
    again = [part.cast(cells.schema[name].dataType).alias(name) for name, part in parts]
    groups = spread.groupBy("grouping_level", *by).agg(*again) if again else spread.select("grouping_level", *by).distinct()
    groups = materialize(groups.withColumn("group_no", F.monotonically_increasing_id()), "groups")
    same = lambda a, b, names: reduce(Column.__and__, [a[n].eqNullSafe(b[n]) for n in names])
    members = materialize(spread.join(groups, same(spread, groups, ["grouping_level", *by])).select("cell", "group_no"), "members")
    result = groups
    n = _DEALT * shuffle_partitions(df.sparkSession)
    for (function, x), name in columns.items():
        if function == "distinct":
            rows = df.filter(F.col(values[x]).isNotNull()).join(cells.select("cell", *by), same(df, cells, by)).select("cell", F.col(values[x]).alias("value"))
            pairs = rows.repartition(n, "value").join(members, "cell").select("group_no", "value").distinct()
            counted = pairs.groupBy("group_no").agg(F.count(F.lit(1)).alias(name))
            result = result.join(counted, "group_no", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return result.select(*by, *columns.values(), "grouping_level")


def semi_filter(df: DataFrame, other: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``df`` that have a match; never multiplies rows. ``keys`` are (df, other) pairs."""
    renamed = other.select(*[F.col(o).alias(f"match_{i}") for i, (_, o) in enumerate(keys)])
    match = [F.col(d) == F.col(f"match_{i}") for i, (d, _) in enumerate(keys)]
    return df.join(renamed, reduce(Column.__and__, match), "left_semi")


def full_join(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Full join of two results with one row per group; null groups meet each other."""
    if not names:
        totals = left.unionByName(right, allowMissingColumns=True)  # one row on each side
        return totals.agg(*[F.first(c, ignorenulls=True).alias(c) for c in totals.columns])
    other = right.select(*[F.col(n).alias(f"other_{n}") for n in names], *[c for c in right.columns if c not in names])
    match = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"other_{n}")) for n in names])
    joined = left.join(other, match, "full")
    shared = [F.coalesce(F.col(n), F.col(f"other_{n}")).alias(n) for n in names]
    return joined.select(*shared, *[c for c in left.columns if c not in names],
                         *[c for c in right.columns if c not in names])
