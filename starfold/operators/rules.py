"""Rules over model metadata: keys, table roles, orientation, active relationships and findings.

The metadata of any number of models is held in three tables, keyed by ``model_id``:

- tables (model_id, table, role_hint, n_measures)
- columns (model_id, table, ordinal, column, type, usage)
- relationships (model_id, seq, from_table, from_column, to_table, to_column), in declared order ``seq``

Findings are rows (model_id, code, severity, source_ref).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from starfold.functions import names as N
from starfold.operators.forest import marked
from starfold.session import discard, materialize

# Usages of columns.
KEY_USAGES = ["identifier", "_identifier", "key"]
FACT_USAGES = ["fact", "_fact", "measure"]

# Finding codes and severities.
SEVERITY = {
    "relationship-self-join": "warning",
    "relationship-role-playing": "info",
    "relationship-ambiguous-loop": "warning",
    "relationship-duplicate": "info",
    "relationship-many-to-many": "warning",
    "relationship-unbound": "warning",
    "relationship-composite-key": "warning",
    "relationship-needs-review": "warning",
    "table-orphan": "info",
    "fact-no-dimension": "warning",
    "model-no-dimensions": "info",
    "model-no-fact": "info",
    "model-snowflake": "info",
    "derived-query": "info",
    "package-source": "warning",
    "detail-filter": "warning",
    "join-needs-review": "warning",
    "join-relationship": "info",
    "calculation-needs-review": "warning",
    "measure-needs-review": "warning",
    "visual-unbound": "warning",
    "element-needs-review": "warning",
    "no-queries": "error",
    "no-query-subjects": "error",
    "no-pages": "warning",
    "dashboard-no-data": "warning",
}

DIMENSIONAL = ["dimension", "date", "bridge"]


def finding(rows: DataFrame, code: str, source_ref: Column) -> DataFrame:
    return rows.select("model_id", F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"),
                       source_ref.alias("source_ref"))


def _pair_text(arrow: str) -> Column:
    return F.concat(F.col("from_table"), F.lit(f" {arrow} "), F.col("to_table"))


# ------------------------------------------------------------------- keys and roles


def with_words(columns: DataFrame) -> DataFrame:
    """Add ``words``, the tokens of each column name, and ``own_name``, whether all of them but a key suffix are words of its
    table's name. Names repeat from model to model, so each is cut once."""
    if {"words", "own_name"} <= set(columns.columns):
        return columns
    foreign = F.array_except(N.key_base(F.col("of_name")), N.tokens(F.col("of_table")))
    names = columns.select(F.col("table").alias("of_table"), F.col("column").alias("of_name")).distinct()
    names = materialize(names.withColumns({"words": N.tokens(F.col("of_name")), "own_name": F.size(foreign) == 0}), "names")
    columns = columns.drop("words")
    same = columns["table"].eqNullSafe(names["of_table"]) & columns["column"].eqNullSafe(names["of_name"])
    return columns.join(names, same, "left").drop("of_table", "of_name")


def seed_keys(columns: DataFrame, suffix_match: bool = False) -> DataFrame:
    """Add ``is_key``: declared as identifier, or named like a key."""
    declared = F.lower(F.trim(F.coalesce("usage", F.lit("")))).isin(KEY_USAGES)
    words = F.col("words") if "words" in columns.columns else None
    return columns.withColumn("is_key", declared | N.looks_like_key(F.col("column"), F.col("type"), suffix_match, words))


def base_role() -> Column:
    """Fact if hinted or if it has measures, else dimension."""
    return (F.when(F.col("role_hint").isin("fact", "date", "bridge"), F.col("role_hint"))
            .when(F.col("n_measures") > 0, "fact").otherwise("dimension"))


def column_stats(columns: DataFrame) -> DataFrame:
    """Per table: date-part columns, keys, other columns, and the position of the preferred datetime column.

    A datetime column with the word date in its name is preferred to one without, then the first.
    All in numbers, so that the aggregation is hashed and needs no sort.
    """
    is_part = F.arrays_overlap("words", N.text_array(N.DATE_PART_TOKENS))
    named = F.array_contains("words", "date")
    dated = F.col("type") == "dateTime"
    first = lambda condition: F.min(F.when(condition, F.col("ordinal")))
    return seed_keys(with_words(columns)).groupBy("model_id", "table").agg(
        F.count_if(is_part).alias("n_date_parts"), F.coalesce(first(dated & named), first(dated)).alias("date_position"),
        F.count_if("is_key").alias("n_keys"), F.count_if(~F.col("is_key")).alias("n_others"))


def _roles_without_bridges(tables: DataFrame, columns: DataFrame) -> DataFrame:
    joined = tables.withColumn("role", base_role()).join(
        column_stats(columns), ["model_id", "table"], "left")
    named = F.arrays_overlap(N.tokens(F.col("table")), N.text_array(N.DATE_NAME_TOKENS))
    is_date = (F.col("role") != "fact") & F.col("date_position").isNotNull() & ((F.col("n_date_parts") >= 2) | named)
    is_date = F.coalesce(is_date, F.lit(False))
    ordinal = F.when(is_date, F.col("date_position"))
    return joined.withColumns({"is_date_table": is_date, "date_ordinal": ordinal,
                               "role": F.when(is_date, "date").otherwise(F.col("role"))})


def date_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Date tables with their preferred date column.

    A non-fact is a date table if it has a datetime column, and a date word in its name or at least two
    date-part columns. Words are whole tokens: "Updates" is not a date.
    """
    dated = _roles_without_bridges(tables, columns).filter("is_date_table")
    names = columns.filter("type = 'dateTime'").select(
        "model_id", "table", F.col("ordinal").alias("date_ordinal"), F.col("column").alias("date_column"))
    return dated.join(names, ["model_id", "table", "date_ordinal"]).select("model_id", "table", "role", "date_column")


ROLES = ("fact", "dimension", "date", "bridge")  # all that ``classify`` gives


def relationship_counts(rels: DataFrame) -> DataFrame:
    """Relationships per table; a self-join counts once."""
    ends = F.array_distinct(F.array("from_table", "to_table"))
    return rels.select("model_id", F.explode(ends).alias("table")).groupBy("model_id", "table").agg(
        F.count(F.lit(1)).alias("n_rels"))


def classify(tables: DataFrame, columns: DataFrame, rels: DataFrame) -> DataFrame:
    """Role of every table. A dimension of two or more keys and nothing else, with two or more
    relationships, is a bridge."""
    n_rels = F.coalesce("n_rels", F.lit(0))
    is_bridge = (F.col("role") == "dimension") & (F.col("n_keys") >= 2) & (F.col("n_others") == 0) & (n_rels >= 2)
    joined = _roles_without_bridges(tables, columns).join(
        relationship_counts(rels), ["model_id", "table"], "left")
    return joined.select("model_id", "table", "n_measures", F.when(is_bridge, "bridge").otherwise(F.col("role")).alias("role"),
                         "is_date_table", n_rels.alias("n_rels"))


# ---------------------------------------------------------------------- orientation


def known_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Role of every table, as a number, and the columns that are probably its primary key: those keys whose names hold no
    word that its own name lacks. Written, as both ends of relationships are looked up in it."""
    position = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int")
    keys = seed_keys(with_words(columns)).filter("is_key and own_name")
    primary = keys.groupBy("model_id", "table").agg(F.collect_set("column").alias("primary_columns"))
    known = tables.groupBy("model_id", "table").agg(F.max(position).alias("role"))
    return materialize(known.join(primary, ["model_id", "table"], "left"), "known-tables")


def _with_sides(rels: DataFrame, known: DataFrame) -> DataFrame:
    """Add the role of either side's table, and whether its column is probably the primary key.

    One end after the other, with the first one written: the relationships are shuffled once for each, and what the
    first shuffle holds is gone before the second begins.
    """
    roles = F.array(*[F.lit(r) for r in ROLES])
    for side in ("from", "to"):
        ends = known.select(F.col("model_id").alias("of_model"), F.col("table").alias("of_table"),
                            F.col("role").alias(f"{side}_role"), "primary_columns")
        found = rels.join(ends, (F.col("model_id") == F.col("of_model")) & (F.col(f"{side}_table") == F.col("of_table")), "left")
        primary = F.coalesce(F.array_contains("primary_columns", F.col(f"{side}_column")), F.lit(False))
        rels = found.select(*rels.columns, F.get(roles, F.col(f"{side}_role") - 1).alias(f"{side}_role"), primary.alias(f"{side}_primary"))
        if side == "from":
            rels = materialize(rels, "from-side")
            # ``deduplicate`` gives a row of nulls for each pair without a number: one for each model is kept.
            rels = rels.filter("seq is not null").unionByName(rels.filter("seq is null").distinct())
    return rels


def orient(rels: DataFrame, tables: DataFrame, columns: DataFrame, repeats: bool = True) -> DataFrame:
    """Relationships from the many side to the one side, with cardinality and filter direction.

    A fact is the many side of a non-fact. Otherwise the side with the probable primary key is the one
    side. Self-joins and relationships of missing tables stay as declared. A relationship with ``declared`` 1:1 keeps that
    if ``found``, the cardinality of the data, is 1:1 too. Rows that come twice are given once; without ``repeats``
    only rows without a number do. ``tables`` may be those of ``known_tables``, which are then looked up as they are.
    """
    tables = tables if "primary_columns" in tables.columns else known_tables(tables, columns)
    sided = _with_sides(rels.distinct() if repeats else rels, tables)
    known = F.col("from_role").isNotNull() & F.col("to_role").isNotNull()
    judged = known & (F.col("from_table") != F.col("to_table"))
    from_fact, to_fact = F.col("from_role") == "fact", F.col("to_role") == "fact"
    flipped = F.coalesce(judged & F.when(from_fact != to_fact, to_fact).otherwise(
        F.col("from_primary") & ~F.col("to_primary")), F.lit(False))
    both_facts = F.coalesce(judged & from_fact & to_fact, F.lit(False))
    bridged = F.coalesce(judged & ((F.col("from_role") == "bridge") | (F.col("to_role") == "bridge")), F.lit(False))
    declared = {"declared", "found"} <= set(rels.columns)
    confirmed = F.coalesce((F.col("declared") == "1:1") & (F.col("found") == "1:1"), F.lit(False)) if declared else F.lit(False)
    swap = lambda a, b: F.when(flipped, F.col(b)).otherwise(F.col(a)).alias(a)
    kept = [c for c in rels.columns if c not in ("from_table", "from_column", "to_table", "to_column")]
    return sided.select(
        *kept, swap("from_table", "to_table"), swap("from_column", "to_column"),
        swap("to_table", "from_table"), swap("to_column", "from_column"),
        swap("from_role", "to_role"), swap("to_role", "from_role"),
        F.when(confirmed, "1:1").when(both_facts, "n:n").otherwise("n:1").alias("cardinality"),
        F.when(both_facts | bridged | confirmed, "both").otherwise("single").alias("cross_filter"))


def mark_endpoints(columns: DataFrame, oriented: DataFrame) -> DataFrame:
    """Columns with key, foreign key and hidden marks taken from the relationships.

    The one side is a key. The many side of a fact is a hidden foreign key. Neither is summarised.
    """
    bound = oriented.filter("from_role is not null and to_role is not null and from_table <> to_table")
    one = bound.select("model_id", F.col("to_table").alias("table"), F.col("to_column").alias("column"),
                       F.lit(True).alias("one"), F.lit(False).alias("many"))
    many = bound.filter("from_role = 'fact'").select(
        "model_id", F.col("from_table").alias("table"), F.col("from_column").alias("column"),
        F.lit(False).alias("one"), F.lit(True).alias("many"))
    ends = one.unionByName(many).groupBy("model_id", "table", "column").agg(
        F.max("one").alias("one"), F.max("many").alias("many"))
    joined = seed_keys(columns).join(ends, ["model_id", "table", "column"], "left")
    is_key = F.col("is_key") | F.coalesce("one", F.lit(False))
    is_foreign = F.coalesce("many", F.lit(False))
    usage = F.lower(F.trim(F.coalesce("usage", F.lit(""))))
    return joined.select(
        "model_id", "table", "ordinal", "column", "type", is_key.alias("is_key"), is_foreign.alias("is_foreign_key"),
        is_foreign.alias("is_hidden"),
        F.when(is_key | is_foreign, "none").when(usage.isin(FACT_USAGES), "sum").alias("summarize_by"))


# ------------------------------------------------------------- duplicates and loops


def deduplicate(rels: DataFrame) -> DataFrame:
    """One row per undirected column pair: the first declared.

    A row is its two ends and which of them comes first, so names are shuffled once; without further columns, all that is
    aggregated is of fixed width, so that the aggregation is hashed and needs no sort.
    """
    left, right = (F.struct(F.col(f"{side}_table").alias("table"), F.col(f"{side}_column").alias("column"))
                   for side in ("from", "to"))
    base = ("model_id", "seq", "from_table", "from_column", "to_table", "to_column")
    more = [c for c in rels.columns if c not in base]
    swapped = (left > right).alias("swapped")
    pairs = rels.select("model_id", "seq", *more, F.least(left, right).alias("end_1"), F.greatest(left, right).alias("end_2"), swapped)
    firsts = pairs.groupBy("model_id", "end_1", "end_2").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct("swapped", *more) if more else F.col("swapped"), "seq").alias("first"))
    turned = F.col("first.swapped") if more else F.col("first")
    end = lambda if_turned, otherwise, name: F.when(turned, F.col(f"{if_turned}.{name}")).when(~turned, F.col(f"{otherwise}.{name}"))
    values = {"seq": F.col("seq"), **{c: F.col(f"first.{c}") for c in more},
              **{f"from_{n}": end("end_2", "end_1", n) for n in ("table", "column")},
              **{f"to_{n}": end("end_1", "end_2", n) for n in ("table", "column")}}
    return firsts.select("model_id", *[values[c].alias(c) for c in rels.columns if c != "model_id"])


def activate(rels: DataFrame) -> DataFrame:
    """Add ``status``: active, self-join, role-playing or ambiguous-loop.

    The first relationship of a pair of tables stands for the pair. Pairs off the forest close a loop;
    further relationships of a pair on it play another role.
    """
    rels = materialize(rels, "declared-relationships")  # counted, then dealt
    known = F.col("from_table").isNotNull() & F.col("to_table").isNotNull()
    ends = {"a": F.when(known, F.least("from_table", "to_table")), "b": F.when(known, F.greatest("from_table", "to_table"))}
    found = marked(rels.withColumns(ends))
    discard(rels)  # what is marked is written
    return found.select(
        *rels.columns,
        F.when(F.col("from_table") == F.col("to_table"), "self-join").when(~F.col("in_forest"), "ambiguous-loop")
        .when(F.col("seq") > F.col("first_seq"), "role-playing").otherwise("active").alias("status"))


# -------------------------------------------------------------------------- findings


def removed_duplicates(rels: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """The relationships that ``deduplicate`` left out."""
    return rels.join(deduplicated.select("model_id", "seq"), ["model_id", "seq"], "left_anti")


def flag_duplicates(removed: DataFrame) -> DataFrame:
    return finding(removed, "relationship-duplicate", _pair_text("<->"))


def flag_self_joins(rels: DataFrame) -> DataFrame:
    return finding(rels.filter("from_table = to_table"), "relationship-self-join", F.col("from_table"))


def flag_role_playing(activated: DataFrame) -> DataFrame:
    return finding(activated.filter("status = 'role-playing'"), "relationship-role-playing", _pair_text("<->"))


def flag_loops(activated: DataFrame) -> DataFrame:
    return finding(activated.filter("status = 'ambiguous-loop'"), "relationship-ambiguous-loop", _pair_text("->"))


def flag_unbound(rels: DataFrame, tables: DataFrame) -> DataFrame:
    """Relationships that name a missing table."""
    known = tables.select("model_id", "table")
    ends = rels.select("model_id", "seq", "from_table", "to_table", F.explode(F.array("from_table", "to_table")).alias("table"))
    missing = ends.join(known, ["model_id", "table"], "left_anti")
    return finding(missing.select("model_id", "seq", "from_table", "to_table").distinct(), "relationship-unbound",
                   _pair_text("->"))


def _with_relationships(tables: DataFrame, rels: DataFrame) -> DataFrame:
    """Tables of models that have any relationship; the rules about a model's shape need one."""
    return tables.join(rels.select("model_id").distinct(), "model_id", "left_semi")


def flag_orphans(tables: DataFrame, rels: DataFrame) -> DataFrame:
    """Tables without a relationship in a model that has several tables and some relationship."""
    linked = relationship_counts(rels).select("model_id", "table")
    several = tables.groupBy("model_id").count().filter("count > 1").select("model_id")
    candidates = _with_relationships(tables, rels).join(several, "model_id", "left_semi")
    return finding(candidates.join(linked, ["model_id", "table"], "left_anti"), "table-orphan", F.col("table"))


def flag_facts_without_dimension(tables: DataFrame, rels: DataFrame) -> DataFrame:
    """Facts whose related tables are all facts, or missing."""
    both_ways = rels.select("model_id", F.col("from_table").alias("table"), F.col("to_table").alias("neighbor")).unionByName(
        rels.select("model_id", F.col("to_table").alias("table"), F.col("from_table").alias("neighbor")))
    dims = tables.filter(F.col("role").isin(DIMENSIONAL)).select("model_id", F.col("table").alias("neighbor"))
    related = both_ways.distinct().join(dims, ["model_id", "neighbor"], "left_semi").select("model_id", "table")
    facts = _with_relationships(tables, rels).filter("role = 'fact'")
    return finding(facts.join(related, ["model_id", "table"], "left_anti"), "fact-no-dimension", F.col("table"))


def flag_model_shape(tables: DataFrame, rels: DataFrame) -> DataFrame:
    """Models with facts but no dimensions, and models without facts."""
    shape = _with_relationships(tables, rels).groupBy("model_id").agg(
        F.count_if(F.col("role") == "fact").alias("n_facts"),
        F.count_if(F.col("role").isin(DIMENSIONAL)).alias("n_dims"))
    nothing = F.lit(None).cast("string")
    return finding(shape.filter("n_facts > 0 and n_dims = 0"), "model-no-dimensions", nothing).unionByName(
        finding(shape.filter("n_facts = 0"), "model-no-fact", nothing))


def flag_snowflakes(oriented: DataFrame) -> DataFrame:
    roles = ["dimension", "date"]
    chained = oriented.filter(F.col("from_role").isin(roles) & F.col("to_role").isin(roles)
                              & (F.col("from_table") != F.col("to_table")))
    return finding(chained, "model-snowflake", _pair_text("->"))


def flag_many_to_many(activated: DataFrame) -> DataFrame:
    return finding(activated.filter("cardinality = 'n:n' and status = 'active'"), "relationship-many-to-many",
                   _pair_text("->"))


def model_summary(tables: DataFrame, activated: DataFrame) -> DataFrame:
    """Counts per model."""
    by_role = tables.groupBy("model_id").agg(
        *[F.count_if(F.col("role") == role).alias(name) for role, name in
          [("fact", "n_facts"), ("dimension", "n_dimensions"), ("date", "n_dates"), ("bridge", "n_bridges")]])
    by_status = activated.groupBy("model_id").agg(
        F.count_if(F.col("status") == "active").alias("n_active"),
        F.count_if(F.col("status") != "active").alias("n_inactive"),
        F.count_if(F.col("cardinality") == "n:n").alias("n_many_to_many"))
    return by_role.join(by_status, "model_id", "full").na.fill(0)


def review_breakdown(findings: DataFrame, limit: int = 8) -> DataFrame:
    """Findings per severity and code: errors first, then by count; the first ``limit`` groups."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(
        F.col("severity") == "info", 2).otherwise(3)
    counted = findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n_findings"))
    return counted.orderBy(rank, F.desc("n_findings"), "code").limit(limit)


class _Results(Mapping):
    """Results by name, each made when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]) -> None:
        self.makers, self.made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def analyze(tables: DataFrame, columns: DataFrame, rels: DataFrame) -> Mapping[str, DataFrame]:
    """All rules in order: tables, columns, relationships, findings and summary of every model.

    The findings that need joins are written one after the other, so that their shuffles don't add up and no plan holds all
    of them; they are made when they are asked for.
    """
    columns = with_words(columns)
    roles = materialize(classify(tables, columns, rels), "model-tables")
    known = known_tables(roles, columns)
    deduplicated = materialize(deduplicate(rels), "model-deduplicated")
    activated = materialize(orient(activate(deduplicated), known, columns, repeats=False), "model-relationships")

    def findings() -> DataFrame:
        removed = materialize(removed_duplicates(rels, deduplicated), "removed-duplicates")
        joined = {"duplicates": lambda: flag_duplicates(orient(removed, known, columns)), "unbound": lambda: flag_unbound(rels, roles),
                  "orphans": lambda: flag_orphans(roles, activated),
                  "facts": lambda: flag_facts_without_dimension(roles, activated), "shapes": lambda: flag_model_shape(roles, activated)}
        written = [materialize(rows(), f"findings-{name}") for name, rows in joined.items()]
        return reduce(DataFrame.unionByName, [*written, *[flag(activated) for flag in (
            flag_self_joins, flag_role_playing, flag_loops, flag_snowflakes, flag_many_to_many)]])

    return _Results({"tables": lambda: roles, "columns": lambda: mark_endpoints(columns, activated), "relationships": lambda: activated,
                     "findings": findings, "summary": lambda: model_summary(roles, activated)})
