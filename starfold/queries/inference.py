"""Model rules and data profiling.

The rules run over the metadata of many models. That metadata is derived from the given tables: every
order is a model of up to six tables, and its line items are the model's relationships.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starfold.functions import names as N
from starfold.operators import profile, rules as R
from starfold.queries import query
from starfold.queries.retail import RELATIONSHIPS, spread, table

# Table slots of a derived model: name, then (column, type, usage).
SLOTS = [
    ("FactSales", [("SalesID", "int64", "identifier"), ("ProductID", "int64", "attribute"),
                   ("Revenue", "decimal", "fact"), ("OrderDateKey", "int64", "attribute")]),
    ("DimProduct", [("ProductID", "int64", "attribute"), ("CategoryCode", "string", "attribute"),
                    ("ProductName", "string", "attribute")]),
    ("OrderDate", [("DateKey", "int64", "attribute"), ("Year", "int64", "attribute"),
                   ("LoadedAt", "dateTime", "attribute"), ("FullDate", "dateTime", "attribute")]),
    ("CustomerMap", [("CustomerID", "int64", "identifier"), ("ProductID", "int64", "attribute")]),
    ("Updates", [("UpdateNo", "int64", "attribute"), ("Month", "int64", "attribute"),
                 ("ChangedOn", "dateTime", "attribute"), ("Week", "int64", "attribute")]),
    ("Region", [("Region", "string", "key"), ("ManagerID", "string", "attribute")]),
    ("Ghost", [("GhostID", "int64", "attribute"), ("Other", "string", "attribute")]),
]
_N_TABLES = 6  # the last slot is never a table, only named by relationships


def _rows_sql(rows, names) -> str:
    """Array of structs, as SQL text."""
    return "array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {v!r}" for n, v in zip(names, row)) + ")" for row in rows) + ")"


def _model_tables(spark, sf_dir) -> DataFrame:
    slots = _rows_sql([(k, name) for k, (name, _) in enumerate(SLOTS[:_N_TABLES])], ["slot", "table"])
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", f"inline({slots})")
    return orders.filter("(o_orderkey + slot) % 7 <> 0").selectExpr(
        "o_orderkey as model_id", "table", "case when (o_orderkey + slot) % 11 = 0 then 'fact' end as role_hint",
        "case when (o_custkey + 2 * slot) % 5 = 0 then 1 + slot else 0 end as n_measures")


def _model_columns(spark, sf_dir) -> DataFrame:
    items = _rows_sql([(k, name, i, *column) for k, (name, columns) in enumerate(SLOTS[:_N_TABLES])
                       for i, column in enumerate(columns)], ["slot", "table", "ordinal", "column", "type", "usage"])
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    orders = orders.selectExpr("o_orderkey as model_id", f"inline({items})")
    return orders.filter("(model_id + slot) % 7 <> 0 and (model_id + 3 * ordinal + slot) % 13 <> 0").drop("slot")


def _model_relationships(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    names = "array(" + ", ".join(repr(name) for name, _ in SLOTS) + ")"
    keys = "array(" + ", ".join(f"array({c[0][0]!r}, {c[1][0]!r})" for _, c in SLOTS) + ")"
    at = lambda array, index: f"get({array}, cast({index} as int))"
    return lines.selectExpr(
        "l_orderkey as model_id",
        "l_linenumber * 100000000000000000 + l_partkey * 100000000 + l_suppkey as seq",
        f"{at(names, 'l_partkey % 6')} as from_table",
        f"{at(at(keys, 'l_partkey % 6'), 'l_linenumber % 2')} as from_column",
        f"{at(names, 'l_suppkey % 7')} as to_table",
        f"{at(at(keys, 'l_suppkey % 7'), '(l_partkey div 6) % 2')} as to_column")


def _metadata(spark, sf_dir):
    return _model_tables(spark, sf_dir), R.with_words(_model_columns(spark, sf_dir)), _model_relationships(spark, sf_dir)


# --------------------------------------------------------------- the same in SQL


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


_TOKENS = ("list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace({0}, "
           "'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
           "'([A-Za-z])([0-9])', '\\1 \\2', 'g')), '[^0-9a-z]+'), lambda t: t <> '')")
_KEY_LIST = "(" + ", ".join(repr(t) for t in N.KEY_TOKENS) + ")"
_PART_LIST = "[" + ", ".join(repr(t) for t in N.DATE_PART_TOKENS) + "]"

_META = f"""
    with recursive slots(slot, name) as (values {_values([(k, n) for k, (n, _) in enumerate(SLOTS)])}),
    items(slot, name, ordinal, col, type, usage) as (values {_values(
        [(k, n, i, *c) for k, (n, cs) in enumerate(SLOTS) for i, c in enumerate(cs)])}),
    tabs as (
        select o_orderkey as model_id, name as tab, case when (o_orderkey + slot) % 11 = 0 then 'fact' end as role_hint,
               case when (o_custkey + 2 * slot) % 5 = 0 then 1 + slot else 0 end as n_measures
        from orders, slots where slot < 6 and (o_orderkey + slot) % 7 <> 0),
    cols as (
        select o_orderkey as model_id, name as tab, ordinal, col, type, usage,
               usage in ('identifier', 'key') or coalesce({_TOKENS.format('col')}[-1] in {_KEY_LIST}
               and type in ('int64', 'string'), false) as is_key
        from orders, items where slot < 6 and (o_orderkey + slot) % 7 <> 0
        and (o_orderkey + 3 * ordinal + slot) % 13 <> 0),
    rels as (
        select l_orderkey as model_id,
               l_linenumber * 100000000000000000 + l_partkey * 100000000 + l_suppkey as seq,
               f.name as from_table, f.col as from_column, t.name as to_table, t.col as to_column
        from (select distinct l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, l_suppkey from lineitem)
        join items f on f.slot = l_partkey % 6 and f.ordinal = l_linenumber % 2
        join items t on t.slot = l_suppkey % 7 and t.ordinal = (l_partkey // 6) % 2),
    base as (select *, case when role_hint = 'fact' or n_measures > 0 then 'fact' else 'dimension' end as role0 from tabs),
    stats as (
        select model_id, tab, count(*) filter (where list_has_any({_TOKENS.format('col')}, {_PART_LIST})) as n_parts,
               count(*) filter (where is_key) as n_keys, count(*) filter (where not is_key) as n_others,
               arg_min(col, (case when list_contains({_TOKENS.format('col')}, 'date') then 0 else 1 end) * 100 + ordinal)
                   filter (where type = 'dateTime') as date_col
        from cols group by 1, 2),
    ends as (
        select model_id, seq, from_table as tab from rels
        union all select model_id, seq, to_table from rels where from_table <> to_table),
    n_ends as (select model_id, tab, count(*) as n_rels from ends group by 1, 2),
    dated as (
        select b.model_id, b.tab, b.n_measures, n_parts, n_keys, n_others, date_col,
               case when role0 <> 'fact' and date_col is not null and (n_parts >= 2
                    or list_has_any({_TOKENS.format('b.tab')}, ['date', 'calendar', 'period']))
                    then 'date' else role0 end as role1
        from base b left join stats s on b.model_id = s.model_id and b.tab = s.tab),
    roles as (
        select d.model_id, d.tab, n_measures, coalesce(n_rels, 0) as n_rels, date_col, role1,
               case when role1 = 'dimension' and n_keys >= 2 and n_others = 0 and n_rels >= 2 then 'bridge'
                    else role1 end as role
        from dated d left join n_ends e on d.model_id = e.model_id and d.tab = e.tab),
    sided as (
        select r.*, f.role as from_role, t.role as to_role,
               coalesce(fk.is_key, false) and len(list_filter(
                   case when len({_TOKENS.format('from_column')}) > 1 and {_TOKENS.format('from_column')}[-1] in {_KEY_LIST}
                   then {_TOKENS.format('from_column')}[:-2] else {_TOKENS.format('from_column')} end,
                   lambda w: not list_contains({_TOKENS.format('from_table')}, w))) = 0 as from_pk,
               coalesce(tk.is_key, false) and len(list_filter(
                   case when len({_TOKENS.format('to_column')}) > 1 and {_TOKENS.format('to_column')}[-1] in {_KEY_LIST}
                   then {_TOKENS.format('to_column')}[:-2] else {_TOKENS.format('to_column')} end,
                   lambda w: not list_contains({_TOKENS.format('to_table')}, w))) = 0 as to_pk
        from rels r
        left join roles f on f.model_id = r.model_id and f.tab = r.from_table
        left join roles t on t.model_id = r.model_id and t.tab = r.to_table
        left join cols fk on fk.model_id = r.model_id and fk.tab = r.from_table and fk.col = r.from_column
        left join cols tk on tk.model_id = r.model_id and tk.tab = r.to_table and tk.col = r.to_column),
    judged as (
        select *, from_role is not null and to_role is not null and from_table <> to_table as judged,
               coalesce(from_role is not null and to_role is not null and from_table <> to_table and case
                   when from_role = 'fact' and to_role <> 'fact' then false
                   when to_role = 'fact' and from_role <> 'fact' then true
                   else from_pk and not to_pk end, false) as flip
        from sided),
    oriented as (
        select model_id, seq,
               case when flip then to_table else from_table end as from_table,
               case when flip then to_column else from_column end as from_column,
               case when flip then from_table else to_table end as to_table,
               case when flip then from_column else to_column end as to_column,
               case when flip then to_role else from_role end as from_role,
               case when flip then from_role else to_role end as to_role,
               case when judged and from_role = 'fact' and to_role = 'fact' then 'n:n' else 'n:1' end as cardinality,
               case when judged and ((from_role = 'fact' and to_role = 'fact') or from_role = 'bridge' or to_role = 'bridge')
                    then 'both' else 'single' end as cross_filter
        from judged),
    firsts as (
        select *, row_number() over (partition by model_id,
                   least(from_table || '.' || from_column, to_table || '.' || to_column),
                   greatest(from_table || '.' || from_column, to_table || '.' || to_column) order by seq) as copy_no
        from oriented),
    kept as (select * exclude (copy_no), least(from_table, to_table) as a, greatest(from_table, to_table) as b
             from firsts where copy_no = 1),
    pairs as (select model_id, a, b, min(seq) as seq from kept where a <> b group by 1, 2, 3),
    reach(model_id, seq, node) as (
        select model_id, seq, a from pairs
        union
        select r.model_id, r.seq, case when p.a = r.node then p.b else p.a end
        from reach r join pairs p on p.model_id = r.model_id and p.seq < r.seq and (p.a = r.node or p.b = r.node)),
    looped as (
        select p.model_id, p.a, p.b, p.seq as first_seq, exists (
            select 1 from reach r where r.model_id = p.model_id and r.seq = p.seq and r.node = p.b) as closes
        from pairs p),
    activated as (
        select k.*, case when k.a = k.b then 'self-join' when closes then 'ambiguous-loop'
                         when k.seq > first_seq then 'role-playing' else 'active' end as status
        from kept k left join looped l on k.model_id = l.model_id and k.a = l.a and k.b = l.b),
    linked as (select distinct model_id from kept)
"""


def _finding_sql(rows: str, code: str, source_ref: str) -> str:
    return (f"select model_id, '{code}' as code, '{R.SEVERITY[code]}' as severity, {source_ref} as source_ref from {rows}")


def _pair(arrow: str) -> str:
    return f"from_table || ' {arrow} ' || to_table"


_DIMS = "('dimension', 'date', 'bridge')"
_FINDINGS = {
    "duplicates": _finding_sql("firsts where copy_no > 1", "relationship-duplicate", _pair("<->")),
    "self_join": _finding_sql("activated where status = 'self-join'", "relationship-self-join", "from_table"),
    "role_playing": _finding_sql("activated where status = 'role-playing'", "relationship-role-playing", _pair("<->")),
    "loops": _finding_sql("activated where status = 'ambiguous-loop'", "relationship-ambiguous-loop", _pair("->")),
    "unbound": _finding_sql("sided where from_role is null or to_role is null", "relationship-unbound", _pair("->")),
    "orphans": _finding_sql("""roles where model_id in (from linked)
        and model_id in (select model_id from roles group by 1 having count(*) > 1)
        and (model_id, tab) not in (select (model_id, from_table) from kept union select (model_id, to_table) from kept)
        """, "table-orphan", "tab"),
    "fact_no_dim": _finding_sql(f"""roles r where role = 'fact' and model_id in (from linked) and not exists (
        select 1 from kept k join roles d on d.model_id = k.model_id and d.role in {_DIMS}
        and ((k.from_table = r.tab and k.to_table = d.tab) or (k.to_table = r.tab and k.from_table = d.tab))
        where k.model_id = r.model_id)""", "fact-no-dimension", "tab"),
    "model_shape": _finding_sql(f"""(select model_id from roles where model_id in (from linked) group by 1
        having count(*) filter (where role = 'fact') > 0 and count(*) filter (where role in {_DIMS}) = 0)
        """, "model-no-dimensions", "cast(null as varchar)") + " union all " + _finding_sql(
        """(select model_id from roles where model_id in (from linked) group by 1
        having count(*) filter (where role = 'fact') = 0)""", "model-no-fact", "cast(null as varchar)"),
    "snowflake": _finding_sql("""activated where from_role in ('dimension', 'date') and to_role in ('dimension', 'date')
        and from_table <> to_table""", "model-snowflake", _pair("->")),
    "m2m": _finding_sql("activated where cardinality = 'n:n' and status = 'active'", "relationship-many-to-many",
                        _pair("->")),
}


# ------------------------------------------------------------------------- rules


_NAMES_SQL = """
    select p_partkey, upper(p_name[1]) || replace(p_name[2:], ' ', '') ||
           ['ID', 'Key', 'SKUCode', '_no', 'Name', ' 2nd'][(p_partkey % 6 + 1)::int] as name from part"""


def _part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("""
        concat(upper(substring(p_name, 1, 1)), replace(substring(p_name, 2), ' ', ''),
               element_at(array('ID', 'Key', 'SKUCode', '_no', 'Name', ' 2nd'), cast(p_partkey % 6 + 1 as int)))
        """).alias("name"))


@query(f"""
    select p_partkey, name, array_to_string(words, ' ') as tokens,
           array_to_string(case when len(words) > 1 and words[-1] in {_KEY_LIST} then words[:-2] else words end, ' ') as key_base
    from (select p_partkey, name, {_TOKENS.replace("'([A-Za-z])([0-9])', '\\1 \\2', 'g')",
           "'([0-9])([a-z])', '\\1 \\2', 'g')").format('name')} as words
    from ({_NAMES_SQL}))""")
def name_tokens(spark, sf_dir):
    name = F.col("name")
    joined = lambda words: F.array_join(words, " ")
    return _part_names(spark, sf_dir).select("p_partkey", "name", joined(N.tokens(name)).alias("tokens"),
                                             joined(N.key_base(name)).alias("key_base"))


@query(_META + """
    select model_id, tab as "table", col as "column", is_key,
           is_key or (type in ('int64', 'string') and regexp_matches(lower(col), '(id|key|code|sk|nk|no|num|number)$'))
           as is_key_by_suffix
    from cols""")
def key_by_name(spark, sf_dir):
    columns = _model_columns(spark, sf_dir)
    both = R.seed_keys(R.seed_keys(columns).withColumnRenamed("is_key", "strict"), suffix_match=True)
    return both.select("model_id", "table", "column", F.col("strict").alias("is_key"),
                       F.col("is_key").alias("is_key_by_suffix"))


@query(_META + """select model_id, tab as "table", role0 as role from base""")
def table_roles(spark, sf_dir):
    return _model_tables(spark, sf_dir).select("model_id", "table", R.base_role().alias("role"))


@query(_META + """
    select model_id, tab as "table", role1 as role, date_col as date_column from dated where role1 = 'date'""")
def date_tables(spark, sf_dir):
    return R.date_tables(_model_tables(spark, sf_dir), _model_columns(spark, sf_dir))


@query(_META + """select model_id, tab as "table", n_rels, role from roles""")
def bridge_tables(spark, sf_dir):
    """Final roles of all tables, bridges included."""
    return R.classify(*_metadata(spark, sf_dir)).select("model_id", "table", "n_rels", "role")


def _oriented(spark, sf_dir):
    tables, columns, rels = _metadata(spark, sf_dir)
    return R.orient(rels, R.classify(tables, columns, rels), columns, repeats=False)


@query(_META + "select model_id, seq, from_table, from_column, to_table, to_column from oriented")
def orient_rels(spark, sf_dir):
    return _oriented(spark, sf_dir).select("model_id", "seq", "from_table", "from_column", "to_table", "to_column")


@query(_META + "select model_id, seq, from_table, to_table, cardinality, cross_filter from oriented")
def infer_cardinality(spark, sf_dir):
    return _oriented(spark, sf_dir).select("model_id", "seq", "from_table", "to_table", "cardinality", "cross_filter")


@query(_META + """
    , bound as (from oriented where from_role is not null and to_role is not null and from_table <> to_table),
    ones as (select distinct model_id, to_table as tab, to_column as col from bound),
    manys as (select distinct model_id, from_table as tab, from_column as col from bound where from_role = 'fact')
    select c.model_id, c.tab as "table", c.col as "column", is_key or o.col is not null as is_key,
           m.col is not null as is_foreign_key, m.col is not null as is_hidden,
           case when is_key or o.col is not null or m.col is not null then 'none' when usage = 'fact' then 'sum' end
           as summarize_by
    from cols c
    left join ones o on o.model_id = c.model_id and o.tab = c.tab and o.col = c.col
    left join manys m on m.model_id = c.model_id and m.tab = c.tab and m.col = c.col""")
def mark_endpoints(spark, sf_dir):
    marked = R.mark_endpoints(_model_columns(spark, sf_dir), _oriented(spark, sf_dir))
    return marked.drop("ordinal", "type")


@query(_META + "select model_id, seq, from_table, from_column, to_table, to_column from kept")
def dedup_pairs(spark, sf_dir):
    """The kept relationships, oriented. Which ones are kept does not depend on their direction."""
    tables, columns, rels = _metadata(spark, sf_dir)
    kept = R.orient(R.deduplicate(rels), R.classify(tables, columns, rels), columns, repeats=False)
    return kept.select("model_id", "seq", "from_table", "from_column", "to_table", "to_column")


@query(_META + _FINDINGS["duplicates"])
def flag_duplicates(spark, sf_dir):
    tables, columns, rels = _metadata(spark, sf_dir)
    removed = R.removed_duplicates(rels, R.deduplicate(rels))
    return R.flag_duplicates(R.orient(removed, R.classify(tables, columns, rels), columns))


def _activated(spark, sf_dir):
    tables, columns, rels = _metadata(spark, sf_dir)
    known = R.known_tables(R.classify(tables, columns, rels), columns)
    return R.orient(R.activate(R.deduplicate(rels)), known, columns, repeats=False)


@query(_META + "select model_id, seq, from_table, to_table, status from activated")
def active_relationships(spark, sf_dir):
    return _activated(spark, sf_dir).select("model_id", "seq", "from_table", "to_table", "status")


@query(_META + _FINDINGS["self_join"])
def flag_self_join(spark, sf_dir):
    return R.flag_self_joins(R.deduplicate(_model_relationships(spark, sf_dir)))


@query(_META + _FINDINGS["role_playing"])
def flag_role_playing(spark, sf_dir):
    return R.flag_role_playing(_activated(spark, sf_dir))


@query(_META + _FINDINGS["loops"])
def flag_loops(spark, sf_dir):
    return R.flag_loops(_activated(spark, sf_dir))


@query(_META + _FINDINGS["unbound"])
def flag_unbound(spark, sf_dir):
    return R.flag_unbound(_model_relationships(spark, sf_dir), _model_tables(spark, sf_dir))


@query(_META + _FINDINGS["orphans"])
def flag_orphans(spark, sf_dir):
    tables, columns, rels = _metadata(spark, sf_dir)
    return R.flag_orphans(R.classify(tables, columns, rels), rels)


@query(_META + _FINDINGS["fact_no_dim"])
def flag_fact_no_dim(spark, sf_dir):
    tables, columns, rels = _metadata(spark, sf_dir)
    return R.flag_facts_without_dimension(R.classify(tables, columns, rels), rels)


@query(_META + _FINDINGS["model_shape"])
def flag_model_shape(spark, sf_dir):
    tables, columns, rels = _metadata(spark, sf_dir)
    return R.flag_model_shape(R.classify(tables, columns, rels), rels)


@query(_META + _FINDINGS["snowflake"])
def flag_snowflake(spark, sf_dir):
    tables, columns, rels = _metadata(spark, sf_dir)
    return R.flag_snowflakes(R.orient(R.deduplicate(rels), R.classify(tables, columns, rels), columns, repeats=False))


@query(_META + _FINDINGS["m2m"])
def flag_m2m(spark, sf_dir):
    return R.flag_many_to_many(_activated(spark, sf_dir))


@query(_META + """
    select coalesce(r.model_id, a.model_id) as model_id, n_facts, n_dimensions, n_dates, n_bridges,
           coalesce(n_active, 0) as n_active, coalesce(n_inactive, 0) as n_inactive,
           coalesce(n_many_to_many, 0) as n_many_to_many
    from (select model_id, count(*) filter (where role = 'fact') as n_facts,
                 count(*) filter (where role = 'dimension') as n_dimensions, count(*) filter (where role = 'date') as n_dates,
                 count(*) filter (where role = 'bridge') as n_bridges from roles group by 1) r
    full join (select model_id, count(*) filter (where status = 'active') as n_active,
                      count(*) filter (where status <> 'active') as n_inactive,
                      count(*) filter (where cardinality = 'n:n') as n_many_to_many from activated group by 1) a
    on r.model_id = a.model_id""")
def model_summary(spark, sf_dir):
    return R.analyze(*_metadata(spark, sf_dir))["summary"]


@query(_META + "select severity, code, count(*) as n_findings from ("
       + " union all ".join(f"({sql})" for sql in _FINDINGS.values())
       + """) group by 1, 2 order by case severity when 'error' then 0 when 'warning' then 1 else 2 end,
       n_findings desc, code limit 8""")
def review_breakdown(spark, sf_dir):
    return R.review_breakdown(R.analyze(*_metadata(spark, sf_dir))["findings"])


# -------------------------------------------------------------------- profiling


_KEY_CANDIDATES = {"lineitem": ["l_orderkey", "l_partkey"], "orders": ["o_orderkey", "o_custkey"],
                   "customer": ["c_custkey", "c_name", "c_nationkey"], "part": ["p_partkey", "p_name"],
                   "nation": ["n_nationkey", "n_regionkey"], "events": ["event_id", "user_id"]}


@query(" union all ".join(f"""
    select '{t}' as table_name, '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_nulls,
           count(distinct {c}) = count({c}) as is_unique, count(distinct {c}) = count(*) as is_key from {t}"""
                          for t, columns in _KEY_CANDIDATES.items() for c in columns))
def profile_keys(spark, sf_dir):
    return profile.profile_keys({t: (table(spark, sf_dir, t), c) for t, c in _KEY_CANDIDATES.items()})


_REFERENCES = [r for r in RELATIONSHIPS if r.to_table != "dim_date"]


_DANGLING = "case when c_nationkey <> 3 then c_custkey else -1 - c_custkey end"


def _reference_tables(spark, sf_dir):
    """Some references dangle and some are null: the keys of one nation's customers are changed, one part's is emptied."""
    names = {t for r in _REFERENCES for t in (r.from_table, r.to_table)}
    tables = {name: table(spark, sf_dir, name) for name in names}
    tables["customer"] = tables["customer"].withColumn("c_custkey", F.expr(_DANGLING))
    tables["lineitem"] = tables["lineitem"].withColumn("l_partkey", F.expr("nullif(l_partkey, 7)"))
    return tables


def _reference_sql(columns: str) -> str:
    source = {"customer": f"(select * replace ({_DANGLING} as c_custkey) from customer)",
              "lineitem": "(select * replace (nullif(l_partkey, 7) as l_partkey) from lineitem)"}
    return " union all ".join(f"""
        select '{r.name}' as relationship, {columns.format(many=r.keys[0][0], one=r.keys[0][1],
                                                          one_table=source.get(r.to_table, r.to_table))}
        from {source.get(r.from_table, r.from_table)}""" for r in _REFERENCES)


@query(_reference_sql("""
    count(*) as n_rows, count(*) - count({many}) as n_null_keys,
    count(*) filter (where {many} is not null and {many} not in (select {one} from {one_table})) as n_unmatched_rows,
    count(distinct {many}) filter (where {many} not in (select {one} from {one_table})) as n_unmatched_keys"""))
def profile_fk(spark, sf_dir):
    return profile.profile_references(_reference_tables(spark, sf_dir), _REFERENCES).drop("cardinality")


@query(_reference_sql("""
    case when count(distinct {many}) = count({many}) then '1' else 'n' end || ':' || (
    select case when count(distinct {one}) = count({one}) then '1' else 'n' end from {one_table}) as cardinality"""))
def cardinality_from_data(spark, sf_dir):
    found = profile.profile_references(_reference_tables(spark, sf_dir), _REFERENCES)
    return found.select("relationship", "cardinality")


@query("""
    select o_custkey as model_id, 1 as seq, 'orders' as from_table, 'latest' as to_table,
           case when count(*) = count(distinct o_orderdate) then '1:1' else 'n:1' end as cardinality,
           case when count(*) = count(distinct o_orderdate) then 'both' else 'single' end as cross_filter
    from orders group by 1""")
def declared_one_to_one(spark, sf_dir):
    """Each customer is a model that declares 1:1; it stays where the order dates of that customer confirm it."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("model_id")).agg(
        F.when(F.count(F.lit(1)) == F.countDistinct("o_orderdate"), "1:1").otherwise("n:1").alias("found"))
    rels = found.select("model_id", F.lit(1).alias("seq"), F.lit("orders").alias("from_table"), F.lit("order date").alias("from_column"),
                        F.lit("latest").alias("to_table"), F.lit("latest key").alias("to_column"), F.lit("1:1").alias("declared"), "found")
    tables = found.select("model_id", F.explode(F.array(F.lit("orders"), F.lit("latest"))).alias("table")).withColumn(
        "role", F.when(F.col("table") == "orders", "fact").otherwise("dimension"))
    columns = found.select("model_id", F.lit("latest").alias("table"), F.lit(1).alias("ordinal"), F.lit("latest key").alias("column"),
                           F.lit("int64").alias("type"), F.lit("").alias("usage"))
    return R.orient(rels, tables, columns).select("model_id", "seq", "from_table", "to_table", "cardinality", "cross_filter")


@query("""
    select cast(d as date) as date, year(d) as year, quarter(d) as quarter, month(d) as month, day(d) as day,
           monthname(d) as month_name, year(d) * 100 + month(d) as year_month
    from (select unnest(generate_series(min(l_shipdate), max(l_shipdate), interval 1 day)) as d from lineitem)""")
def date_dimension(spark, sf_dir):
    return profile.date_dimension(table(spark, sf_dir, "lineitem"), "l_shipdate")
