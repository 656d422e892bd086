"""Expressions that Spark runs, and reports from their definition to their rows."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Row, functions as F

from starfold.functions import parser
from starfold.operators.visuals import Visual, page_frames, visual_frame
from starfold.plans.definitions import Definition, report_of, with_scoped
from starfold.plans.model import Measure, Model, Relationship, Table, output_names


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, 10.0, "x", 1), (2, 0.0, "x", 1), (3, 5.0, None, 2), (None, 2.0, "y", None), (3, 5.0, "y", 2)]
    return spark.createDataFrame(data, "a int, b double, c string, k int")


_NUMBERS = st.sampled_from(["[S].[a]", "[b]", "[k]", "2", "0.5"])


def _extend(inner):
    binary = st.builds(lambda x, o, y: f"{x} {o} {y}", inner, st.sampled_from("+-*/"), inner)
    group = st.builds("({})".format, inner)
    call = st.builds(lambda f, x: f"{f}({x})", st.sampled_from(["abs", "round", "floor", "sqrt", "sum", "total", "average", "min", "count", "coalesce", "substring", "nosuch"]), inner)
    scoped = st.builds(lambda f, x, k: f"{f}({x} for {k})", st.sampled_from(["total", "average", "maximum", "count"]), inner, st.sampled_from(["[c]", "[k], [c]", "report"]))
    chosen = st.builds(lambda x, y, z: f"if ({x} > {y}) then ({y}) else ({z})", inner, inner, inner)
    case = st.builds(lambda x, y: f"case when {x} is not null and {y} between 1 and 3 then {y} else -{x} end", inner, inner)
    cast = st.builds(lambda x, t: f"cast({x} ; {t})", inner, st.sampled_from(["int", "decimal(9, 2)", "double", "varchar"]))
    return st.one_of(binary, group, call, scoped, chosen, case, cast, st.builds(lambda x, y: f"{x} {y}", inner, inner))


@given(st.recursive(_NUMBERS, _extend, max_leaves=6), st.sampled_from(["none", "total", "average", "countDistinct", "calculated"]))
@settings(max_examples=120, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
def test_what_is_understood_runs(rows, text, aggregate):
    found = parser.rewrite(text, aggregate)
    if found is None:
        return
    df = with_scoped(rows, found.columns)
    (df.agg(F.expr(found.sql)) if found.is_aggregate else df.select(F.expr(found.sql))).schema
    for column in found.columns:  # the text of the window runs too
        rows = rows.withColumn(column.name, F.expr(column.sql))
    rows.schema


def test_scoped_aggregates(rows):
    found = parser.rewrite("[b] / total([b] for [c])", "none")
    df = with_scoped(rows, found.columns)
    assert sorted((r[0] or "", r[1]) for r in df.select("c", F.expr(found.sql)).collect()) == [
        ("", 1.0), ("x", 0.0), ("x", 1.0), ("y", 2 / 7), ("y", 5 / 7)]
    two = parser.rewrite("total(average([b] for [c]))", "none")
    assert two.is_aggregate and with_scoped(rows, two.columns).agg(F.expr(two.sql)).first()[0] == 5 + 5 + 5 + 3.5 + 3.5
    assert parser.rewrite("maximum(sum([b]))", "total") is None
    assert parser.rewrite("average([a] for [b])", "total").sql == "sum(`scoped_1`)"
    for text in ("sum([a]) + [b]", "[a] [b]", "substring([a])", "[a] between 1", "count(distinct [a] for [b])", "case when [a] end", "[a] +", "cast([a]; int(3))"):
        assert parser.rewrite(text, "none") is None, text


@pytest.fixture(scope="module")
def package(spark):
    sales = spark.createDataFrame([(1, 1, 10.0, 2), (1, 2, 4.0, 2), (2, 1, 6.0, 3), (None, 2, 1.0, 1)], "shop int, day int, price double, pieces int")
    shop = spark.createDataFrame([(1, "North", "A"), (2, None, "B")], "id int, town string, name string")
    day = spark.createDataFrame([(1, "Mon"), (2, "Tue")], "id int, name string")
    return Model({"sales": Table(sales, is_fact=True), "shop": Table(shop), "day": Table(day)},
                 [Relationship("sales_shop", "sales", "shop", [("shop", "id")]), Relationship("sales_day", "sales", "day", [("day", "id")]),
                  Relationship("resold", "sales", "day", [("pieces", "id")])],
                 [Measure("total", "sales", "sum", "price"), Measure("days", "sales", "countdistinct", "day"), Measure("mean", "sales", "average", "price")])


def _item(no, name, expression, aggregate="none", query_no=1, item_class=None, broken=False):
    return Row(query_no=query_no, item_no=no, item=name, expression=expression, aggregate=aggregate, broken=broken,
               item_class=item_class or ("measure" if aggregate != "none" else "physical"))


def _source(no, name, source="package", derived=None, filters=()):
    return Row(query_no=no, query=name, source=source, derived_from=derived, detail_filters=list(filters))


def _visual(no, kind, query, shown=()):
    return Row(page_no=1, page="P", visual_no=no, kind=kind, query=query, shown=list(shown))


def test_a_report_with_odd_items(package):
    items = [_item(1, "Name", "[P].[shop].[name]"), _item(2, "name", "[P].[day].[name]"), _item(3, "Price", "[sales].[price] * 2"),
             _item(4, "Sum", "[sales].[price]", "total"), _item(5, "Per piece", "[sales].[price] / [sales].[pieces]", "total"),
             _item(6, "Bad type", "[shop].[name] - date", "none"), _item(7, "Broken", None, broken=True), _item(8, "Empty", None),
             _item(9, "Both", "[Price] + 1"), _item(10, "Mixed", "sum([sales].[price]) + upper([shop].[town])", "calculated"),
             _item(11, "Wrong", "upper([sales].[price], 2)", "total")]
    definition = Definition(items, [], [_source(1, "Q", filters=["[sales].[price] > 1", "nosuch([Name])", "sum([sales].[price]) > 1"]),
                                        _source(2, "None of it")],
                            [_visual(1, "table", "Q", ["Sum", "Name", "Nothing", "Both"]), _visual(2, "table", "Q"), _visual(3, "pie", None),
                             _visual(4, None, None), _visual(5, "table", "None of it")])
    report = report_of(definition, package)
    first, every = report.frames()[1, 1], report.frames()[1, 2]
    assert first.columns == ["Name", "Both", "Sum"]
    assert sorted(map(tuple, first.collect())) == [("A", 9.0, 4.0), ("A", 21.0, 10.0), ("B", 13.0, 6.0)]
    assert every.columns == ["Name", "Price", "Both", "Sum", "Per piece"]
    assert sorted((f["code"], f["query"]) for f in report.findings) == sorted([
        ("calculation-needs-review", "Q"), ("element-needs-review", "Q"), ("reference-unbound", "Q"), ("name-repeated", "Q"),
        ("measure-needs-review", "Q"), ("measure-needs-review", "Q"), ("detail-filter", "Q"), ("detail-filter", "Q"), ("query-unbound", "None of it"), ("visual-unbound", ""),
        ("visual-unbound", "None of it")])


def test_joined_and_derived_queries(package):
    items = [_item(1, "Shop", "[sales].[shop]"), _item(2, "Price", "[sales].[price]"), _item(1, "Id", "[shop].[id]", query_no=2),
             _item(2, "Town", "[shop].[town]", query_no=2), _item(1, "Where", "[Shops].[Town]", query_no=3),
             _item(2, "Paid", "[Lines].[Price]", "total", query_no=3), _item(1, "Dear", "[Price]", "maximum", query_no=4)]
    join = Row(query_no=3, join_no=1, mapped=True, from_table="Lines", from_column="Shop", to_table="Shops", to_column="Id", condition="")
    lost = Row(query_no=3, join_no=2, mapped=True, from_table="Lines", from_column="Shop", to_table="Gone", to_column="Id", condition="[x] = [y]")
    definition = Definition(items, [join, lost], [_source(1, "Lines"), _source(2, "Shops"), _source(3, "Both", "join"),
                                                  _source(4, "Top", "derived", "Lines", ["[Shop] = 1"])],
                            [_visual(1, "table", "Both"), _visual(2, "table", "Top")])
    report = report_of(definition, package)
    assert sorted((r[0] or "", r[1]) for r in report.frames()[1, 1].collect()) == [("", 7.0), ("North", 14.0)]
    assert [tuple(r) for r in report.frames()[1, 2].collect()] == [(10.0,)]
    assert [f["code"] for f in report.findings] == ["relationship-unbound"]


def test_names_that_clash_get_their_table_or_role(package):
    df = package.query(["shop.name", "day.name"], ["total"])
    assert df.columns == ["shop_name", "day_name", "total"]
    roles = package.query(["day@sales_day.name", "day@resold.name", "day.name"], ["total"])
    assert roles.columns == ["sales_day_name", "resold_name", "day_name", "total"]
    assert {tuple(r) for r in roles.collect()} == {("Mon", "Tue", "Mon", 10.0), ("Tue", "Tue", "Tue", 4.0), ("Mon", None, "Mon", 6.0), ("Tue", "Mon", "Tue", 1.0)}
    assert package.query(["day@resold.name"], ["total"], {"day@resold": "name = 'Tue'"}).collect()[0][1] == 14.0
    with pytest.raises(ValueError):
        package.query([("shop.name", "x"), ("day.name", "x")], ["total"])
    with pytest.raises(ValueError):
        package.query(["day@nothing.name"], ["total"])
    assert output_names(["a.x", ("b.x", "y")]) == ["x", "y"] and output_names(["a.x", "b.x"]) == ["a_x", "b_x"]


def test_distinct_counts_join_no_fact_rows(package):
    df = package.query(["shop.town"], ["days", "total"])
    assert sorted((r[0] or "", r[1], r[2]) for r in df.collect()) == [("", 2, 7.0), ("North", 2, 14.0)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [value" in plan[plan.index("Join"):] or "value_0" in plan[plan.index("Join"):]


def test_matrix_labels_and_totals(spark):
    data = [("r", "null", 1), ("r", None, 2), ("s", "total", 4), ("s", "'null'", 8), ("s", None, 16)]
    model = Model({"f": Table(spark.createDataFrame(data, "a string, b string, v int"), is_fact=True)}, (), [Measure("n", "f", "sum", "v")])
    df = visual_frame(model, Visual("crosstab", {"rows": ["f.a"], "columns": ["f.b"], "values": ["n"]}, totals=True))
    found = {(r["a"], r["row_level"]): r.asDict() for r in df.collect()}
    assert set(df.columns) == {"a", "row_level", "'null'", "null", "'total'", "''null''", "total"}
    assert found[None, 1]["total"] == 31 and found["s", 0]["null"] == 16 and found["r", 0]["'null'"] == 1 and found["s", 0]["'total'"] == 4
    empty = visual_frame(model, Visual("crosstab", {"rows": ["f.a"], "columns": ["f.b"], "values": ["n"]}, filters={"f": "v > 99"}))
    assert empty.count() == 0
    with pytest.raises(ValueError):
        visual_frame(model, Visual("line", {"y": ["n"]}))


def test_a_page_scans_a_fact_once(package):
    visuals = {"a": Visual("table", {"rows": ["shop.town", "day.name"], "values": ["total"]}), "b": Visual("pie", {"category": ["shop.town"], "values": ["mean"]}),
               "c": Visual("kpi", {"values": ["mean", "total"]}), "d": Visual("kpi", {"values": ["days"]}),
               "e": Visual("kpi", {"values": ["total"]}, filters={"day": "name = 'Tue'"})}
    frames = page_frames(package, visuals)
    for name, visual in visuals.items():
        assert sorted(map(str, frames[name].collect())) == sorted(map(str, visual_frame(package, visual).collect())), name
        scanned = "price" in frames[name]._jdf.queryExecution().optimizedPlan().toString()
        assert scanned == (name == "e") or name == "d"
