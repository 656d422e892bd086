"""The demo star, paths through a model, and default aggregates."""

import pytest
from pyspark.sql import functions as F

from starfold.operators.visuals import Visual, visual_frame
from starfold.plans.model import Measure, Model, Relationship, Table, first_active_edges, with_calculated
from starfold.queries.retail import RELATIONSHIPS, retail_model

SALES = """2024 1 1 West 125000 74000 250 500 6250
2024 1 2 West 88000 52000 440 200 4400
2024 4 3 East 210000 138000 140 1500 10500
2024 4 4 East 46000 27000 460 100 2300
2024 7 5 Central 320000 205000 160 2000 16000
2024 7 6 Central 54000 31000 360 150 2700
2024 10 1 West 142000 84000 284 500 7100
2024 10 3 North 189000 124000 126 1500 9450
2025 1 2 West 96000 56000 480 200 4800
2025 1 5 Central 368000 232000 184 2000 18400
2025 4 4 East 52000 30000 520 100 2600
2025 4 6 North 61000 35000 406 150 3050"""


@pytest.fixture(scope="module")
def demo(spark):
    rows = [line.split() for line in SALES.splitlines()]
    columns = ["Year", "Month", "ProductKey", "Region", "Revenue", "Cost", "Quantity", "Price", "Discount"]
    sales = spark.createDataFrame(rows, columns).select("Region", *[F.col(c).cast("int") for c in columns[:3]], *[
        F.col(c).cast("decimal(18,2)") for c in ("Revenue", "Cost", "Price", "Discount")], F.col("Quantity").cast("int"))
    product = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "C")], "ProductKey int, Line string")
    return Model(
        {"sales": Table(sales, is_fact=True), "product": Table(product)},
        [Relationship("sales_product", "sales", "product", [("ProductKey", "ProductKey")])],
        [Measure("Total Revenue", "sales", "sum", "Revenue"), Measure("Gross Profit", "sales", "sum", "Revenue - Cost"),
         Measure("Net Revenue", "sales", "sum", "Revenue - Discount"), Measure("Avg Unit Price", "sales", "average", "Price"),
         Measure("Total Quantity", "sales", "sum", "Quantity"),
         Measure("Margin", "sales", "sum", "(Revenue - Cost) / Revenue"),
         Measure("By Zero", "sales", "sum", "Revenue / (Cost - Cost)"),
         Measure("Lines", "sales", "rowcount")])


def test_demo_totals(demo):
    row = demo.query((), ["Total Revenue", "Gross Profit", "Net Revenue", "Avg Unit Price", "Total Quantity"]).first()
    assert [float(row[0]), float(row[1]), float(row[2]), round(float(row[3]), 2), row[4]] == [
        1751000.0, 663000.0, 1663450.0, 741.67, 3810]


def test_ratio_of_sums_and_zero_divisor(demo):
    row = demo.query((), ["Margin", "By Zero"]).first()
    assert round(float(row["Margin"]), 6) == round(663000 / 1751000, 6)
    assert row["By Zero"] is None


def test_unmatched_rows_keep_their_measures(demo):
    rows = {r["Line"]: r["Lines"] for r in demo.query(["product.Line"], ["Lines"]).collect()}
    assert rows == {"A": 4, "B": 4, "C": 2, None: 2}


def test_dimension_filter_restricts_the_fact(demo):
    rows = demo.query(["sales.Region"], ["Lines"], {"product": "Line = 'B'"}).collect()
    assert {r["Region"]: r["Lines"] for r in rows} == {"East": 3, "North": 1}


def test_matrix_finds_its_columns(demo):
    df = visual_frame(demo, Visual("crosstab", {"rows": ["sales.Region"], "columns": ["sales.Year"], "values": ["Lines"]}))
    assert df.columns == ["Region", "2024", "2025"]
    assert {r["Region"]: (r["2024"], r["2025"]) for r in df.collect()}["West"] == (3, 1)


def test_first_edges_stay_active():
    names = [(r.from_table, r.to_table) for r in RELATIONSHIPS]
    status = first_active_edges(names)
    assert [i + 1 for i, s in enumerate(status) if s != "active"] == [6, 9]
    assert first_active_edges([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "c")]) == [
        "active", "role-playing", "active", "ambiguous-loop", "self-join"]


def test_paths(spark, sf_dir):
    model = retail_model(spark, sf_dir)
    hops = lambda *a, **k: [e.name for e in model.path(*a, **k)]
    assert hops("lineitem", "region") == ["line_order", "order_customer", "customer_nation", "nation_region"]
    assert hops("lineitem", "region", use=["supplier_nation"]) == ["line_supplier", "supplier_nation", "nation_region"]
    assert hops("lineitem", "dim_date", use=["ship_date"]) == ["ship_date"]
    with pytest.raises(ValueError):
        model.path("part", "orders")


def test_filters_reach_the_scan_and_unused_tables_are_not_joined(spark, sf_dir):
    df = retail_model(spark, sf_dir).query(["lineitem.l_returnflag"], ["quantity"], {"lineitem": "l_linestatus = 'F'"})
    plan = df._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert "EqualTo(l_linestatus,F)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string>" in plan


def test_the_fact_is_folded_before_it_is_joined(spark, sf_dir):
    """One hot key then costs one row per task in the join."""
    plan = retail_model(spark, sf_dir).query(["part.p_brand"], ["quantity"])._jdf.queryExecution().optimizedPlan().toString()
    below_join = plan[plan.index("Join"):]
    assert "Aggregate [key_line_part_0" in below_join


def test_totals_of_several_facts(spark, sf_dir):
    model = retail_model(spark, sf_dir)
    row = model.query((), ["n_lines", "n_events"]).first()
    assert (row["n_lines"], row["n_events"]) == (model.tables["lineitem"].rows().count(), model.tables["events"].rows().count())


def test_output_names_may_be_names_of_other_columns(demo):
    rows = demo.query([("sales.Region", "Price")], ["Lines", "Avg Unit Price"]).collect()
    assert {r["Price"]: r["Lines"] for r in rows}["West"] == 4


def test_a_calculation_that_is_not_understood_keeps_its_column(demo):
    df, findings = with_calculated(demo.tables["sales"].rows(),
                                   {"Region": "nonsense(Region)", "Double": "Quantity * 2"})
    assert [f["code"] for f in findings] == ["calculation-needs-review"]
    assert df.select("Region", "Double").first()["Double"] > 0
