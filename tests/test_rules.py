"""Rule fixtures, and the two ways to find the active relationships."""

import random

import pytest

from starfold.operators import rules as R
from starfold.operators.forest import forest
from starfold.plans.model import first_active_edges

TABLES = "model_id string, table string, role_hint string, n_measures long"
COLUMNS = "model_id string, table string, ordinal int, column string, type string, usage string"
RELS = "model_id string, seq long, from_table string, from_column string, to_table string, to_column string"


def _frames(spark, models):
    """models: name -> ({table: (n_measures, [(column, type)])}, [(from_table, from_column, to_table, to_column)])."""
    tables = [(m, t, None, n) for m, (ts, _) in models.items() for t, (n, _) in ts.items()]
    columns = [(m, t, i, c, ty, "") for m, (ts, _) in models.items() for t, (_, cs) in ts.items() for i, (c, ty) in enumerate(cs)]
    rels = [(m, i, *r) for m, (_, rs) in models.items() for i, r in enumerate(rs)]
    return (spark.createDataFrame(tables, TABLES), spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(rels, RELS))


def _ids(*names):
    return [(n, "int64") for n in names]


MODELS = {
    "star": ({"Landings": (1, _ids("LandingID", "SpeciesID", "CaughtDateKey", "SoldDateKey")),
              "Species": (0, _ids("SpeciesID", "FamilyID") + [("Latin", "string")]),
              "Family": (0, _ids("FamilyID") + [("FamilyName", "string")]),
              "CatchDate": (0, _ids("DateKey") + [("Date", "dateTime"), ("Year", "int64")])},
             [("Landings", "SpeciesID", "Species", "SpeciesID"), ("Species", "FamilyID", "Family", "FamilyID"),
              ("Landings", "CaughtDateKey", "CatchDate", "DateKey"), ("Landings", "SoldDateKey", "CatchDate", "DateKey")]),
    "flip": ({"Species": (0, _ids("SpeciesID")), "Landings": (1, _ids("SpeciesID"))},
             [("Species", "SpeciesID", "Landings", "SpeciesID")]),
    "self": ({"Vessel": (1, _ids("VesselID", "MotherID"))}, [("Vessel", "MotherID", "Vessel", "VesselID")]),
    "facts": ({"Quota": (1, _ids("WaterID")), "Caught": (1, _ids("WaterID"))}, [("Quota", "WaterID", "Caught", "WaterID")]),
    "orphan": ({"Catches": (1, _ids("SpeciesID")), "Species": (0, _ids("SpeciesID")), "Buoys": (0, _ids("BuoyID"))},
               [("Catches", "SpeciesID", "Species", "SpeciesID")]),
    "loop": ({"A": (1, _ids("BID", "CID")), "B": (0, _ids("BID", "CID")), "C": (0, _ids("CID", "AID"))},
             [("A", "BID", "B", "BID"), ("B", "CID", "C", "CID"), ("C", "AID", "A", "AID")]),
    "twice": ({"Catches": (1, _ids("SpeciesID")), "Species": (0, _ids("SpeciesID"))},
              [("Catches", "SpeciesID", "Species", "SpeciesID"), ("Species", "SpeciesID", "Catches", "SpeciesID")]),
    "bridge": ({"Loans": (1, _ids("LoanID")), "LoanOwner": (0, _ids("LoanID", "OwnerID")), "Owner": (0, _ids("OwnerID") + [("Name", "string")])},
               [("Loans", "LoanID", "LoanOwner", "LoanID"), ("LoanOwner", "OwnerID", "Owner", "OwnerID")]),
    "updates": ({"Catches": (1, _ids("UpdateID")), "Updates": (0, _ids("UpdateID") + [("Changed", "dateTime")])},
                [("Catches", "UpdateID", "Updates", "UpdateID")]),
    "unbound": ({"Catches": (1, _ids("SpeciesID"))}, [("Catches", "SpeciesID", "Gone", "SpeciesID")]),
}


@pytest.fixture(scope="module")
def analyzed(spark):
    result = R.analyze(*_frames(spark, MODELS))
    return {name: df.collect() for name, df in result.items()}


def _codes(analyzed, model):
    return sorted(f["code"] for f in analyzed["findings"] if f["model_id"] == model)


def test_roles(analyzed):
    roles = {(r["model_id"], r["table"]): r["role"] for r in analyzed["tables"]}
    assert roles["star", "Landings"] == "fact" and roles["star", "CatchDate"] == "date"
    assert roles["star", "Species"] == "dimension" and roles["bridge", "LoanOwner"] == "bridge"
    assert roles["updates", "Updates"] == "dimension"


def test_findings(analyzed):
    assert _codes(analyzed, "star") == ["model-snowflake", "relationship-role-playing"]
    assert _codes(analyzed, "self") == ["fact-no-dimension", "model-no-dimensions", "relationship-self-join"]
    assert _codes(analyzed, "facts") == ["fact-no-dimension", "fact-no-dimension", "model-no-dimensions", "relationship-many-to-many"]
    assert _codes(analyzed, "orphan") == ["table-orphan"]
    assert _codes(analyzed, "loop") == ["model-snowflake", "relationship-ambiguous-loop"]
    assert _codes(analyzed, "twice") == ["relationship-duplicate"]
    assert _codes(analyzed, "bridge") == []
    assert "relationship-unbound" in _codes(analyzed, "unbound")


def test_orientation_and_direction(analyzed):
    rels = {(r["model_id"], r["seq"]): r for r in analyzed["relationships"]}
    assert rels["flip", 0]["from_table"] == "Landings" and rels["flip", 0]["cardinality"] == "n:1"
    assert rels["facts", 0]["cardinality"] == "n:n" and rels["facts", 0]["cross_filter"] == "both"
    assert rels["bridge", 1]["cross_filter"] == "both"
    assert [rels["star", i]["status"] for i in range(4)] == ["active", "active", "active", "role-playing"]


def test_endpoint_marks(analyzed):
    marks = {(c["model_id"], c["table"], c["column"]): c for c in analyzed["columns"]}
    assert marks["star", "Landings", "SpeciesID"]["is_hidden"] and marks["star", "Landings", "SpeciesID"]["is_foreign_key"]
    assert not marks["star", "Species", "FamilyID"]["is_hidden"]
    assert marks["star", "CatchDate", "DateKey"]["is_key"]


def _random_pairs(seed, n_models, n_nodes, n_edges):
    rng = random.Random(seed)
    rows = []
    for m in range(n_models):
        seen = set()
        for seq in rng.sample(range(n_edges * 3), n_edges):
            a, b = sorted(rng.sample(range(n_nodes), 2))
            if (a, b) not in seen:
                seen.add((a, b))
                rows.append((m, f"t{a}", f"t{b}", seq))
    return rows


def _expected(rows):
    result = {}
    for m in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == m), key=lambda r: r[3])
        for r, status in zip(own, first_active_edges((r[1], r[2]) for r in own)):
            result[m, r[3]] = status == "active"
    return result


def test_forest_against_edges_in_order(spark):
    rows = _random_pairs(7, 6, 14, 25) + [(99, "hub", f"t{i}", i) for i in range(40)] + [
        (98, f"t{i:02}", f"t{i + 1:02}", 50 - i) for i in range(30)]
    found = forest(spark.createDataFrame(rows, "model_id long, a string, b string, seq long"))
    assert {(r["model_id"], r["seq"]): r["in_forest"] for r in found.collect()} == _expected(rows)


def test_forest_of_edges_that_share_a_number(spark):
    rows = [(1, "a", "b", 1), (1, "b", "c", 1), (1, "a", "c", 1), (1, "c", "d", 2), (1, "a", "d", 2)]
    found = forest(spark.createDataFrame(rows, "model_id long, a string, b string, seq long"))
    assert {(r["a"], r["b"]) for r in found.filter("in_forest").collect()} == {("a", "b"), ("a", "c"), ("a", "d")}


def test_breakdown_puts_errors_first(spark):
    rows = [("m", "no-queries", "error", None)] + [("m", "detail-filter", "warning", None)] * 3 + [("m", "derived-query", "info", None)] * 5
    df = R.review_breakdown(spark.createDataFrame(rows, "model_id string, code string, severity string, source_ref string"), limit=2)
    assert [(r["code"], r["n_findings"]) for r in df.collect()] == [("no-queries", 1), ("detail-filter", 3)]
