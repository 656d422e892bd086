"""Windows, joins and profiling against brute force on small data with hot keys."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from starfold.operators import joins as J, profile as P, windows as W
from starfold.plans.model import Relationship
from starfold.sources.tables import EmptySource, JdbcSource


@pytest.fixture(scope="module")
def rows():
    """Group "hot" holds most rows; many values are equal, some are missing."""
    rng = random.Random(3)
    return [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, 2.5, 7.0, float(rng.randint(0, 9))]))
            for i in range(600)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(5)


def _groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    return groups


def test_running_per_group(df, rows):
    found = {r["id"]: (r["total"], r["n"]) for r in W.running(df, ["id"], {"total": "v"}, {"n": "v"}, ["g"]).collect()}
    for group in _groups(rows).values():
        total, n = 0.0, 0
        for i, _, v in sorted(group):
            total, n = total + (v or 0), n + (v is not None)
            assert found[i] == (pytest.approx(total), n)


def test_running_refuses_ties(df):
    with pytest.raises(Exception, match="ties"):
        W.running(df, ["v"], counts={"n": "id"}).collect()


@pytest.mark.parametrize("by", [(), ("g",)])
def test_rank(df, rows, by):
    found = {r["id"]: r["rank"] for r in W.rank(df, "v", partition_by=by).collect()}
    key = lambda v: float("inf") if v is None else -v
    for group in (_groups(rows).values() if by else [rows]):
        for i, _, v in group:
            assert found[i] == 1 + sum(key(other[2]) < key(v) for other in group)


def test_percentiles(df, rows):
    found = {r["g"]: r for r in W.percentiles(df, "v", {"p50": 0.5, "p90": 0.9, "p0": 0.0, "p100": 1.0}, ["g"]).collect()}
    for g, group in _groups(rows).items():
        values = sorted(v for _, _, v in group if v is not None)
        assert found[g]["p50"] == pytest.approx(statistics.median(values))
        assert (found[g]["p0"], found[g]["p100"]) == (values[0], values[-1])
        position = 0.9 * (len(values) - 1)
        low, high = values[int(position)], values[min(int(position) + 1, len(values) - 1)]
        assert found[g]["p90"] == pytest.approx(low + (high - low) * (position % 1))


def test_hierarchy_keeps_cycles_and_strangers(spark):
    members = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (5, 77), (6, 7), (7, 6), (8, 6)], "k long, p long")
    found = {r["node"]: (r["path"], r["level"], r["root"]) for r in J.hierarchy_paths(members, "k", "p").collect()}
    assert found == {1: ("1", 1, 1), 2: ("1|2", 2, 1), 3: ("1|2|3", 3, 1), 4: ("4", 1, 4), 5: ("5", 1, 5),
                     6: (None, None, None), 7: (None, None, None), 8: (None, None, None)}


def test_one_to_one_refuses_duplicates(spark):
    left = spark.createDataFrame([(1,), (2,)], "a long")
    right = spark.createDataFrame([(1,), (1,)], "b long")
    with pytest.raises(ValueError):
        J.one_to_one(left, right, [("a", "b")])


def test_band_join(spark, rows):
    bands = [(k, float(k) - 1.5, float(k) + 2) for k in range(-3, 12)] + [(50, 3.0, 3.0), (51, -1e300, 1e300)]
    values = spark.createDataFrame([r for r in rows if r[2] is not None], "id long, g string, v double")
    joined = J.band_join(values, spark.createDataFrame(bands, "k long, low double, high double"), "v", "low", "high")
    expected = sorted((i, k) for i, _, v in rows if v is not None for k, low, high in bands if low <= v < high)
    assert sorted((r["id"], r["k"]) for r in joined.collect()) == expected


def test_bridge_counts_once(spark):
    accounts = spark.createDataFrame([(1,), (2,), (3,)], "acct long")
    bridge = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "b_acct long, b_cust long")
    customers = spark.createDataFrame([(10,), (11,)], "cust long")
    assert [r[0] for r in J.through_bridge(accounts, bridge, customers, [("acct", "b_acct")], [("b_cust", "cust")]).collect()] == [1]


def test_references_with_nulls_and_strangers(spark):
    many = spark.createDataFrame([(1,), (1,), (2,), (9,), (9,), (None,)], "fk long")
    one = spark.createDataFrame([(1,), (2,), (3,)], "pk long")
    row = P.profile_references({"m": many, "o": one}, [Relationship("r", "m", "o", [("fk", "pk")])]).first()
    assert (row.n_rows, row.n_null_keys, row.n_unmatched_rows, row.n_unmatched_keys, row.cardinality) == (6, 1, 2, 1, "n:1")


def test_keys_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, "x"), (2, None, "x"), (3, 3, "y")], "a long, b long, c string")
    found = {r.column_name: (r.n_nulls, r.is_unique, r.is_key) for r in P.profile_keys({"t": (df, ["a", "b", "c"])}).collect()}
    assert found == {"a": (0, True, True), "b": (1, True, False), "c": (0, False, False)}


def test_sources(spark):
    options = JdbcSource("db1", "Sales", "dbo", partition=("id", 0, 1000, 8)).options("FactSales")
    assert options["dbtable"] == "dbo.FactSales" and options["numPartitions"] == "8" and "db1" in options["url"]
    empty = EmptySource({"t": [("a", "decimal(10,3)"), ("b", "date"), ("c", "interval")]}).read(spark, "t")
    assert empty.dtypes == [("a", "decimal(10,3)"), ("b", "date"), ("c", "string")] and empty.isEmpty()


def test_hierarchy_of_any_depth(spark):
    rows = [(i, i - 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (1002, 1000)]
    found = {r["node"]: r for r in J.hierarchy_paths(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
    assert len(found) == 303 and found[299]["level"] == 300 and found[299]["root"] == 0
    assert found[299]["path"] == "|".join(map(str, range(300)))
    assert all(found[i]["path"] is None and found[i]["root"] is None for i in (1000, 1001, 1002))


def test_bands_by_rows_and_by_totals(spark):
    import random

    rng = random.Random(0)
    values = [(rng.choice([None, float(rng.randint(0, 50)), rng.random() * 50]), rng.randint(1, 9)) for _ in range(400)]
    bands = [(i, lo, lo + rng.choice([-1.0, 0.0, 0.5, 7.0, 60.0])) for i, lo in enumerate(float(rng.randint(-5, 55)) for _ in range(60))]
    bands.append((99, None, 3.0))
    rows = spark.createDataFrame(values, "v double, n long")
    ranges = spark.createDataFrame(bands, "b long, lo double, hi double")
    want = {b: [n for v, n in values if v is not None and lo is not None and lo <= v < hi] for b, lo, hi in bands}
    found = {r["b"]: (r["n_rows"], r["total"]) for r in J.band_totals(rows, ranges, "v", "lo", "hi", {"total": "n"}).collect()}
    assert found == {b: (len(x), sum(x) if x else None) for b, x in want.items()}
    joined = J.band_join(rows, ranges, "v", "lo", "hi").groupBy("b").count().collect()
    assert {r["b"]: r["count"] for r in joined} == {b: len(x) for b, x in want.items() if x}
