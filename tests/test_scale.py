"""Operators made for many rows, with small bounds, against brute force on nulls, ties, repeats and hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from starfold.operators import joins as J, profile as P, rules as R, windows as W
from starfold.operators.forest import forest, marked
from starfold.plans.model import Relationship
from starfold.sources import artifacts as A, tables as S


def test_forest_in_pieces(spark):
    rng = random.Random(2)
    rows = [(m, a, b, rng.randint(1, 40)) for m in ("x", "y", "z") for a, b in {tuple(sorted(rng.sample("abcdefghijkl", 2))) for _ in range(6 if m == "z" else 60)}]
    pairs = spark.createDataFrame(rows, "model_id string, a string, b string, seq long").repartition(3)
    whole, cut = (sorted(map(tuple, forest(pairs, piece).collect())) for piece in (1000, 7))
    assert whole == cut and sum(r[4] for r in whole) == sum(len({t for r in rows if r[0] == m for t in r[1:3]}) - 1 for m in "xy") + sum(
        r[4] for r in whole if r[0] == "z")


def test_statuses_in_pieces(spark):
    """Further relationships of a pair, null ends, self-joins and shared numbers: the same whatever a task holds at once."""
    rng = random.Random(4)
    rows = [(m, rng.randrange(40), *rng.choices(["a", "b", "c", "d", "e", "f", None], k=2)) for m in (1, 2, None) for _ in range(60)]
    rels = spark.createDataFrame(rows, "model_id long, seq long, a string, b string")
    edges = rels.withColumn("x", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b"))).withColumn(
        "y", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b"))).select(
        "model_id", F.col("x").alias("a"), F.col("y").alias("b"), "seq")
    key = lambda r: tuple((v is None, v) for v in r)
    whole, cut = (sorted(map(tuple, marked(edges, piece).collect()), key=key) for piece in (1000, 9))
    assert len(whole) == len(rows) and whole == cut
    for model in (1, 2, None):
        mine = [r for r in whole if r[0] == model]
        first, leader = {}, {}

        def find(x):
            while leader.get(x, x) != x:
                x = leader[x]
            return x

        for _, a, b, seq, *_ in sorted((r for r in mine if r[1] is not None and r[1] != r[2]), key=lambda r: (r[3], r[1], r[2])):
            if (a, b) not in first:
                first[a, b] = seq, find(a) != find(b)
                leader[find(a)] = find(b)
        assert all((r[4], r[5]) == first.get((r[1], r[2]), (None, None)) for r in mine)


def test_percentiles_with_brackets(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("hot", float(rng.choice([1, 1, 2, 5, 9]) if i % 3 else rng.randint(0, 5000))) for i in range(3000)] + [("small", float(i)) for i in range(7)] + [("none", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    exact = {}
    for g in {r[0] for r in rows}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        position = 0.37 * (len(values) - 1)
        if values:
            low, high = values[int(position)], values[min(int(position) + 1, len(values) - 1)]
            exact[g] = (pytest.approx(low + (high - low) * (position % 1)), values[-1])
    found = lambda: {r.g: (r.p, r.top) for r in W.percentiles(df, "v", {"p": 0.37, "top": 1.0}, ["g"]).collect()}
    assert found() == exact
    monkeypatch.setattr(W, "_WHOLE", 10)
    monkeypatch.setattr(W, "_SKETCH", 200)
    assert found() == exact
    monkeypatch.setattr(W, "_SKETCH", 3)  # a sketch too coarse to trust: what it misses is found all the same
    assert found() == exact
    total = W.percentiles(df, "v", {"p": 0.5}).first()
    values = sorted(v for _, v in rows if v is not None)
    assert total.p == pytest.approx((values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2)


def test_hierarchy_totals(spark):
    rows = [(1, None, 5), (2, 1, 7), (3, 2, None), (4, 4, 1), (5, 77, 2), (6, 7, 1), (7, 6, 1), (8, 6, 1), (None, 1, 3), (None, None, 9)]
    rows += [(100 + i, 1 if i < 30 else 99 + i, 1) for i in range(60)]  # a hot parent, then a chain
    df = spark.createDataFrame(rows, "k long, p long, v long")
    up = {k: p for k, p, _ in rows if k is not None and p != k and p in {r[0] for r in rows}}

    def ancestors(k):
        seen = []
        while k is not None and k not in seen:
            seen.append(k)
            k = up.get(k)
        return None if k is not None else seen

    want = {k: [0, None] for k, _, _ in rows if k is not None}
    for k, p, v in rows:
        for a in (ancestors(k) if k is not None else []) or []:  # one without a key is a root
            want[a][0] += 1
            want[a][1] = want[a][1] if v is None else (want[a][1] or 0) + v
    found = {r.node: (r.n_members, r.total) for r in J.hierarchy_totals(df, "k", "p", {"total": "v"}).collect() if r.node is not None}
    for k in want:
        assert found[k] == ((None, None) if ancestors(k) is None else tuple(want[k])), k
    paths = {(r.node, r.path) for r in J.hierarchy_paths(df, "k", "p").collect()}
    assert (3, "1|2|3") in paths and sum(n is None for n, _ in paths) >= 1 and len(J.hierarchy_paths(df, "k", "p").collect()) == len(rows)
    for function in (lambda d: J.hierarchy_paths(d, "k", "p"), lambda d: J.hierarchy_totals(d, "k", "p", {})):
        with pytest.raises(ValueError, match="repeated"):
            function(df.unionByName(df.filter("k = 2")))


@pytest.mark.parametrize("first,second", [("<", ">"), ("<=", ">="), (">", None), ("<=", "<")])
def test_joins_by_inequalities(spark, first, second):
    rng = random.Random(7)
    left = [(i, rng.choice([None, 3.0, 3.0, float(rng.randint(0, 20))]), float(rng.randint(0, 9))) for i in range(90)]
    right = [(i, rng.choice([None, 3.0, float(rng.randint(-5, 25))]), float(rng.randint(0, 9))) for i in range(70)]
    test = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__}
    want = sorted((i, j) for i, a, b in left for j, c, d in right
                  if a is not None and c is not None and test[first](a, c) and (second is None or test[second](b, d)))
    conditions = [("a", first, "c")] + ([("b", second, "d")] if second else [])
    df = J.inequality_join(spark.createDataFrame(left, "i long, a double, b double"), spark.createDataFrame(right, "j long, c double, d double"), conditions)
    assert sorted((r.i, r.j) for r in df.collect()) == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        J.many_to_one(df, df, [])


def test_intervals_that_overlap(spark):
    rng = random.Random(8)
    ends = lambda n: [(i, lo, lo + rng.choice([-1.0, 0.0, 1.0, 5.0, 200.0])) for i, lo in enumerate(float(rng.choice([4, 4, 4, rng.randint(0, 60)])) for _ in range(n))]
    left, right = ends(80) + [(99, None, 3.0)], ends(60) + [(98, -1e300, 1e300)]
    want = sorted((i, j) for i, a, b in left for j, c, d in right if a is not None and a < b and c < d and a < d and c < b)
    df = J.interval_join(spark.createDataFrame(left, "i long, a double, b double"), spark.createDataFrame(right, "j long, c double, d double"), ("a", "b"), ("c", "d"))
    assert sorted((r.i, r.j) for r in df.collect()) == want


def test_references_of_unlike_types(spark):
    many = spark.createDataFrame([(1, -0.0), (1, 2.0), (2, None), (9, 0.0)], "fk int, x double")
    one = spark.createDataFrame([(1, 0), (2, 2), (3, 3)], "pk long, y int")
    rels = [Relationship("a", "m", "o", [("fk", "pk")]), Relationship("b", "m", "o", [("x", "y")]), Relationship("c", "o", "o", [("pk", "y"), ("y", "y")])]
    found = {r.relationship: tuple(r)[1:] for r in P.profile_references({"m": many, "o": one}, rels).collect()}
    assert found == {"a": (4, 0, 1, 1, "n:1"), "b": (4, 1, 0, 0, "n:1"), "c": (3, 0, 1, 1, "1:1")}
    nothing = P.profile_references({"m": many.limit(0), "o": one.limit(0)}, rels[:1]).first()
    assert tuple(nothing)[1:] == (0, 0, 0, 0, "1:1")


def test_declared_one_to_one(spark):
    rels = spark.createDataFrame([("m", 1, "a", "x", "b", "b id", "1:1", "1:1"), ("m", 2, "a", "y", "b", "b id", "1:1", "n:1"), ("m", 3, "a", "z", "b", "b id", None, "1:1")],
                                 "model_id string, seq int, from_table string, from_column string, to_table string, to_column string, declared string, found string")
    tables = spark.createDataFrame([("m", "a", "dimension"), ("m", "b", "dimension")], "model_id string, table string, role string")
    columns = spark.createDataFrame([("m", "b", 0, "b id", "int64", "")], "model_id string, table string, ordinal int, column string, type string, usage string")
    assert {r.seq: r.cardinality for r in R.orient(rels, tables, columns).collect()} == {1: "1:1", 2: "n:1", 3: "n:1"}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, path)
    first = S.refresh_snapshot(spark.range(3), path)
    bad = spark.range(5).select(F.when(F.col("id") < 9, F.raise_error(F.lit("stop"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        S.refresh_snapshot(bad, path)
    assert S.read_snapshot(spark, path).count() == 3
    second = S.refresh_snapshot(S.read_snapshot(spark, path).unionByName(spark.range(1)), path)  # from itself
    assert (first.count(), second.count(), S.read_snapshot(spark, path).count()) == (3, 4, 4)
    S.refresh_snapshot(spark.range(7), path)
    assert S.read_snapshot(spark, path).count() == 7 and len(S._versions(spark, path)) == 2


def test_skipped_files(spark, tmp_path):
    for name in ("a.xml", ".b.json", "_c/d.Module", "k=1/e.xml", "_k=1/f.xml", "_temporary/g.xml", ".h.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("<x/>")
    assert {r.source_ref for r in A.skipped_files(spark, str(tmp_path)).collect()} == {".b.json", "d.Module"}
    assert A.scan_folder(spark, str(tmp_path)).count() == 3
