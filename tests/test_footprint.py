"""What operators leave on disk, shuffle and plan, and that their results are those of brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from starfold.functions import names as N
from starfold.operators import joins as J, rules as R
from starfold.plans.model import Measure, Model, Relationship, Table
from starfold.session import discard, materialize

TABLES = "model_id long, table string, role_hint string, n_measures long"
COLUMNS = "model_id long, table string, ordinal int, column string, type string, usage string"
RELS = "model_id long, seq long, from_table string, from_column string, to_table string, to_column string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle(spark):
    """F4 to F9: what a write has shuffled is gone after it, although the frame is still held."""
    before = _shuffle_files(spark)
    df = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    written = materialize(df, "released")
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, written.collect())) and written.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    folder = spark.sparkContext._jvm.java.io.File(written.written_to)
    assert folder.exists()
    discard(written)
    assert not folder.exists()


def _random_models(spark):
    rng = random.Random(6)
    names = ["Sales", "Product", "SoldDate", "Owner", None]
    columns = ["SalesID", "ProductKey", "Product", "DateKey", "OwnerNo", "SoldDateKey", None]
    tables = [(m, t, rng.choice([None, "fact"]), rng.choice([0, 0, 2])) for m in range(30) for t in names[:4] if rng.random() < 0.8]
    tables = [*tables, *tables[:9]]  # some twice
    cols = [(m, t, i, c, rng.choice(["int64", "decimal"]), rng.choice(["", "key"])) for m, t, *_ in tables for i, c in enumerate(rng.sample(columns, 4))]
    rels = [(m, rng.choice([None, *range(6)]), rng.choice(names), rng.choice(columns), rng.choice(names), rng.choice(columns))
            for m in [*range(30), None] for _ in range(8)]
    return (spark.createDataFrame(tables, TABLES), spark.createDataFrame(cols, COLUMNS), spark.createDataFrame([*rels, *rels[:40]], RELS))


def test_orient_looks_up_each_end_once(spark):
    """F4 to F9: relationships are not taken apart and put together again; nulls, repeated rows and tables."""
    tables, columns, rels = _random_models(spark)
    roles = tables.withColumn("role", R.base_role())
    oriented = R.orient(rels, roles, columns)
    assert "Generate" not in _plan(oriented)
    role, primary = {}, set()
    for m, t, r in roles.select("model_id", "table", "role").collect():
        role[m, t] = max(role.get((m, t), ""), r, key=("", *R.ROLES).index)
    words = lambda df, name, f: {r[0]: r[1] for r in df.select(name, f(F.col(name))).distinct().collect()}
    base, own = words(columns, "column", N.key_base), words(tables, "table", N.tokens)
    for m, t, c, is_key in R.seed_keys(columns).select("model_id", "table", "column", "is_key").collect():
        if is_key and c is not None and set(base[c]) <= set(own[t]):
            primary.add((m, t, c))
    expected = set()
    for m, seq, a, x, b, y in set(map(tuple, rels.collect())):
        ra, rb = (role.get((m, t)) if m is not None else None for t in (a, b))
        flip = bool(ra and rb and a != b and ((rb == "fact") if (ra == "fact") != (rb == "fact") else (m, a, x) in primary and (m, b, y) not in primary))
        facts = bool(ra == rb == "fact" and a != b)
        ends = (b, y, a, x, rb, ra) if flip else (a, x, b, y, ra, rb)
        expected.add((m, seq, *ends, "n:n" if facts else "n:1", "both" if facts else "single"))
    unnumbered = R.orient(R.deduplicate(rels), roles, columns, repeats=False).filter("seq is null").collect()
    assert len(unnumbered) == len({r.model_id for r in unnumbered}) > 1
    found = list(map(tuple, oriented.collect()))
    assert len(found) == len(expected) and set(found) == expected


def test_first_of_each_pair(spark):
    """F4 to F9: a pair's names are shuffled once, and hashed; its first row stays whole, further columns with it."""
    _, _, rels = _random_models(spark)
    kept = R.deduplicate(rels)
    assert "SortAggregate" not in _plan(kept)
    more = R.deduplicate(rels.withColumn("note", F.concat_ws("/", "seq", "from_table", "from_column")))
    groups = {}
    for r in map(tuple, rels.collect()):
        pair = frozenset([r[2:4], r[4:6]])
        groups.setdefault((r[0], pair), []).append(r)
    first = {k: min((r[1] for r in rs if r[1] is not None), default=None) for k, rs in groups.items()}
    found = kept.collect()
    assert len(found) == len(groups) and kept.columns == rels.columns
    for r in map(tuple, found):
        if r[1] is None:
            assert r[2:] == (None,) * 4
        else:
            key = r[0], frozenset([r[2:4], r[4:6]])
            assert first[key] == r[1] and r in groups[key]
    text = lambda r: "/".join(str(v) for v in (r.seq, r.from_table, r.from_column) if v is not None)
    assert all(r.note == text(r) for r in more.collect() if r.seq is not None) and more.count() == len(groups)


def test_findings_are_made_in_steps(spark):
    """no plan holds the joins of all findings, and a summary makes none."""
    tables, columns, rels = _random_models(spark)
    result = R.analyze(tables, columns, rels.filter("seq is not null and model_id is not null"))
    assert set(result) == {"tables", "columns", "relationships", "findings", "summary"} and not result.made
    assert "Join" not in _plan(result["findings"]) and result["findings"] is result["findings"]
    assert {r.code for r in result["findings"].collect()} >= {"relationship-duplicate", "relationship-unbound", "relationship-self-join"}


def test_distinct_counts_at_several_grains(spark):
    """values are dealt once, not once for each grain; null groups, null values and one that is everywhere."""
    rng = random.Random(8)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.choice([1, 2, None]), rng.choice([None, 0, 0, *range(1, 30)]), rng.choice([1.5, None])) for _ in range(400)]
    facts = spark.createDataFrame([(*r, rng.choice([1, 2, 3, None])) for r in rows], "g string, h int, v long, x double, k int")
    dims = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id int, name string")
    model = Model({"f": Table(facts, is_fact=True), "d": Table(dims)}, [Relationship("fd", "f", "d", [("k", "id")])],
                  [Measure("values", "f", "countdistinct", "v"), Measure("others", "f", "countdistinct", "x"), Measure("total", "f", "sum", "x"),
                   Measure("dec", "f", "sum", "cast(x as decimal(9,2))"), Measure("n", "f", "rowcount")])
    joined = [dict(zip(("g", "h", "v", "x", "name"), (r.g, r.h, r.v, r.x, {1: "p", 2: "q"}.get(r.k)))) for r in facts.collect()]
    for names, fields in ((("g", "h"), ["f.g", "f.h"]), (("g", "name"), ["f.g", "d.name"])):
        for sets in ([[0, 1], [0], [1], []], [[1, 0]]):
            df = model.query(fields, ["values", "others", "total", "dec", "n"], sets=sets)
            assert dict(df.dtypes)["dec"] == dict(model.query(fields, ["dec"], sets=sets).dtypes)["dec"] and "Expand" not in _plan(df)
            expected = set()
            for s in sets:
                level = sum(2 ** (1 - i) for i in range(2) if i not in s)
                groups = {}
                for r in joined:
                    groups.setdefault(tuple(r[n] if i in s else None for i, n in enumerate(names)), []).append(r)
                for key, own in groups.items():
                    xs = [r["x"] for r in own if r["x"] is not None]
                    expected.add((*key, len({r["v"] for r in own} - {None}), len(set(xs)), sum(xs) if xs else None,
                                  float(sum(xs)) if xs else None, len(own), level))
            assert {(*r[:5], None if r.dec is None else float(r.dec), *r[6:]) for r in df.collect()} == expected and df.count() == len(expected)


@pytest.mark.parametrize("few", [J._FEW_ROWS, 0])
def test_inequalities_use_all_tasks(spark, monkeypatch, few):
    """pairs are the work, so tasks are not put together by the bytes of the sides; with a side in each task or not."""
    monkeypatch.setattr(J, "_FEW_ROWS", few)
    rng = random.Random(9)
    some = lambda n: [(i, rng.choice([None, float(rng.randint(0, 20))]), rng.randint(0, 30)) for i in range(n)]
    small, large = some(25), some(900)
    small, large = [*small, *small[:3]], [*large, *large[:5]]
    for left, right in ((small, large), (large, small)):
        for ops in ((">", "<="), ("<", ">="), (">=",)):
            conditions = list(zip("ab", ops, "cd"))
            df = J.inequality_join(spark.createDataFrame(left, "i long, a double, b int"), spark.createDataFrame(right, "j long, c double, d int"), conditions)
            compare = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__}
            expected = sorted(((x, y) for x in left for y in right if all(
                x[k] is not None and y[k] is not None and compare[op](float(x[k]), float(y[k])) for k, op in enumerate(ops, 1))), key=str)
            assert df.columns == list("iabjcd") and sorted(((tuple(r[:3]), tuple(r[3:])) for r in df.collect()), key=str) == expected
    df = J.inequality_join(spark.createDataFrame(small, "i long, a double, b int"), spark.createDataFrame(large, "j long, c double, d int"), [("b", "<=", "d")])
    used = df.select("i", F.spark_partition_id().alias("task")).groupBy("task").count().count()
    assert used >= 8 if few else used > 1
