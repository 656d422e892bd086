"""Expressions, detection, and extraction from definition files."""

import pytest
from pyspark.sql import functions as F

from starfold.functions import expressions as X, names as N
from starfold.operators import coverage as C, extract as E
from starfold.sources import artifacts as A

EXPRESSIONS = [
    ("[Shop].[Lines].[Price]", "total", "sum(`Price`)"),
    (" [Shop].[Parts].[Brand] ", "none", "`Brand`"),
    ("[Shop].[Lines].[Price] * [Shop].[Lines].[Count]", "maximum", "max(`Price`) * max(`Count`)"),
    ("if ([Lines].[Tax] < 3) then ('low') else ('high')", "none", "if((`Tax` < 3), ('low'), ('high'))"),
    ("if ([p] > floor([q])) then (if ([p] > 5) then (round([q],2)) else (7)) else (8)", "sum",
     "sum(if((`p` > floor(`q`)), (if((`p` > 5), (round(`q`,2)), (7))), (8)))"),
    ("trim(upper([Parts].[Name]))", "none", "trim(upper(`Name`))"),
    ("extract( Month , [Orders].[Placed on])", "none", "Month(`Placed on`)"),
    ("case when [p] between 1 and 2 then 'x' else 'y' end", "none", "case when `p` between 1 and 2 then 'x' else 'y' end"),
    ("switch([p], 'k', 1, 2) + today()", "none", "decode(`p`, 'k', 1, 2) + current_date()"),
    ("([p] + [q]) / ([p] * ([q] / 2))", "total",
     "(sum(`p`) + sum(`q`)) / nullif((sum(`p`) * (sum(`q`) / nullif(2, 0))), 0)"),
    ("[p] / -[q]", "none", "`p` / nullif(-`q`, 0)"),
    ("rank([Lines].[Price])", "calculated", None),
    ("running-total([Lines].[Price])", "none", None),
    ("_add_years([d], [n] + 1)", "none", "add_months(`d`, 12 * (`n` + 1))"),
    ("'[p]; (' || [q]", "none", "'[p]; (' || `q`"),
    ("cast(cast([p];int); varchar(3))", "none", "cast(cast(`p` as int) as varchar(3))"),
    ("abs([p]", "none", None), ("[p]) + (1", "none", None), ("[p + 1", "none", None), ("'open || [p]", "none", None),
    ("if ([p] > 1) then [q] else [r]", "none", None),
    ("stddev([p])", "calculated", "stddev_samp(`p`)"),
    ("  ", "total", None),
    (None, "total", None),
]


def test_expressions(spark):
    df = spark.createDataFrame([(i, e, a) for i, (e, a, _) in enumerate(EXPRESSIONS)], "i int, e string, a string")
    found = {r.i: r.t for r in df.select("i", X.to_spark_sql(F.col("e"), F.col("a")).alias("t")).collect()}
    assert [found[i] for i in range(len(EXPRESSIONS))] == [t for _, _, t in EXPRESSIONS]


def test_expressions_of_any_length_and_depth(spark):
    long = "if ([p] > 1) then ([p]" + " + 1" * 250_000 + ") else (0)"
    deep = "(" * 100_000 + "[p]" + ")" * 100_000
    nested = "if ([p] = 1) then (2) else (" * 5_000 + "[q]" + ")" * 5_000
    texts = [long, deep, nested, "(" * 100_000, "[" * 100_000, "'" * 99_999, ";" * 50_000, "/" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, e string")
    found = {r.i: r.t for r in df.select("i", X.to_spark_sql(F.col("e"), F.lit("none")).alias("t")).collect()}
    assert found[0] == "if((`p` > 1), (`p`" + " + 1" * 250_000 + "), (0))"
    assert found[1] == deep.replace("[p]", "`p`")
    assert found[2] == "if((`p` = 1), (2), (" * 5_000 + "`q`" + "))" * 5_000
    assert found[3] is None and found[4] is None and found[5] is None and found[6] is None


def test_rewritten_text_runs(spark):
    data = spark.createDataFrame([(1, 4, "abc", "2024-05-06"), (3, 0, "xyz", "2025-01-01")],
                                 "a int, b int, Line string, `Order date` string")
    for text, aggregated in (("(sum(`a`) - sum(`b`)) / nullif((sum(`a`) + sum(`b`)), 0)", 0.0), ("sum(`a`)", 4)):
        assert data.agg(F.expr(text)).first()[0] == aggregated
    assert [r[0] for r in data.select(F.expr("decode(`a`, 1, 'x', 'y')")).collect()] == ["x", "y"]


def test_tokens(spark):
    names = ["OrderDateKey", "order_date key", "SKUCode", "l_orderkey", "Total2024", "%%", "CategoryID"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = {r.n: (r.t, r.b, r.l) for r in df.select("n", N.tokens(F.col("n")).alias("t"), N.key_base(F.col("n")).alias("b"),
                                                    N.last_token(F.col("n")).alias("l")).collect()}
    assert found["OrderDateKey"] == (["order", "date", "key"], ["order", "date"], "key")
    assert found["order_date key"][0] == ["order", "date", "key"] and found["SKUCode"][0] == ["sku", "code"]
    assert found["l_orderkey"][2] == "orderkey" and found["Total2024"][0] == ["total", "2024"] and found["%%"] == ([], [], None)
    assert found["CategoryID"][1] == ["category"]


def test_safe_names():
    assert N.safe_names(["a b", "ab", "a-b", "1x", ""]) == ["ab", "ab2", "ab3", "_1x", "_"]


KINDS = [
    ("a.bin", '{"widgets": {}}', "dashboard"), ("a.bin", ' \n{"querySubject": []}', "module"), ("a.module", '{"foo": 1}', "module"),
    ("a.json", "plain text", "module"), ("a.txt", '<report xmlns="x"/>', "report"), ("a.txt", "<project/>", "model"),
    ("a.bin", '<x xmlns="http://y/bmt/60"/>', "model"), ("a.exploration", "", "dashboard"), ("a.bin", "", "unknown"),
    ("a.bin", '{"layout": [broken', "dashboard"), ("A.XML", "", "report"), ("a.cpf", "?", "model"),
]


def test_kinds(spark):
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(KINDS)], "i int, path string, content string")
    found = {r.i: r.k for r in df.select("i", A.artifact_kind(F.col("path"), F.col("content")).alias("k")).collect()}
    assert [found[i] for i in range(len(KINDS))] == [k for _, _, k in KINDS]


def test_folder_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.xml": b"<report/>", "sub/b.JSON": b"{\"x\": 1}", "c.md": b"no", "sub/d.Module": b"{\xff}", ".e.xml": b"<x/>"}.items():
        (tmp_path / name).write_bytes(data)
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(A.scan_folder(spark, str(tmp_path))) == ["a.xml", "b.JSON", "d.Module"]
    assert names(A.scan_folder(spark, str(tmp_path), recursive=False)) == ["a.xml"]


REPORT = """<report xmlns="http://x/"><queries><query name="Trips"><source><model/></source><selection>
<dataItem name="Harbour" aggregate="none"><expression>[Fleet].[Berth].[Quay]</expression></dataItem>
<dataItem name="Broken"><expression>[a</expr></dataItem>
<dataItem name="Draught" aggregate="maximum"><expression>[Fleet].[Hull].[Draught] - [Fleet].[Hull].[Ballast]</expression></dataItem>
<dataItem name="Tons" aggregate="calculated"><expression><![CDATA[moving-average([Fleet].[Load].[Tons], 3)]]></expression></dataItem>
</selection></query></queries><layouts><page name="P"><list/><vizPie refQuery="Trips"/></page><page name="Empty"/></layouts></report>"""

DASHBOARD = """{"widgets": [{"id": "w1", "name": "column", "data": {"dataViews": [{"dataItems": [{"id": "d1", "itemId": "[Sales].[Year]"},
{"itemLabel": "Revenue"}]}]}, "slotmapping": {"slots": [{"name": "categories", "dataItems": ["d1"]}]}}, {"type": "image", "id": "w2"}, 5],
"layout": {"items": [{"name": "T1", "items": [{"items": [{"id": "w1"}, {"id": "nope"}]}]}, {"title": "T2", "items": []}]}}"""

MODULE = """{"querySubject": [{"identifier": "Sales", "item": [{"queryItem": {"label": "ID", "usage": "identifier", "datatype": "INTEGER"}},
{"folder": 1}, {"queryItem": {"label": "Amt", "usage": "fact", "regularAggregate": "average", "expression": "[a]/[b]"}}]}, 7],
"relationship": [{"left": {"ref": "[Sales]", "maxcard": "many"}, "right": {"ref": ["Gone"]}, "link": [
{"leftRef": "[Sales].[ID]", "rightRef": ["Gone", "ID"]}]}, {"left": {"ref": "[Sales]"}, "right": {"ref": "[Sales]"}, "link": []}]}"""


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("r.xml", REPORT), ("d.json", DASHBOARD), ("m.module", MODULE), ("bad.json", "{oops"), ("odd.bin", "?")]
    return C.extract_corpus(spark.createDataFrame(rows, "path string, content string"))


def test_report_items(corpus):
    found = {r["item"]: (r["aggregate"], r["item_class"], r["expression"], r["broken"]) for r in corpus["items"].collect()}
    assert found["Harbour"] == ("none", "physical", "[Fleet].[Berth].[Quay]", False)
    assert found["Draught"] == ("maximum", "measure", "[Fleet].[Hull].[Draught] - [Fleet].[Hull].[Ballast]", False)
    assert found["Tons"] == ("calculated", "measure", "moving-average([Fleet].[Load].[Tons], 3)", False)
    assert [r[3] for r in found.values()].count(True) == 1 and len(found) == 4  # the broken one is marked, so it is no good row


def test_dashboard(corpus):
    fields = {(r["page"], r["table"], r["column"], r["role"], r["kind"]) for r in corpus["fields"].collect()}
    assert fields == {("T1", "Sales", "Year", "category", "column"), ("T1", "Data", "Revenue", "values", "column")}
    assert {r["page"] for r in corpus["widgets"].collect()} == {"T1", "T2"}


def test_module(corpus):
    columns = {r["column"]: (r["table"], r["type"], r["summarize_by"], r["ordinal"]) for r in corpus["module_columns"].collect()}
    assert columns == {"ID": ("Sales", "int64", "none", 1), "Amt": ("Sales", "string", "average", 3)}


def test_findings_and_coverage(corpus):
    findings = C.corpus_findings(corpus)
    codes = sorted((r["path"], r["code"]) for r in findings.collect())
    assert codes == [
        ("m.module", "calculation-needs-review"), ("m.module", "relationship-needs-review"), ("m.module", "relationship-unbound"),
        ("r.xml", "element-needs-review"), ("r.xml", "measure-needs-review"), ("r.xml", "package-source"),
        ("r.xml", "visual-unbound")]
    rows = {r["path"]: r for r in C.coverage(corpus, findings).collect()}
    assert (rows["bad.json"]["status"], rows["odd.bin"]["kind"], rows["odd.bin"]["status"]) == ("failed", "unknown", "failed")
    assert (rows["r.xml"]["n_tables"], rows["r.xml"]["n_measures"], rows["r.xml"]["n_pages"]) == (1, 2, 2)
    assert (rows["d.json"]["n_pages"], rows["m.module"]["n_relationships"]) == (2, 1)
    totals = C.totals(C.coverage(corpus, findings)).first()
    assert (totals["n_ok"], totals["n_failed"], totals["n_findings"]) == (3, 2, 7)


def test_cardinality_words(spark):
    words = {"1:n": True, "n": True, "*": True, "1..n": True, "0..1": False, "1:1": False, "0:1": False, "1": False, "": False, None: False}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.m for r in df.select("w", E._is_many(F.col("w")).alias("m")).collect()} == words


def test_kind_by_the_root_behind_long_comments(spark):
    comment = "<!-- " + "report " * 3000 + "-->"
    rows = [("a.xml", f'<?xml version="1.0"?>\n{comment}\n<project name="p"><namespace/></project>'),
            ("b.xml", f"{comment}<report><name>querySubject</name></report>"), ("c.xml", f"{comment}<querySubject/>"),
            ("d.xml", "<projection/>")]
    found = spark.createDataFrame(rows, "path string, content string").select(
        "path", A.artifact_kind(F.col("path"), F.col("content")).alias("kind")).collect()
    assert dict(found) == {"a.xml": "model", "b.xml": "report", "c.xml": "model", "d.xml": "report"}


ODD_REPORT = """<report><queries><query name="R&amp;D > rest"><selection>
<dataItem name="p > q" aggregate="total"/><dataItem name='it"s' aggregate="none"><expression>[D].[x &lt; y]</expression></dataItem>
<dataItem name="raw"><expression>[D].[a] < [D].[b]</expression></dataItem>
<dataItem name="c"><expression><![CDATA[[D].[c] > 1]]></expression></dataItem></selection></query>
<query name="J"><source><joinOperation><joinOperands><joinOperand cardinality="1:n"><queryRef refQuery="R&amp;D > rest"/></joinOperand>
<joinOperand cardinality="1:1"><queryRef refQuery="J"/></joinOperand></joinOperands>
<joinFilter><filterExpression>[R&amp;D > rest].[k1] = [J].[k1]</filterExpression></joinFilter>
<joinFilter><filterExpression>[R&amp;D > rest].[k2] = [J].[k2]</filterExpression></joinFilter></joinOperation>
<joinOperation><joinFilter><filterExpression>[J].[k3] = [J].[k3]</filterExpression></joinFilter>
<joinFilter><filterExpression>[J].[k4] = [J].[k4]</filterExpression></joinFilter></joinOperation></source></query></queries></report>"""


def test_no_element_is_lost(spark):
    reports = spark.createDataFrame([("r.xml", ODD_REPORT)], "path string, content string")
    queries = E.report_queries(reports)
    items = {r["item"]: r for r in E.report_items(queries).collect()}
    assert {i for i in items if not items[i]["broken"]} == {"p > q", 'it"s', "c"} and sum(r["broken"] for r in items.values()) == 1
    assert items["c"]["expression"] == "[D].[c] > 1" and items['it"s']["expression"] == "[D].[x < y]"
    assert {r["query"] for r in items.values()} == {"R&D > rest"}
    joins = sorted((r["query_no"], r["join_no"], r["from_column"], r["from_table"]) for r in E.report_joins(queries).collect())
    assert [(j[1], j[2]) for j in joins] == [(1, "k1"), (2, "k2"), (3, "k3"), (4, "k4")] and joins[0][3] == "R&D > rest"
    corpus = C.extract_corpus(reports)
    declared = C.corpus_relationships(corpus).orderBy("seq").collect()
    assert [r["from_column"] for r in declared] == ["k1", "k2", "k3", "k4"]
    assert C.corpus_findings(corpus).filter("code = 'element-needs-review'").count() == 1
