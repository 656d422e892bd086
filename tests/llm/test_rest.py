"""Search, archives, classifiers and the pipeline."""

import base64
import gzip
import hashlib
import io
import json
import math
import os
import random
import zipfile

import duckdb
import pytest

import oracle
from starfold.llm import quality, queries, search, toxicity, warc


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name]) == []


def test_search_against_brute_force(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [0.1] * 8) for i in range(40)]  # ties
    rows += [(5, rows[5][1]), (100, rows[100][1]), (100, rows[100][1]), (150, [0.3] * 8), (7, [0.5] * 8), (400, [0.1, 0.2]), (401, None), (402, [None] * 8), (403, [math.nan] * 8),
             (404, [math.inf] + [0.0] * 7), (None, [0.9] * 8), (50, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    import numpy as np
    from pyspark.sql import functions as F
    clean = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for own, (q, v) in enumerate(clean):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for at, (j, w) in enumerate(clean) if at != own)
            want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])]
    found = search.top_k(vectors, F.col("vec_id") % 50 == 0, shard_rows=60)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert search.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_essential_terms_of_sparse_postings():
    """Values of both signs, most of them zero, and scores that stay at or below zero, at any number of rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n, share, sign in [(0, 0.1, 0), (3, 0.5, 0), (700, 0.05, 0), (700, 0.3, -1), (9_000, 0.1, 1), (9_000, 0.9, 0)]:
        vectors = rng.integers(-90, 90, (n, 24)) * (rng.random((n, 24)) < share)
        vectors = -np.abs(vectors) if sign < 0 else np.abs(vectors) if sign > 0 else vectors
        vectors[:, 5] *= 10 ** 6 if share == 0.3 else 1
        ids = rng.permutation(n // 2 + 1)[rng.integers(0, n // 2 + 1, n)]
        shard = search.Shard(vectors, ids)
        for query in [*np.abs(vectors[7:8]), rng.integers(-90, 90, 24), np.zeros(24, int), rng.integers(0, 90, 24) * 10 ** 8]:
            scores, found = shard.search(query, 6)
            want = sorted((-int(s), int(i)) for s, i in zip(vectors @ query, ids))[:6]
            assert [(-s, i) for s, i in zip(scores.tolist(), found.tolist())] == want


def test_archives_are_valid_zip_files(spark, tmp_path):
    long = "x" * 1500 + "é"
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, long), (4, "http://c/\n d", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (3, "again", long), (None, "no id", long), (8, "u", "y" * 1000), (9, "u", "z" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "packages")
    got = sorted(((-1 if r.page_id is None else r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                 for r in warc.round_trip(pages, path).collect())
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == long and i != 3
        want.append((-1 if i is None else i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                     3 if revisit else None))
    assert got == sorted(want)
    files = [f for f in os.listdir(path) if f.startswith("part-") and os.path.getsize(f"{path}/{f}")]
    for name in files:
        with zipfile.ZipFile(f"{path}/{name}") as package:
            assert package.testzip() is None and set(package.namelist()) == {warc.DATA, warc.INDEX}
    assert warc.round_trip(pages.limit(0), str(tmp_path / "none")).count() == 0


def _record(kind, uid, body, *, http=True, digest=None, **more):
    block = (b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) if http else b"") + (b"" if kind == "revisit" else body)
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uid}>", "Content-Length": str(len(block)),
              **({"Content-Type": "application/http; msgtype=response"} if http else {}),
              **({"WARC-Payload-Digest": digest} if digest else {}), **{k.replace("_", "-"): v for k, v in more.items()}}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_packages_of_other_writers(spark, tmp_path):
    """Several archives, packed or not, indexed or scanned, with kinds of records and digests that we do not write."""
    base32 = lambda raw: base64.b32encode(hashlib.sha1(raw).digest()).decode()
    one, two, big = b"<p>one</p>", "zwei ü".encode(), b"\r\n\r\nWARC/1.1" * 40_000
    records = [_record("warcinfo", "i", b"software: x", http=False), _record("response", "a", one, digest=f"sha1:{base32(one)}",
               WARC_Target_URI="http://a/", WARC_Date="2020-01-01T00:00:00Z"),
               _record("response", "b", two, digest=f"sha256:{hashlib.sha256(two).hexdigest()}"),
               _record("response", "c", big, digest="sha1:" + "0" * 40), _record("response", "d", b"", digest="odd"),
               _record("revisit", "e", one, digest=f"sha1:{base32(one)}", WARC_Refers_To="<urn:uuid:a>"),
               _record("resource", "f", one, http=False)]
    packed = [gzip.compress(r) for r in records]
    starts = [sum(map(len, packed[:i])) for i in range(len(packed))]
    line = lambda i: "a)/ 20200101000000 " + json.dumps({"offset": starts[i], "length": str(len(packed[i])), "filename": "x.warc.gz"})
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "other.zip", "w", zipfile.ZIP_STORED) as package:
        package.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        package.writestr("archive/x.warc.gz", b"".join(packed))
        package.writestr("indexes/index.cdx.gz", gzip.compress(("!meta\n" + line(5) + "\n" + line(1) + "\n" + line(2)).encode()))
        package.writestr("archive/scanned.warc.gz", b"".join(packed[:4]) + gzip.compress(b"".join(records[4:])))
        package.writestr("archive/plain.warc", b"\r\n" + b"".join(records))
        package.writestr("pages/pages.jsonl", "")
    with zipfile.ZipFile(tmp_path / "in" / "empty.zip", "w"):
        pass
    sha1 = lambda raw: hashlib.sha1(raw).hexdigest()
    want = {"i": ("warcinfo", 11, sha1(b"software: x"), None, None, b"software: x"), "a": ("response", 10, sha1(one), True, None, one),
            "b": ("response", len(two), sha1(two), True, None, two), "c": ("response", len(big), sha1(big), False, None, big),
            "d": ("response", 0, sha1(b""), None, None, b""), "e": ("revisit", 10, sha1(one), None, "<urn:uuid:a>", None),
            "f": ("resource", 10, sha1(one), None, None, one)}
    rows = warc.read_records(spark, str(tmp_path / "in")).collect()
    got = [(r.record_id[10:-1], (r.record_type, r.payload_bytes, r.payload_digest, r.intact, r.refers_to_id,
                                 None if r.payload is None else bytes(r.payload))) for r in rows]
    key = lambda x: x[0]
    assert sorted(got, key=key) == sorted([(i, want[i]) for i in [*"iabcdef", *"iabcdef", "e", "a", "b"]], key=key)
    assert {(r.url, r.date) for r in rows if r.record_id == "<urn:uuid:a>"} == {("http://a/", "2020-01-01T00:00:00Z")}
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark, str(tmp_path / "in")).collect()


def test_directory_without_zip64():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as package:
        package.writestr("a", b"first")
        package.writestr("b", b"second" * 100)
    data = raw.getvalue()
    found = warc.directory(lambda at, n: data[at:at + n], len(data))
    assert data[found["a"][0]:sum(found["a"])] == b"first" and data[found["b"][0]:sum(found["b"])] == b"second" * 100


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rng, rows, labels = random.Random(1), [], []
    for i in range(900):
        words = prose(i, rng.randint(20, 200)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilest", "Vilely,", "grubbiest", "grubby."])
        good = i % 5 != 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else words[:3] * 40
        rows.append((i, " ".join(words), "en", f"s{i % 7}", None))
        labels.append((i, int(good), int(toxic)))
    labels += [(1, 0, 1), (1, 0, 1), (2, 0, 1), (None, 1, 1), (5000, 1, 1), (3, None, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_of_documents_that_were_not_learned(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out("doc_id")))
    rows = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out("doc_id")).collect()
    told = [r for r in rows if r.held_out]
    assert len(told) > 200 and all(0 <= r.score <= 1 for r in rows)
    hit = sum(r.predicted == (r.doc_id % 4 == 0) for r in told) / len(told)
    assert hit > 0.95
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in told:
        if r.predicted and r.doc_id % 4 == 0 and r.doc_id % 5:
            sentence = " ".join(text[r.doc_id].lower().replace(".", " ").replace(",", " ").split()[r.worst_start:r.worst_end])
            assert "vil" in sentence or "grub" in sentence


def test_toxicity_of_odd_rows(spark, labelled, odd_documents):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(r.score == 0 and r.worst_score is None for r in rows if r.doc_id in (2, 3, 4))
    one_kind = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert all(r.predicted == 0 for r in toxicity.score(odd_documents, one_kind).collect())
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).filter("predicted = 1").count() == 0


def test_quality_by_both_views(spark, labelled, odd_documents):
    docs, labels = labelled
    views = quality.fit(docs, labels)
    rows = quality.score(docs, views, keep=("source",)).collect()
    assert sum(r.good == (r.doc_id % 5 != 0) for r in rows) / len(rows) > 0.95
    assert all(r.good for r in rows if r.doc_id % 5 and r.doc_id not in (1, 2))
    assert quality.score(odd_documents, views).count() == odd_documents.count()
    assert quality.score(docs.limit(0), views).count() == 0
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.score(docs, None).filter("good = 0").count() == 0


def test_only_weights_of_the_classifier_reach_the_driver(spark, labelled, monkeypatch):
    docs, labels = labelled
    to_driver = []
    kind = type(docs)
    whole = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: to_driver.append(whole(self)) or to_driver[-1])
    views = quality.fit(docs, labels)
    assert len(views[0].weights) > quality.TRIGRAMS > len(views[1].weights) and to_driver
    assert sum(table.nbytes for table in to_driver) < 100_000


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toArrow())
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        if name == "quality_classifier":
            kept = {r.doc_id for r in docs.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.95 * len(good)
    left = {r.doc_id: r.text for r in docs.collect()}
    last = corpus_pipeline.tokenize(spark, docs, sf_dir).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in left.items()}
    assert all(t in given[i] or len(t) < len(given[i]) for i, t in left.items())
