"""The prefix trie, the permutation index and the filter audit, each against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from starfold.llm import filters, permutation, trie


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [t for _, t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    own = {n: (len(m) - 1) * len(n[-1][1].encode()) if n else 0 for n, m in members.items()}
    children = Counter(n[:-1] for n in members if n)
    saved, leaves = Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            saved[n[:d]] += own[n]
            leaves[n[:d]] += n not in children
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest())
                  for n, m in members.items())


def found_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in trie.prefix_trie(df).collect())


def test_trie_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)  # several pieces in most conversations
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(101, 104), 7_000_000_000, 206, 207]:
        for t in range(rng.choice([1, 1, 2, 3, 9, 25])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])))
    for c in (300, 301, 302, 303):  # the same conversation again and again, with its prefix
        rows += [(c, t, "user", f"turn {t}") for t in range(12 if c < 303 else 5)]
    rows += [(400, None, "user", "x"), (400, None, "user", "x"), (400, 3, "user", "x"), (400, 3, "assistant", "y"),
             (None, 1, "user", "lost"), (400, 3, "user", "x"), (401, 1, "us", "er x"), (402, 1, "user", " x")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, x1 int").repartition(5)
    assert found_trie(df) == brute_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    only = [(c, 0, "user", "x") for c in (11, 12, 13, 14) if zlib.crc32(str(c).encode()) % 9]
    assert found_trie(spark.createDataFrame(only, "conv_id long, turn long, role string, text string")) == brute_trie(only)
    texts = trie.with_texts(trie.prefix_trie(df), df).filter("depth > 0 AND conv_id = 300 AND text <> ''").collect()
    assert {r.text for r in texts if r.depth == 12} <= {"turn 11"}


def test_trie_of_one_long_conversation(spark):
    rows = [(0, t, "user", f"{t % 7}") for t in range(900)] + [(c, t, "user", f"{t % 7}") for c in range(1, 5) for t in range(0, 600 + c % 2)]
    assert found_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == brute_trie(rows)


def brute_nearest(rows, k):
    vectors = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)]
    found = []
    for a, (i, q) in enumerate(vectors):
        if i % 20 == 0:
            scored = sorted((-float(q @ v), j) for b, (j, v) in enumerate(vectors) if a != b)
            found += [(i, r + 1, j, round(-s, 6)) for r, (s, j) in enumerate(scored[:k])]
    return sorted(found)


def test_index_with_copies_and_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    rows += [(1000 + i, rows[20][1]) for i in range(90)]  # a third of all rows
    rows += [(20, rows[20][1]), (40, [1.0] * 8), (None, [1.0] * 8), (60, None), (300, [0.0] * 8), (320, [math.nan] * 8),
             (340, [math.inf] * 8), (360, [None] * 8), (380, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, hash int, shard string").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in permutation.nearest(df, F.col("vec_id") % 20 == 0, k=7).collect())
    assert got == brute_nearest(rows, 7)
    few = df.filter("vec_id in (0, 20, 3)").limit(3)
    assert permutation.nearest(few, F.col("vec_id") % 20 == 0).count() > 0
    assert permutation.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert permutation.nearest(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("crowd", [0, 1500])
def test_recall_of_the_index(spark, crowd):
    """At least 0.9 of the true nearest on vectors without any structure, and beside a third of near copies."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(4500, 32))
    if crowd:
        vectors[:crowd] = vectors[0] + 0.05 * rng.normal(size=(crowd, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    order = rng.permutation(len(vectors))
    table = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors[order].astype(np.float32).tolist(), pa.list_(pa.float32()))})
    got = permutation.nearest(spark.createDataFrame(table), F.col("vec_id") % 20 == 0, least=200).toArrow().to_pandas()
    own = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    single = vectors[order].astype(np.float32).astype(float)
    hits = 0
    for q in range(0, len(single), 20):
        scores = single @ single[q]
        scores[q] = -9
        hits += len(own[q] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hits / (20 * len(own)) >= 0.9 and len(own) == 225


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall(r"[#$%&*|]", text or ""))


def counts(texts):
    found = filters.measure(pa.array(texts, pa.string()))
    return list(zip(*[found[n].tolist() for n in ("words", "distinct_words", "capitals", "code_points", "symbols")]))


@given(st.lists(st.one_of(st.none(), st.text("aAbZé漢😀 \t\n\x0b\x0c\r\x1f\x00\x85#$|", max_size=60), st.text(max_size=30)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_counts_of_one_pass(texts):
    assert counts(texts) == [brute_counts(t) for t in texts]


def test_counts_of_long_and_colliding_words(monkeypatch):
    texts = ["a" * 70 + " " + "a" * 70 + " " + "a" * 69 + "b", "x" * 300_000, "a" * 64 + " " + "a" * 63, "a a\0 a\0\0 a", "é " * 9_000,
             " ".join(str(i % 977) for i in range(30_000)), None, ""]
    assert counts(texts) == [brute_counts(t) for t in texts]
    monkeypatch.setattr(filters, "mix", lambda x: x & np.uint64(3))  # words that collide are told apart
    assert counts(texts[:4] + ["one two three two six six"]) == [brute_counts(t) for t in texts[:4] + ["one two three two six six"]]


def test_audit_of_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (6, 0, None), (4, 1, None), (8, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    docs = odd_documents.unionByName(odd_documents.withColumns({"doc_id": F.col("doc_id") + 10, "lang": F.lit(None).cast("string")}))
    rows, told = docs.collect(), [r for r in labels.collect() if r.doc_id is not None]
    good, toxic = {r.doc_id for r in told if r.quality == 1}, {r.doc_id for r in told if r.toxic == 1}
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    profiles = Counter()
    for r in rows:
        w, distinct, capitals, points, symbols = brute_counts(r.text)
        failed = "".join(f for f, bad in zip("ABCDE", (
            w < 200, 100 * distinct < 50 * w, 100 * capitals > 3 * points, symbols > 0,
            r.doc_id is not None and r.doc_id > first[r.text or ""])) if bad)
        profiles[r.lang or "", failed, r.doc_id in good, r.doc_id in toxic] += 1
    want, shapley = [], Counter()
    for part in {p for p, *_ in profiles}:
        own = [(f, g, t, n) for (p, f, g, t), n in profiles.items() if p == part]
        for order in map("".join, permutations("ABCDE")):
            for i, x in enumerate(order):
                here = [(f, g, t, n) for f, g, t, n in own if not set(order[:i]) & set(f)]
                gone = [(g, t, n) for f, g, t, n in here if x in f]
                shapley[part, x] += sum(n for *_, n in gone)
                want.append((part, order, i + 1, sum(n for f, _, _, n in here if x not in f), sum(n for *_, n in gone),
                             sum(n for f, _, _, n in own if x in f and set(order[:i]) & set(f)), sum(n for f, _, _, n in own if f == x),
                             sum(n for g, _, n in gone if g), sum(n for _, t, n in gone if t)))
    want = sorted((*w, shapley[w[0], w[1][w[2] - 1]]) for w in want)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in filters.audit(docs, labels).select(*names).collect()) == want and len(want) == 1200
    assert filters.audit(docs.limit(0), labels).count() == 0 and filters.audit(docs, labels.limit(0)).count() == 1200
