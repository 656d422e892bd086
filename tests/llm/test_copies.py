"""Near-duplicates, repeated passages and benchmark leaks against brute force and planted cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from starfold.llm import decontam, neardup, substring
from starfold.llm.scratch import Scratch
from starfold.llm import graph


def weighted(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return Counter(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def probability_jaccard(x, y):
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys())
    return total


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_similarity_by_definition(prose):
    rng = random.Random(3)
    for seed in range(30):
        words = prose(seed, 12).split()
        a, b = (" ".join(rng.choices(words, k=40)) + " " + prose(seed, 30) for _ in range(2))
        x, y = weighted(a), weighted(b)
        number = {k: i + 1 for i, k in enumerate(x.keys() | y.keys())}
        side = lambda c: map(np.array, zip(*sorted((number[k], float(v)) for k, v in c.items())))
        assert neardup.probability_jaccard(*side(x), *side(y)) == pytest.approx(probability_jaccard(x, y))


def test_registers_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(0)
    items = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    x, y = rng.integers(1, 6, 300).astype(float), rng.integers(0, 6, 300).astype(float)
    kept = y > 0
    held = neardup.prob_min_hash(np.concatenate([items, items[kept]]), np.repeat([0, 1], [300, kept.sum()]),
                                 np.concatenate([x, y[kept]]), 2, m=4096)
    order = np.argsort(items)
    order_y = order[kept[order]]
    truth = neardup.probability_jaccard(items[order], x[order], items[order_y], y[order_y])
    assert (held[0] == held[1]).mean() == pytest.approx(truth, abs=0.04)


def brute_classes(rows):
    sets = [weighted(t or "") for _, t in rows]
    leader = list(range(len(rows)))

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = probability_jaccard(sets[i], sets[j]) >= 0.8 if sets[i] and sets[j] else \
                not sets[i] and not sets[j] and (rows[i][1] == rows[j][1])
            if same:
                leader[find(i)] = find(j)
    least = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            least[find(i)] = min(least.get(find(i), number), number)
    return sorted(((-1 if n is None else n), least.get(find(i))) for i, (n, _) in enumerate(rows))


def test_classes_against_brute_force(spark, prose, monkeypatch):
    monkeypatch.setattr(neardup, "_SMALL", 3)  # so that blocks are compared too
    monkeypatch.setattr(neardup, "_BLOCK", 4)
    rows, number = [], 0
    for seed in range(12):
        base = prose(seed, 120)
        for copy in range(6):
            rows.append((number, edited(base, number, copy)))
            number += 1
    base = prose(99, 90)
    rows += [(number + i, edited(base, 1000 + i, 2)) for i in range(25)]  # many near copies of one text
    rows += [(500 + i, prose(7, 60)) for i in range(5)] + [(600, "!!!"), (601, "!!!"), (602, "???"), (603, ""), (604, None),
                                                           (605, None), (606, "two words"), (607, "Two, words"), (None, prose(7, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect())
    want = dict(brute_classes([r for r in rows if r[1] is not None and r[1] != ""]))
    got = [g for g in got if g[0] not in (603, 604, 605)]
    assert [g for g in got if g[1] != want[g[0]]] == []


def test_one_row_of_each_group_stays(spark, odd_documents):
    kept = neardup.first_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert found.count((1, "one two three")) == 1 and (7, "the same id again") in found
    assert len({t for _, t in found}) == len(found)
    assert neardup.near_duplicates(odd_documents.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [
        (200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(50)]
    leader = {}

    def find(x):
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        leader[b] = a
    got = {r.node: r.root for r in graph.components(
        spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(leader))


@pytest.mark.parametrize("piece", [0, 10_000])
def test_components_of_one_piece_take_no_rounds(spark, piece):
    rng = random.Random(5)
    name = lambda x: f"{x * 7919 % 1000:03d}".encode()
    pairs = [(x, x + 1) for x in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    leader = {x: x for pair in pairs for x in pair}
    for _ in leader:
        for a, b in pairs:
            leader[a] = leader[b] = min(leader[a], leader[b], key=name)
    scratch = Scratch(spark, "components")
    edges = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in pairs], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in graph.components(edges, scratch, **({} if piece else {"piece": 0})).collect()}
    assert got == {name(x): name(root) for x, root in leader.items() if x != root}
    assert scratch.n == 2 if piece else scratch.n > 2
    assert not graph.components(edges.limit(0), Scratch(spark, "components")).collect()


def test_passages_that_were_planted(spark, prose):
    passage, twisted = prose(1, 70), prose(2, 80)
    words = twisted.split(" ")
    words[20], words[55] = "changed", "changed"
    del words[40]
    rows = [(1, prose(10, 50) + " " + passage + " " + prose(11, 40)), (2, passage), (3, prose(12, 30) + "\n" + passage.upper()),
            (4, prose(13, 60) + " " + twisted), (5, " ".join(words) + " " + prose(14, 90)), (6, prose(15, 300)),
            (7, prose(16, 40) + " " + " ".join(passage.split(" ")[:30])), (8, None), (9, ""), (None, prose(17, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.other_id): r for r in substring.repeated_passages(docs).collect()}
    assert set(found) == {(2, 1), (3, 1), (5, 4)}
    text = dict(rows)
    assert text[2][found[2, 1].start:found[2, 1].end] == passage.rstrip(".")
    assert text[3][found[3, 1].start:found[3, 1].end].lower() == passage.rstrip(".")
    assert found[5, 4].n_words >= 75 and found[5, 4].identity > 0.9
    cleaned = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert cleaned[1] == text[1] and cleaned[6] == text[6] and cleaned[8] is None and cleaned[2].strip(". ") == ""
    assert passage[:40].upper() not in cleaned[3] and prose(12, 30) in cleaned[3]


@pytest.mark.parametrize("size, gap", [(60, 100), (100, 250), (200, 500), (60, 30)])
def test_two_passages_with_other_words_between(spark, prose, size, gap):
    one, two = prose(30, size), prose(31, size)
    rows = [(i, f"{prose(40 + i, 30)} {one} {prose(50 + i, gap)} {two} {prose(60 + i, 30)}") for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.repeated_passages(docs).collect()
    assert all((r.doc_id, r.other_id) == (2, 1) and r.n_words >= size and r.identity >= 0.8 for r in found)
    cleaned = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert cleaned[1] == rows[0][1] and one not in cleaned[2] and two not in cleaned[2]
    assert gap < 100 or len(found) == 2 and prose(52, gap)[50:-50] in cleaned[2]


@pytest.mark.parametrize("lines", [2, 3])
def test_passages_made_of_lines_that_others_have(spark, prose, lines):
    line = [" ".join(prose(70 + i, 60 // lines).replace(".", "").split()) for i in range(lines)]
    whole = " ".join(line)
    rows = [(i + 1, f"{prose(80 + i, 40)} {x} {prose(90 + i, 40)}") for i, x in enumerate(line)]
    rows += [(i, f"{prose(100 + i, 40)} {whole} {prose(200 + i, 40)}") for i in (50, 90, 91)]
    # The borders of the lines are elsewhere too, so that no seed leads from one of the passages to another.
    cut = whole.split(" ")
    rows += [(10 + i, f"{prose(300 + i, 40)} {' '.join(cut[i:i + 36])} {prose(400 + i, 40)}") for i in (6, 12, 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [r for r in substring.repeated_passages(docs).collect()]
    assert {(r.doc_id, r.other_id) for r in found} == {(90, 50), (91, 50)}
    text = dict(rows)
    assert all(whole in text[r.doc_id][r.start:r.end] and r.n_words >= 60 for r in found)


def test_stretches_against_all_pairs():
    rng = random.Random(6)
    for _ in range(300):
        score = [rng.choice([1, 1, -4, -9]) for _ in range(rng.randint(1, 25))]
        good = [(i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1) if sum(score[i:j]) >= 0]
        want = [x for x in good if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in good)]
        assert substring._stretches(np.array(score, float)) == want


def test_passages_of_odd_rows(spark, odd_documents):
    assert substring.without_repeats(odd_documents).count() == odd_documents.count()
    assert substring.repeated_passages(odd_documents.limit(0)).count() == 0


def test_chaining_against_all_predecessors():
    rng = random.Random(2)
    for _ in range(100):
        segments = sorted((rng.randrange(60), rng.randrange(60), rng.randint(6, 12)) for _ in range(rng.randint(1, 12)))
        found = substring.chain(segments)
        assert sorted(i for c in found for i in c) == list(range(len(segments)))
        best = [float(s[2]) for s in segments]
        for i, (q, r, size) in enumerate(segments):
            for j, (q2, r2, size2) in enumerate(segments):
                end, other_end = q2 + size2 - 5, r2 + size2 - 5
                if end <= q and other_end <= r:
                    best[i] = max(best[i], size + best[j] - substring._GAP_COST * (q - end + r - other_end))
        score = 0.0
        for n, i in enumerate(found[0]):
            q, r, size = segments[i]
            if n:
                q2, r2, size2 = segments[found[0][n - 1]]
                score -= substring._GAP_COST * (q - q2 - size2 + 5 + r - r2 - size2 + 5)
            score += size
        assert score == pytest.approx(max(best))


def test_winnowing_picks_from_every_window():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 12, 40, 0, 3]
    grams = rng.integers(1, 1 << 60, sum(sizes)).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    picked = set(substring.winnow(grams, first, 12).tolist())
    for s, e in zip(first, first[1:]):
        for at in range(s, max(e - 11, s + 1)):
            window = range(at, min(at + 12, e))
            assert not len(window) or min(window, key=lambda i: grams[i]) in picked


@pytest.fixture(scope="module")
def benchmark(spark, prose):
    items = [(i, prose(1000 + i, 20 + i)) for i in range(30)] + [(100, None), (101, ""), (102, "...")]
    items.append((103, prose(2000, 300)))
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("at_once", [10_000, 10])
def test_leaks_that_were_planted(spark, prose, benchmark, at_once):
    items = {r.item_id: r.text for r in benchmark.collect()}
    rows = [(i, prose(i, 200)) for i in range(60)]
    rows += [(100 + i, prose(300 + i, 70) + " " + items[i] + " " + prose(400 + i, 90)) for i in range(0, 30, 3)]
    rows += [(200 + i, prose(500 + i, 70) + " " + edited(items[i], i, (20 + i) // 10).upper()) for i in range(10, 30, 4)]
    rows += [(300, prose(600, 100) + " " + items[103] + " " + prose(601, 50)), (301, None), (302, ""), (None, items[5]),
             (303, items[20][:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark, items_at_once=at_once).collect()}
    want = {(100 + i, i) for i in range(0, 30, 3)} | {(200 + i, i) for i in range(10, 30, 4)} | {(300, 103), (None, 5)}
    assert found == want
    if at_once > 10:
        kept = {r.doc_id for r in decontam.without_leaks(docs, benchmark).collect()}
        assert kept == {r[0] for r in rows} - {d for d, _ in want}


def test_leaks_of_frequent_words(spark, prose):
    hidden = prose(5000, 25)  # a third of all rows hold it, so its words are frequent
    items = [(i, prose(1000 + i, 20 + i)) for i in range(20)] + [(200, hidden), (201, "ke ba lo mi nu"), (202, "Zu ke?")]
    rows = [(i, prose(i, 120)) for i in range(60)]
    rows += [(100 + i, f"{prose(600 + i, 20)} {hidden} {prose(700 + i, 20)}") for i in range(40)]
    rows += [(150 + i, f"{prose(800 + i, 20)} {edited(hidden, i, 2)} {prose(900 + i, 20)}") for i in range(5)]
    rows += [(160, f"{prose(1, 60)} ke ba lo mi nu {prose(2, 60)}")]
    words = {i: " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " " for i, t in rows}
    plain = {i: " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " " for i, t in items}
    want = {(d, i) for d, t in words.items() for i, x in plain.items() if x in t}
    assert {(100 + i, 200) for i in range(40)} | {(160, 201)} <= want and any(i == 202 for _, i in want)
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want | {(150 + i, 200) for i in range(5)} <= found
    assert {i for d, i in found if i < 200} == {i for d, i in want if i < 200}


def test_leaks_of_empty_tables(spark, benchmark, odd_documents):
    assert decontam.leaks(odd_documents.limit(0), benchmark).count() == 0
    assert decontam.leaks(odd_documents, benchmark.limit(0)).count() == 0
    assert decontam.leaks(odd_documents, benchmark).count() == 0


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(a, b) == table[-1][-1]
