"""Encoding, counting and packing against the libraries themselves."""

import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from starfold.llm import bpe, counts, packing, pretokens  # noqa: E402


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def definition(ranks):
    return bpe.model_json(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(0)
    parts = ["a", "b", "'s", "'ll", "'", " ", "  ", "\n", "\t", "1", "²", "!", "?!", "é", "漢", "😀", "İ", "ing", "the", " The"]
    return ["", " ", "a  ", "\n's", "''s", "x" * 3000, "ab" * 999, " " * 500] + [
        "".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(600)]


def test_ids_are_those_of_tiktoken(definition, library):
    encoder = bpe.Encoder(definition, pretokens.character_classes(pretokens.tiktoken_joins(P.PATTERN)))
    ids, ends = encoder.ids(texts())
    starts = [0, *ends[:-1]]
    assert [ids[a:b].tolist() for a, b in zip(starts, ends)] == [library.encode_ordinary(t) for t in texts()]


def thue_morse(letters, n):
    """A word and its mirror image: any sum of powers modulo 2 ** 64 is the same for both."""
    word, swap = letters[0], str.maketrans(letters, letters[::-1])
    while len(word) < n:
        word += word.translate(swap)
    return [word, word.translate(swap)]


@pytest.mark.parametrize("letters", ["in", "th", "er"])
def test_texts_of_one_hash_are_told_apart(definition, library, letters):
    from tokenizers import Tokenizer

    pair = thue_morse(letters, 2048)
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        other = file.read()
    counter, tokenizer = counts.Counter(other, pretokens.character_classes(pretokens.tokenizers_joins(other))), Tokenizer.from_str(other)
    encoder = bpe.Encoder(definition, pretokens.character_classes(pretokens.tiktoken_joins(P.PATTERN)))
    for given in (pair, pair[::-1], [f"a {pair[0]} b {pair[1]}", pair[1]]):  # in one chunk, and against what is known
        ids, ends = encoder.ids(given)
        assert [i.tolist() for i in np.split(ids, ends[:-1])] == [library.encode_ordinary(t) for t in given]
        assert counter(given).tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in given]


def test_memo_that_overflows_changes_nothing(definition, library):
    encoder = bpe.Encoder(definition, pretokens.character_classes())
    encoder.memo.limit = 5
    for text in texts()[:50]:
        assert encoder.ids([text])[0].tolist() == library.encode_ordinary(text)


def test_round_trip_of_odd_rows(spark, odd_documents, definition, library):
    rows = bpe.round_trip(odd_documents, definition, P.PATTERN).collect()
    given = odd_documents.collect()
    key = lambda i, raw: (-1 if i is None else i, raw)
    assert sorted(key(r.doc_id, bytes(r.decoded)) for r in rows) == sorted(key(r.doc_id, (r.text or "").encode()) for r in given)
    encoded = bpe.encode(odd_documents, definition, P.PATTERN)
    again = bpe.decode(encoded, definition).collect()
    digest = lambda rows: sorted(hashlib.sha1(bytes(r.decoded)).hexdigest() for r in rows)
    assert digest(again) == digest(rows)
    assert bpe.round_trip(odd_documents.limit(0), definition, P.PATTERN).count() == 0


def test_offsets_cover_the_characters(spark, definition):
    text = "Ünïcode 漢字 and 😀 don't"
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), definition, P.PATTERN, offsets=True).first()
    tokens = bpe.token_bytes(definition)
    at = 0
    for number, start, end in zip(row.ids, row.starts, row.ends):
        size = len(tokens[number])
        assert text[start:end].encode().find(text.encode()[at:at + size]) >= 0
        at += size
    assert row.starts[0] == 0 and row.ends[-1] == len(text)


def test_null_ids_decode_to_null(spark, definition):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, definition).collect()} == {1: None, 2: bytearray(b"")}


def test_counts_are_those_of_the_library(spark, odd_documents):
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        json = file.read()
    library = Tokenizer.from_str(json)
    more = texts()[:200] + ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", " <|endoftext"]
    docs = odd_documents.select("doc_id", "text").unionByName(
        spark.createDataFrame(list(enumerate(more, 100)), "doc_id long, text string"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in counts.count_tokens(docs, json).collect())
    want = []
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert got == sorted(want)


def test_merging_takes_overlapping_pairs_from_the_left():
    merges = counts.Merges.__new__(counts.Merges)
    merges.size, merges.keys, merges.ranks, merges.merged = 10, np.array([11]), np.array([0]), np.array([2])
    assert counts.merge_all(np.array([1, 1, 1, 1, 1, 3, 1]), np.array([0, 0, 0, 0, 0, 1, 1]), merges, 3).tolist() == [3, 2, 0]


def test_best_fit_against_a_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([5, 8, 16, 31])
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 50))]
        rows = packing.best_fit_decreasing(sizes, length)
        room = []
        for size in sorted(sizes, reverse=True):
            fitting = [r for r in range(len(room)) if room[r] >= size]
            if fitting:
                room[min(fitting, key=lambda r: room[r])] -= size
            else:
                room.append(length - size)
        assert sorted(p for row in rows for p in row) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[p] for p in row) for row in rows) == sorted(room)


def test_packed_rows_hold_every_id(spark, odd_documents, definition, library, tmp_path):
    path = str(tmp_path / "rows")
    packing.write(packing.pack(odd_documents, definition, P.PATTERN, length=256, pool_tokens=3000), path)
    rows = packing.read(spark, path)
    for r in rows.collect():
        assert len(r.tokens) == 256 * r.width and r.cu_seqlens[-1] == r.n_tokens <= 256
        assert r.resets == r.cu_seqlens[:-1] and all(a < b for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))
    found = {}
    for s in packing.segments(rows).collect():
        found.setdefault(s.doc_id, []).append((s.part, s.pool, s.doc_start, np.frombuffer(bytes(s.ids), "<u2").tolist()))
    total = sum(len(x[3]) for parts in found.values() for x in parts)
    assert total == sum(len(library.encode_ordinary(r.text or "")) for r in odd_documents.collect())
    for i in (6, 8):
        text = next(r.text for r in odd_documents.collect() if r.doc_id == i)
        assert [x for part in sorted(found[i]) for x in part[3]] == library.encode_ordinary(text)
    assert packing.pack(odd_documents.limit(0), definition, P.PATTERN).count() == 0
