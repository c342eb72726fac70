"""Encoding against whole-text encoding and an exact round trip; the corner cases its docstring defines."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mergestone.llm.encoding import encode_documents, token_counts
from mergestone.llm.tokens import VOCABULARY, decode, encode_batch, encoding, safe_boundaries

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


def whole(text):
    return encoding().encode_ordinary(text) if text else []


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


LONG = [
    "word " * 900, "a" * 3000, " " * 2500 + "x", "\n\n\n \t" * 700 + "y", "don't we'll " * 300, "日本語のテキスト、" * 300, "x1y2 " * 700 + "   z",
    "Привет, мир! " * 200 + "b" * 900, "<|endoftext|> " * 200, "é" * 1500 + " end", "👩‍🌾🤷🏽 " * 300,
]


def test_equals_whole_text_encoding(spark):
    rows = list(enumerate(["", None, "a", " ", "<|endoftext|>", "\x00b", *LONG]))
    got = {r.doc_id: r.ids for r in encode_documents(frame(spark, rows), chunk=200, overlap=40).collect()}
    assert got == {i: whole(t) for i, t in rows}


@pytest.mark.parametrize("chunk,overlap", [(50, 7), (64, 64), (97, 3), (1000, 10)])
def test_any_chunk_size(spark, chunk, overlap):
    rng = random.Random(chunk)
    words = ["the ", "  ", "\n", "x", "don't", "'re", "1234", "é", "語", "!?", "\t \n", "veryverylongword" * 3]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(400)))) for i in range(40)]
    got = {r.doc_id: r.ids for r in encode_documents(frame(spark, rows), chunk=chunk, overlap=overlap).collect()}
    assert got == {i: whole(t) for i, t in rows}


def test_repeated_and_null_ids_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", 9, "q"), (1, "c", 8, "q"), (None, "d" * 500, 7, "q"), (None, "e " * 200, 7, None)], "doc_id long, text string, ids int, piece string")
    got = sorted((r.doc_id or 0, r.ids) for r in encode_documents(df, chunk=64, overlap=16).collect())
    twice = frame(spark, [(1, "long " * 90), (1, "long " * 90), (1, "long " * 91)])
    assert sorted(r.ids for r in encode_documents(twice, chunk=64, overlap=16).collect()) == sorted([whole("long " * 90)] * 2 + [whole("long " * 91)])
    assert got == sorted([(1, whole("a b")), (1, whole("c")), (0, whole("d" * 500)), (0, whole("e " * 200))])


def test_only_a_gap_without_a_boundary_is_joined(spark):
    from mergestone.llm.encoding import stitched_parts

    text = "some words " * 60 + "x" * 700 + " more words" * 60
    parts = sorted(stitched_parts(frame(spark, [(7, text)]), chunk=100, overlap=30).collect(), key=lambda r: r.piece)
    assert "".join(r.part for r in parts) == text and len(parts) == 21
    assert 5 <= sum(r.joins for r in parts) <= 8
    assert [r.ids for r in encode_documents(frame(spark, [(7, text)]), chunk=100, overlap=30).collect()] == [whole(text)]


def test_contractions_at_a_cut(spark):
    rows = [(i, ("'" * i + "real ''re'all ''''llama 's 'tis ") * 40) for i in range(8)] + [(100, "'''real" * 200), (101, "a\x1cb\x85c 1½2Ⅷx " * 60)]
    for chunk in (37, 50, 53):
        got = {r.doc_id: r.ids for r in encode_documents(frame(spark, rows), chunk=chunk, overlap=20).collect()}
        assert got == {i: whole(t) for i, t in rows}


def test_empty_table(spark):
    assert encode_documents(frame(spark, [])).collect() == []


def test_counts(spark):
    rows = list(enumerate(LONG))
    assert {r.doc_id: r.n_tokens for r in token_counts(frame(spark, rows), chunk=100, overlap=20).collect()} == {i: len(whole(t)) for i, t in rows}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1'\n\té語!s.re"), max_size=200), st.integers(0, 200))
def test_safe_boundaries_split_without_change(text, k):
    places = safe_boundaries(text, 0, 1, len(text))
    if places:
        p = places[k % len(places)]
        assert whole(text[:p]) + whole(text[p:]) == whole(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    offsets, values = encode_batch([text, None])
    assert decode(list(values)) == text
    assert list(offsets) == [0, len(values), len(values)]


def test_the_two_libraries_agree():
    tokenizers = pytest.importorskip("tokenizers")
    path = VOCABULARY.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no json vocabulary")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text in LONG:
        assert t.encode(text, add_special_tokens=False).ids == whole(text)
