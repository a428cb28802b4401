import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.encode import TOKENIZERS, chunks, decode, encode, encoding, ids_of, rank_file, token_counts

PATH = rank_file("byte_bpe_50k")


def test_matches_the_reference_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", "plain text", "中文 mixed é 🙂​", "<|endoftext|> as text", "a" * 3000, "  spaces\n\n\ttabs ", "it's we'll they've", "１２３ 456", "word " * 30_000, None]
    rows = [(i, x, [0]) for i, x in enumerate(texts)]
    got = {r.doc_id: r.ids for r in encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")).collect()}
    assert got == {i: (t.encode(x, add_special_tokens=False).ids if x else []) for i, x in enumerate(texts)}


def test_round_trip_and_counts(spark):
    texts = ["", "naïve café", "数据 data", "\r\n mixed ends", "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    e = encode(df)
    assert {r.doc_id: r.text for r in decode(e).collect()} == dict(enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {r.doc_id: len(r.ids) for r in e.collect()}
    bad = spark.createDataFrame([(1, None), (2, [10**9])], "doc_id bigint, ids array<int>")
    assert [r.text for r in decode(bad).collect()] == [None, None]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" '\tsdtlreABé12.,!?\n中文—́ ", max_size=80), st.integers(1, 20))
def test_cuts_are_safe(text, size):
    enc = encoding(PATH)
    cut = list(chunks(text, size))
    assert "".join(cut) == text and [i for c in cut for i in enc.encode_ordinary(c)] == enc.encode_ordinary(text)


def test_surrogates_do_not_crash():
    assert ids_of("\ud800 x", PATH) == ids_of("? x", PATH) or ids_of("\ud800 x", PATH)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_words_without_boundary():
    text = "".join(random.Random(1).choice("abcdef") for _ in range(70_000))
    assert list(chunks(text)) == [text]
