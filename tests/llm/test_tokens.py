import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from reprise.llm import tokens as T

PATH = f"{T.FOLDER}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.tokenizer(PATH).ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    enc = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.tokenizer(PATH).ranks, special_tokens={})
    text = text.encode("utf-8", "replace").decode()
    assert T.tokenizer(PATH).encode_batch([text]) == [enc.encode_ordinary(text)]


def test_long_words_are_exact(reference):
    for text in ("a" * 20_000, "ab" * 5000 + "é" * 3000, "日本" * 2000, " " * 9000, "<|endoftext|>", "don't we'll I'M"):
        assert T.tokenizer(PATH).encode_batch([text])[0] == reference.encode_ordinary(text)


def test_exact_merging_alone(reference):
    for word in (" unbelievably", "xqzvw", "ingingingtion", " Hykobozim"):
        assert T.tokenizer(PATH).merge(word.encode()) == reference.encode_ordinary(word)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "hi there", 7), (3, "hi there", 7)], "doc_id bigint, text string, ids int")
    got = T.token_ids(df, "doc_id", "text", PATH).collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in got) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert T.token_ids(df.limit(0), "doc_id", "text", PATH).collect() == []


def test_corpus(spark, small, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in T.ids(spark, small).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in texts.items()}
    assert sum(r["n_tokens"] for r in T.sizes(spark, small).collect()) == sum(map(len, got.values()))
