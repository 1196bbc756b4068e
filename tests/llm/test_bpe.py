"""Merge replay against the tiktoken library."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe

TEXTS = ["", " ", "  a  b ", "Hello world, it's 3.14!", "a\n\n b\t c", "aaaaaaaaaaaaaaaa aaa", "naïve café ÅÄÖ 東京タワー 😀😀", "x y   z", "\x1c \x1d a", "the " * 50, "end \n", None]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


def ids(b):
    return bpe.np.frombuffer(b, "<u4").tolist()


def test_same_ids_as_the_library(library):
    texts = [t or "" for t in TEXTS]
    got = bpe.codec().encode(texts)
    assert [ids(g) for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [bpe.codec().decode(g).decode() for g in got] == texts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB thein 09.,'\n\t éß 東"), max_size=80))
def test_any_text(library, text):
    got = bpe.codec().encode([text])[0]
    assert ids(got) == library.encode_ordinary(text)
    assert bpe.codec().decode(got) == text.encode()


def test_query_shape(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, _q_other int")
    rows = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0


def test_encode_and_decode_columns(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(docs)).collect()
    assert [bytes(r["_q_bytes"]).decode() for r in out] == [r["text"] or "" for r in out]
