"""Exact round trips, and the ids of the library."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import token_files as tf
from tests.llm.test_bpe import TEXTS


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_values_come_back(values):
    control, data = tf.pack_values(np.array(values, np.uint32))
    assert tf.unpack_values(np.frombuffer(control, "u1"), np.frombuffer(data, "u1"), len(values)).tolist() == values


def test_query_against_the_library(spark):
    texts = [*TEXTS, "a <|endoftext|> b", "tail  "] * 3
    rows = [(i * 7 - 20, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(None, "no id", 0), (rows[3][0], rows[3][1], 1)], "doc_id long, text string, tokens int")
    library = Tokenizer.from_file(tf.VOCABULARY)
    library.encode_special_tokens = True
    want, start = [], 0
    for d, t, _ in sorted([(None, "no id", 0), (rows[3][0], rows[3][1], 1), *rows], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tf.read(tf.write(docs, block_bytes=40)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert tf.read(tf.write(docs.limit(0))).count() == 0
