import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pair_bpe

PATH = "/opt/tokenizers/byte_bpe_50k.json"
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
REFERENCE = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, ids string, row string, decoded string"


def ids(text):
    return np.frombuffer(pair_bpe.model(PATH).encode_batch([text])[0], "<u4").tolist()


@pytest.mark.parametrize(
    "text",
    ["", " ", "aaaaaaaaaaaaa", "  a  b\n\n c\t", "It's we'll 'S", "<|endoftext|>x<|endoftext|> <|endoftext|", "día — 日本語 \U0001f600", "a  b\x1cc\x85", "½ Ⅷ x² _a_", "the " * 5000, "x" * 30000],
)
def test_same_ids_as_the_library(text):
    assert ids(text) == REFERENCE.encode(text, add_special_tokens=False).ids
    assert pair_bpe.model(PATH).decode(pair_bpe.model(PATH).encode_batch([text])[0]) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("aeé '\n_1s", max_size=60))
def test_any_text(text):
    assert ids(text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, "a b", "x", "y", "z"), (1, "a b", "x", "y", "z"), (None, None, None, None, None), (2, "", "", "", "")]
    out = pair_bpe.encode_rows(spark.createDataFrame(rows, SCHEMA), PATH)
    got = sorted((r.row.doc_id or 0, len(r.ids) // 4, r.decoded) for r in out.collect())
    assert got == [(0, 0, ""), (1, 2, "a b"), (1, 2, "a b"), (2, 0, "")]
    assert pair_bpe.query(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_long_pretokens_are_not_kept():
    bpe = pair_bpe.model(PATH)
    bpe.forget()
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(50)]
    packed = bpe.encode_batch(texts)
    assert max(map(len, bpe.words), default=0) <= pair_bpe.CACHE_CHARS
    assert bpe.encode_batch(texts) == packed and [bpe.decode(p) for p in packed] == texts
