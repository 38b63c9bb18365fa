import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import viterbi_count

PATH = "/opt/tokenizers/piece_bpe_32k.model"
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, score string, n_tokens string, row string"


def library(pieces):
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement=viterbi_count.MARK, prepend_scheme="always", split=False)
    return t


@pytest.fixture(scope="module")
def pair():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return viterbi_count.model(PATH), library([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())])


TEXTS = ["", " ", "   ", "hello world", "  two  spaces ", "a\nb\n\nc", "día 日本語 \U0001f600\U0001f600 ok", "▁x▁", "<s> <0x41> <unk>", "\t\r\x00", "the " * 3000, "x" * 20000, "\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_count_as_the_library(pair, text):
    ours, theirs = pair
    assert int(ours.texts([text])[0].imag) == len(theirs.encode(text).ids)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=50) | st.text("aeinst é\n\U0001f600", max_size=50))
def test_any_text(pair, text):
    ours, theirs = pair
    assert int(ours.texts([text])[0].imag) == len(theirs.encode(text).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 0), min_size=14, max_size=14), st.text("abc \nz", max_size=14))
def test_ties(scores, text):
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "a", "b", "ab", "ba", "abc", "▁", "▁a", "bc", "c", "aa", "▁▁", "aab", "cc"]
    pieces = [(n, float(scores[(i - 257) % 14] if i > 256 else -5)) for i, n in enumerate(names)]
    assert int(viterbi_count.CountingViterbi(pieces).texts([text])[0].imag) == len(library(pieces).encode(text).ids)


def test_rows(spark):
    rows = [(1, "a b", "x", "y", "z"), (1, "a b", "x", "y", "z"), (None, None, None, None, None), (2, "", "", "", "")]
    got = sorted((r.doc_id or 0, r.n_tokens, r.score) for r in viterbi_count.query(spark.createDataFrame(rows, SCHEMA), PATH).collect())
    assert [g[:2] for g in got] == [(0, 0), (1, 2), (1, 2), (2, 0)] and got[0][2] == 0 and got[1][2] < 0
    assert viterbi_count.query(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    with pytest.raises(ValueError):
        viterbi_count.CountingViterbi([("a", 0.0)])


def test_long_words_are_not_kept():
    counting = viterbi_count.model(PATH)
    counting.words.clear()
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(50)]
    found = counting.texts(texts)
    assert max(map(len, counting.words), default=0) <= viterbi_count.CACHE_CHARS and counting.texts(texts) == found
