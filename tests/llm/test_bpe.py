"""Token counts and BPE round trips against the tokenizers library on whole texts."""

import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lotwise.llm.bpe_codec import Memo, cuts, encode, encode_documents
from lotwise.llm.bpe_engine import engine
from lotwise.llm.token_counts import chunked_count, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
PIECES = st.lists(st.sampled_from(["the ", "!\x1c", "Hello", " world", "  ", "\n\n", "\t", "<|endoftext|>", "<|endo", "ß", "日本語", "1234", "'ll", " 'S", "...", " ", " x", "\x1c", "\x85", "é", "🙂", "a" * 40]), max_size=60).map("".join)
HARD = ["", " ", "a", "\n" * 3000, "x" * 5000, "ab " * 4000, "<|endoftext|>" * 300, "word " * 50 + "z" * 3000 + " word" * 50, "é" * 2000 + " " * 2000 + "日本" * 500, "1 2  3   4    5" * 200]


def truth(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(PIECES | st.text(max_size=200))
def test_engine_chunks_and_memo_agree_with_the_library(text):
    want = truth(text)
    model = engine(PATH)
    assert model.encode(text) == want
    assert chunked_count(model, text, 24, 4) == len(want)
    assert encode(Memo(model, 200), text, 16, 40).tolist() == want
    assert model.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    want = truth(text)
    model = engine(PATH)
    assert chunked_count(model, text, 100, 8) == len(want)
    assert encode(Memo(model, 10_000), text, 64, 256).tolist() == want


def test_cuts_are_content_defined():
    rng = np.random.default_rng(1)
    body = "".join(chr(c) for c in rng.integers(97, 123, 6000))
    a, b = cuts(body, 128, 4096), cuts("some other start " + body, 128, 4096)
    assert len({x + 17 for x in a} & set(b)) > 0.8 * len(a) and a[-1] == len(body)


def test_queries_over_odd_rows(spark):
    texts = [None, *HARD, "same text", "same text", "spam <|endoftext|> eggs " * 2000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    got = {r.doc_id: r for r in count_tokens(docs, PATH, chunk=1000, overlap=16).collect()}
    back = {r.doc_id: r for r in encode_documents(docs, PATH).collect()}
    for i, text, _, _ in rows:
        text = text or ""
        want = truth(text)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), len(want), len(want) > 1024)
        assert (back[i].n_tokens, back[i].ids, back[i].decoded) == (len(want), want, text)
        assert back[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert back[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert count_tokens(docs.limit(0), PATH).count() == 0 == encode_documents(docs.limit(0), PATH).count()


JOINTS = ["ab", "日本", "12", "!?", "'", "'s", "'re", "、", "é", "\u0301", "²", "<|endoftext|>", "<|endo", "text|>", " ", "ア", "-"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(JOINTS), max_size=40).map("".join))
def test_every_joint_is_a_boundary_wherever_a_scan_begins(text):
    model = engine(PATH)
    for p in range(1, len(text)):
        if model.is_joint(text, p):
            assert truth(text) == truth(text[:p]) + truth(text[p:])
    assert chunked_count(model, text, 12, 3) == len(truth(text))


def test_long_texts_without_spaces_take_linear_work():
    rng = np.random.default_rng(2)
    model = engine(PATH)
    only = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 400_000))  # one run of letters
    marked = "".join(chr(c) if c % 50 else "。" for c in rng.integers(0x4E00, 0x9FA5, 400_000))
    for text in (only, marked):
        want = len(truth(text[:50_000]))
        assert chunked_count(model, text[:50_000], 16384, 512) == want
        began = time.time()
        chunked_count(model, text, 16384, 512)
        took = time.time() - began
        began = time.time()
        truth(text)
        assert took < 1 + 6 * (time.time() - began)
