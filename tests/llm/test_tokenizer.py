from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelgrid.llm.tokenizer import TOKENIZER_DIR, encode_corpus, load

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def ours(xs):
    ids, begin = load(PATH).encode(xs)
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]


def test_same_ids(theirs):
    r = random.Random(2)
    xs = ["", " ", "\n\t  x ", "aaaaaaa", "abababab" * 50, "I'll've", "<|endoftext|> done", "Trực tiếp từ bến phà Đoạt Nuầm - số 10", "\U0001f468‍\U0001f469 é é", "".join(r.choice("abcdef") for _ in range(6000)), "a" * 9000]
    assert ours(xs) == theirs(xs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=40), max_size=6))
def test_same_ids_of_any_text(theirs, xs):
    assert ours(xs) == theirs(xs)


def test_operator(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (4, "ab " * 100_000, "x")], "k bigint, t string, ids string")
    got = {r.k: r.ids for r in encode_corpus(df, ["k"], "t").collect()}
    assert got[1] == [] and got[2] == [] and got[3] == [31373, 995] and len(got[4]) > 100_000
    assert encode_corpus(df, ["k"], "t").count() == 5
    assert encode_corpus(df.limit(0), ["k"], "t").collect() == []
