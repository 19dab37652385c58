from __future__ import annotations

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelgrid.llm.canonical import LOOK_ALIKES, canonical, canonical_text


def test_same_reading():
    base = "Cảnh báo mưa lớn Đoạt - số 94"
    variants = [
        unicodedata.normalize("NFD", base),
        base.replace(" ", " "),
        base.replace("m", "m​").replace("l", "­l"),
        base.replace("C", "С").replace("o", "о"),
        base.replace("Đ", "Ð"),
        base.replace("-", "‑"),
        "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base),
        base.replace("9", "\U0001d7eb"),
        base.replace("n", "\U0001d5c7"),
        base.replace("a", "а"),
        unicodedata.normalize("NFD", base).replace("́", "́").replace("̣", "͏̣"),
        base.replace("m", "ⅿ"),
    ]
    assert [canonical(v) for v in variants] == [base] * len(variants)


def test_different_reading_stays_different():
    for a, b in [("số", "sổ"), ("So", "so"), ("m²", "m2"), ("½", "1/2"), ("①", "1"), ("a–b", "a-b"), ("a  b", "a b"), ("ba", "bà"), ("1", "l"), ("đ", "d")]:
        assert canonical(a) != canonical(b)


def test_pictures_keep_their_joiners():
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    assert canonical(f"x {family} a‍b") == f"x {family} ab"


def whole(text):
    """The plain way: the whole text at once."""
    from reelgrid.llm.canonical import tables

    m = tables()[1]
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(m)).translate(m))


odd = st.text(st.sampled_from([*"aeou ơưAĐ1-", *LOOK_ALIKES, *map(chr, [0x300, 0x301, 0x302, 0x309, 0x31B, 0x323, 0x341, 0xA0, 0x200B, 0xAD, 0xFF41, 0x217F, 0x1D5C7, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x3000])]), max_size=30)


@settings(max_examples=400, deadline=None)
@given(odd)
def test_splicing_equals_the_whole_and_settles(t):
    c = canonical(t)
    assert c == whole(t)
    assert canonical(c) == c


def test_column(spark):
    df = spark.createDataFrame([(None,), ("",), ("à" * 5000,), ("x",)], "t string")
    assert [r.c for r in df.select(canonical_text(F.col("t")).alias("c")).collect()] == [None, "", "à" * 5000, "x"]
    assert df.limit(0).select(canonical_text(F.col("t"))).collect() == []
