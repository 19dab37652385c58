from __future__ import annotations

import re

import numpy as np
import pytest

from reelgrid.llm.turns import HESITATIONS, TurnMaker, labelled_boundaries, labelled_tokens, models, speaker_of, speaker_turns


def turns(*texts):
    segments = [t if isinstance(t, dict) else {"start": float(i), "duration": 1.0, "text": t} for i, t in enumerate(texts)]
    return [(s, len(w)) for s, _, _, w in TurnMaker(*models()).turns(segments)]


@pytest.mark.parametrize("name, want", [("M.C.", "MC"), ("Nguoi dan", "MC"), ("NGƯỜI DẪN CHƯƠNG TRÌNH", "MC"), ("P.V.", "PV"), ("phóng  viên", "PV"), ("Khach moi", "KHACH"), ("Khách", "KHACH"), ("SPEAKER_07", "S7"), ("spk7", "S7"), ("người nói 07", "S7"), ("S 12", "S12"), ("sông 7", None)])
def test_speaker_names(name, want):
    assert speaker_of(name) == want


def test_labels_times_sounds_and_hesitation():
    assert turns("không có nhãn", "[00:01.5] >> MC : xin à... chào [Vỗ tay] các bạn ♪ nhạc ♪", "(0:02) tiếp tục <music> nhé *cười* 00:00:03", "(PV): có khoảng (ba lượt xe) 10 lượt khách ghé. >> [Speaker 3] hừm, vâng 00:00:04,100 --> 00:00:05,000 ạ") == [("UNK", 3), ("MC", 7), ("PV", 9), ("S3", 2)]


def test_words_that_name_a_speaker_in_a_sentence():
    assert turns("MC: có khoảng 30 lượt khách ghé chợ", "người dẫn đứng trước bản đồ, phía xa khách mời", "S2 - cảnh 4: một con mèo") == [("MC", 17), ("S2", 5)]


def test_order_repeats_nulls_and_empty_turns():
    a = {"start": 5.0, "duration": 1.0, "text": "PV: sau cùng"}
    assert turns(a, {"start": 1.0, "duration": None, "text": "MC: trước hết"}, a, None, {"start": 2.0, "duration": 1.0, "text": None}, {"start": 2.5, "duration": 1.0, "text": " "}, {"start": 3.0, "duration": 1.0, "text": "S1: ừmmm..."}, {"start": 4.0, "duration": 1.0, "text": "mc: lại là tôi"}, {"start": None, "duration": None, "text": "cuối"}) == [("MC", 5), ("PV", 3)]


def at(start, text, duration=1.0):
    return {"start": start, "duration": duration, "text": text}


def test_gap_and_context_make_a_bare_name_a_label():
    """The same words begin a turn after a gap and a finished sentence, and go on without."""
    name = "PV Chúng tôi bắt đầu nhé"
    assert turns(at(0, "S1: xong cả rồi."), at(4, name)) == [("S1", 3), ("PV", 5)]
    assert turns(at(0, "S1: xong cả rồi."), at(1.1, name)) == [("S1", 9)]
    assert turns(at(0, "S1: xong cả rồi, theo"), at(4, name)) == [("S1", 10)]
    assert turns(at(0, "S1: xong."), at(9, "PV mang máy quay tới")) == [("S1", 6)]
    # A small word with a dash is a label where a sentence begins, and an aside inside one.
    assert turns(at(0, "S1: họ tới nơi. khách - xin cảm ơn")) == [("S1", 3), ("KHACH", 3)]
    assert turns(at(0, "S1: đó là khách - xin cảm ơn")) == [("S1", 6)]


def test_boundaries_are_not_the_separator_alone():
    boundary, _ = models()
    x, y = labelled_boundaries(1500, seed=61)
    said = boundary.probability(x) >= 0.5
    rule = x[:, 1:5].any(axis=1)  # a separator or brackets
    assert (said == y).mean() >= 0.97 and (said != rule).mean() >= 0.02
    no_gap = x.copy()
    no_gap[:, 11] = 0
    assert ((boundary.probability(no_gap) >= 0.5) != said).mean() >= 0.01


def test_hesitations_that_nobody_listed():
    maker = TurnMaker(*models())
    unheard = ["hửm", "hửm...", "ừhm", "mmm", "Mmmm,", "ưmmm", "ờmmm...", "uhhhm", "hmmmmm"]
    assert not set(re.sub(r"(.)\1+", r"\1", re.sub(r"\W", "", t.lower())) for t in ("hửm", "ừhm")) & set(HESITATIONS)
    assert maker.spoken([["tôi", t, "nghĩ"] for t in unheard]) == [["tôi", "nghĩ"]] * len(unheard)
    words = "mẹ mở hẻm ôm em him ham hum mưa hờn ướm ẩm home hơi ười mùi ôi mây hoa âm".split()
    assert maker.spoken([["tôi", w, "nghĩ"] for w in words]) == [["tôi", w, "nghĩ"] for w in words]
    assert maker.spoken([["mưa", "12", "mm"], ["thì", "mmm", "thôi"]]) == [["mưa", "12", "mm"], ["thì", "thôi"]]


def test_long_sound_notes():
    long = "la " * 60
    assert turns(f"MC: xin ♪ {long}♪ chào *{long}cười* nhé") == [("MC", 3)]


def test_held_out_accuracy():
    boundary, hesitation = models()
    x, y = labelled_boundaries(600, seed=50)
    assert ((boundary.probability(x) >= 0.5) == y).mean() >= 0.97
    x, y = labelled_tokens(seed=51)
    assert ((hesitation.probability(x) >= 0.5) == y).mean() >= 0.97


def test_operator(spark):
    seg = "array<struct<start:double,duration:double,text:string>>"
    df = spark.createDataFrame([(1, [(0.0, 1.0, "MC: a b")], "x"), (1, [(0.0, 1.0, "MC: a b")], "x"), (2, None, "x"), (3, [], "x"), (4, [(0.0, 1.0, "từ " * 20_000)], "x")], f"k bigint, s {seg}, key string")
    got = speaker_turns(df, "k", "s").distinct().orderBy("k").collect()
    assert [(r.k, r.turn_no, r.speaker, r.n_words) for r in got] == [(1, 1, "MC", 2), (4, 1, "UNK", 20_000)]
    assert speaker_turns(df.limit(0), "k", "s").collect() == []


def test_boosting_learns_an_interaction():
    from reelgrid.llm.boost import Boosted

    x = np.random.default_rng(1).random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Boosted(trees=60).fit(x[:400], y[:400]).probability(x[400:]) >= 0.5) == y[400:]).mean() > 0.9
