from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from reelgrid.llm import pii, pii_table
from reelgrid.llm.crf import Crf
from tests.conftest import DATA


@pytest.fixture(scope="module")
def finder():
    return pii.finder()


def measured(finder, rows):
    """(precision, recall) over rows of (text, spans)."""
    found = finder.find([t for t, _ in rows])
    right = got = want = 0
    for (_, spans), f in zip(rows, found):
        a, b = Counter((k, s) for s, _, k in spans), Counter((k, s) for k, s, _ in f)
        right, got, want = right + sum((a & b).values()), got + sum(b.values()), want + sum(a.values())
    return right / got, right / want


def test_new_rows_of_the_training_templates(finder):
    precision, recall = measured(finder, [pii_table.joined(p) for p in pii_table.labelled_rows(300, seed=321)])
    assert precision >= 0.97 and recall >= 0.97


def test_templates_that_were_held_out(finder):
    assert {pii_table.held_out(t) for t in pii_table.WITH_DATA} == {True, False}
    precision, recall = measured(finder, [pii_table.joined(p) for p in pii_table.labelled_rows(400, seed=322, measured=True)])
    print(f"held-out templates: precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.8 and recall >= 0.8


# Sentences written by hand, with ordinary names and addresses; what is to be found stands in double brackets with its kind.
WRITTEN = """
Anh [[person|Nguyễn Văn An]] đã chuyển khoản, liên lạc qua [[email|nguyen.van.an@gmail.com]].
Căn cước công dân số [[id_number|001203004567]] do công an cấp.
Cầu thủ [[person|Trần Quốc Bảo]] rời sân vì chấn thương.
[[person|John Miller]] moved to Hanoi in spring.
Chị [[person|Lê Thị Hồng]] gọi số [[phone|0912 345 678]] nhưng không ai bắt máy.
Mời bà [[person|Phạm Minh Châu]] tới phòng khám.
Mọi thắc mắc gửi [[email|hotro@yahoo.com]] hoặc gọi [[phone|0987654321]].
Nhà em ở [[address|25 ngõ 12 đường Láng Hạ, quận Đống Đa]], shop giao giúp.
Bác sĩ [[person|Hoàng Anh Tuấn]] khám buổi sáng.
Theo luật sư [[person|Vũ Đức Minh]], hợp đồng vô hiệu.
Ms [[person|Linda Carter]] will answer at [[email|linda.carter@outlook.com]].
Passport [[id_number|B1234567]] belongs to Mr [[person|David Brown]].
Send the box to [[address|48 Baker Street]], please.
em tên [[person|nguyễn thu trang]] ạ, số em [[phone|0905.123.456]]
Người liên hệ: [[person|Đặng Hoài Nam]], điện thoại [[phone|(024) 3825 1234]].
Thầy [[person|Bùi Xuân Phái]] dạy vẽ đã nhiều năm.
Mail em là [[email|hoa_pham99 [at] gmail [dot] com]] nhé.
Call [[person|Susan Clark]] on [[phone|+1-555-555-0142]] after lunch.
Cụ [[person|Trịnh Thị Mai]] sống một mình ở [[address|7 phố Hàng Bông]].
Ca sĩ [[person|Mỹ Linh Đan]] hát mở màn.
"""
NOTHING = """
Trận đấu ở Hải Phòng hoãn vì mưa.
Công ty cổ phần Sữa Ba Vì tăng vốn.
Đơn hàng VN-20394-7 bị trả lại.
Mã vạch 8936012345678 bị mờ.
Cầu Long Biên cấm xe tải.
The Golden Gate Bridge was painted red.
Theo dõi kênh @nauan_24 để học nấu ăn.
Phim có 1.234.567 lượt xem.
Trường Đại học Bách Khoa tuyển sinh.
Quốc lộ 5 ùn tắc từ sáng.
"""


def test_written_sentences(finder):
    rows = []
    for line in WRITTEN.strip().splitlines():
        text, spans = "", []
        for i, part in enumerate(re.split(r"\[\[(\w+\|.*?)\]\](?!\])", line)):
            if i % 2:
                kind, part = part.split("|", 1)
                spans.append((len(text), len(text) + len(part), kind))
            text += part
        rows.append((text, spans))
    assert sum(len(s) for _, s in rows) == 29
    precision, recall = measured(finder, rows)
    wrong = [(t, f) for (t, s), f in zip(rows, finder.find([t for t, _ in rows])) if {(k, a) for a, _, k in s} != {(k, a) for k, a, _ in f}]
    print(f"written sentences: precision {precision:.3f}, recall {recall:.3f}", *wrong, sep="\n")
    assert recall >= 0.9 and precision >= 0.9
    found = finder.find(NOTHING.strip().splitlines())
    print("places in sentences without any:", sum(map(len, found)), [f for f in found if f])
    assert sum(map(len, found)) <= 1


def test_no_sentence_of_the_table_is_in_the_documents():
    """No three words in a row of the labelled table stand in the test documents."""
    import duckdb

    if not DATA.exists():
        pytest.skip("no test tables here")
    rows = duckdb.connect().execute(f"select text from '{DATA.parent}/sf0.01/documents.parquet' where text is not null").fetchall()
    docs = re.sub(r"[^\w\n]+", " ", " \n ".join(t.lower() for (t,) in rows))
    for t in pii_table.WITH_DATA + pii_table.WITHOUT + pii_table.CLAUSES + pii_table.CLAUSES_EN:
        for part in re.split(r"\{\w+\}|\n", t):
            words = re.sub(r"\W+", " ", part.lower()).split()
            for i in range(len(words) - 2):
                assert f" {' '.join(words[i : i + 3])} " not in docs, t


def test_kinds_and_places(finder):
    text = "Liên hệ Vệch Tảng Dứt qua số (+84) 547 103 775 để nhận lại băng hình. Gửi thư tới nhà 340 ngách 10/39 phố Lệch Quừng, quận Buyên Quừng (người nhận Nẩy Loạt Đổn). Số giấy tờ 098160824199 được đọc nhầm trên sóng sáng nay. gửi mail cho em qua n.tat.1999 [at] bienho [dot] invalid nhé"
    want = {("person", text.index("Vệch")), ("phone", text.index("(+84")), ("address", text.index("340")), ("person", text.index("Nẩy")), ("id_number", text.index("0981")), ("email", text.index("n.tat"))}
    assert {(k, a) for k, a, _ in finder.find([text])[0]} == want


def test_what_is_none(finder):
    texts = ["Mã vạch 8934009289247 không đọc được.", "Video đạt 672.799.242 lượt xem sau 94 ngày.", "Mã đơn DH-1159-15 thuộc lô băng 775.", "Đường Phạp Nhiệc bị ngập, xe đi vòng qua quốc lộ 64.", "Kênh @rieng_86 đăng lại đoạn này lúc 11:56.", "Trung tâm Khí tượng Hỏi Nhổn tài trợ 821 triệu đồng cho chương trình.", "Phường Buyên Quừng vừa khánh thành ga tàu."]
    assert finder.find(texts) == [[] for _ in texts]


def test_unseen_characters_are_counted(finder):
    a = "Liên hệ Vệch Tảng Dứt qua số 0547103775 để nhận lại băng hình."
    b = a.replace("Liên", "Li​ên").replace("Tảng", "Tả​ng")
    (k, s, e), *_ = finder.find([b])[0]
    assert (k, s, b[s:e]) == ("person", 9, "Vệch Tả​ng Dứt")


def test_operators(spark):
    say = "Liên hệ Vệch Tảng Dứt qua số 0547103775 để nhận lại băng hình."
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, say, "x"), (4, say, "x"), (5, "tin vắn. " * 30_000, "x")], "d bigint, t string, key string")
    assert {tuple(r) for r in pii.personal_data(df, "d", "t").select("d", "pii_kind", "start_at").collect()} == {(4, "person", 8), (4, "phone", 29)}
    red = {r.d: r.t for r in pii.redact(df.withColumnRenamed("key", "text"), "d", "t").withColumnRenamed("text", "t").collect()}
    assert red[1] is None and red[2] == "" and red[4] == "Liên hệ <PERSON> qua số <PHONE> để nhận lại băng hình."
    assert pii.personal_data(df.limit(0), "d", "t").collect() == []


def test_how_the_corpus_writes_words(spark):
    rows = [("chợ Bến nổi",)] * 4 + [("Bến và chợ",)] * 3 + [("CHỢ",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").repartition(3)
    assert pii.written_words(df, "t") == {"chợ": 1, "bến": 3} and pii.written_words(df, "t", 1) == {"bến": 3}


def test_a_small_name_is_known_by_how_others_write_it(finder):
    text = "sáng nay chị rẩy khoạt thềm ra chợ"
    written = {w: 1 for w in "sáng nay chị ra chợ".split()} | {w: 3 for w in "rẩy khoạt thềm".split()}
    got = finder.find([text], pii.Vocabulary(finder.lexicon, written))[0]
    assert [(k, text[a:b]) for k, a, b in got] == [("person", "rẩy khoạt thềm")]


def test_decomposed_letters_and_long_texts(finder):
    import unicodedata

    a = "Gặp anh Nguyễn Văn An ở cổng. " + "trời trở lạnh. " * 20_000 + "Máy 0912345678 nhé."
    d = unicodedata.normalize("NFD", a)
    for t in (a, d):
        got = [(k, unicodedata.normalize("NFC", t[s:e])) for k, s, e in finder.find([t])[0]]
        assert got == [("person", "Nguyễn Văn An"), ("phone", "0912345678")]
    assert finder.find([a, "x", ""])[0] == finder.find(["", "y", a])[2]


def test_field_equals_brute_force():
    import itertools

    r = np.random.default_rng(1)
    crf = Crf(3, 8)
    crf.pair, crf.first = r.normal(size=(3, 3)).astype(np.float32), r.normal(size=3).astype(np.float32)
    e = r.normal(size=(9, 3)).astype(np.float32)
    lengths = np.array([4, 0, 5])

    def score(y, x):
        return crf.first[y[0]] + sum(x[i, y[i]] for i in range(len(y))) + sum(crf.pair[a, b] for a, b in zip(y, y[1:]))

    got = crf.decode(e, lengths)
    for a, n in ((0, 4), (4, 5)):
        x = e[a : a + n]
        assert tuple(got[a : a + n]) == max(itertools.product(range(3), repeat=n), key=lambda y: score(y, x))
    single, double = crf._marginals(e[None, :4], np.ones((1, 4), bool))
    p = {y: np.exp(score(y, e[:4])) for y in itertools.product(range(3), repeat=4)}
    z = sum(p.values())
    assert single[0, 2, 1] == pytest.approx(sum(v for y, v in p.items() if y[2] == 1) / z, rel=1e-4)
    assert double[0, 2] == pytest.approx(sum(v * sum(a == 0 and b == 2 for a, b in zip(y, y[1:])) for y, v in p.items()) / z, rel=1e-4)


def test_decoding_skips_only_what_can_not_matter():
    """The bound leaves out most tokens of easy sequences and never changes the best path."""
    r = np.random.default_rng(2)
    for seed in range(6):
        crf = Crf(5, 8)
        crf.pair += r.normal(size=(5, 5)).astype(np.float32)
        crf.first += r.normal(size=5).astype(np.float32)
        e = r.normal(size=(400, 5)).astype(np.float32)
        e[:, 0] += 6
        e[r.integers(0, 400, 30), r.integers(1, 5, 30)] += 9
        lengths = np.array([0, 1, 150, 2, 47, 200])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[lengths > 0]
        got = crf.decode(e, lengths, cells=97)
        for a, z in zip(starts, [*starts[1:], 400]):
            score, back = e[a] + crf.first, []
            for i in range(a + 1, z):
                s = score[:, None] + crf.pair
                back.append(s.argmax(0))
                score = s.max(0) + e[i]
            path = [int(score.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert got[a:z].tolist() == path[::-1]
        assert crf._may_gain(e, starts).mean() < 0.9
