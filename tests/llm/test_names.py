from __future__ import annotations

import pytest

from reelgrid.llm.components import connected_components
from reelgrid.llm.names import LEAST_JARO_WINKLER, block_keys, forms, jaro_winkler, likeness, link_names, name_clusters, slips

KNOWN = [(1, "person", "Nẩy Dẻo Ngốp", None), (2, "person", "Thầu Rắt Quệch", "Bé Sạp"), (3, "person", "Nẩy Dẻo Thoai", None), (4, "org", "Trung tâm Gốm sứ Rãi Phiệc", None), (5, "location", "Thị trấn Nhoạt Nuầm", None), (6, "org", "Trung tâm Nông sản Troai Loảnh", None), (None, "person", None, None)]


def link(spark, names):
    s = spark.createDataFrame([(k, n, 9, "x") for k, n in names], "kind string, name string, entity_id int, form string")
    e = spark.createDataFrame([(*k, 1) for k in KNOWN], "entity_id bigint, entity_kind string, full_name string, nickname string, key int")
    return {(r.kind, r.name): r.entity_id for r in link_names(s, e).collect()}


def test_spellings(spark):
    person = {"Nẩy Dẻo Ngốp": 1, "nay deo ngop": 1, "Ngốp, Nẩy Dẻo": 1, "NGỐP NẨY DẺO": 1, "N. D. Ngốp": 1, "N.D. Ngop": 1, "Nẩy D. Ngốp": 1, "Dẻo Ngốp": 1, "ông Nẩy Dẻo Ngốp": 1, "TS. Nay Deo Ngopp": 1, "Nẩy Dẻo Nốgp": 1, "Bé Sạp": 2, "Bác sĩ Be Sap": 2, "bé ssạp": 2, "Nẩy​ Dẻo  Ngốp": 1}
    nobody = ["Jorrec Ashquill", "Nẩy Dẻo", "N. D.", "nan", "", "  ", "Nẩy Dẽo Ngốp Tênh", None]
    org = {"TT Gốm sứ Rãi Phiệc": 4, "gom su rai phiec": 4, "TT Rãi Phiệc": 4, "Gốm sứ Rãi Phiệc TT": 4, "TTGSRP": 4, "T.T.G.S.R.P": 4, "Trung tam Gom su Rai Phiecc": 4}
    place = {"TT. Nhoạt Nuầm": 5, "Nhoat-Nuam": 5, "Nhoạt Nuầm, thị trấn": 5, "TT.Nhoạt Nuầmm": 5}
    names = [("person", n) for n in [*person, *nobody]] + [("org", n) for n in org] + [("location", n) for n in place] + [("person", "Bé Sạp")] * 5 + [(None, "x")]
    want = {("person", n): e for n, e in person.items()} | {("org", n): e for n, e in org.items()} | {("location", n): e for n, e in place.items()}
    assert link(spark, names) == want


def test_what_fits_two_means_neither(spark):
    assert link(spark, [("person", "N. D. Ngoai")]) in ({}, {("person", "N. D. Ngoai"): 3})
    assert link(spark, [("person", "N. D. Xxoai")]) == {}


def test_empty(spark):
    assert link(spark, []) == {}


def test_unknown_names_form_clusters(spark):
    groups = [["Quách Thoan Rèo", "quach thoan reo", "Rèo, Quách Thoan", "ông Quách Thoann Rèo", "Quách Thaon Rèo"], ["Jorrec Ashquill", "Jorec Ashquill", "Ashquill Jorrec"], ["Bùi Nham"], ["Nẩy Dẻo Ngốp", "nay deo ngop"]]
    rows = [("person", n) for g in groups for n in g] + [("org", "Quách Thoan Rèo"), ("person", "nan")]
    s = spark.createDataFrame(rows, "kind string, name string")
    e = spark.createDataFrame(KNOWN, "entity_id bigint, entity_kind string, full_name string, nickname string")
    got = {(r.kind, r.name): (r.cluster, r.entity_id) for r in name_clusters(s, e).collect()}
    assert set(got) == set(rows)
    clusters = [{got["person", n][0] for n in g} for g in groups]
    assert all(len(c) == 1 for c in clusters) and len(set.union(*clusters)) == 4
    assert got["org", "Quách Thoan Rèo"][0] not in set.union(*clusters) and {got["person", n][1] for n in groups[3]} == {1}
    assert {got["person", n][1] for g in groups[:3] for n in g} == {None}


def slipped(r, name):
    """A name with one letter left out, doubled, replaced or swapped, in a word of at least four letters."""
    words = name.split()
    i = r.choice([i for i, w in enumerate(words) if len(w) >= 4])
    w, j = words[i], r.randrange(len(words[i]) - 1)
    words[i] = r.choice([w[:j] + w[j + 1 :], w[:j] + w[j] + w[j:], w[:j] + r.choice("aeghiknoptu") + w[j + 1 :], w[:j] + w[j + 1] + w[j] + w[j + 2 :]])
    return " ".join(words)


def test_the_threshold_is_measured():
    """Slips drawn into invented names against the other pairs that share a block."""
    import random
    from collections import defaultdict

    r = random.Random(5)
    # First names of few syllables and given names of many, so that many people differ in one word by a letter or two.
    few = ["thuong", "quach", "nhung", "phan", "khong", "trinh"]
    part = lambda: r.choice("b d h kh l m n ng ph qu t th tr v x".split()) + r.choice("a e i o u".split()) + r.choice(["", "c", "m", "n", "ng", "p", "t"])
    names = list(dict.fromkeys(f"{r.choice(few)} {r.choice(few)} {part()}" for _ in range(6000)))
    blocks = defaultdict(set)
    for n in names:
        for k in block_keys(n.split()):
            blocks[k].add(n)
    right = total = refused = others = 0
    for n in names:
        s = slipped(r, n)
        met = set().union(*(blocks.get(k, set()) for k in block_keys(s.split())))
        total += 1
        right += n in met and likeness(s.split(), n.split()) >= LEAST_JARO_WINKLER
        # Another name is refused if it is under the threshold or not as near as the right one.
        own = likeness(s.split(), n.split())
        for o in met - {n}:
            others += 1
            v = likeness(s.split(), o.split())
            refused += v < LEAST_JARO_WINKLER or v < own
    print(f"kept {right / total:.4f} of {total}, refused {refused / max(others, 1):.4f} of {others}")
    assert right / total >= 0.98 and others > 1000 and refused / others >= 0.4


def test_forms_grow_in_a_line():
    sizes = [len(forms("person", " ".join("abcdefghijklmnopqrstuvwx"[i] + "ong" for i in range(n)), None)) for n in (4, 8, 12, 24)]
    assert sizes[-1] < 250 and sizes[2] < 120


def test_measures():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert [slips("abc", x) for x in ("abc", "abcd", "acb", "bc", "abd", "cab", "")] == [0, 1, 1, 1, 1, 2, 2]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(200)] + [("hub", f"s{i}") for i in range(50)] + [("hub", "s1")] * 30 + [("z", "z"), (None, "q"), ("q", None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"p{i:04d}"] for i in range(201)} == {"p0000"}
    assert {got[f"s{i}"] for i in range(50)} == {"hub"} and got["z"] == "z" and len(got) == 201 + 51 + 1
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []
