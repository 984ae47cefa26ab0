from quillspark.llm import forms

TEXT = "field string, id bigint, text string, id_a string"


def rewrite(*texts):
    counts = {}
    for c in "".join(texts) + "aeiouyđĐ" * 50 + "ếệậươêâăô" * 20:
        counts[c] = counts.get(c, 0) + 1
    r = forms.Rewriter(forms.look_alike_classes(counts))
    return [r(t) for t in texts]


def test_same_look_one_form():
    same = [
        ["Việt ế", "Việt ế", "Việt ế", "Việt ế", "Viе̣̂t ế"],
        ["Ｆｕｌｌ ＡＢＣ１２", "Full ABC12"], ["ﬁn ﬃ", "fin ffi"], ["理　x", "理 x"], ["a​b-c", "ab‐c", "a﻿b‑c"],
        ["Đo Ðo", "Ɖo Đo"], ["ガ が", "ｶﾞ が"], ["раdо", "pado"], ["a b", "a b", "a b", " a\tb "], ["x\r\ny", "x\ny"],
    ]
    for group in same:
        assert len(set(rewrite(*group))) == 1, group


def test_different_looks_stay_apart():
    for a, b in [("A", "a"), ("hò", "hó"), ("m²", "m2"), ("x³", "x3"), ("1", "7"), ("da", "đa"), ("o", "ơ"), ("①", "1"), ("½", "1/2")]:
        assert len(set(rewrite(a, b))) == 2, (a, b)


def test_nothing_shown():
    assert rewrite("​  ⁠\n", "") == ["", ""] and forms.Rewriter({})(None) is None


def test_union_find_is_transitive():
    c = forms.Classes()
    for a, b in [("a", "b"), ("c", "d"), ("b", "c"), ("x", "yz")]:
        c.join(a, b)
    assert len({c.find(x) for x in "abcd"}) == 1 and c.find("x") == c.find("yz") != c.find("a")


def test_pairs(spark):
    rows = [
        ("t", 1, "cà phê", None), ("t", 1, "cà phê", None), ("t", 2, "cà phê", None), ("t", 3, "cà phê", None), ("u", 4, "cà​ phê", None),
        ("t", 5, None, None), ("t", 6, "​", None), ("t", 7, " ", None), ("t", 8, "CÀ PHÊ", None), (None, 9, "cà phê", None), ("t", 10, "x" * 50_000 + "é", None), ("t", 11, "x" * 50_000 + "é", None),
    ]
    df = spark.createDataFrame(rows, TEXT)
    got = forms.looks_same_pairs(df, "field", "id", "text", forms.corpus_classes([(df, "text")]))
    assert sorted(map(tuple, got.collect())) == [("t", 1, 2), ("t", 2, 3), ("t", 10, 11)]
    none = df.limit(0)
    assert forms.looks_same_pairs(none, "field", "id", "text", forms.corpus_classes([(none, "text")])).collect() == []


def test_frequent_spelling_represents():
    """The more frequent spelling of an accented letter stands for its class, by real counts of both."""
    assert forms.look_alike_classes({"é": 3, "e": 99, "́": 9, "é": 2})["é"] == "é"
    assert forms.look_alike_classes({"é": 3, "e": 99, "́": 9, "é": 5})["é"] == "é"
    assert forms.look_alike_classes({"A": 5, "a": 9}, fold=True)["A"] == "a"


def test_classes(spark):
    rows = [("t", 1, "cà phê", None), ("t", 1, "cà phê", None), ("t", 2, "cà phê", None), ("t", 3, "trà", None), ("t", 4, "​", None), ("t", 5, None, None), (None, 6, "trà", None)]
    rows.append(("t", 7, "cà phê", None))
    df = spark.createDataFrame(rows, TEXT)
    got = forms.looks_same_classes(df, "field", "id", "text", forms.corpus_classes([(df, "text")]))
    assert sorted(map(tuple, got.collect())) == [("t", 1, 1, 3, 2), ("t", 2, 1, 3, 2), ("t", 3, 3, 1, 1), ("t", 7, 1, 3, 2)]
    assert forms.looks_same_classes(df.limit(0), "field", "id", "text", {}).collect() == []
