import random

from quillspark.llm import leaks as L

ITEMS = "item_id long, question string, expected string, text string"


def test_wu_manber_against_brute_force():
    rng = random.Random(3)
    for m in (2, 3, 5):
        patterns = {}
        for i in range(40):
            patterns.setdefault(tuple(rng.randint(0, 3) for _ in range(m)), set()).add(i)
        wm = L.WuManber(patterns, m)
        for _ in range(200):
            seq = tuple(rng.randint(0, 5) for _ in range(rng.randint(0, 30)))
            want = set().union(*[patterns.get(seq[i : i + m], set()) for i in range(len(seq) - m + 1)] or [set()])
            assert wm.find(seq) == want


def test_leaks(spark):
    w = "quỹ học bổng dành mấy suất cho lớp khi dự án kéo dài"  # 12 words
    zh = "关于奖学金评审组在第二轮评审期间收到多少份问卷结果的说明"
    items = spark.createDataFrame([(1, w, None, "x"), (1, w, None, "x"), (2, "one two three", zh, "x"), (3, None, None, "x")], ITEMS)
    docs = [
        (1, "Mở đầu. **QUỸ** học bổng — dành mấy\r\nsuất, cho lớp (khi) dự <b>án</b> kéo... Hết.", 0),  # 11 of 12 words
        (2, " ".join(w.split()[:9]) + " hết", 0), (3, "quỹ học bổng d​ành mấy ѕuất cho lớp khi dự án", 0),
        (4, "前" + zh[:8] + "，\n" + zh[8:20] + "。", 0), (5, zh[:19], 0), (6, None, 0), (7, "", 0), (1, None, 0), (8, "từ " * 100_000 + w, 0),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    got = L.leaks(df, "doc_id", "text", items, "item_id", ["question", "expected"])
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 1), (4, 2), (8, 1)]
    assert L.leaks(df, "doc_id", "text", items.limit(0), "item_id", ["question", "expected"]).collect() == []
    assert L.leaks(df.limit(0), "doc_id", "text", items, "item_id", ["question", "expected"]).collect() == []


def test_long_and_broken_tags():
    w = "one two three four five six seven eight nine ten"
    found = L.Matcher([(1, [w])], {})
    assert found(w.replace("five", f'five <a href="{"x y " * 100}">')) == {1}
    assert found(w.replace("five", 'five <span\nclass="a b"\r\nid="c">')) == {1}
    assert found(f"if a <b\nthen {w}\nand c> d") == {1}  # no tag


def test_case_and_spelling_together(spark):
    """Capitals, decomposed and with twins, are found whichever spelling the corpus has more of."""
    import unicodedata

    w = "những ứng dụng ớt đỏ ở nước mình rất được ưa chuộng"
    cyr = "весна пришла и снова нас ждёт новая работа в поле"
    items = spark.createDataFrame([(1, w, None, "x"), (2, cyr, None, "x"), (3, "die große straße führt uns an dem alten haus vorbei", None, "x")], ITEMS)
    up = w.upper()
    apart = unicodedata.normalize("NFD", up)
    docs = [up, apart, unicodedata.normalize("NFD", w), up.replace("O", "О").replace("E", "Е"), apart.replace("A", "А")]
    rows = [(i, t) for i, t in enumerate(docs)] + [(10, cyr.upper()), (11, cyr), (12, "DIE GROSSE STRASSE FÜHRT UNS AN DEM ALTEN HAUS VORBEI")]
    for filler in ("Ứ Ớ Í " * 500, unicodedata.normalize("NFD", "Ứ Ớ Í Ữ ứ ớ " * 500), "В Н С Р " * 500, "x"):
        df = spark.createDataFrame([*rows, (99, filler)], "doc_id long, text string")
        got = L.leaks(df, "doc_id", "text", items, "item_id", ["question", "expected"])
        assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (10, 2), (11, 2), (12, 3)], filler[:10]


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS_A_PASS", 2)
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    items = spark.createDataFrame([(i, text(i)) for i in range(7)], "item_id long, question string")
    df = spark.createDataFrame([(i, text(i)) for i in range(7)], "doc_id long, text string")
    assert sorted(map(tuple, L.leaks(df, "doc_id", "text", items, "item_id", ["question"]).collect())) == [(i, i) for i in range(7)]
