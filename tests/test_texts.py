import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import chunking as C
from quillspark.settings import Settings
from quillspark.sources import html as H
from quillspark.sources import tables as S


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def lens(units, **kw):
    return [len(c) for c in C.pack(units, 1000, 200)]


def test_packing():
    p = lambda *u: [(c * n, False) for c, n in u]
    assert lens(p(("a", 600), ("b", 300), ("c", 300))) == [901, 300]
    assert lens(p(("a", 600), ("b", 150), ("c", 400))) == [751, 551]
    assert lens(p(("a", 600), ("b", 150), ("L", 2000))) == [751, 150, 1151, 1000]
    # edge lengths: each unit counts one blank, also towards the overlap, except the last one taken over
    assert lens(p(("a", 799), ("b", 200))) == [799, 200] and lens(p(("a", 798), ("b", 200))) == [999]
    assert lens(p(("a", 600), ("b", 200), ("c", 500))) == [801, 701] and lens(p(("a", 600), ("b", 201), ("c", 500))) == [802, 500]
    assert C.pack([("a", True), ("b", False)], 10, 0) == ["a b"]
    assert C.fragments("x" * 1000 + " y", 1000) == ["x" * 1000, "y"] and C.fragments("a" * 399 + "," + "b" * 600 + "c", 1000) == ["a" * 399 + "," + "b" * 600, "c"]
    assert C.fragments("a" * 400 + ", " + "b" * 999, 1000) == ["a" * 400 + ",", " " * 0 + "b" * 999]
    assert lens([("a" * 100, False), ("b" * 1500, True), ("c" * 100, False)]) == [100, 1601, 100]
    assert [len(x) for x in C.fragments("L" * 500 + "," + "L" * 900, 1000)] == [501, 900]


def test_sentences_of_prose(spark):
    cases = {"It works. Next one; Third? yes! ok": ["It works.", "Next one;", "Third?", "yes!", "ok"], "He met Nam. Then left.": ["He met Nam. Then left."], "see no. 5 here. end": ["see no. 5 here. end"], "Theo WHO. Sau đó. Hết": ["Theo WHO.", "Sau đó.", "Hết"], "Ông A. Nói. Ở đây": ["Ông A. Nói. Ở đây"], "": []}
    for text, want in cases.items():
        assert C._prose(text) == want
    assert col(spark, list(cases), C.sentences) == list(cases.values())


def test_units_and_chunks(spark):
    assert C.units("a b.\nc | d\ne | f\n\nx") == [("a b.", False), ("c | d\ne | f", True), ("x", False)]
    df = spark.createDataFrame([(1, "A b. " * 400, 0), (2, None, 0), (3, " \n", 0)], "doc_id long, text string, piece int")
    got = C.chunk_blocks(df, ["doc_id"], "text", 300, 50).collect()
    assert {r.doc_id for r in got} == {1} and max(len(r.text) for r in got) <= 350 and sorted(r.piece for r in got) == list(range(len(got)))


def test_tokens(spark):
    got = col(spark, ["compute_loss", "computeLoss", "hàm_compute_loss", "a_b", "...", "và", None], lambda c: X.search_tokens(c))
    assert col(spark, ["Nếu rồi thế bằng nó rằng còn đây kia ấy", "gì sao bạn em", "Việt"], lambda c: X.search_tokens(c)) == [[], ["gì", "sao", "bạn", "em"], ["việt"]]
    assert got == [["compute_loss", "compute", "loss"], ["computeloss", "compute", "loss"], ["hàm_compute_loss", "hàm", "compute", "loss"], ["a_b"], [], [], []]


def test_scalars(spark):
    assert col(spark, ["see [3][7] and [3]", "none"], X.cited_labels) == [[3, 7], []]
    assert col(spark, ['ok {"route":"complex"} x', "bad", None], lambda c: F.try_variant_get(X.read_json(c), "$.route", "string")) == ["complex", None, None]
    assert col(spark, ["abcdefg", ""], lambda c: X.slices(c, 3)) == [["abc", "def", "g"], []]
    assert col(spark, ["ậ b", "x (cid:12) y", None], X.normalize) == ["ậ b", "x (cid:12) y", None]
    assert col(spark, ["a\r\n\r\n\r\n b\t c (cid:1)"], X.normalize_structure) == ["a\n\nb c"]
    heads = {"1.1 Title": "1.1 Title", "1.  T": None, "1.1. T": None, "II. Câu hỏi": "II. Câu hỏi", "VI.Câu": "VI. Câu", "bước 4 - Chạy": "bước 4: Chạy", "Bước 4": None, "Không": None, "KẾT LUẬN chung": "KẾT LUẬN chung", "Mục lục": "Mục lục", "Kết luậnx": None, "Điều 5": None}
    assert col(spark, list(heads), X.heading_label) == list(heads.values())
    assert col(spark, ["a = b", "a+b", "x^{2", "x_{i", "f/{", ")/(", "≡", "≈", "⊇"], X.has_math) == [True, False, True, True, True, True, True, False, False]
    assert col(spark, ["a ⇒ b", "∂x", "≈", "∞", "a | b", "[BẢNG] x", "5$", "a)/(b", "x"], X.is_atomic_line) == [True, True, False, False, True, True, True, True, False]
    greet = {"Xin chào!": True, "xinchào": True, "hiii": True, "OK?": True, "okay...": True, "goodbye": True, "Bạn là ai?": True, "trợ lý": True, "bạn có thể làm gì": True, "chào bạn": True, "chào em": False, "thank": False, "chào mừng hội thảo": False}
    assert col(spark, list(greet), X.is_greeting) == list(greet.values())
    assert col(spark, [0.00125, 2.00005, 0.03125, None], lambda c: X.python_round(c, 4), "double") == [0.0013, 2.0, 0.0312, None]
    df = spark.createDataFrame([("T", None, "x"), ("T", "S", "x"), (None, "", "x")], "t string, s string, x string")
    assert [r[0] for r in df.select(X.index_text(F.col("t"), F.col("s"), F.col("x"))).collect()] == ["T\nx", "T › S\nx", "x"]


def test_settings():
    s = Settings.of({"RRF_K": "61", "USE_RERANKER": "Yes", "FINAL_TOP_K": "bad"})
    assert (s.rrf_k, s.use_reranker, s.final_top_k) == (61, True, 5)


def test_pages(spark):
    page = "<html><head><title> A <b>t</b> </title></head><body><nav><p>menu</p></nav><main><article><h1>H</h1><ul><li><p>one  two</p></li></ul><script>x</script>rest</article></main></body></html>"
    assert H.visible_text(page) == "H\n\none two\n\none two" and H.visible_text("<div>just &amp; text</div>") == "just & text" and H.visible_text(None) is None
    assert col(spark, [page, "<h1>only</h1>", "x"], lambda c: H.title(c, F.lit("u"))) == ["A t", "only", "u"]
    urls = ["https://a.b/c%20d.pdf", " http://x ", "ftp://a/b", "not a url", None]
    assert col(spark, urls, H.valid_url) == [True, True, False, False, False]
    assert col(spark, urls, H.file_name)[:2] == ["c d.pdf", "document.pdf"]
    df = spark.createDataFrame([(9, "%PDF-1", "a.pdf"), (1, "x", "a.pdf"), (1, "%PDF-", "a.txt"), (1, "%PDF-", "A.PDF"), (1, None, None)], "n int, h string, f string")
    assert [r[0] for r in df.select(H.upload_error(F.col("n"), F.col("h"), F.col("f"), 5)).collect()] == [413, 400, 400, None, 400]


def test_markdown_questions(spark, tmp_path):
    (tmp_path / "q.md").write_text("| STT | Câu hỏi | Đáp án |\n|---|---|---|\n| 1 | a? | b |\n| x | no | no |\ntext\n")
    assert [tuple(r) for r in S.markdown_questions(spark, f"{tmp_path}/q.md", "easy").collect()] == [("e1", "a?", "b", "easy")]
    spark.range(1).write.parquet(f"{tmp_path}/t")
    assert S.read_with_defaults(spark, f"{tmp_path}/t", "id long, extra string").first()["extra"] is None


def test_composition_is_skipped_only_where_it_changes_nothing():
    import re
    import unicodedata

    import regex

    touched = regex.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", X.COMPOSES), regex.V1)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert all(touched.match(c) for c in every if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c))
    second = {chr(int(x[1], 16)) for c in every if len(x := unicodedata.decomposition(c).split()) == 2 and not x[0].startswith("<") and unicodedata.normalize("NFC", c) == c}
    assert all(touched.match(c) for c in second)


def test_blocks_with_texts_to_embed(spark):
    rows = [(1, 0, "A b.", None), (1, 1, "c", "c embedded"), (1, 2, "  ", None), (2, 0, "A b. " * 300, None), (2, 1, None, None)]
    out = C.chunks_of(spark.createDataFrame(rows, "doc long, ord int, t string, e string"), "doc", "ord", "t", "e", 500, 100).collect()
    assert sorted((r.ord, r.piece, r.text, r.embed_text) for r in out if r.doc == 1) == [(0, 0, "A b.", None), (1, 0, "c", "c embedded")]
    assert len([r for r in out if r.doc == 2]) > 2 and all(r.embed_text is None for r in out if r.doc == 2)
