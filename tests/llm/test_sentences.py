from quillspark.llm.sentences import sentence_ends, sentences


def cut(text):
    out, at = [], 0
    for e in sentence_ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


def test_scripts_and_marks():
    cases = {
        "Một câu. Hai câu? Ba!!": ["Một câu.", "Hai câu?", "Ba!!"],
        "Ông N. V. H. gặp PGS.TS. Tiêu Hạc tại TP. Phú Lộc. Xem tr. 4 và Điều 8.9.": ["Ông N. V. H. gặp PGS.TS. Tiêu Hạc tại TP. Phú Lộc.", "Xem tr. 4 và Điều 8.9."],
        "Mang sách, vở, v.v. Đơn vị nhận. Mang sách, v.v. do khoa cấp.": ["Mang sách, vở, v.v.", "Đơn vị nhận.", "Mang sách, v.v. do khoa cấp."],
        "“Nộp ở đâu?” cán bộ hỏi. “Nhớ mang đơn!” ThS. Ôn Dực nhắc cả lớp. Xong.": ["“Nộp ở đâu?” cán bộ hỏi.", "“Nhớ mang đơn!” ThS. Ôn Dực nhắc cả lớp.", "Xong."],
        "He left (cf. item no. 3.) early... then slept. (It was late.) Prof. Orvane met Mrs. Quillon at 5 a.m. sharp.": ["He left (cf. item no. 3.) early... then slept.", "(It was late.)", "Prof. Orvane met Mrs. Quillon at 5 a.m. sharp."],
        "Am 3. Mai 2019 kam er z. B. spät. „Wo liegt das Heft?“, fragte sie. Gut.": ["Am 3. Mai 2019 kam er z. B. spät.", "„Wo liegt das Heft?“, fragte sie.", "Gut."],
        "« Où est-il ? » demande Luc. Ici !": ["« Où est-il ? » demande Luc.", "Ici !"],
        "«Где?» — спросил он. План и т. д. на двух. Конец.": ["«Где?» — спросил он.", "План и т. д. на двух.", "Конец."],
        "成绩单在哪里？“请问”。“名单在哪里？”教务处问道。老师说：“请整理。”图书馆关门。共3.5分。": ["成绩单在哪里？", "“请问”。", "“名单在哪里？”教务处问道。", "老师说：“请整理。”", "图书馆关门。", "共3.5分。"],
        "担当者は「来てください。」と答えた。次です。": ["担当者は「来てください。」と答えた。", "次です。"],
        "यह है। वह है? अंत": ["यह है।", "वह है?", "अंत"],
        "แก้ไขแผน 83 วันในการส่ง อย่าลืม": ["แก้ไขแผน 83 วันในการส่ง", "อย่าลืม"],
        "Hết hạn.Tổ thư ký nộp bai_46.v24.28.pdf từ https://a.example/b?id=9107. Xong.": ["Hết hạn.", "Tổ thư ký nộp bai_46.v24.28.pdf từ https://a.example/b?id=9107.", "Xong."],
    }
    for text, want in cases.items():
        assert cut(text) == want, text


def test_structure():
    text = "1. Kết luận\r\n\r\nCâu một dài\r\nqua dòng. Câu hai; vẫn\r\n \r\n- mục a;\r\n- mục b. c\r\n\r\nTT | Tên | Điểm\r\n1 | A. B | 3\r\n\r\n$J = \\frac{1}{2}. x$\r\n\r\nĐiều 2. Phạm vi"
    assert cut(text) == ["1. Kết luận", "Câu một dài\r\nqua dòng.", "Câu hai; vẫn", "- mục a;", "- mục b. c", "TT | Tên | Điểm", "1 | A. B | 3", "$J = \\frac{1}{2}. x$", "Điều 2. Phạm vi"]


def test_nothing_and_long():
    assert [sentence_ends(t) for t in (None, "", " \n​\n")] == [[], [], []]
    long = "Một câu ngắn. " * 20_000
    assert len(sentence_ends(long)) == 20_000 and len(sentence_ends("x" * 300_000)) == 1
    assert sentence_ends("“mở mà không đóng. Câu hai.")[-1] == 27


def test_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 5), (2, None, 5), (1, "A b. C d.", 5)], "doc_id long, text string, end_pos int")
    assert sorted(map(tuple, sentences(df, "text").collect())) == [(1, 4), (1, 4), (1, 9), (1, 9)]
    assert sentences(df.limit(0), "text").collect() == []


def test_far_starts_change_nothing(monkeypatch):
    """Comparing far starts by their best alone gives what comparing all starts gives."""
    import random

    from quillspark.llm import sentences as S

    rng = random.Random(8)
    parts = ["Một câu ", "dài. ", "(x. ", "y) ", "“Ai? ", "nói!” ", "etc. ", "từ " * 40, "「はい。", "」", "次。", '"q. ', 'a." ', "[z. ", "w]. ", "x" * 700 + " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    found = [sentence_ends(t) for t in texts]
    monkeypatch.setattr(S, "_FAR", 1 << 60)
    assert found == [sentence_ends(t) for t in texts]


def test_long_quotation_is_one_sentence():
    assert sentence_ends("“" + "một câu ngắn ở đây. " * 10_000 + "”") == [200_002]
    assert sentence_ends("(" * 20_000 + "a. " + "」" * 20_000) == [40_003]
