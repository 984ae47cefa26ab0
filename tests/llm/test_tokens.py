import os
import random

import pytest

from quillspark.llm import tokens as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.VOCABULARY), reason="no vocabulary files")


def test_fragments_encode_like_whole_texts():
    e = E.FragmentEncoder(E.read_vocabulary(E.VOCABULARY))
    rng = random.Random(1)
    odd = ["  a  b", "x''s don't 'S ''ve→'s", "a\n\n b \n", "  　x　 y", "<|endoftext|>hi", "é'té 12ab34 ..'s", "จะไป 'll", "ﬁ🎓🎓👍️ z"]
    odd += ["".join(rng.choice(" '\nabsé学。’.,12→🎓 　tdvelm") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in odd:
        assert e(t) == e.plain(t), t
    assert e("") == e(None) == []
    long = "".join(odd)
    blocks = list(e.blocks(long, 500))
    assert len(blocks) > 20 and "".join(blocks) == long and [i for b in blocks for i in e(b)] == e.plain(long)
    assert list(e.blocks("x" * 5000, 100)) == ["x" * 5000]


def test_corpus(spark):
    rows = [(1, "Xin chào <|endoftext|>", 1), (2, None, 1), (3, "", 1), (4, "từ dài 学生。 " * 400, 1), (5, " ", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    e = E.FragmentEncoder(E.read_vocabulary(E.VOCABULARY))
    got = {r.doc_id: r.ids for r in E.encode_corpus(df, "doc_id", "text", block_chars=100).collect()}
    assert got == {i: e.plain(t) if t else [] for i, t, _ in rows}
    assert E.encode_corpus(df.limit(0), "doc_id", "text").collect() == []
    twice = E.encode_corpus(df.where("doc_id = 4").unionByName(df.where("doc_id = 4")), "doc_id", "text", block_chars=100).collect()
    assert [r.ids for r in twice] == [e.plain(rows[3][1])] * 2
