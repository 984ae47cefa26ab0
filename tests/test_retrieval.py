import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import agent as A
from quillspark.operators import evaluation as E
from quillspark.operators import retrieval as R
from quillspark.operators.embedding import embed, set_embeddings
from quillspark.settings import Settings
from quillspark.shared import Scratch

S = Settings()


def scores(spark, corpus, query):
    docs = spark.createDataFrame([(i, d.split()) for i, d in enumerate(corpus, 1)], "id long, tokens array<string>")
    q = spark.createDataFrame([(1, query.split())], "q long, t array<string>")
    scratch = Scratch(spark)
    return {r.id: r.score for r in R.bm25(R.build_index(docs, "id", "tokens", S, scratch), q, "q", "t", "id", 30, scratch).collect()}


def test_bm25(spark):
    one = ["cat sat mat", "cat cat dog", "bird", "dog sat log", "fish bowl"]
    assert scores(spark, one, "cat dog zzz") == pytest.approx({1: 0.302447, 2: 0.747369, 4: 0.302447}, abs=1e-6)
    two = ["cat sat", "cat dog", "cat cat bird", "cat", "fish"]
    assert scores(spark, two, "cat") == pytest.approx({1: 0.156945, 2: 0.156945, 3: 0.193873, 4: 0.205990}, abs=1e-6)
    assert scores(spark, two, "cat dog")[2] == pytest.approx(1.203242, abs=1e-6)
    assert scores(spark, two, "cat cat")[3] == pytest.approx(2 * 0.193873, abs=2e-6)
    assert scores(spark, two, "zzz") == {}


def ranked(spark, rows):
    return spark.createDataFrame([(1, i, s, k) for k, (i, s) in enumerate(rows, 1)], "q long, id long, score double, rank int")


def test_rrf(spark):
    f = {r.id: (round(r.rrf, 6), r.pos) for r in R.rrf(ranked(spark, [(1, 9.0), (2, 8.0)]), ranked(spark, [(2, 0.9), (3, 0.8)]), "q", "id").collect()}
    assert f == {2: (0.032522, 1), 1: (0.016393, 2), 3: (0.016129, 3)}
    tie = R.rrf(ranked(spark, [(1, 9.0)]), ranked(spark, [(2, 0.9)]), "q", "id").orderBy("pos").collect()
    assert [r.id for r in tie] == [1, 2] and tie[0].rrf == tie[1].rrf


def test_dense_against_brute_force(spark):
    x = np.random.default_rng(1).standard_normal((60, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0]), (102, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = R.dense(df, "id", "v", df.where("id < 5").withColumnRenamed("id", "q"), "q", "v", 4).collect()
    x = np.vstack([x, np.zeros((1, 8))]).astype(np.float32).astype(float)
    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    ids = [*range(60), 102]
    for q in range(5):
        want = sorted((-round(float(u[q] @ u[j]), 6), ids[j]) for j in range(61))[:4]
        assert [(r.id, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.q == q] == [(i, k) for k, (_, i) in enumerate(want, 1)]


def test_metrics(spark):
    lists = {("e1", "bm25"): [11, 1, 16, 9, 7], ("e1", "hybrid"): [11, 2, 9, 13, 8], ("e3", "bm25"): [2, 9, 8, 16, 6], ("e3", "hybrid"): [2, 9, 6, 16, 13], ("h10", "bm25"): [12, 13, 17, 14, 11], ("none", "bm25"): [1]}
    rel = [("e1", 2), ("e1", 2), ("e3", 2), ("e3", 9), ("e3", 8), ("h10", 13), ("h10", 14), ("h10", 6)]
    r = spark.createDataFrame([(q, m, d, k) for (q, m), ds in lists.items() for k, d in enumerate(ds, 1)], "item string, method string, doc long, rank int")
    s = E.per_query(r, spark.createDataFrame(rel, "item string, doc long"), spark.createDataFrame([("e1",), ("e3",), ("h10",), ("none",)], "item string"), "item", "doc", 5, ["bm25", "hybrid"])
    got = {(x.item, x.method): (x.recall, x.mrr, x.hit) for x in s.collect()}
    assert got[("e1", "bm25")] == (0, 0, 0) and got[("e1", "hybrid")] == (1, 0.5, 1) and got[("e3", "bm25")] == (1, 1, 1)
    assert got[("e3", "hybrid")] == (0.666667, 1, 1) and got[("h10", "bm25")] == (0.666667, 0.5, 1) and got[("none", "bm25")] == got[("none", "hybrid")] == (0, 0, 0)
    pool = {x.doc: x.place for x in E.pool(r.where("item = 'e1'"), "item", "doc", ["bm25", "hybrid"], 10).collect()}
    assert pool[11] == 1 and pool[2] == 12 and len(pool) == 8


def test_merge_subquestions(spark):
    def merge(old, kept, new):
        df = spark.createDataFrame([(old, kept, new)], "o array<string>, k array<boolean>, n array<string>")
        return df.select(A.merge_subquestions(F.col("o"), F.col("k"), F.col("n"), 4)).first()[0]

    assert merge(["a", "b", "c"], [True, False, False], ["x"]) == ["a", "x"]
    assert merge(["a", "b"], [True, False], ["x", "y", "z"]) == ["a", "x", "y", "z"]
    assert merge(["a", "b"], [False, True], ["x"]) == ["x", "b"] and merge(["a"], [True], []) == ["a"]


def test_agent_loop(spark):
    docs = spark.createDataFrame([(1, "quỹ học bổng dành suất cho lớp".split()), (2, "lịch thi cuối kỳ".split()), (3, "thư viện".split())], "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(1, "quỹ học bổng dành suất", 0), (2, "Xin chào!", 0), (3, "zzz yyy xxx www", 0), (4, "quỹ học bổng khi lịch thi", 0), (5, "quỹ học bổng khi zzz yyy", 0), (6, "zzz khi yyy", 0)], "item_id long, question string, label int")

    scratch = Scratch(spark)
    index = R.build_index(docs, "doc_id", "tokens", S, scratch)

    def retrieve(subs):
        w = subs.select("sub_key", X.words("subquestion").alias("t"))
        top = R.bm25(index, w, "sub_key", "t", "doc_id", 5, scratch)
        return top.join(R.overlap_of(index, top, w, "sub_key", "t", "doc_id", scratch), ["sub_key", "doc_id"])

    answers, citations = A.answer(q, "item_id", "question", retrieve, S)
    got = {r.item_id: r for r in answers.collect()}
    assert (got[1].route, got[1].stopped, got[1].iterations, got[1].partial, got[1].n_steps) == ("simple", None, 0, False, 0)
    assert got[2].route == "no_retrieval" and got[2].n_context == 0
    assert got[3].answer == A.NOT_FOUND and not got[3].partial and all(r.verified for r in got.values())
    assert got[4].route == "complex" and got[4].n_steps == 2 and got[4].stopped == "converged"
    assert (got[5].stopped, got[5].partial, got[5].iterations) == ("sufficient", True, 0) and got[6].stopped == "early_stop" and got[6].partial
    assert all(r.cited for r in citations.collect())
    never = A.Providers(sufficient=lambda notes: F.lit(False), unsupported=lambda a, n: F.array(F.lit("x"), F.lit("y")))
    got = {r.item_id: r for r in A.answer(q.where("item_id = 5"), "item_id", "question", retrieve, S, never)[0].collect()}
    assert got[5].stopped == "early_stop" and got[5].iterations == 1 and not got[5].verified and got[5].reason == "x; y"


def test_second_half_keeps_all_words(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(1000)),), ("one",), ("a b c",)], "t string")
    assert [len(r[0].split()) for r in df.select(A.second_half(F.col("t"))).collect()] == [501, 1, 3]


@pytest.mark.parametrize("direct", [0, R.DIRECT_POSTINGS])
def test_search_against_scoring_all(spark, monkeypatch, direct):
    """Bounds leave out nothing: the searches equal scoring every document, ties and repeated query terms included."""
    import random

    monkeypatch.setattr(R, "DIRECT_POSTINGS", direct)

    rng = random.Random(6)
    words = [f"t{i}" for i in range(40)]
    pick = lambda n: [rng.choice(words[: rng.choice([3, 10, 40])]) for _ in range(n)]
    docs = spark.createDataFrame([(i, pick(rng.randint(0, 30))) for i in range(400)], "id long, tokens array<string>")
    queries = spark.createDataFrame([(i, pick(rng.randint(0, 8)) + ["absent"] * (i % 2)) for i in range(30)], "q long, t array<string>")
    scratch = Scratch(spark)
    index = R.build_index(docs, "id", "tokens", S, scratch)
    tokens, asked = {r.id: r.tokens for r in docs.collect()}, {r.q: r.t for r in queries.collect()}
    idf = {r.term: r.idf for r in index.terms.collect()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    bm, ov = {}, {}
    for q, t in asked.items():
        for i, d in tokens.items():
            part = lambda x: idf[x] * d.count(x) * 2.5 / (d.count(x) + 1.5 * (0.25 + 0.75 * len(d) / mean))
            bm[q, i] = round(sum(part(x) for x in t if x in d), 6)
            ov[q, i] = round(len(set(t) & set(d)) / max(len(set(t)), 1), 6)
    best = lambda of, k: {(q, i, n) for q in asked for n, (_, i) in enumerate(sorted((-s, i) for (x, i), s in of.items() if x == q and s > 0)[:k], 1)}
    rows = lambda df: {(r.q, r.id, r["rank"]) for r in df.collect()}
    for k in (1, 5):
        assert rows(R.bm25(index, queries, "q", "t", "id", k, scratch)) == best(bm, k)
        assert rows(R.overlap(index, queries, "q", "t", "id", k, scratch)) == best(ov, k)
    for share in (0.3, 0.5, 1.0):
        got = {(r.q, r.id): r.share for r in R.overlap_at_least(index, queries, "q", "t", "id", share, scratch).collect()}
        assert got == {p: s for p, s in ov.items() if s >= share}
    assert R.bm25(index, queries.limit(0), "q", "t", "id", 3, scratch).collect() == []
    none = R.build_index(docs.limit(0), "id", "tokens", S, scratch)
    assert R.bm25(none, queries, "q", "t", "id", 3, scratch).collect() == []


def test_dense_in_slices(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((50, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([x, x]))], "id long, v array<double>")
    whole = R.dense(df, "id", "v", df.withColumnRenamed("id", "q"), "q", "v", 3).collect()
    monkeypatch.setattr(R, "QUERY_SLICE", 7)
    monkeypatch.setattr(R, "VECTOR_BATCH", 9)
    assert sorted(whole) == sorted(R.dense(df, "id", "v", df.withColumnRenamed("id", "q"), "q", "v", 3).collect()) and len(whole) == 300
    assert R.dense(df, "id", "v", df.limit(0).withColumnRenamed("id", "q"), "q", "v", 3).collect() == []


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["cat", "sat"]), (2, ["cat", "cat", "dog"]), (3, ["bird"]), (4, []), (5, ["fish"]), (6, ["fish"])], "id long, tokens array<string>")
    q = spark.createDataFrame([(1, ["dog", "cat"])], "q long, t array<string>")
    search = lambda index: sorted((r.id, r.score) for r in R.bm25(index, q, "q", "t", "id", 5, Scratch(spark)).collect())
    R.write_index(docs, "id", "tokens", f"{tmp_path}/i", S)
    want = search(R.build_index(docs, "id", "tokens", S, Scratch(spark)))
    assert search(R.open_index(spark, f"{tmp_path}/i", S)) == want and {i for i, _ in want} == {1, 2}
    R.write_index(docs.where("id < 3"), "id", "tokens", f"{tmp_path}/half", S)
    R.append_to_index(f"{tmp_path}/half", docs.where("id > 1"), "id", "tokens", f"{tmp_path}/both", S)
    assert [i for i, _ in search(R.open_index(spark, f"{tmp_path}/both", S))] == [1, 2]
    spark.createDataFrame([(1, 1, 0.0, 1)], "n_docs bigint, length bigint, floor double, version int").write.mode("overwrite").parquet(f"{tmp_path}/i/stats")
    with pytest.raises(ValueError):
        R.open_index(spark, f"{tmp_path}/i", S)


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "compute_loss của mô hình"), (2, "compute loss"), (3, None), (4, "compute_loss của mô hình"), (5, "và")], "id long, text string")
    scratch = Scratch(spark)
    none = spark.createDataFrame([], "content string, embedding array<float>")
    every, new = embed(texts, "id", "text", none, scratch)
    got = {r.id: np.array(r.embedding) for r in every.collect()}
    assert new.count() == 3 and sorted(got) == [1, 2, 4, 5] and not got[5].any() and (got[1] == got[4]).all() and abs(np.linalg.norm(got[1]) - 1) < 1e-6
    again, more = embed(texts, "id", "text", new, scratch)
    assert more.count() == 0 and again.count() == 4
    table = spark.createDataFrame([(1, None, "a"), (9, [1.0], "b")], "id long, embedding array<float>, x string")
    assert {r.id: len(r.embedding) for r in set_embeddings(table, "id", every).collect()} == {1: 256, 9: 1}
