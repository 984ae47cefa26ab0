from datetime import datetime as T

from quillspark.operators import references as R
from quillspark.operators.ordering import numbered, with_previous
from quillspark.operators.skew import skew_join
from quillspark.shared import Scratch

M = "id bigint, citations string, created_at timestamp, noise string"
C = "id bigint, document_id bigint, created_at timestamp, noise string"
D = "doc_id bigint, created_at timestamp, id string"
L = "document_id bigint, change string, changed_at timestamp"
t = lambda d: T(2024, 1, d)


def run(spark, m, c, d, log):
    out = R.orphan_references(spark.createDataFrame(m, M), spark.createDataFrame(c, C), spark.createDataFrame(d, D), spark.createDataFrame(log, L), Scratch(spark))
    return sorted((r.src_table, r.period, r.src_id, r.ref_table, r.ref_id) for r in out.collect())


def test_orphans_of_all_kinds(spark):
    m = [
        (1, '[{"chunk_id": 10, "document_id": "1"}, {"chunk_id": "99"}]', t(5), None),
        (1, '[{"chunk_id": 10, "document_id": "1"}, {"chunk_id": "99"}]', t(5), None),  # delivered twice
        (2, '[{"chunk_id": 10, "document_id": 7', t(5), None),  # cut off
        (3, '[{"chunk_id": null, "document_id": 2}, {"document_id": 3}, {}]', t(5), None),
        (4, None, t(5), None), (5, "", t(5), None), (6, '{"document_id": 77}', t(5), None), (7, '[{"document_id": 4}]', None, None),
    ]
    c = [(10, 1, t(2), None), (11, None, t(2), None), (12, 3, t(9), None), (13, 4, t(3), None), (10, 1, t(2), None)]
    d = [(1, t(1), "x"), (2, t(1), "x"), (3, t(8), "x"), (4, None, "x")]
    log = [(2, "restore", t(1)), (2, "delete", t(3)), (3, "delete", t(1)), (3, "restore", t(2)), (3, "restore", t(2)), (50, "delete", t(1))]
    assert run(spark, m, c, d, log) == [("messages", "2024-01", 1, "chunks", 99), ("messages", "2024-01", 3, "documents", 2), ("messages", "2024-01", 3, "documents", 3)]


def test_empty_tables(spark):
    assert run(spark, [], [], [], []) == []
    assert run(spark, [], [(1, 5, t(1), None)], [], []) == [("chunks", "2024-01", 1, "documents", 5)]


def test_match_semantics(spark):
    refs = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, 1, None), (4, 8, None), (5, None, None), (6, None, 2)], "r int, a int, b int")
    to = spark.createDataFrame([(1, 1), (1, 2), (3, None)], "a int, b int")
    got = {m: sorted(x.r for x in R.orphans(refs, ["a", "b"], to, m).collect()) for m in ("simple", "full", "partial")}
    assert got == {"simple": [2], "full": [2, 3, 4, 6], "partial": [2, 4]}


def test_skew_join_is_exact(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(600)] + [(700, None)], "i int, k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, "k", how).select("i", "k").collect()))
        assert sorted(map(str, skew_join(left, right, ["k"], how, hot_rows=50).select("i", "k").collect())) == want


def test_numbering_across_range_partitions(spark):
    df = spark.createDataFrame([("hot", i * 7 % 500) for i in range(500)] + [("a", 2), ("a", 1), (None, 5), (None, 4)], "g string, o int")
    got = numbered(df, ["g"], ["o"], "n", Scratch(spark)).collect()
    assert all(r.n == r.o + 1 for r in got if r.g == "hot") and {(r.o, r.n) for r in got if r.g == "a"} == {(1, 1), (2, 2)} and {(r.o, r.n) for r in got if r.g is None} == {(4, 1), (5, 2)}
    prev = with_previous(df, ["g"], ["o"], {"o": "before"}, Scratch(spark)).collect()
    assert all(r.before == (r.o - 1 if r.o else None) for r in prev if r.g == "hot") and {(r.o, r.before) for r in prev if r.g == "a"} == {(1, None), (2, 1)}
