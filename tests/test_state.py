from datetime import datetime as T

from pyspark.sql import functions as F

from quillspark.operators import layout as L
from quillspark.operators import state as S
from quillspark.settings import Settings
from quillspark.shared import Scratch
from quillspark.streaming import traces

G = "doc_id long, page int, c string, x0 double, x1 double, cx double, cy double, size double"
B = "doc_id long, page int, x0 double, x1 double, y double"


def test_history_and_summaries(spark):
    m = spark.createDataFrame([(i, "s", "c") for i in range(1, 15)] + [(i, "t", "c") for i in range(20, 28)], "id long, session_id string, content string")
    assert sorted(r.id for r in S.recent(m, 6).where("session_id = 't'").collect()) == [22, 23, 24, 25, 26, 27]
    none = spark.createDataFrame([], "id long, session_id string, summary string, summarized_up_to long")
    assert sorted(r.id for r in S.to_summarise(m, none, Settings()).collect()) == list(range(1, 9))
    some = spark.createDataFrame([(1, "s", "a", 2), (2, "s", "b", 5), (3, "old", "c", 1)], "id long, session_id string, summary string, summarized_up_to long")
    assert sorted(r.id for r in S.to_summarise(m, some, Settings()).collect()) == [6, 7, 8]
    new = spark.createDataFrame([("s", "n", 8), ("u", "n", 9)], "session_id string, summary string, summarized_up_to long")
    assert sorted((r.session_id, r.summary, r.summarized_up_to, r.action) for r in S.upsert_summaries(some, new).collect()) == [("old", "c", 1, "kept"), ("s", "n", 8, "updated"), ("u", "n", 9, "added")]


def test_lifecycle_tables(spark):
    t = lambda m: T(2024, 1, 1, 0, m)
    df = spark.createDataFrame([(1, "processing", t(1)), (2, "processing", t(30)), (3, "complete", t(1)), (4, None, None)], "id long, status string, created_at timestamp")
    assert [(r.status, r.was_stale) for r in S.stale(df, F.lit(t(20))).orderBy("id").collect()] == [("failed", True), ("processing", False), ("complete", False), (None, False)]
    up = S.partial_update(df, "id", spark.createDataFrame([(1, "x"), (2, None), (9, "y")], "id long, status string"), ["status"])
    assert [r.status for r in up.orderBy("id").collect()] == ["x", "processing", "complete", None]
    kids = spark.createDataFrame([(7, 1), (8, 2), (9, None)], "k long, ref long")
    left = S.cascade_delete(df, "id", spark.createDataFrame([(1,), (1,)], "id long"), {"kids": (kids, "ref")})
    assert left["parent"].count() == 3 and sorted(r.k for r in left["kids"].collect()) == [8, 9]
    d = S.drift(df.select("id"), spark.createDataFrame([(1,), (2,), (50,)], "x long")).first()
    assert (d.missing, d.extra, d.both, d.in_sync) == (2, 1, 2, False)
    traced = spark.createDataFrame([(1, '[{"type":"thinking"},{"type":"route","data":{"route":"simple"}}]'), (2, "cut off ["), (3, None)], "id long, trace string")
    assert [(r.id, r.seq, r.type, r.data) for r in S.trace_events(traced).collect()] == [(1, 2, "route", '{"route":"simple"}')]


def glyphs(spark, text, cy, x0=0.0, page=1, size=10.0):
    return [(1, page, c, x0 + 6 * i, x0 + 6 * i + 5.5, x0 + 6 * i + 2.75, cy, size) for i, c in enumerate(text) if c != " "]


def lines(spark, marks, bars):
    return [(r.page, r.line) for r in L.page_lines(spark.createDataFrame(marks, G), spark.createDataFrame(bars, B)).orderBy("page", "line_no").collect()]


def test_layout(spark):
    at = lambda c, x, y: (1, 1, c, x - 2.0, x + 2.0, x, y, 10.0)
    assert lines(spark, [at("a", 120.0, 44.0), at("b", 120.0, 57.0)], [(1, 1, 100.0, 140.0, 50.0)]) == [(1, "(a)/(b)")]
    assert lines(spark, [at("a", 120.0, 49.0), at("b", 120.0, 53.0)], [(1, 1, 100.0, 140.0, 50.0)]) == [(1, "ab")]
    assert [len(r) for r in L.rows([{"cy": y, "x0": 0.0} for y in (10.0, 13.5, 17.0)])] == [2, 1]
    assert lines(spark, glyphs(spark, "một hai", 10.0) + glyphs(spark, "ba", 30.0), []) == [(1, "một hai"), (1, "ba")]
    d = spark.createDataFrame([(1, 1, "line", 0.0, 10.0, 50.0, 10.5), (1, 1, "line", 0.0, 10.0, 90.0, 10.0), (1, 1, "rect", 0.0, 10.0, 20.0, 11.5), (1, 1, "rect", 0.0, 10.0, 10.0, 10.0)], "doc_id long, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.x1 for r in L.fraction_bars(d, F.lit(100.0)).collect()) == [20.0, 50.0]
    assert L.page_lines(spark.createDataFrame([], G), spark.createDataFrame([], B)).collect() == []


def test_sections_and_boilerplate(spark):
    rows = [(1, 1, 1, "HEADER", 10.0), (1, 1, 2, "1.1 Mở đầu", 12.0), (1, 1, 3, "thân", 10.0), (1, 2, 1, "HEADER", 10.0), (1, 2, 2, "tiếp", 10.0), (1, 3, 1, "HEADER", 10.0), (1, 3, 2, "1.2 f(x) = 2", 12.0), (1, 4, 1, "cuối", 10.0), (1, 4, 2, "cuối nữa", 10.0), (2, 1, 1, "HEADER", 10.0), (2, 2, 1, "HEADER", 10.0)]
    kept = L.drop_boilerplate(spark.createDataFrame(rows, L.LINE))
    assert sorted({r.doc_id for r in kept.where("line = 'HEADER'").collect()}) == [2]
    got = [(r.page, r.section, r.text) for r in L.blocks(kept.where("doc_id = 1")).orderBy("page").collect()]
    assert got == [(1, "1.1 Mở đầu", "thân"), (2, "1.1 Mở đầu", "tiếp"), (3, "1.1 Mở đầu", "1.2 f(x) = 2"), (4, "1.1 Mở đầu", "cuối\ncuối nữa")]


def test_stream_lifecycles(spark, tmp_path):
    rows = [(1, 0, "route"), (1, 1, "final"), (1, 2, "error"), (2, 0, "route"), (3, 0, "cancel"), (3, 1, "final")]
    spark.createDataFrame(rows, "id long, seq int, type string").coalesce(1).write.parquet(f"{tmp_path}/e")
    out = traces.run_once(traces.lifecycles(spark.readStream.schema("id long, seq int, type string").parquet(f"{tmp_path}/e")), "update", Scratch(spark), "s")
    assert sorted((r.id, r.status, r.events) for r in out.collect()) == [(1, "complete", 2), (2, "processing", 1), (3, "cancelled", 1)]
    frames = spark.createDataFrame([('event: a\ndata: {"x":1}\n\n: note\n\nevent: b\ndata: bad{\n\n',)], "f string")
    assert [(e.type, e.data) for e in frames.select(traces.sse_events(F.col("f"))).first()[0]] == [("a", '{"x":1}')]
    docs = spark.readStream.schema("id long, seq int, type string").parquet(f"{tmp_path}/e").withColumnRenamed("id", "doc_id")
    live = lambda: spark.createDataFrame([(1,)], "doc_id long")
    traces.ingest(docs, live, lambda d: d, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").start().awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1}
