import gzip
import zlib

from pyspark.sql import functions as F

from quillspark.operators import evaluation as E
from quillspark.sources import parsed as P


def test_parser_blocks(spark):
    kind = "k int, content string, embed string, blocks array<struct<type:string,page:int,content:string>>"
    rows = [
        (1, "lost[[START OF PAGE 2]] a [[START OF PAGE 3]]  b", "e", [("Text", 3, "x"), ("Title", 2, "T")]),
        (2, " plain ", None, [("Text", 5, "x"), ("Text", 4, "y")]), (3, "  ", None, [("Text", 1, "x")]), (4, None, None, None),
    ]
    got = sorted((r.k, r.page, r.section, r.text, r.embed_text) for r in P.parser_blocks(spark.createDataFrame(rows, kind), ["k"]).collect())
    assert got == [(1, 2, "T", "a", "e"), (1, 3, "T", "b", "e"), (2, 4, None, "plain", None)]


def test_bodies(spark):
    raw = "chữ".encode()
    bare = zlib.compressobj(wbits=-15)
    rows = [(1, gzip.compress(raw), "GZIP"), (2, zlib.compress(raw), "deflate"), (3, bare.compress(raw) + bare.flush(), "deflate"), (4, raw, None), (5, b"bad", "gzip"), (6, None, "gzip")]
    df = spark.createDataFrame([(i, bytearray(b) if b else None, e) for i, b, e in rows], "i int, b binary, e string")
    got = {r.i: r.x and bytes(r.x) for r in df.select("i", P.decompressed(F.col("b"), F.col("e")).alias("x")).collect()}
    assert got == {1: raw, 2: raw, 3: raw, 4: raw, 5: None, 6: None}
    df = spark.createDataFrame([(1, bytearray("é".encode("latin-1")), "text/html; charset=ISO-8859-1"), (2, bytearray("é".encode()), None), (3, bytearray(b"a\xff"), "text/plain")], "i int, b binary, t string")
    assert [r[0] for r in df.orderBy("i").select(P.decoded(F.col("b"), F.col("t"))).collect()] == ["é", "é", "a�"]
    df = spark.createDataFrame([("text/html", "x"), ("application/pdf", "<html"), (None, "<!DOCTYPE html>"), (None, None)], "t string, h string")
    assert [r[0] for r in df.select(P.is_text(F.col("t"), F.col("h"))).collect()] == [True, False, True, False]
    b = spark.createDataFrame([(1, 2, "a", 1), (1, None, "b", 1)], "doc_id int, page int, text string, ord int")
    assert [r.text for r in P.union_blocks(b, b.withColumn("text", F.upper("text"))).collect()] == ["b", "B", "a", "A"]


def test_ab_and_scenarios(spark):
    runs = spark.createDataFrame([("A", "A", 1.0, 3.0), ("B", "A", 3.0, 4.0), ("A", "?", 1.0, 4.0), ("B", "?", 1.0, 5.0)], "variant string, preferred string, seconds double, quality double")
    r = E.ab_summary(runs, ["quality"]).first()
    assert (r.quality_a, r.quality_b, r.quality_delta, r.prefer_a, r.prefer_b, r.prefer_tie, r.time_ratio) == (3.5, 4.5, 1.0, 1, 0, 1, 2.0)
    t = spark.createDataFrame([("s1", "route"), ("s1", "plan"), ("s2", "error")], "scenario string, type string")
    s = spark.createDataFrame([("s1", ["route", "plan"], ["error"]), ("s2", ["route"], ["error"]), ("s3", ["route"], None)], "scenario string, expect array<string>, forbid array<string>")
    assert {x.scenario: (x.missing, x.forbidden, x.passed) for x in E.scenario_checks(t, s).collect()} == {"s1": ([], [], True), "s2": (["route"], ["error"], False), "s3": (["route"], [], False)}
