"""Layout over glyphs placed from titles: every character of a title in its own cell, eight cells a blank apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import layout as L


def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    """Titles written as glyphs, one line for each, and read again."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "title").where("title is not null")
    words = F.filter(F.split(F.regexp_replace("title", r"[\s\p{Z}]+", " "), " "), lambda x: x != "")
    flat = docs.select("doc_id", F.array_join(words, " ").alias("t"))
    g = flat.select("doc_id", F.posexplode(F.filter(F.transform(F.split("t", ""), lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda s: s["c"] != "")).alias("p", "s")).where("s.c != ' '")
    x = F.col("s.i") * 6.0
    glyphs = g.select("doc_id", F.lit(1).alias("page"), F.col("s.c").alias("c"), x.alias("x0"), (x + 5.5).alias("x1"), (x + 2.75).alias("cx"), F.lit(20.0).alias("cy"), F.lit(10.0).alias("size"))
    bars = spark.createDataFrame([], "doc_id bigint, page int, x0 double, x1 double, y double")
    return L.page_lines(glyphs, bars).select("doc_id", "line_no", "line")


def queries() -> dict:
    return {"layout_lines": layout_lines}


def oracle_sql() -> dict[str, str]:
    flat = "trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g'), ' ')"
    return {"layout_lines": f"select doc_id, 1 as line_no, {flat} as line from documents where title is not null and {flat} != ''"}
