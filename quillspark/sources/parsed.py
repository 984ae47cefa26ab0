"""Results of external parsers and fetched bodies as blocks and text."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

START_OF_PAGE = r"\[\[START OF PAGE (\d+)\]\]"


def parser_blocks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of parser chunks: keys, page, section, text, embed_text.

    ``chunks`` has keys, content, embed and blocks (array of type, page). The page is the smallest of the blocks', the
    section the first Section Header or Title's content. Content with page marks gives a block a page, what stands
    before the first mark is dropped; blank blocks are too.
    """
    c = chunks.withColumn("page", F.array_min(F.transform("blocks", lambda b: b["page"])))
    heads = F.filter("blocks", lambda b: b["type"].isin("Section Header", "Title"))
    c = c.withColumn("section", F.get(F.transform(heads, lambda b: b["content"]), F.lit(0)))
    marks = F.regexp_extract_all("content", F.lit(START_OF_PAGE), F.lit(1))
    parts = F.slice(F.split("content", START_OF_PAGE), 2, 1_000_000)
    whole = F.array(F.struct(F.col("page").alias("page"), F.col("content").alias("text")))
    by_page = F.transform(F.arrays_zip(marks.alias("m"), parts.alias("p")), lambda x: F.struct(x["m"].cast("int").alias("page"), x["p"].alias("text")))
    each = c.select(*keys, "section", "embed", F.explode(F.when(F.size(marks) > 0, by_page).otherwise(whole)).alias("b"))
    text = F.trim("b.text")
    return each.where(F.coalesce(text, F.lit("")) != "").select(*keys, F.col("b.page").alias("page"), "section", text.alias("text"), F.col("embed").alias("embed_text"))


def _inflate(s: pd.Series, how: pd.Series) -> pd.Series:
    def one(body, encoding):
        if body is None or encoding not in ("gzip", "deflate"):
            return body
        try:
            if encoding == "gzip":
                return gzip.decompress(body)
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompress(body, -zlib.MAX_WBITS)
        except (OSError, EOFError, zlib.error):
            return None

    return pd.Series([one(b, h) for b, h in zip(s, how)])


def decompressed(body: Column, encoding: Column) -> Column:
    """A fetched body as sent before compression: gzip, deflate with or without its header; null where it is damaged."""
    return F.pandas_udf(_inflate, BinaryType())(body, F.lower(F.coalesce(encoding, F.lit(""))))


def decoded(body: Column, content_type: Column) -> Column:
    """A body as text by the charset its content type names, UTF-8 by default; bytes that don't fit are replaced."""
    charset = F.upper(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=[\"']?([\w-]+)", 1))
    return F.when(charset.isin("ISO-8859-1", "LATIN-1", "LATIN1"), F.decode(body, "ISO-8859-1")).when(charset == "UTF-16", F.decode(body, "UTF-16")).otherwise(F.make_valid_utf8(body.cast("string")))


def is_text(content_type: Column, head: Column) -> Column:
    """Whether a response is text: by its content type or, without one, by its first characters."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.rlike(r"^text/|html|xml|json") | ((kind == "") & F.coalesce(F.lower(head).rlike(r"^\s*<(!doctype|html)"), F.lit(False)))


def union_blocks(local: DataFrame, transcribed: DataFrame) -> DataFrame:
    """Blocks of both origins in page order, local ones first on a page: doc_id, page, text, place."""
    both = local.withColumn("origin", F.lit(0)).unionByName(transcribed.withColumn("origin", F.lit(1)))
    return both.orderBy("doc_id", F.coalesce("page", F.lit(0)), "origin", "ord")
