"""p8: sentences of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.sentences import sentence_arrays, sentences


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per sentence of documents.text with its end position."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return sentences(docs, "text").select("doc_id", "end_pos")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Sentences per document: how many and the longest span between two ends."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    e = sentence_arrays(docs, "text", "e")
    span = F.expr("array_max(transform(e, (x, i) -> x - if(i = 0, 0, e[i - 1])))")
    return e.select("doc_id", F.size("e").alias("sentences"), span.alias("longest"))


def queries() -> dict:
    return {"p8_found": p8_found, "p8_report": p8_report}


def oracle_sql() -> dict[str, str]:
    return {}  # not expressible: tested on small fixtures
