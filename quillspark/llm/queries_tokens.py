"""p6: token ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.tokens import encode_corpus


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the ids of its text by byte_bpe_50k."""
    return encode_corpus(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id", "text")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per language label: documents, tokens."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    n = p6_ids(spark, d).select("doc_id", F.size("ids").alias("n"))
    return docs.join(n, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))


def queries() -> dict:
    return {"p6_ids": p6_ids, "p6_counts": p6_counts}


def oracle_sql() -> dict[str, str]:
    return {}  # not expressible: tested against the tokenizer's own encoding of whole texts
