"""p7: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.leaks import leaks

FIELDS = ["question", "expected", "evidence"]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of a test item."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{d}/questions.parquet").select("item_id", *FIELDS)
    return leaks(docs, "doc_id", "text", items, "item_id", FIELDS)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items that leaked, with the number of documents they are found in."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict:
    return {"p7_found": p7_found, "p7_items": p7_items}


def oracle_sql() -> dict[str, str]:
    return {}  # not expressible: tested against brute force on small fixtures
