"""p1: the most similar chunks of every chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.neighbours import most_similar


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar other chunks of every chunk with a usable embedding, ranked."""
    return most_similar(spark.read.parquet(f"{d}/chunks.parquet").select("id", "embedding"), "id", "embedding")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of which either is among the 10 most similar of the other."""
    return p1_neighbours(spark, d).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def queries() -> dict:
    return {"p1_found": p1_found, "p1_neighbours": p1_neighbours}


def oracle_sql() -> dict[str, str]:
    return {}  # approximate: recall is tested against brute force
