"""p4: oversized chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.splitting import coarsest_boundaries, split_oversized


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk over the limit with the coarsest boundary at which cutting suffices."""
    return coarsest_boundaries(spark.read.parquet(f"{d}/chunks.parquet").select("id", "text"), "id", "text")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All chunks as pieces within the limit, numbered anew in each document."""
    c = spark.read.parquet(f"{d}/chunks.parquet").select("id", "document_id", "chunk_index", "section", "text")
    return split_oversized(c, "id", "document_id", "chunk_index", "text", ["section"]).withColumnsRenamed({"piece_index": "chunk_index", "piece": "text"})


def queries() -> dict:
    return {"p4_found": p4_found, "p4_pieces": p4_pieces}


def oracle_sql() -> dict[str, str]:
    return {}  # not expressible: tested against brute force and for whole coverage
