"""p5: texts that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import forms

FIELDS = [("chunks", "id", "text"), ("documents", "doc_id", "title"), ("messages", "id", "content")]


def _fields(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, key, col in FIELDS:
        one = spark.read.parquet(f"{d}/{table}.parquet").select(F.lit(f"{table}.{col}").alias("field"), F.col(key).alias("id"), F.col(col).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts of one field that look the same but aren't identical."""
    rows = _fields(spark, d)
    return forms.looks_same_pairs(rows, "field", "id", "text", forms.corpus_classes([(rows, "text")]))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three fields with its class of equal looks: the same links in one row for each text."""
    rows = _fields(spark, d)
    return forms.looks_same_classes(rows, "field", "id", "text", forms.corpus_classes([(rows, "text")]))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three fields in its one form."""
    rows = _fields(spark, d)
    form = forms.form_udf(forms.corpus_classes([(rows, "text")]))
    return rows.select("field", "id", form("text").alias("form")).dropDuplicates(["field", "id"])


def queries() -> dict:
    return {"p5_found": p5_found, "p5_classes": p5_classes, "p5_forms": p5_forms}


def oracle_sql() -> dict[str, str]:
    return {}  # not expressible: tested on small fixtures
