"""Tables of the store and of indexes: reading with defaults, markdown question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_with_defaults(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table under a fixed schema: columns that its files don't have yet are null."""
    return spark.read.schema(schema).option("mergeSchema", "true").parquet(path)


def markdown_questions(spark: SparkSession, path: str, difficulty: str) -> DataFrame:
    """Rows of a markdown table whose first cell is a number: qid, question, expected, difficulty. Other lines are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).where(F.trim("value").startswith("|")).select(cells.alias("c")).where((F.size("c") >= 3) & F.col("c")[0].rlike(r"^\d+$"))
    return rows.select(F.concat(F.substring(F.lit(difficulty), 1, 1), F.col("c")[0]).alias("qid"), F.col("c")[1].alias("question"), F.col("c")[2].alias("expected"), F.lit(difficulty).alias("difficulty"))

