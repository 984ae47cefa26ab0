"""p3: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import references as R
from quillspark.shared import Scratch


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orphan references of messages and chunks."""
    m = _read(spark, d, "messages").select("id", "citations", "created_at")
    c = _read(spark, d, "chunks").select("id", "document_id", "created_at")
    docs = _read(spark, d, "documents").select("doc_id", "created_at")
    return R.orphan_references(m, c, docs, _read(spark, d, "document_log"), Scratch(spark)).select("src_table", "period", "src_id", "ref_table", "ref_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table and month."""
    return p3_found(spark, d).groupBy("src_table", "ref_table", "period").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("src_id").alias("sources"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Citations whose (chunk, document) pair agrees with no chunk row, under partial match: one known half suffices where the other is null."""
    m = _read(spark, d, "messages").select("id", "citations", "created_at").dropDuplicates(["id"])
    c = _read(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id").distinct()
    cited = R.cited_ids(m).select(F.col("id").alias("message_id"), "chunk_id", "document_id").distinct()
    return R.orphans(cited, ["chunk_id", "document_id"], c, match="partial")


_CITED = """
  m as (select distinct id, created_at, citations from messages where citations is not null),
  cited as (
    select id, created_at, try_cast(trim(json_extract_string(j, '$.chunk_id')) as bigint) as chunk_id,
      try_cast(trim(json_extract_string(j, '$.document_id')) as bigint) as document_id
    from (select id, created_at, unnest(case when json_valid(citations) and json_type(citations::json) = 'ARRAY' then from_json(citations::json, '["json"]') end) as j from m))
"""
_FOUND = f"""
with {_CITED},
  refs as (
    select 'messages' src_table, created_at, id src_id, 'chunks' ref_table, chunk_id ref_id from cited
    union select 'messages', created_at, id, 'documents', document_id from cited
    union select 'chunks', created_at, id, 'documents', document_id from chunks),
  last as (select document_id, arg_max(change, (changed_at, change)) as change from document_log group by 1),
  target as (
    select 'documents' ref_table, doc_id ref_id, min(created_at) ref_at from documents
    where doc_id not in (select document_id from last where change = 'delete') group by 2
    union all select 'chunks', id, min(created_at) from chunks group by 2),
  found as (
    select distinct src_table, strftime(created_at, '%Y-%m') as period, src_id, ref_table, ref_id from refs r
    where ref_id is not null and not exists (select 1 from target t where t.ref_table = r.ref_table and t.ref_id = r.ref_id and not coalesce(t.ref_at > r.created_at, false)))
"""


def queries() -> dict:
    return {"p3_found": p3_found, "p3_report": p3_report, "p3_pairs": p3_pairs}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _FOUND + "select * from found",
        "p3_report": _FOUND + "select src_table, ref_table, period, count(*) as orphans, count(distinct src_id) as sources from found group by all",
        "p3_pairs": f"""with {_CITED}
          select distinct id as message_id, chunk_id, document_id from cited c
          where (chunk_id is not null or document_id is not null) and not exists (
            select 1 from chunks k where (c.chunk_id is null or k.id = c.chunk_id) and (c.document_id is null or k.document_id = c.document_id))""",
    }
