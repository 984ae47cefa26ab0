"""Structured Streaming over the event and message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import Scratch
from quillspark.streaming import traces as S


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files: a source reads a folder, so a single file is picked from its folder by name."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type from a stream."""
    e = stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.run_once(S.windowed_counts(e, "ts", "event_type", "1 day", "30 days"), "update", Scratch(spark), "counts")
    out = out.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))  # the last count of each window
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_lifecycles(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of messages as their trace events stream in, each ended by the event that its status implies."""
    m = stream_of(spark, d, "messages").where(F.trim(F.lower("role")) == "assistant")
    kinds = F.transform(F.coalesce(F.expr("try_variant_get(try_parse_json(trace), '$', 'array<variant>')"), F.expr("cast(array() as array<variant>)")), lambda e: F.try_variant_get(e, "$.type", "string"))
    end = F.when(F.col("status") == "complete", F.array(F.lit("final"))).when(F.col("status") == "failed", F.array(F.lit("error"))).when(F.col("status") == "cancelled", F.array(F.lit("cancel"))).otherwise(F.array().cast("array<string>"))
    events = m.select("id", F.posexplode(F.concat(F.array(F.lit("thinking")), kinds, end)).alias("seq", "type")).dropDuplicates(["id", "seq"]).where("type is not null")
    out = S.run_once(S.lifecycles(events), "update", Scratch(spark), "states")
    last = out.groupBy("id").agg(F.max_by(F.struct("status", "events", "last_type"), "batch").alias("s"))
    return last.select("id", "s.*")


def queries() -> dict:
    return {f.__name__: f for f in (stream_event_counts, stream_lifecycles)}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_event_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all",
        "stream_lifecycles": """with m as (select distinct on (id) * from messages where trim(lower(role), ' ') = 'assistant'),
          j as (select id, status, case when json_valid(trace) and json_type(trace::json) = 'ARRAY' then list_filter(list_transform(from_json(trace::json, '["json"]'), lambda x: json_extract_string(x, '$.type')), lambda x: x is not null) else [] end as k from m),
          a as (select id, status, ['thinking'] || coalesce(k, []) || case status when 'complete' then ['final'] when 'failed' then ['error'] when 'cancelled' then ['cancel'] else [] end as k from j)
          select id, case when status in ('complete', 'failed', 'cancelled') then status else 'processing' end as status, len(k)::int as events, k[-1] as last_type from a""",
    }
