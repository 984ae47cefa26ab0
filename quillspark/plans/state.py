"""Sessions, messages, summaries, documents and their chunks as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import evaluation as E
from quillspark.operators import references
from quillspark.operators import state as T
from quillspark.operators.ordering import with_previous
from quillspark.settings import Settings
from quillspark.shared import Scratch

S = Settings()


def _read(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def message_counts(spark: SparkSession, d: str) -> DataFrame:
    """Messages per session."""
    return T.once(_read(spark, d, "messages", "id", "session_id")).groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))


def session_list(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with their message counts, last updated first: place."""
    n = message_counts(spark, d).withColumnRenamed("session_id", "id")
    return _read(spark, d, "sessions").join(n, "id", "left").select("id", "title", "updated_at", F.coalesce("messages", F.lit(0)).alias("messages")).orderBy(F.desc("updated_at"), "id")


def recent_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 6 messages of each session."""
    m = T.once(_read(spark, d, "messages", "id", "session_id", "role", "content"))
    return T.recent(m, S.history_window).select("session_id", "id", "back", F.substring("content", 1, 200).alias("preview"))


def prompt_transcript(spark: SparkSession, d: str) -> DataFrame:
    """The last 4 messages of each session as a transcript with speaker names."""
    m = T.once(_read(spark, d, "messages", "id", "session_id", "role", "content"))
    role = F.lower(F.regexp_replace("role", r"^\s+|\s+$", ""))
    line = F.concat(F.when(role == "user", "Người dùng").when(role == "assistant", "Trợ lý").otherwise("Khác"), F.lit(": "), F.coalesce(F.substring("content", 1, 200), F.lit("")))
    said = T.recent(m, S.prompt_history).select("session_id", "id", line.alias("line")).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("l"))
    return said.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def summary_window(spark: SparkSession, d: str) -> DataFrame:
    """Messages that a new summary has to take in."""
    return T.to_summarise(T.once(_read(spark, d, "messages", "id", "session_id")), _read(spark, d, "conversation_summaries"), S)


def latest_summary(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "conversation_summaries", "id", "session_id", "summary", "summarized_up_to")
    return T.current_view(c, "session_id", ["id"])


def upsert_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summaries after sessions with something to summarise got a new one."""
    new = summary_window(spark, d).groupBy("session_id").agg(F.max("id").alias("summarized_up_to"), F.count(F.lit(1)).alias("n"))
    return T.upsert_summaries(_read(spark, d, "conversation_summaries"), new.select("session_id", F.concat(F.lit("Gồm "), F.col("n"), F.lit(" tin nhắn")).alias("summary"), "summarized_up_to"))


def session_title(spark: SparkSession, d: str) -> DataFrame:
    """Sessions titled by the first 60 characters of their first message."""
    m = T.once(_read(spark, d, "messages", "id", "session_id", "content"))
    first = m.groupBy(F.col("session_id").alias("id")).agg(F.min_by(F.substring("content", 1, 60), "id").alias("title"))
    return T.partial_update(_read(spark, d, "sessions", "id", "title"), "id", first, ["title"])


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    m = T.once(_read(spark, d, "messages", "id", "status"))
    docs = _read(spark, d, "documents", "doc_id", "status")
    both = m.select(F.lit("messages").alias("tbl"), "status").unionByName(docs.select(F.lit("documents").alias("tbl"), "status"))
    return both.groupBy("tbl", "status").agg(F.count(F.lit(1)).alias("n"))


def stale_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Statuses after what is still processing ten minutes before the last message is failed."""
    m = T.once(_read(spark, d, "messages", "id", "status", "created_at"))
    last = m.agg((F.max("created_at") - F.expr(f"interval {S.stale_minutes} minutes")).alias("cutoff"))
    return T.stale(m.join(F.broadcast(last)), F.col("cutoff")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("was_stale").alias("stale"))


def admission(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that take no new message now, as one is processing."""
    busy = _read(spark, d, "messages", "session_id", "status").where("status = 'processing'").select(F.col("session_id").alias("id"))
    return _read(spark, d, "sessions", "id").join(busy, "id", "left_semi")


def missing_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that messages name but that have no row."""
    m = _read(spark, d, "messages", "session_id").where("session_id is not null").distinct()
    return m.join(_read(spark, d, "sessions", "id").withColumnRenamed("id", "session_id"), "session_id", "left_anti")


def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    """What is left of documents and chunks after the log's deletions: counts."""
    docs, chunks = _read(spark, d, "documents", "doc_id"), T.once(_read(spark, d, "chunks", "id", "document_id"))
    gone = references.deleted_documents(_read(spark, d, "document_log")).withColumnRenamed("document_id", "doc_id")
    left = T.cascade_delete(docs, "doc_id", gone, {"chunks": (chunks, "document_id")})
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(name).alias("tbl"), "n_left")
    return count(left["parent"], "documents").unionByName(count(left["chunks"], "chunks"))


def document_states(spark: SparkSession, d: str) -> DataFrame:
    """The last logged change of each document."""
    return T.current_view(_read(spark, d, "document_log").distinct(), "document_id", ["changed_at", "change"])


def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents", "n_chunks").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chunks").alias("chunks"))


def stale_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose n_chunks isn't the number of their chunks."""
    n = T.once(_read(spark, d, "chunks", "id", "document_id")).groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("actual"))
    j = _read(spark, d, "documents", "doc_id", "n_chunks").join(n, "doc_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return j.where(~F.col("n_chunks").eqNullSafe(F.col("actual").cast("int")))


def index_drift(spark: SparkSession, d: str) -> DataFrame:
    """Chunks against a vector index of those with an embedding of the right length."""
    c = _read(spark, d, "chunks", "id", "embedding")
    return T.drift(c.select("id"), c.where("size(embedding) = 64").select("id"))


def embed_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Keys of index texts that have to be embedded: those no chunk with a full embedding has."""
    c = T.once(_read(spark, d, "chunks", "id", "text", "embedding"))
    keyed = c.select(X.content_key(F.lit("model"), F.col("text")).alias("key"), (F.size("embedding") == 64).alias("there")).where("key is not null")
    return T.cache_misses(keyed, keyed.where("there"))


def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Texts ingested under several ids: how many documents, the smallest id."""
    docs = _read(spark, d, "documents", "doc_id", "text").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def contextual_header(spark: SparkSession, d: str) -> DataFrame:
    """Index texts of chunks: under title and section of their document; by key and length."""
    c = T.once(_read(spark, d, "chunks", "id", "document_id", "section", "text"))
    docs = _read(spark, d, "documents", "doc_id", "title").withColumnRenamed("doc_id", "document_id")
    text = X.index_text(F.col("title"), F.col("section"), F.col("text"))
    return c.join(docs, "document_id").select("id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("sha"))


def chunk_previous(spark: SparkSession, d: str) -> DataFrame:
    """The chunk before each chunk in its document, however many chunks that has."""
    c = T.once(_read(spark, d, "chunks", "id", "document_id", "chunk_index")).where("document_id is not null")
    return with_previous(c, ["document_id"], ["chunk_index", "id"], {"id": "previous_id"}, Scratch(spark)).select("id", "previous_id")


def citations_used(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each message and those its content refers to by label."""
    m = T.once(_read(spark, d, "messages", "id", "content", "citations")).where("citations is not null")
    items = F.expr("try_variant_get(try_parse_json(citations), '$', 'array<variant>')")
    labels = F.transform(items, lambda x: F.try_variant_get(x, "$.label", "int"))
    used = F.array_intersect(labels, X.cited_labels(F.coalesce("content", F.lit(""))))
    return m.where(items.isNotNull()).select("id", F.size(labels).alias("n_citations"), F.size(used).alias("n_used"))


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The context of each message: its citations as labelled blocks, by length."""
    m = T.once(_read(spark, d, "messages", "id", "citations")).where("citations is not null")
    items = F.expr("try_variant_get(try_parse_json(citations), '$', 'array<variant>')")
    c = m.select("id", F.explode(items).alias("c")).select("id", F.try_variant_get("c", "$.label", "int").alias("label"), F.try_variant_get("c", "$.doc_source", "string").alias("src"), F.try_variant_get("c", "$.page", "int").alias("page"))
    head = F.concat(F.lit("["), F.coalesce(F.col("label").cast("string"), F.lit("")), F.lit("] ("), F.coalesce("src", F.lit("")), F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit(", trang "), F.col("page"))).otherwise(""), F.lit(")"))
    packed = c.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("label", head.alias("h")))).alias("l"))
    return packed.select("id", F.array_join(F.transform("l", lambda x: x["h"]), "\n\n").alias("context"))


def trace_types(spark: SparkSession, d: str) -> DataFrame:
    """Trace events by type."""
    return T.trace_events(T.once(_read(spark, d, "messages", "id", "trace"))).groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("id").alias("messages"))


def trace_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per message: its route, its iterations, whether it converged."""
    e = T.trace_events(T.once(_read(spark, d, "messages", "id", "trace")))
    get = lambda k: F.get_json_object("data", f"$.{k}")
    return e.groupBy("id").agg(F.count(F.lit(1)).alias("events"), F.max_by(F.when(F.col("type") == "route", get("route")), F.when(F.col("type") == "route", F.col("seq"))).alias("route"), F.max(get("iteration").cast("int")).alias("iterations"), F.max(F.col("type") == "converged").alias("converged"))


def trace_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Per status of messages, taken as a scenario, which expected events its traces miss and which forbidden ones they have."""
    m = T.once(_read(spark, d, "messages", "id", "trace", "status"))
    seen = T.trace_events(m).join(m.select("id", F.col("status").alias("scenario")), "id").select("scenario", "type").distinct()
    expect = m.select(F.col("status").alias("scenario")).where("scenario is not null").distinct()
    expect = expect.select("scenario", F.array(F.lit("route"), F.lit("synthesize")).alias("expect"), F.array(F.lit("converged")).alias("forbid"))
    out = E.scenario_checks(seen, expect)
    return out.select("scenario", F.size("missing").alias("missing"), F.size("forbidden").alias("forbidden"), "passed")


def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Trace events as event-stream frames, by digest."""
    e = T.trace_events(T.once(_read(spark, d, "messages", "id", "trace")))
    frame = F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), F.col("data"), F.lit("\n\n"))
    return e.select("id", "seq", F.md5(frame).alias("frame"))


_M = "m as materialized (select distinct on (id) * from messages)"


def queries() -> dict:
    fs = [message_counts, session_list, recent_history, prompt_transcript, summary_window, latest_summary, upsert_summary, session_title, status_counts, stale_cleanup, admission, missing_sessions, delete_documents, document_states, kb_stats, stale_chunk_counts, index_drift, embed_cache_misses, content_duplicates, contextual_header, chunk_previous, citations_used, context_blocks, trace_types, trace_metrics, trace_scenarios, sse_frames]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    win = f"""with {_M}, n as (select session_id, count(*) as total from m group by 1 having count(*) > 12),
      r as (select session_id, id, row_number() over (partition by session_id order by id desc) as back from m),
      u as (select session_id, min(id) as until from r where back <= 6 group by 1), s as (select session_id, arg_max(summarized_up_to, id) as upto from conversation_summaries group by 1),
      w as (select m.session_id, m.id from m join n using (session_id) join u using (session_id) left join s using (session_id) where m.id > coalesce(upto, 0) and m.id < until)"""
    cit = f"""with {_M}, j as (select id, content, case when json_valid(citations) and json_type(citations::json) = 'ARRAY' then from_json(citations::json, '["json"]') end as js from m where citations is not null)"""
    tr = f"""with {_M}, j as (select id, case when json_valid(trace) and json_type(trace::json) = 'ARRAY' then from_json(trace::json, '["json"]') end as js from m where trace is not null),
      e as (select id, unnest(js) as e, generate_subscripts(js, 1) as seq from j where js is not null), t as (select id, seq, json_extract_string(e, '$.type') as type, json_extract(e, '$.data')::varchar as data from e)"""
    chunks = "c as (select distinct on (id) * from chunks)"
    return {
        "message_counts": f"with {_M} select session_id, count(*) as messages from m group by 1",
        "session_list": f"with {_M} select s.id, s.title, s.updated_at, count(m.id) as messages from sessions s left join m on m.session_id = s.id group by all",
        "recent_history": f"with {_M} select session_id, id, back::int as back, substring(content, 1, 200) as preview from (select *, row_number() over (partition by session_id order by id desc) as back from m) where back <= 6",
        "prompt_transcript": f"""with {_M}, r as (select *, row_number() over (partition by session_id order by id desc) as back, lower(regexp_replace(role, '^\\s+|\\s+$', '', 'g')) as rl from m)
          select session_id, string_agg(case rl when 'user' then 'Người dùng' when 'assistant' then 'Trợ lý' else 'Khác' end || ': ' || coalesce(substring(content, 1, 200), ''), chr(10) order by id) as transcript from r where back <= 4 group by 1""",
        "summary_window": win + " select session_id, id from w",
        "latest_summary": "select session_id, arg_max(id, id) as id, arg_max(summary, id) as summary, arg_max(summarized_up_to, id) as summarized_up_to from conversation_summaries group by 1",
        "upsert_summary": win + """, o as (select session_id, arg_max(summary, id) as summary, arg_max(summarized_up_to, id) as upto from conversation_summaries group by 1), nw as (select session_id, max(id) as upto, count(*) as n from w group by 1)
          select session_id, coalesce('Gồm ' || nw.n || ' tin nhắn', o.summary) as summary, coalesce(nw.upto, o.upto) as summarized_up_to, case when nw.upto is null then 'kept' when o.upto is null then 'added' else 'updated' end as action from o full join nw using (session_id)""",
        "session_title": f"with {_M} select s.id, coalesce(f.title, s.title) as title from sessions s left join (select session_id, arg_min_null(substring(content, 1, 60), id) as title from m group by 1) f on f.session_id = s.id",
        "status_counts": f"with {_M} select 'messages' as tbl, status, count(*) as n from m group by all union all select 'documents', status, count(*) from documents group by all",
        "stale_cleanup": f"with {_M}, x as (select *, status = 'processing' and created_at < (select max(created_at) from m) - interval 10 minutes as old from m) select case when old then 'failed' else status end as status, count(*) as n, count(*) filter (where old) as stale from x group by 1",
        "admission": "select id from sessions where id in (select session_id from messages where status = 'processing')",
        "missing_sessions": "select distinct session_id from messages where session_id is not null and session_id not in (select id from sessions)",
        "delete_documents": f"""with {chunks}, gone as (select document_id from document_log group by 1 having arg_max(change, (changed_at, change)) = 'delete')
          select 'documents' as tbl, count(*) as n_left from documents where doc_id not in (from gone) union all select 'chunks', count(*) from c where document_id is null or document_id not in (from gone)""",
        "document_states": "select document_id, arg_max(change, (changed_at, change)) as change, max(changed_at) as changed_at from document_log group by 1",
        "kb_stats": "select count(*) as documents, sum(n_chunks)::bigint as chunks from documents",
        "stale_chunk_counts": f"with {chunks}, n as (select document_id, count(*) as a from c group by 1) select doc_id, n_chunks, coalesce(a, 0) as actual from documents left join n on document_id = doc_id where n_chunks is distinct from coalesce(a, 0)",
        "index_drift": f"with {chunks} select count(*) filter (where coalesce(len(embedding), -1) != 64) as missing, 0::bigint as extra, count(*) filter (where len(embedding) = 64) as both, bool_and(coalesce(len(embedding), -1) = 64) as in_sync from c",
        "embed_cache_misses": f"with {chunks}, k as (select sha256('model::' || text) as key, coalesce(len(embedding) = 64, false) as there from c where text is not null) select distinct key from k where key not in (select key from k where there)",
        "content_duplicates": "select sha256(text) as sha, count(*) as copies, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1",
        "contextual_header": f"""with {chunks}, h as (select c.id, c.text, concat_ws(' › ', nullif(title, ''), nullif(section, '')) as head from c join documents on doc_id = document_id),
          x as (select id, case when head = '' then text else head || chr(10) || text end as t from h) select id, length(t)::int as n_chars, sha256(t) as sha from x""",
        "chunk_previous": f"with {chunks} select id, lag(id) over (partition by document_id order by chunk_index nulls first, id) as previous_id from c where document_id is not null",
        "citations_used": cit + """, l as (select id, list_transform(js, lambda x: try_cast(json_extract_string(x, '$.label') as int)) as labels, list_transform(regexp_extract_all(coalesce(content, ''), '\\[(\\d{1,9})\\]', 1), lambda x: x::int) as cited from j where js is not null)
          select id, len(labels)::int as n_citations, len(list_distinct(list_intersect(labels, cited)))::int as n_used from l""",
        "context_blocks": cit + """, c as (select id, unnest(js) as c from j where js is not null), f as (select id, try_cast(json_extract_string(c, '$.label') as int) as label, json_extract_string(c, '$.doc_source') as src, try_cast(json_extract_string(c, '$.page') as int) as page from c),
          h as (select id, label, '[' || coalesce(label::varchar, '') || '] (' || coalesce(src, '') || case when coalesce(page, 0) != 0 then ', trang ' || page else '' end || ')' as h from f)
          select id, string_agg(h, chr(10) || chr(10) order by label nulls first, h) as context from h group by 1""",
        "trace_types": tr + " select type, count(*) as events, count(distinct id) as messages from t where type is distinct from 'thinking' group by 1",
        "trace_metrics": tr + " select id, count(*) as events, arg_max(json_extract_string(data, '$.route'), seq) filter (where type = 'route') as route, max(try_cast(json_extract_string(data, '$.iteration') as int)) as iterations, bool_or(type = 'converged') as converged from t where type is distinct from 'thinking' group by 1",
        "trace_scenarios": tr + """, s as (select status as scenario, list_distinct(flatten(list(coalesce(k, [])))) as seen from m left join (select id, list(type) as k from t where type is distinct from 'thinking' group by 1) using (id) where status is not null group by 1),
          c as (select scenario, len(list_filter(['route', 'synthesize'], lambda x: not list_contains(seen, x)))::int as missing, len(list_filter(['converged'], lambda x: list_contains(seen, x)))::int as forbidden from s)
          select scenario, missing, forbidden, missing = 0 and forbidden = 0 as passed from c""",
        "sse_frames": tr + " select id, seq::int as seq, md5('event: ' || type || chr(10) || 'data: ' || data || chr(10) || chr(10)) as frame from t where type is distinct from 'thinking'",
    }
