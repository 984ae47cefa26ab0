"""Written indexes, inserts, ingest, reports and parsed inputs over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import chunking as C
from quillspark.operators import evaluation as E
from quillspark.operators import layout as L
from quillspark.operators import references
from quillspark.operators import retrieval as R
from quillspark.operators import state as T
from quillspark.operators.embedding import set_embeddings
from quillspark.plans import retrieval as P
from quillspark.plans.streams import stream_of
from quillspark.settings import Settings
from quillspark.shared import Scratch
from quillspark.sources import html as H
from quillspark.sources import parsed
from quillspark.sources.tables import read_with_defaults
from quillspark.streaming import traces as S

SET = Settings()


def _read(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def index_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 from an index of half of the documents, written by term, to which the other half was appended."""
    s = P._Search(spark, d)
    docs = s.scratch.save(P._docs(spark, d), "docs")
    first, both = f"{s.scratch.at}/first", f"{s.scratch.at}/both"
    R.write_index(docs.where("doc_id % 2 = 0"), "doc_id", "tokens", first, SET)
    R.append_to_index(first, docs.where("doc_id % 2 = 1"), "doc_id", "tokens", both, SET)
    return R.bm25(R.open_index(spark, both, SET), s.questions, "item_id", "tokens", "doc_id", SET.bm25_top_k, s.scratch)


def insert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after each document that has none got one, under new ids in order of the documents."""
    c = T.once(_read(spark, d, "chunks", "id", "document_id", "chunk_index"))
    new = _read(spark, d, "documents", "doc_id").join(c.select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti")
    return T.insert(c, "id", new.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index")), ["document_id"], Scratch(spark))


def repaired_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the length of their embedding after those of a wrong length got one of 64 cells."""
    c = T.once(_read(spark, d, "chunks", "id", "embedding"))
    wrong = c.where(F.coalesce(F.size("embedding") != 64, F.lit(True))).select("id", F.array_repeat(F.lit(0.125), 64).alias("embedding"))
    return set_embeddings(c, "id", wrong).groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"))


def joined_answers(spark: SparkSession, d: str) -> DataFrame:
    """Contents of messages cut into pieces of 24 characters, as they are streamed, and joined again: by digest."""
    m = T.once(_read(spark, d, "messages", "id", "content")).where("content is not null")
    pieces = m.select("id", F.posexplode(X.slices(F.col("content"), 24)).alias("seq", "text"))
    return T.joined_tokens(pieces, "id").select("id", F.md5("answer").alias("digest"))


def feature_usage(spark: SparkSession, d: str) -> DataFrame:
    """Messages with a trace by what their runs used: complex routes, convergence, context."""
    e = T.trace_events(T.once(_read(spark, d, "messages", "id", "trace")))
    get = lambda k: F.get_json_object("data", f"$.{k}")
    return E.feature_usage(e, {"complex": get("route") == "complex", "converged": F.col("type") == "converged", "with_context": get("n_context").cast("int") > 0})


def mean_relevant(spark: SparkSession, d: str) -> DataFrame:
    """The mean number of relevant documents of a question."""
    return E.mean_relevant(P._Search(spark, d).scores(), "item_id")


def eval_report(spark: SparkSession, d: str) -> DataFrame:
    """Report lines of the overall scores of each method."""
    s = E.summary(P._Search(spark, d).scores().withColumn("all", F.lit(1)), "all").where("overall = 1")
    return E.report_lines(s, "method", ["recall", "mrr", "hit"]).select("method", "line")


def ab_report(spark: SparkSession, d: str) -> DataFrame:
    """One A/B summary of sessions: their first two messages taken as the runs of variants A and B, lengths as seconds, ids as rubric and preference."""
    m = T.once(_read(spark, d, "messages", "id", "session_id", "content"))
    first = R.first_wins(m, "session_id", "id", ["id"])  # each id once
    ranked = T.recent(first, 2).withColumn("variant", F.when(F.col("back") == 1, "A").otherwise("B"))
    runs = ranked.select("variant", (F.coalesce(F.length("content"), F.lit(0)) / 100.0).alias("seconds"), (F.col("id") % 5 + 1).cast("double").alias("faithful"))
    liked = F.when(F.col("faithful") > 3, "A").when(F.col("faithful") > 2, "B").otherwise("?")
    return E.ab_summary(runs.withColumn("preferred", liked), ["faithful"])


def citation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of citations rounded to 2 digits as their binary values say."""
    m = T.once(_read(spark, d, "messages", "id", "citations")).where("citations is not null")
    items = F.expr("try_variant_get(try_parse_json(citations), '$', 'array<variant>')")
    one = m.select("id", F.posexplode(items).alias("place", "c")).select("id", "place", F.try_variant_get("c", "$.score", "double").alias("score"))
    return one.where("score is not null").select("id", "place", X.python_round(F.col("score"), 2).alias("score"))


def parser_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks read as a parser's results, their section as a header block: blocks by page and section."""
    c = T.once(_read(spark, d, "chunks", "id", "text", "page", "section", "embed_text"))
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.col("page").alias("page"), F.col(text).alias("content"))
    head = F.when(F.col("section").isNull(), F.array(block("Text", "text"))).otherwise(F.array(block("Section Header", "section"), block("Text", "text")))
    out = parsed.parser_blocks(c.select("id", F.col("text").alias("content"), F.col("embed_text").alias("embed"), head.alias("blocks")), ["id"])
    return out.select("id", "page", "section", F.length("text").alias("n_chars"), F.col("embed_text").isNotNull().alias("embeds"))


def chunk_bypass(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents, their stored chunks taken as blocks: those of documents with texts to embed stay as they are; chunks per document."""
    blocks = T.once(_read(spark, d, "chunks", "id", "document_id", "text", "embed_text")).where("document_id is not null")
    out = C.chunks_of(blocks, "document_id", "id", "text", "embed_text", SET.chunk_max_chars, SET.chunk_overlap)
    ready = out.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.coalesce(F.col("embed_text"), F.lit("")) != "").alias("ready"))
    return ready.where("ready").select("document_id", "chunks")


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages: the title element, for every third document a heading instead, for every fifth only the address."""
    docs = _read(spark, d, "documents", "doc_id", "title", "source").where("title is not null and source is not null")
    esc = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit(" ")), F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    i = F.col("doc_id")
    page = F.when(i % 5 == 0, F.lit("<html><body><p>x</p></body></html>")).when(i % 3 == 0, F.concat(F.lit("<html><body><h1 class='a'> <b>"), esc, F.lit("</b></h1></body></html>"))).otherwise(F.concat(F.lit("<html><head><TITLE>\n"), esc, F.lit("</TITLE></head><body><h1>no</h1></body></html>")))
    return docs.select("doc_id", H.title(page, F.col("source")).alias("title"))


def pdf_guesses(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether their source type, the head of their text or their address looks like a PDF."""
    docs = _read(spark, d, "documents", "doc_id", "source_type", "source", "text")
    kind = F.when((F.col("source_type") == "pdf") & (F.col("doc_id") % 2 == 0), "application/pdf; q=1").otherwise("text/html")
    return docs.groupBy("source_type", H.looks_like_pdf(kind, F.col("text"), F.col("source")).alias("pdf")).agg(F.count(F.lit(1)).alias("n"))


def defaulted_columns(spark: SparkSession, d: str) -> DataFrame:
    """Chunks read under a schema with a column that their files don't have."""
    c = read_with_defaults(spark, f"{d}/chunks.parquet", "id bigint, page int, added string")
    return T.once(c).groupBy(F.col("page").isNull().alias("no_page")).agg(F.count(F.lit(1)).alias("n"), F.count("added").alias("added"))


def math_glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Characters of titles under a mathematical font for every second document: how often each comes out."""
    docs = _read(spark, d, "documents", "doc_id", "title").where("title is not null")
    each = docs.select("doc_id", F.explode(F.split("title", "")).alias("c")).where("c != ''")
    font = F.when(F.col("doc_id") % 2 == 0, "ABCDEF+CMEX10").otherwise("Times")
    return each.groupBy(L.glyph_char(F.col("c"), font).alias("glyph")).agg(F.count(F.lit(1)).alias("n"))


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events read back from the frames of each message's trace, with a comment between frames: by type."""
    e = T.trace_events(T.once(_read(spark, d, "messages", "id", "trace"))).where("type is not null and data is not null")
    frame = F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), F.col("data"), F.lit("\n\n: ping\n\n"))
    sent = e.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", frame.alias("f")))).alias("fs")).select("id", F.array_join(F.transform("fs", lambda x: x["f"]), "").alias("frames"))
    return sent.select(F.explode(S.sse_events(F.col("frames"))).alias("e")).groupBy("e.type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("e.data")).alias("chars"))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents ingested from a stream, those deleted meanwhile left out: their chunks of at most 1,000 characters, counted."""
    docs = _read(spark, d, "documents", "doc_id")
    gone = references.deleted_documents(_read(spark, d, "document_log")).withColumnRenamed("document_id", "doc_id")
    path = f"{Scratch(spark).at}/ingested"
    pieces = lambda df: df.select("doc_id", F.explode(X.slices(F.col("text"), SET.chunk_max_chars)).alias("text"))
    writer = S.ingest(stream_of(spark, d, "documents"), lambda: docs.join(gone, "doc_id", "left_anti"), pieces, path)
    writer.option("checkpointLocation", f"{path}-checkpoint").start().awaitTermination()
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("n_chars"))


_M = "m as materialized (select distinct on (id) * from messages)"
_C = "c as materialized (select distinct on (id) * from chunks)"


def queries() -> dict:
    fs = [index_search, insert_chunks, repaired_embeddings, joined_answers, feature_usage, mean_relevant, eval_report, ab_report, citation_scores, parser_blocks, chunk_bypass, page_titles, pdf_guesses, defaulted_columns, math_glyphs, event_frames, stream_ingest]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    tr = f"""with {_M}, j as (select id, case when json_valid(trace) and json_type(trace::json) = 'ARRAY' then from_json(trace::json, '["json"]') end as js from m where trace is not null),
      e as (select id, unnest(js) as e from j where js is not null), t as (select id, json_extract_string(e, '$.type') as type, json_extract(e, '$.data')::varchar as data from e), u as (select * from t where type is null or type != 'thinking')"""
    esc = "replace(replace(replace(title, '&', ' '), '<', ' '), '>', ' ')"
    flat = f"nullif(trim(regexp_replace({esc}, '\\s+', ' ', 'g'), ' '), '')"
    path = "lower(case when regexp_matches(trim(source), '[\\s<>{}|^`]') then '' else coalesce(regexp_extract(trim(source), '^(?:\\w+://[^/?#]+)?([^?#]*)', 1), '') end)"
    return {
        "index_search": P.oracle_sql()["bm25_topk"],
        "insert_chunks": f"with {_C}, n as (select doc_id from documents where doc_id not in (select document_id from c where document_id is not null)) select id, document_id, chunk_index from c union all select (select max(id) from c) + row_number() over (order by doc_id), doc_id, 0 from n",
        "repaired_embeddings": f"with {_C} select 64 as dims, count(*) as n from c",
        "joined_answers": f"with {_M} select id, md5(regexp_replace(content, '^[\\s\\x0b\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x{{85}}\\p{{Z}}]+$', '', 'g')) as digest from m where content != ''",
        "feature_usage": tr + ", p as (select id, max(coalesce(json_extract_string(data, '$.route') = 'complex', false)) as complex, max(coalesce(type = 'converged', false)) as converged, max(coalesce(try_cast(json_extract_string(data, '$.n_context') as int) > 0, false)) as with_context from u group by 1) select count(*) as runs, count(*) filter (where complex) as complex, count(*) filter (where converged) as converged, count(*) filter (where with_context) as with_context from p",
        "mean_relevant": P._EVAL + "select count(*) as queries, round(avg(n_relevant), 6) as mean_relevant from (select distinct item_id, n_relevant from sc)",
        "eval_report": P._EVAL + "select method, printf('| %s | %.3f | %.3f | %.3f |', method, round(avg(recall), 6), round(avg(mrr), 6), round(avg(hit), 6)) as line from sc group by 1",
        "ab_report": f"""with {_M}, r as (select *, row_number() over (partition by session_id order by id desc) as back from m), x as (select case back when 1 then 'A' else 'B' end as v, coalesce(length(content), 0) / 100.0::double as s, (id % 5 + 1)::double as f from r where back <= 2)
          select round(avg(f) filter (where v = 'A'), 2) as faithful_a, round(avg(f) filter (where v = 'B'), 2) as faithful_b, round(avg(f) filter (where v = 'B') - avg(f) filter (where v = 'A'), 2) as faithful_delta, count(*) filter (where v = 'A' and f > 3) as prefer_a, count(*) filter (where v = 'A' and f > 2 and f <= 3) as prefer_b,
            count(*) filter (where v = 'A' and f <= 2) as prefer_tie, round(sum(s) filter (where v = 'B') / greatest(sum(s) filter (where v = 'A'), 0.01), 2) as time_ratio from x""",
        "citation_scores": f"""with {_M}, j as (select id, case when json_valid(citations) and json_type(citations::json) = 'ARRAY' then from_json(citations::json, '["json"]') end as js from m where citations is not null),
          e as (select id, unnest(js) as e, generate_subscripts(js, 1) - 1 as place from j where js is not null) select id, place::int as place, printf('%.2f', json_extract_string(e, '$.score')::double)::double as score from e where json_extract_string(e, '$.score') is not null""",
        "parser_blocks": f"with {_C} select id, page, section, length(trim(text, ' '))::int as n_chars, embed_text is not null as embeds from c where trim(text, ' ') != ''",
        "chunk_bypass": f"with {_C}, r as (select document_id from c where document_id is not null group by 1 having bool_or(coalesce(embed_text, '') != '')) select document_id, count(*) as chunks from c where document_id in (from r) and regexp_matches(text, '[^\\s\\x0b]') group by 1",
        "page_titles": f"select doc_id, case when doc_id % 5 = 0 then source else coalesce({flat}, case when doc_id % 3 = 0 then source else 'no' end) end as title from documents where title is not null and source is not null",
        "pdf_guesses": f"select source_type, coalesce(source_type = 'pdf' and doc_id % 2 = 0, false) or coalesce(starts_with(text, '%PDF'), false) or ends_with({path}, '.pdf') as pdf, count(*) as n from documents group by all",
        "defaulted_columns": f"with {_C} select page is null as no_page, count(*) as n, 0::bigint as added from c group by 1",
        "math_glyphs": "with e as (select doc_id, unnest(list_transform(range(1, length(title) + 1), lambda i: substring(title, i, 1))) as c from documents where title is not null) select case when doc_id % 2 = 0 then translate(c, 'XPqYZR', '∑∑√∏∫∫') else c end as glyph, count(*) as n from e group by 1",
        "event_frames": tr + " select type, count(*) as n, sum(length(data))::bigint as chars from u where type is not null and data is not null group by 1",
        "stream_ingest": "with g as (select document_id from document_log group by 1 having arg_max(change, (changed_at, change)) = 'delete') select doc_id, ceil(length(text) / 1000.0)::bigint as chunks, length(text) as n_chars from documents where length(text) > 0 and doc_id not in (from g)",
    }
