"""Text pipeline: normal forms, lines, headings, boilerplate, sentences, chunks, addresses, log lines, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import chunking as C
from quillspark.operators import layout as L
from quillspark.operators import state as T
from quillspark.plans.retrieval import _TOK
from quillspark.settings import Settings
from quillspark.shared import Scratch, spread
from quillspark.sources import html as H

S = Settings()


def _docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", *cols)


def nfc_texts(spark: SparkSession, d: str) -> DataFrame:
    """Composed texts with white space collapsed, by digest and length."""
    t = _docs(spark, d, "text").select("doc_id", F.regexp_replace(X.nfc("text"), r"\s+", " ").alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


def structured_texts(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d, "text").select("doc_id", X.normalize_structure("text").alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """Search tokens without stopwords and with parts of compounds, counted over all texts."""
    return spread(_docs(spark, d, "text")).select(F.explode(X.search_tokens("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def line_units(spark: SparkSession, d: str) -> DataFrame:
    """Lines per document, and how many must stay whole."""
    lines = C.lines(_docs(spark, d, "text"), "doc_id", "text").where("line != ''")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(X.is_atomic_line(F.col("line"))).alias("atomic"))


def section_ffill(spark: SparkSession, d: str) -> DataFrame:
    """Lines under the last heading before them, and the run of body lines they belong to: runs per document and section."""
    label = F.when((F.length("line") <= 80) & ~X.has_math(F.col("line")), X.heading_label(F.col("line")))
    lines = C.lines(_docs(spark, d, "text"), "doc_id", "text").where("line != ''").withColumn("label", label)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.withColumn("section", F.last("label", ignorenulls=True).over(w)).withColumn("run", F.sum(F.col("label").isNotNull().cast("int")).over(w)).where("label is null")
    return run.groupBy("doc_id", "run", "section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of chunks as lines of their document's pages: doc_id, page, line."""
    c = T.once(spark.read.parquet(f"{d}/chunks.parquet").select("id", "document_id", "page", "text")).where("document_id is not null and page is not null")
    lines = C.lines(c.select(F.struct("document_id", "page").alias("k"), "text"), "k", "text").where("line != ''")
    return lines.select(F.col("k.document_id").alias("doc_id"), "k.page", "line")


def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 1 to 60 characters that stand on half of a document's pages, three at least."""
    return L.boilerplate(_page_lines(spark, d))


def body_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines per page without boilerplate."""
    return L.drop_boilerplate(_page_lines(spark, d)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines"))


def empty_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages on which boilerplate leaves fewer than 200 characters."""
    lines = Scratch(spark).save(_page_lines(spark, d), "lines")
    return L.empty_pages(lines, L.drop_boilerplate(lines), 200)


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of prose lines by the packing rules, counted per document."""
    lines = C.lines(_docs(spark, d, "text"), "doc_id", "text").where("line != ''").where(~X.is_atomic_line(F.col("line")))
    return lines.groupBy("doc_id").agg(F.sum(F.size(C.sentences(F.col("line")))).alias("sentences"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Documents as overlapping chunks."""
    out = C.chunk_blocks(_docs(spark, d, "text"), ["doc_id"], "text", S.chunk_max_chars, S.chunk_overlap)
    return out.select("doc_id", "piece", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Sources by kind: whether they are valid addresses, their host, their file name."""
    s = _docs(spark, d, "source").where("source is not null")
    url = F.col("source")
    return s.select("doc_id", H.valid_url(url).alias("valid"), F.when(H.valid_url(url), F.try_parse_url(F.trim(url), F.lit("HOST"))).alias("host"), F.when(H.valid_url(url), H.file_name(url)).alias("file"))


def upload_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the code that their upload would be refused with, their text taken as content."""
    docs = _docs(spark, d, "source", "text", "n_chars")
    code = H.upload_error(F.col("n_chars"), F.when(F.col("source").endswith(".pdf"), "%PDF-").otherwise(F.col("text")), F.col("source"), 5_000)
    return docs.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Titles and visible text of pages made of documents: a navigation, the title, a paragraph for each line."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = _docs(spark, d, "title", "text").where("text is not null and title is not null")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    page = F.concat(F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title><script>x()</script></head><body><nav><p>menu</p></nav><article>"), body, F.lit("</article></body></html>"))
    text = docs.select("doc_id", H.visible(page).alias("t"))
    return text.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Events by type with what their properties hold."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"), F.countDistinct("user_id").alias("users"))


def log_latency(spark: SparkSession, d: str) -> DataFrame:
    """Key-value log lines written from events and read again: calls and mean duration of each node."""
    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.concat(F.lit("RAG_FLOW node="), F.col("event_type"), F.lit(" user="), F.col("user_id"), F.lit(" duration_ms="), F.col("event_id") % 1000)
    kv = F.str_to_map(F.regexp_replace(line, "^RAG_FLOW ", ""), F.lit(" "), F.lit("="))
    ms = kv["duration_ms"].cast("bigint")
    return e.select(kv["node"].alias("node"), ms.alias("ms")).groupBy("node").agg(F.count(F.lit(1)).alias("calls"), F.sum("ms").alias("ms"), F.max("ms").alias("slowest"))


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    return T.current_view(e, "user_id", ["ts", "event_id"])


def difficulty_labels(spark: SparkSession, d: str) -> DataFrame:
    """Question sets by difficulty, its labels brought to one spelling."""
    q = spark.read.parquet(f"{d}/questions.parquet")
    low = F.lower(F.trim(F.regexp_replace("difficulty", r"\*", "")))
    label = F.when(low.isin("easy", "dễ", "de"), "easy").when(low.isin("medium", "trung bình", "tb"), "medium").when(low.isin("hard", "khó", "kho"), "hard").otherwise("other")
    return q.groupBy("question_set", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def greetings(spark: SparkSession, d: str) -> DataFrame:
    """Messages that need no retrieval: greetings, by role."""
    m = T.once(spark.read.parquet(f"{d}/messages.parquet").select("id", "role", "content"))
    return m.groupBy(F.lower(F.trim("role")).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_greeting(F.col("content"))).alias("greetings"))


def order_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by nation of the customer: joins and sums over the star schema."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    li = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    j = li.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("rev").alias("rev"), F.count(F.lit(1)).alias("n"))
    c = j.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("rev").alias("rev"), F.sum("n").alias("n"))
    return c.join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("rev", 2).alias("revenue"), F.col("n").alias("items"))


def queries() -> dict:
    fs = [nfc_texts, structured_texts, search_terms, line_units, section_ffill, boilerplate_lines, body_lines, empty_pages, sentence_split, chunk_pack, url_parts, upload_checks, page_text, event_props, log_latency, latest_event, difficulty_labels, greetings, order_revenue]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    end = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"
    lines = f"l0 as (select doc_id, unnest(string_split_regex(text, {end})) as raw, generate_subscripts(string_split_regex(text, {end}), 1) as line_no from documents where text is not null), l as materialized (select doc_id, line_no, regexp_replace(raw, '^[ \\t]+|[ \\t]+$', '', 'g') as line from l0)"
    pages = f"c as (select distinct on (id) * from chunks where document_id is not null and page is not null), l0 as (select document_id as doc_id, page, unnest(string_split_regex(text, {end})) as raw from c), l as materialized (select doc_id, page, regexp_replace(raw, '^[ \\t]+|[ \\t]+$', '', 'g') as line from l0 where regexp_replace(raw, '^[ \\t]+|[ \\t]+$', '', 'g') != '')"
    boiler = "p as (select doc_id, count(distinct page) as pages from l group by 1 having count(distinct page) >= 3), bo as materialized (select doc_id, line, count(distinct page) as n from l join p using (doc_id) where length(line) between 1 and 60 group by doc_id, line having count(distinct page) >= greatest(3, floor(any_value(pages) * 0.5::double)))"
    body = "b as materialized (select * from l where not exists (select 1 from bo where bo.doc_id = l.doc_id and bo.line = l.line))"
    atomic = "(starts_with(line, '[BẢNG]') or contains(line, ' | ') or regexp_matches(line, '[∑√∏∫≤≥≠⇒⇐→←±·×÷∈∀∅∩∪⊆⊇≡∇∂]') or contains(line, ')/(') or contains(line, '$'))"
    hint = "regexp_matches(line, '[∑√∏∫≤≥≠⇒⇐→←±·×÷∈∀∅∩∪⊆≡]|\\)/\\(|/\\{|\\^\\{|_\\{|=')"
    b_ = "[\\s\\x{85}\\p{Z}]"
    short = "(^|[^\\p{L}\\p{N}_])([A-ZĐÀÁẠẢÃ][a-zàáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹ]*\\.) "
    kept = f"regexp_replace(regexp_replace(line, '{short}', '\\1\\2' || chr(1), 'g'), '{short}', '\\1\\2' || chr(1), 'g')"
    upper = "[A-ZÀÁẠẢÃÂẦẤẬẨẪĂẰẮẶẲẴĐÉÈẺẼÊỀẾỆỂỄÍÌỊỈĨÓÒỌỎÕÔỒỐỘỔỖƠỜỚỢỞỠƯỜỨỰỬỮÚÙỤỦŨƯỪỨỰỬỮÝỲỴỶỸ]"
    cut = f"regexp_replace(regexp_replace({kept}, '([?!]){b_}+', '\\1' || chr(2), 'g'), '([.;]){b_}+({upper})', '\\1' || chr(2) || '\\2', 'g')"
    return {
        "nfc_texts": "with t as (select doc_id, regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g') as t from documents) select doc_id, length(t)::int as n, md5(t) as digest from t",
        "structured_texts": f"""with a as (select doc_id, replace(regexp_replace(nfc_normalize(text), '\\(cid:\\d+\\)', ' ', 'g'), chr(63718), '√') as t from documents),
            b as (select doc_id, array_to_string(list_transform(string_split_regex(t, {end}), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), chr(10)) as t from a),
            c as (select doc_id, regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') as t from b) select doc_id, length(t)::int as n, md5(t) as digest from c""",
        "search_terms": f"select term, count(*) as n from (select unnest({_TOK.format('text')}) as term from documents where text is not null) group by 1",
        "sentence_split": f"with {lines} select doc_id, sum(len(list_filter(string_split({cut}, chr(2)), lambda x: trim(x) != '')))::bigint as sentences from l where line != '' and not {atomic} group by 1",
        "empty_pages": f"with {pages}, {boiler}, {body}, k as (select doc_id, page from b group by all having sum(length(line)) >= 200) select distinct doc_id, page from l where (doc_id, page) not in (select (doc_id, page) from k)",
        "page_text": """with a as (select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[\\s\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x != ''), chr(10) || chr(10)) as t from documents where text is not null and title is not null)
            select doc_id, length(t)::int as n, md5(t) as digest from a""",
        "line_units": f"with {lines} select doc_id, count(*) as lines, count(*) filter (where {atomic}) as atomic from l where line != '' group by 1",
        "section_ffill": f"""with {lines}, h0 as (select *, regexp_replace(line, '^{b_}+|{b_}+$', '', 'g') as t from l where line != ''), h as (select *, case when length(line) <= 80 and not {hint} then
            case when regexp_matches(t, '^\\d+(\\.\\d+){{0,3}}{b_}+[^\\s\\p{{Z}}]') then regexp_replace(t, '^(\\d+(?:\\.\\d+){{0,3}}){b_}+', '\\1 ')
              when regexp_matches(t, '^[IVXLCDM]{{1,5}}\\.{b_}*[^\\s\\p{{Z}}]') then regexp_replace(t, '^([IVXLCDM]{{1,5}})\\.{b_}*', '\\1. ')
              when regexp_matches(t, '(?i)^(Bước{b_}+\\d+){b_}*[:.\\-]?{b_}*[^\\s\\p{{Z}}]') then regexp_extract(t, '(?i)^(Bước{b_}+\\d+){b_}*[:.\\-]?{b_}*([^\\s\\p{{Z}}].*)$', 1) || ': ' || regexp_extract(t, '(?i)^(Bước{b_}+\\d+){b_}*[:.\\-]?{b_}*([^\\s\\p{{Z}}].*)$', 2)
              when regexp_matches(t, '(?i)^(Mục{b_}*lục|Phụ{b_}*lục|Tài{b_}*liệu{b_}*tham{b_}*khảo|Kết{b_}*luận|Giới{b_}*thiệu|Tổng{b_}*kết)([^\\p{{L}}\\p{{N}}_]|$)') then t end end as label from h0),
            r as (select *, last_value(label ignore nulls) over w as section, sum((label is not null)::int) over w as run from h window w as (partition by doc_id order by line_no rows between unbounded preceding and current row))
            select doc_id, run::bigint as run, section, count(*) as lines, sum(length(line))::bigint as chars from r where label is null group by all""",
        "boilerplate_lines": f"with {pages}, {boiler} select doc_id, line, n from bo",
        "body_lines": f"with {pages}, {boiler}, {body} select doc_id, page, count(*) as lines from b group by all",
        "url_parts": "with s as (select doc_id, trim(source) as u from documents where source is not null), v as (select *, regexp_matches(u, '^(?i:https?)://[^/?#\\s]+[^\\s]*$') as valid from s) select doc_id, valid, case when valid then regexp_extract(u, '^\\w+://([^/?#:]+)', 1) end as host, case when valid then coalesce(nullif(trim(url_decode(regexp_extract(regexp_extract(u, '^\\w+://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1))), ''), 'document.pdf') end as file from v",
        "upload_checks": "select case when n_chars > 5000 then 413 when not coalesce(starts_with(case when ends_with(source, '.pdf') then '%PDF-' else text end, '%PDF'), false) then 400 when not coalesce(ends_with(lower(source), '.pdf'), false) then 400 end as code, count(*) as n from documents group by 1",
        "event_props": "select event_type, count(*) as n, sum(json_extract(props, '$.k')::int)::bigint as k, count(distinct user_id) as users from events group by 1",
        "log_latency": "select event_type as node, count(*) as calls, sum(event_id % 1000)::bigint as ms, max(event_id % 1000) as slowest from events group by 1",
        "latest_event": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts, arg_max(event_type, (ts, event_id)) as event_type from events group by 1",
        "difficulty_labels": "with q as (select question_set, lower(trim(replace(difficulty, '*', ''))) as low from questions) select question_set, case when low in ('easy', 'dễ', 'de') then 'easy' when low in ('medium', 'trung bình', 'tb') then 'medium' when low in ('hard', 'khó', 'kho') then 'hard' else 'other' end as label, count(*) as n from q group by all",
        "greetings": "with m as (select distinct on (id) * from messages) select lower(trim(role, ' ')) as r, count(*) as n, count(*) filter (where regexp_matches(content, '(?i)^\\s*(xin\\s*chào|hello|hi+|hey+|chào\\s+bạn|cảm\\s*ơn|thanks|thank\\s*you|tạm\\s*biệt|goodbye|bye|bạn\\s+là\\s+ai[?!]*|bạn\\s+có\\s+thể\\s+làm\\s+gì[?!]*|trợ\\s+lý|đang\\s+sẵn\\s*sàng|ok[?!.]*|okay[?!.]*)[\\s.!?]*$')) as greetings from m group by 1",
        "order_revenue": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*)::bigint as items from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    }
