"""Retrieval and its evaluation: questions against documents, vectors against vectors."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vectors as V
from quillspark.operators import evaluation as E
from quillspark.operators import retrieval as R
from quillspark.operators.embedding import embed, hashed
from quillspark.settings import Settings
from quillspark.shared import Scratch, spread

S = Settings()
#: Vectors whose id is divisible by this are the queries of the searches over vectors.
QUERY_EVERY = 50
METHODS = ["bm25", "dense", "hybrid", "rerank"]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(_read(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", X.search_tokens("text").alias("tokens"))


def _questions(spark: SparkSession, d: str, col: str = "question") -> DataFrame:
    return _read(spark, d, "questions").select("item_id", X.search_tokens(col).alias("tokens"))


class _Search:
    """Documents and questions of one query: the index and the rankings, each made once."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d, self.scratch = spark, d, Scratch(spark)
        self.questions = self.scratch.save(_questions(spark, d), "questions")

    @cached_property
    def index(self) -> R.Index:
        return R.build_index(_docs(self.spark, self.d), "doc_id", "tokens", S, self.scratch)

    @cached_property
    def bm25(self) -> DataFrame:
        return self.scratch.save(R.bm25(self.index, self.questions, "item_id", "tokens", "doc_id", S.bm25_top_k, self.scratch), "bm25")

    @cached_property
    def dense(self) -> DataFrame:
        """Documents by the cosine of their offline vector with the question's."""
        vec = lambda name, key, col: self.scratch.save(spread(_read(self.spark, self.d, name).where(F.col(col).isNotNull()).select(key, col)).select(key, hashed(F.col(col)).alias("v")), "vectors")
        found = R.dense(vec("documents", "doc_id", "text"), "doc_id", "v", vec("questions", "item_id", "question"), "item_id", "v", S.dense_top_k)
        return self.scratch.save(found, "dense")

    @cached_property
    def fused(self) -> DataFrame:
        return self.scratch.save(R.rrf(self.bm25, self.dense, "item_id", "doc_id", S.rrf_k), "fused")

    def reranked(self, k: int) -> DataFrame:
        """Candidates rescored by the squashed share of the question's terms that they hold, the offline reranker."""
        cut = self.fused.where(F.col("pos") <= S.rerank_top_n)
        share = R.overlap_of(self.index, cut, self.questions, "item_id", "tokens", "doc_id", self.scratch)
        score = F.round(1 / (1 + F.exp(-8 * (F.coalesce("share", F.lit(0.0)) - 0.5))), 6)
        return R.hybrid(cut.join(share, ["item_id", "doc_id"], "left"), "item_id", "doc_id", replace(S, final_top_k=k), score)

    def ranked(self) -> DataFrame:
        tag = lambda df, m: df.select("item_id", F.lit(m).alias("method"), "doc_id", "rank")
        hybrid = self.fused.where(F.col("pos") <= S.bm25_top_k).withColumnRenamed("pos", "rank")
        legs = [tag(self.bm25, "bm25"), tag(self.dense, "dense"), tag(hybrid, "hybrid"), tag(self.reranked(S.rerank_top_n), "rerank")]
        return self.scratch.save(reduce(DataFrame.unionByName, legs), "ranked")

    def relevant(self) -> DataFrame:
        """Documents that hold at least half of the distinct terms of an item's evidence or, where it has none, of its answer."""
        q = _read(self.spark, self.d, "questions").select("item_id", X.search_tokens(F.coalesce("evidence", "expected")).alias("tokens"))
        return self.scratch.save(R.overlap_at_least(self.index, q, "item_id", "tokens", "doc_id", 0.5, self.scratch).select("item_id", "doc_id"), "relevant")

    def scores(self) -> DataFrame:
        return self.scratch.save(E.per_query(self.ranked(), self.relevant(), self.questions, "item_id", "doc_id", 5, METHODS), "scores")


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


def term_idf(spark: SparkSession, d: str) -> DataFrame:
    return _Search(spark, d).index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _Search(spark, d).bm25


def overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    s = _Search(spark, d)
    return R.overlap(s.index, s.questions, "item_id", "tokens", "doc_id", S.dense_top_k, s.scratch)


def question_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _Search(spark, d).dense


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and vector rankings fused by reciprocal ranks."""
    return _Search(spark, d).fused.select("item_id", "doc_id", "rrf", "rank_1", "rank_2", "pos")


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Fusion, the first 20 candidates, the final 5, then title and source of these."""
    final = R.hybrid(_Search(spark, d).fused, "item_id", "doc_id", S)
    meta = _read(spark, d, "documents").select("doc_id", "title", "source", "source_type")
    return final.join(meta, "doc_id").select("item_id", "doc_id", "rank", "final", "title", "source", "source_type")


def rerank_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """As hybrid_retrieve, with candidates rescored by the offline reranker."""
    return _Search(spark, d).reranked(S.final_top_k).select("item_id", "doc_id", "rank", "final", "rrf")


def embed_misses(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents against a cache that holds those of the pdf sources: by source type, texts, new vectors, and the sum of cells."""
    docs = _read(spark, d, "documents").select("doc_id", "text", "source_type")
    scratch = Scratch(spark)
    empty = spark.createDataFrame([], "content string, embedding array<float>")
    cache = scratch.save(embed(docs.where("source_type = 'pdf'"), "doc_id", "text", empty, scratch)[1], "cache")
    every, new = embed(docs, "doc_id", "text", cache, scratch)
    fresh = docs.select("doc_id", "source_type", X.content_key(F.lit("hashed"), F.col("text")).alias("content")).join(new.select("content", F.lit(1).alias("made")), "content", "left")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    rows = fresh.join(every, "doc_id", "left").groupBy("source_type").agg(F.count("content").alias("texts"), F.count("made").alias("made"), F.round(F.sum(F.round(total, 3)), 1).alias("lengths"))
    return rows


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = v.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense(v, "vec_id", "embedding", q, "query_id", "embedding", 10)


def chunk_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with usable embeddings most similar to each chunk whose id is divisible by 50."""
    c = _read(spark, d, "chunks").select("id", "embedding").dropDuplicates(["id"])
    fine = F.coalesce((F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    c = c.where(fine)
    q = c.where(F.col("id") % QUERY_EVERY == 0).select(F.col("id").alias("query_id"), "embedding")
    return R.dense(c, "id", "embedding", q, "query_id", "embedding", S.dense_top_k).withColumnRenamed("id", "chunk_id")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(V.unit(F.col("embedding"))), 6).alias("unit_norm"))


def dense_eval_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Of the vectors found for a query, how many carry its label, and the rank of the first that does."""
    v = _vectors(spark, d).select("vec_id", "label")
    found = dense_topk(spark, d).where("vec_id != query_id").join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    same = F.col("label") == F.col("want")
    return found.groupBy("want").agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("found"), F.count_if(same).alias("same"), F.round(F.avg(F.when(same, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("weight"))


def recall_mrr_hit(spark: SparkSession, d: str) -> DataFrame:
    return _Search(spark, d).scores()


def eval_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores per method, overall and by question set."""
    sets = _read(spark, d, "questions").select("item_id", "question_set")
    return E.summary(_Search(spark, d).scores().join(R.query_side(sets), "item_id"), "question_set")


def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    """Items with relevant documents of which a method found none."""
    return _Search(spark, d).scores().where("n_relevant > 0 and hit = 0").select("item_id", "method", "n_relevant")


def eval_pool(spark: SparkSession, d: str) -> DataFrame:
    return E.pool(_Search(spark, d).ranked(), "item_id", "doc_id", METHODS, 10)


def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid scores by item against BM25 as the state before."""
    s = _Search(spark, d).scores()
    pick = lambda m: s.where(F.col("method") == m).select("item_id", "recall", "mrr")
    return E.compare(pick("bm25"), pick("hybrid"), ["item_id"], ["recall", "mrr"])


def pool_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The pool of all rankings with each document once, from the first ranking that has it."""
    leg = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    return R.first_wins(_Search(spark, d).ranked().withColumn("leg", leg), "item_id", "doc_id", ["leg", "rank"]).select("item_id", "doc_id", "method", "rank")


def method_preferences(spark: SparkSession, d: str) -> DataFrame:
    """Per question set how often fusion ranks the first relevant document better than BM25, worse, or alike."""
    sets = _read(spark, d, "questions").select("item_id", "question_set")
    p = E.preferences(_Search(spark, d).scores(), "item_id", "hybrid", "bm25", "mrr").join(sets, "item_id")
    n = lambda x: F.count_if(F.col("preferred") == x).alias(f"n_{x}")
    return p.groupBy("question_set").agg(n("hybrid"), n("bm25"), n("tie"))


_STOP = """['và','là','của','có','các','được','cho','trong','với','khi','này','đó','một','những','đến','từ','theo','để','ra','vào','thì','mà','hay','hoặc','nếu','vì','do','bởi','nên',
  'cũng','đã','sẽ','đang','rồi','tại','trên','dưới','về','như','thế','ở','bằng','lại','nó','rằng','phải','không','chỉ','còn','đây','kia','ấy']"""
_TOK = (
    """flatten(list_transform(list_filter(regexp_extract_all(nfc_normalize({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: not list_contains(STOP, replace(lower(t), '_', ' '))), lambda t: [lower(t)] ||
  case when contains(t, '_') or regexp_matches(t, '[a-z0-9][A-Z]') then list_filter(list_transform(string_split_regex(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[\\s_]+'), lambda p: lower(p)),
    lambda p: length(p) > 1 and p != lower(t) and not list_contains(STOP, p)) else []::varchar[] end))"""
).replace("STOP", _STOP)
_CELL = "('0x' || substr(md5(term), 1, 8))::bigint % 256"
_SIGN = "case when contains('02468ace', substr(md5(term), 9, 1)) then 1 else -1 end"
_BASE = f"""
with d as materialized (select doc_id, coalesce({_TOK.format("text")}, []) as tokens from documents),
  q as materialized (select item_id, question_set, coalesce({_TOK.format("question")}, []) as tokens from questions),
  n as (select count(*) as n_docs, avg(len(tokens)) as avg_len from d),
  dt as materialized (select doc_id, len(tokens) as doc_len, unnest(tokens) as term from d),
  tf as materialized (select doc_id, term, count(*) as tf, any_value(doc_len) as doc_len from dt group by all),
  raw as (select term, count(*) as df, ln((select n_docs from n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf group by 1),
  idf as materialized (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
  qt as materialized (select item_id, term, count(*) as times from (select item_id, unnest(tokens) as term from q) group by all),
  bs as (select item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / (select avg_len from n)))), 6) as score
    from qt join tf using (term) join idf using (term) group by all),
  bm as materialized (select * from (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from bs where score > 0) where rank <= 30),
  qn as (select item_id, count(*) as n from qt group by 1),
  os as materialized (select item_id, doc_id, round(count(*) / any_value(n), 6) as score from qt join tf using (term) join qn using (item_id) group by item_id, doc_id),
  ov as materialized (select * from (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from os) where rank <= 30),
  dc as (select doc_id, {_CELL} as cell, sum(tf * {_SIGN})::double as c from tf group by all), dv as materialized (select doc_id, cell, (c / sqrt(sum(c * c) over (partition by doc_id)))::float::double as v from dc where c != 0),
  qc as (select item_id, {_CELL} as cell, sum(times * {_SIGN})::double as c from qt group by all), qv as materialized (select item_id, cell, (c / sqrt(sum(c * c) over (partition by item_id)))::float::double as v from qc where c != 0),
  dl as (select doc_id, sqrt(sum(v * v)) as n from dv group by 1), ql as (select item_id, sqrt(sum(v * v)) as n from qv group by 1),
  dp as (select item_id, doc_id, sum(q.v * d.v / ql.n / dl.n) as s from qv q join dv d using (cell) join ql using (item_id) join dl using (doc_id) group by all),
  de0 as (select a.item_id, b.doc_id, round(coalesce(s, 0), 6) + 0.0 as score from (select item_id from questions where question is not null) a cross join (select doc_id from documents where text is not null) b left join dp using (item_id, doc_id)),
  de as materialized (select * from (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from de0) where rank <= 30),
  fu0 as (select item_id, doc_id, round(coalesce(1 / (60.0::double + b.rank), 0) + coalesce(1 / (60.0::double + o.rank), 0), 9) as rrf, b.rank as rank_1, o.rank as rank_2 from bm b full join de o using (item_id, doc_id)),
  fu as materialized (select *, (row_number() over (partition by item_id order by rrf desc, rank_1 nulls last, rank_2, doc_id))::int as pos from fu0),
  re as materialized (select *, (row_number() over (partition by item_id order by final desc, pos))::int as rank from (
    select item_id, doc_id, pos, rrf, round(1 / (1 + exp(-8 * (coalesce(score, 0) - 0.5))), 6) as final from fu left join os using (item_id, doc_id) where pos <= 20))
"""
_EVAL = (
    _BASE
    + f""",
  ranked as materialized (select item_id, 'bm25' as method, doc_id, rank, 1 as leg from bm union all select item_id, 'dense', doc_id, rank, 2 from de
    union all select item_id, 'hybrid', doc_id, pos, 3 from fu where pos <= 30 union all select item_id, 'rerank', doc_id, rank, 4 from re),
  rt as (select item_id, unnest(list_distinct(coalesce({_TOK.format("coalesce(evidence, expected)")}, []))) as term from questions),
  rn as (select item_id, count(*) as n from rt group by 1),
  rel as materialized (select item_id, doc_id from rt join tf using (term) join rn using (item_id) group by item_id, doc_id having round(count(*) / any_value(rn.n), 6) >= 0.5),
  grid as (select item_id, question_set, method from q, (select distinct method from ranked)),
  got as (select item_id, method, count(*) as hits, min(rank) as first from ranked join rel using (item_id, doc_id) where rank <= 5 group by all),
  nr as (select item_id, count(*) as n_relevant from rel group by 1),
  sc as materialized (select item_id, question_set, method, coalesce(n_relevant, 0) as n_relevant,
    round(case when coalesce(n_relevant, 0) > 0 then coalesce(hits, 0) / n_relevant else 0 end, 6) as recall, round(coalesce(1.0::double / first, 0), 6) as mrr, (coalesce(hits, 0) > 0)::int as hit
    from grid left join nr using (item_id) left join got using (item_id, method))
"""
)
_USABLE = "coalesce(len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0, false)"
_COS = """with v as (select vec_id, label, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings),
  s as (select q.vec_id as query_id, v.vec_id, q.label as want, v.label, round(list_inner_product(list_transform(q.e, lambda x: x / case when q.n = 0 then 1 else q.n end), list_transform(v.e, lambda x: x / case when v.n = 0 then 1 else v.n end)), 6) as score from v q, v where q.vec_id % 50 = 0),
  t as (select * from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s) where rank <= 10)
"""
_CHUNK_COS = f"""with c as (select distinct on (id) id, embedding::double[] as e from chunks where {_USABLE}), v as (select id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from c),
  s as (select q.id as query_id, v.id as chunk_id, round(list_inner_product(q.e, v.e), 6) as score from v q, v where q.id % 50 = 0)
  select query_id, chunk_id, score, rank from (select *, (row_number() over (partition by query_id order by score desc, chunk_id))::int as rank from s) where rank <= 30"""


def queries() -> dict:
    fs = [token_stats, term_idf, bm25_topk, overlap_topk, question_dense_topk, rrf_fusion, embed_misses, hybrid_retrieve, rerank_retrieve, dense_topk, chunk_dense_topk, vector_norms, dense_eval_by_label, recall_mrr_hit, eval_by_group, eval_failures, eval_pool, metric_delta, method_preferences, pool_first_wins]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {
        "token_stats": _BASE + "select doc_id, len(tokens)::int as n_tokens, len(list_distinct(tokens))::int as n_distinct from d",
        "term_idf": _BASE + "select term, df, round(idf, 6) as idf from idf",
        "bm25_topk": _BASE + "select item_id, doc_id, score, rank from bm",
        "overlap_topk": _BASE + "select item_id, doc_id, score, rank from ov",
        "rrf_fusion": _BASE + "select item_id, doc_id, rrf, rank_1, rank_2, pos from fu",
        "hybrid_retrieve": _BASE + "select item_id, doc_id, pos as rank, rrf as final, title, source, source_type from fu join documents using (doc_id) where pos <= 5",
        "rerank_retrieve": _BASE + "select item_id, doc_id, rank, final, rrf from re where rank <= 5",
        "question_dense_topk": _BASE + "select item_id, doc_id, score, rank from de",
        "embed_misses": _BASE + """, t as (select doc_id, source_type, text, exists (select 1 from documents p where p.source_type = 'pdf' and p.text = x.text) as known from documents x)
          select source_type, count(text) as texts, count(*) filter (where text is not null and not known) as made, round(sum(case when dl.n is null and text is not null then 0.0 when text is not null then 1.0 end)::double, 1) as lengths from t left join dl using (doc_id) group by 1""",
        "chunk_dense_topk": _CHUNK_COS,
        "dense_topk": _COS + "select query_id, vec_id, score, rank from t",
        "vector_norms": "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm, case when list_sum(list_transform(embedding::double[], lambda x: x * x)) = 0 then 0.0::double else 1.0::double end as unit_norm from embeddings",
        "dense_eval_by_label": _COS + "select want, count(distinct query_id) as queries, count(*) as found, count(*) filter (where label = want) as same, round(avg(case when label = want then 1.0::double / rank else 0 end), 6) as weight from t where vec_id != query_id group by 1",
        "recall_mrr_hit": _EVAL + "select item_id, method, n_relevant, recall, mrr, hit from sc",
        "eval_by_group": _EVAL + "select method, question_set, grouping(question_set)::int as overall, count(*) as queries, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(hit), 6) as hit from sc group by grouping sets ((method), (method, question_set))",
        "eval_failures": _EVAL + "select item_id, method, n_relevant from sc where n_relevant > 0 and hit = 0",
        "eval_pool": _EVAL + "select item_id, doc_id, min(10 * (leg - 1) + rank)::int as place from ranked where rank <= 10 group by all",
        "metric_delta": _EVAL + "select a.item_id, a.recall, a.mrr, b.recall as recall_before, b.mrr as mrr_before, round(a.recall - b.recall, 6) as recall_delta, round(a.mrr - b.mrr, 6) as mrr_delta from sc a join sc b using (item_id) where a.method = 'hybrid' and b.method = 'bm25'",
        "method_preferences": _EVAL + "select a.question_set, count(*) filter (where a.mrr > b.mrr) as n_hybrid, count(*) filter (where b.mrr > a.mrr) as n_bm25, count(*) filter (where a.mrr = b.mrr) as n_tie from sc a join sc b using (item_id) where a.method = 'hybrid' and b.method = 'bm25' group by 1",
        "pool_first_wins": _EVAL + "select item_id, doc_id, method, rank from (select *, row_number() over (partition by item_id, doc_id order by leg, rank) as r from ranked) where r = 1",
    }
