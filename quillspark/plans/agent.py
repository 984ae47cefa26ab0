"""The answering loop over the held-out questions and all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import agent as A
from quillspark.operators import retrieval as R
from quillspark.plans.retrieval import _BASE, _TOK
from quillspark.settings import Settings
from quillspark.shared import Scratch, spread

S = Settings()


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/questions.parquet").select("item_id", "question")


def agent_routes(spark: SparkSession, d: str) -> DataFrame:
    return A.route(_questions(spark, d), "question").select("item_id", "route")


def agent_plans(spark: SparkSession, d: str) -> DataFrame:
    """Subquestions of each question, one row each."""
    planned = A.plan(A.route(_questions(spark, d), "question"), "question", S)
    return planned.select("item_id", F.posexplode("subquestions").alias("sub", "subquestion"))


def _retriever(spark: SparkSession, d: str):
    """Searches for subquestions in one index of all documents: the final rows of BM25 with the share of terms they hold."""
    scratch = Scratch(spark)
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id").select("doc_id", X.search_tokens("text").alias("tokens"))
    index = R.build_index(docs, "doc_id", "tokens", S, scratch)

    def retrieve(subs: DataFrame) -> DataFrame:
        q = scratch.save(subs.select("sub_key", X.search_tokens("subquestion").alias("tokens")), "subquestions")
        top = scratch.save(R.bm25(index, q, "sub_key", "tokens", "doc_id", S.final_top_k, scratch), "top")
        return top.join(R.overlap_of(index, top, q, "sub_key", "tokens", "doc_id", scratch), ["sub_key", "doc_id"])

    return retrieve


def agent_answers(spark: SparkSession, d: str) -> DataFrame:
    return A.answer(_questions(spark, d), "item_id", "question", _retriever(spark, d), S)[0]


def agent_citations(spark: SparkSession, d: str) -> DataFrame:
    return A.answer(_questions(spark, d), "item_id", "question", _retriever(spark, d), S)[1]


def queries() -> dict:
    return {f.__name__: f for f in (agent_routes, agent_plans, agent_answers, agent_citations)}


def _round_sql(n: int) -> str:
    """The pool and the judged steps of the subquestions s{n} (item_id, sub, subquestion)."""
    return f"""
  st{n} as materialized (select item_id, sub, term, count(*) as times from (select item_id, sub, unnest({_TOK.format("subquestion")}) as term from s{n}) group by all),
  bs{n} as (select item_id, sub, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / (select avg_len from n)))), 6) as score from st{n} join tf using (term) join idf using (term) group by all),
  top{n} as materialized (select * from (select *, row_number() over (partition by item_id, sub order by score desc, doc_id) as rank from bs{n} where score > 0) where rank <= 5),
  sn{n} as (select item_id, sub, count(*) as n from st{n} group by all),
  sh{n} as (select item_id, sub, doc_id, round(count(*) / any_value(sn{n}.n), 6) as share from top{n} join st{n} using (item_id, sub) join tf using (term, doc_id) join sn{n} using (item_id, sub) group by item_id, sub, doc_id),
  ju{n} as materialized (select item_id, sub, any_value(subquestion) as subquestion, coalesce(max(share), 0) >= 0.5 as good from s{n} left join sh{n} using (item_id, sub) group by all)"""


def _loop_sql(routed: str) -> str:
    """Without a judge a loop takes two rounds at most: any good step suffices, and a second round without one has failed as often as the first."""
    return (
        _BASE
        + f""", {routed},
  pl as (select item_id, route, case route when 'complex' then list_filter(list_transform(string_split_regex(question, '(?i)\\s+(?:trong khi|while|although|when|khi)\\s+'), lambda x: trim(x)), lambda x: x != '')[1:4] else [question] end as s from r where route != 'no_retrieval'),
  s0 as materialized (select item_id, generate_subscripts(s, 1) - 1 as sub, unnest(s) as subquestion from pl), {_round_sql(0)},
  e0 as (select item_id, 0 as round, count(*) filter (where not good) as failed, count(*) filter (where good) as notes from ju0 where item_id in (select item_id from r where route = 'complex') group by 1),
  s1 as materialized (select item_id, sub, array_to_string(string_split_regex(subquestion, '\\s+')[greatest(len(string_split_regex(subquestion, '\\s+')) // 2, 1):], ' ') as subquestion from s0 where item_id in (select item_id from e0 where notes = 0 and failed > 0)), {_round_sql(1)},
  e1 as (select item_id, 1 as round, count(*) filter (where not good) as failed, count(*) filter (where good) as notes from ju1 group by 1),
  ended as (select item_id, round as iterations, case when failed = 0 then 'converged' when notes > 0 then 'sufficient' else 'early_stop' end as stopped from (from e0 union all from e1) where failed = 0 or notes > 0 or round = 1),
  step as (select item_id, subquestion, arg_max(good, round) as good from (select *, 0 as round from ju0 where item_id in (select item_id from e0) union all select *, 1 from ju1) group by all),
  per as (select item_id, count(*) as n_steps, count(*) filter (where not good) as n_failed from step group by 1),
  pool as (select *, row_number() over (partition by item_id, doc_id order by round, sub, rank) as r from (select *, 0 as round from top0 union all select *, 1 from top1)),
  context as materialized (select * from (select p.item_id, doc_id, score, route, (row_number() over (partition by p.item_id order by score desc, round, sub, rank))::int as label from pool p join r using (item_id) where p.r = 1) where label <= case route when 'complex' then 8 else 5 end)
"""
    )


def oracle_sql() -> dict[str, str]:
    greet = "regexp_matches(question, '(?i)^\\s*(xin\\s*chào|hello|hi+|hey+|chào\\s+bạn|cảm\\s*ơn|thanks|thank\\s*you|tạm\\s*biệt|goodbye|bye|bạn\\s+là\\s+ai[?!]*|bạn\\s+có\\s+thể\\s+làm\\s+gì[?!]*|trợ\\s+lý|đang\\s+sẵn\\s*sàng|ok[?!.]*|okay[?!.]*)[\\s.!?]*$')"
    r = f"with r as (select item_id, question, case when {greet} then 'no_retrieval' when len(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) > 25 or regexp_matches(question, '(?i)\\s(và|trong khi|while|although|when|khi)\\s') then 'complex' else 'simple' end as route from questions)"
    loop = _loop_sql(r.removeprefix("with "))
    return {
        "agent_answers": loop + """ select r.item_id, route, coalesce(iterations, 0)::int as iterations, stopped, coalesce(n_steps, 0) as n_steps, coalesce(n_failed, 0) as n_failed, coalesce(n_failed, 0) > 0 as partial, coalesce(c.n, 0) as n_context,
            case when route = 'no_retrieval' then 'Xin chào!' when c.n is null then 'Không tìm thấy thông tin trong tài liệu.' else 'Theo tài liệu ' || array_to_string(list_transform(range(1, c.n + 1), lambda i: '[' || i || ']'), '') end as answer, true as verified, '' as reason
          from r left join ended using (item_id) left join per using (item_id) left join (select item_id, count(*) as n from context group by 1) c using (item_id)""",
        "agent_citations": loop + " select item_id, label, doc_id, score, true as cited from context",
        "agent_routes": r + " select item_id, route from r",
        "agent_plans": r + """, p as (select item_id, case route when 'complex' then list_filter(list_transform(string_split_regex(question, '(?i)\\s+(?:trong khi|while|although|when|khi)\\s+'), lambda x: trim(x)), lambda x: x != '')[1:4] else [question] end as s from r where route != 'no_retrieval')
          select item_id, (generate_subscripts(s, 1) - 1)::int as sub, unnest(s) as subquestion from p""",
    }
