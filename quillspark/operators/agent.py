"""Answering many questions at once: route, plan, retrieve, judge, replan, select context, cite.

Model steps are providers: column functions with offline defaults, which are what the loop falls back to when a
model can't be reached. Questions move through the loop together; a driver-side loop of at most three rounds
carries the open ones on, and what is written between rounds is read by later ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.settings import Settings
from quillspark.shared import Scratch

NOT_FOUND = "Không tìm thấy thông tin trong tài liệu."


def offline_route(question: Column) -> Column:
    """complex for a question with several parts or many words, else simple."""
    return F.when((F.size(X.words(question)) > 25) | question.rlike(r"(?iu)\s(và|trong khi|while|although|when|khi)\s"), "complex").otherwise("simple")


def offline_plan(question: Column) -> Column:
    """The parts of a question around its conjunctions."""
    return F.split(question, r"(?iu)\s+(?:trong khi|while|although|when|khi)\s+")


@dataclass(frozen=True)
class Providers:
    route: Callable[[Column], Column] = offline_route
    plan: Callable[[Column], Column] = offline_plan
    #: Whether a note drawn from a passage is relevant, by the share of the subquestion's words in it.
    relevant: Callable[[Column], Column] = field(default=lambda share: share >= 0.5)
    #: Whether a note is grounded in its passage; without a judge it counts as grounded.
    grounded: Callable[[Column], Column] = field(default=lambda share: F.lit(True))
    #: Whether the grounded notes of a question, by their number, suffice; asked only where there is one. Without a judge they do.
    sufficient: Callable[[Column], Column] = field(default=lambda notes: F.lit(True))
    #: Claims of an answer that its context doesn't support, from the answer and the number of passages; without a judge none.
    unsupported: Callable[[Column, Column], Column] = field(default=lambda answer, n_context: F.array().cast("array<string>"))


def route(questions: DataFrame, question: str, providers: Providers = Providers(), index_ready: bool = True) -> DataFrame:
    """questions with ``route``: no_retrieval for greetings and without an index; a provider's own no_retrieval counts as simple."""
    label = F.coalesce(providers.route(F.col(question)), F.lit("simple"))
    label = F.when(label == "no_retrieval", "simple").otherwise(label)
    plain = F.lit(not index_ready) | F.coalesce(X.is_greeting(F.col(question)), F.lit(False))
    return questions.withColumn("route", F.when(plain, "no_retrieval").otherwise(label))


def plan(routed: DataFrame, question: str, settings: Settings, providers: Providers = Providers()) -> DataFrame:
    """routed with ``subquestions``: at most four that aren't blank for complex questions, else the question itself."""
    parts = F.slice(F.filter(F.transform(providers.plan(F.col(question)), lambda x: F.trim(x)), lambda x: x != ""), 1, settings.max_subquestions)
    one = F.array(F.col(question))
    return routed.withColumn("subquestions", F.when((F.col("route") == "complex") & (F.size(parts) > 0), parts).when(F.col("route") == "no_retrieval", F.array().cast("array<string>")).otherwise(one))


def merge_subquestions(old: Column, kept: Column, new: Column, most: int) -> Column:
    """Old subquestions that are kept stay in place, the others are replaced by new ones in order, leftovers follow, at most ``most``.

    ``kept`` is an array of booleans beside ``old``. Failed ones without a replacement are dropped.
    """
    failed_before = lambda i: i - F.size(F.filter(F.slice(kept, 1, i), lambda x: x))
    filled = F.transform(old, lambda o, i: F.when(F.get(kept, i), o).otherwise(F.get(new, failed_before(i))))
    used = F.size(F.filter(kept, lambda k: ~k))
    rest = F.when(F.size(new) > used, F.slice(new, used + 1, F.greatest(F.size(new) - used, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(F.filter(filled, lambda x: x.isNotNull()), rest), 1, most)


def steps(planned: DataFrame, query_id: str, retrieve: Callable[[DataFrame], DataFrame], providers: Providers) -> tuple[DataFrame, DataFrame]:
    """One round for all questions: the retrieved pool (query_id, sub, doc_id, rank, score) and a judged step per subquestion.

    ``retrieve`` takes (sub_key, query_id, sub, subquestion) and returns (sub_key, doc_id, score, rank, share).
    """
    subs = planned.select(query_id, F.posexplode("subquestions").alias("sub", "subquestion")).withColumn("sub_key", F.concat_ws("/", query_id, "sub"))
    pool = retrieve(subs).join(subs.select("sub_key", query_id, "sub"), "sub_key")
    best = pool.groupBy("sub_key").agg(F.max("share").alias("share"))
    judged = subs.join(best, "sub_key", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    judged = judged.withColumn("relevant", providers.relevant(F.col("share"))).withColumn("grounded", providers.grounded(F.col("share")))
    return pool, judged


def select_context(pool: DataFrame, query_id: str, limit: Column) -> DataFrame:
    """Labelled context: each document once, from its first place in the pool, the best scores first."""
    first = Window.partitionBy(query_id, "doc_id").orderBy("round", "sub", "rank")
    one = pool.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "round", "sub", "rank")
    return one.withColumn("label", F.row_number().over(w)).where(F.col("label") <= limit)


def check_answer(answers: DataFrame, answer_col: str, n_context: str, providers: Providers = Providers()) -> DataFrame:
    """answers with ``verified`` and ``reason``: no claim is unsupported, or the unsupported ones joined by semicolons."""
    claims = providers.unsupported(F.col(answer_col), F.col(n_context))
    return answers.withColumn("verified", F.size(claims) == 0).withColumn("reason", F.array_join(claims, "; "))


def second_half(question: Column) -> Column:
    """The words of a question from the middle on, all but the first where it has two or three; the offline replan of a failed subquestion."""
    words = F.split(question, r"\s+")
    at = F.greatest(F.floor(F.size(words) / 2), F.lit(1)).cast("int")
    return F.array_join(F.slice(words, at, F.size(words)), " ")


def stop_reason(failed: Column, before: Column, sufficient: Column, last: bool) -> Column:
    """Why a question's loop ends after a round, or null: converged, sufficient, early_stop, max_iters, checked in this order."""
    why = F.when(failed == 0, "converged").when(sufficient, "sufficient").when(failed >= before, "early_stop")
    return F.coalesce(why, F.lit("max_iters")) if last else why


def answer(questions: DataFrame, query_id: str, question: str, retrieve: Callable[[DataFrame], DataFrame], settings: Settings, providers: Providers = Providers()) -> tuple[DataFrame, DataFrame]:
    """Answers (query_id, route, iterations, stopped, n_steps, n_failed, partial, n_context, answer, verified, reason) and citations.

    A simple question is retrieved for once. A complex one's loop ends when all its steps are relevant and grounded
    (converged), when its grounded notes suffice (sufficient), when a round failed as many steps as the one before
    (early_stop), or after the last round (max_iters); ``iterations`` counts the replans. A replan asks the failed
    subquestions again by their words from the middle on. Steps are kept by subquestion, the latest counts.
    """
    scratch = Scratch(questions.sparkSession)
    routed = scratch.save(plan(route(questions, question, providers), question, settings, providers), "planned")
    open_ = routed.where("route != 'no_retrieval'").select(query_id, "route", "subquestions").withColumn("before", F.lit(None).cast("long"))
    pools, ended, all_steps = [], [], []
    for n in range(settings.max_replan_iters):
        pool, judged = steps(open_, query_id, retrieve, providers)
        pools.append(scratch.save(pool.withColumn("round", F.lit(n)), "pool"))
        judged = scratch.save(judged.join(open_.where("route = 'complex'").select(query_id), query_id, "left_semi").withColumn("round", F.lit(n)), "steps")
        all_steps.append(judged)
        good = F.col("relevant") & F.col("grounded")
        state = judged.groupBy(query_id).agg(F.count_if(~good).alias("failed"), F.count_if(good).alias("notes"), F.sort_array(F.collect_list(F.struct("sub", good.alias("ok"), "subquestion"))).alias("s"))
        enough = (F.col("notes") > 0) & providers.sufficient(F.col("notes"))
        why = stop_reason(F.col("failed"), F.col("before"), enough, n + 1 == settings.max_replan_iters)
        state = scratch.save(open_.join(state, query_id).withColumn("stopped", why), "state")
        ended.append(state.where("stopped is not null").select(query_id, F.lit(n).alias("iterations"), "stopped"))
        again = state.where("stopped is null")
        if n + 1 == settings.max_replan_iters or not again.limit(1).count():
            break
        failed = F.transform(F.filter("s", lambda x: ~x["ok"]), lambda x: second_half(x["subquestion"]))
        merged = merge_subquestions(F.transform("s", lambda x: x["subquestion"]), F.transform("s", lambda x: x["ok"]), failed, settings.max_subquestions)
        open_ = scratch.save(again.select(query_id, "route", merged.alias("subquestions"), F.col("failed").cast("long").alias("before")), "open")
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    last = Window.partitionBy(query_id, "subquestion").orderBy(F.desc("round"))
    step = union(all_steps).withColumn("_r", F.row_number().over(last)).where("_r = 1")
    per = step.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(~(F.col("relevant") & F.col("grounded"))).alias("n_failed"))
    limit = F.when(F.col("route") == "complex", 8).otherwise(settings.final_top_k)
    context = scratch.save(select_context(union(pools).join(routed.select(query_id, "route"), query_id), query_id, limit), "context")
    labels = context.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_context"), F.array_join(F.transform(F.sort_array(F.collect_list("label")), lambda x: F.concat(F.lit("["), x, F.lit("]"))), "").alias("marks"))
    out = routed.select(query_id, "route").join(union(ended), query_id, "left").join(per, query_id, "left").join(labels, query_id, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    text = F.when(F.col("route") == "no_retrieval", "Xin chào!").when(F.coalesce("n_context", F.lit(0)) == 0, NOT_FOUND).otherwise(F.concat(F.lit("Theo tài liệu "), "marks"))
    answers = out.select(query_id, "route", zero("iterations"), "stopped", zero("n_steps"), zero("n_failed"), (F.coalesce("n_failed", F.lit(0)) > 0).alias("partial"), zero("n_context"), text.alias("answer"))
    answers = check_answer(answers, "answer", "n_context", providers)
    cited = context.join(answers.select(query_id, "answer"), query_id)
    citations = cited.select(query_id, "label", "doc_id", "score", F.array_contains(X.cited_labels(F.col("answer")), F.col("label")).alias("cited"))
    return answers, citations
