"""Retrieval quality: recall, reciprocal rank and hits of ranked lists against relevant sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X


def per_query(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, query_id: str, id_col: str, k: int, methods: list[str]) -> DataFrame:
    """query_id, method, n_relevant, recall, mrr, hit at k. A query without relevant ids, or without results, scores 0 in all.

    ``ranked`` has query_id, method, id_col, rank. Repeated relevant pairs count once. Each query gets a row for each of ``methods``.
    """
    rel = relevant.select(query_id, id_col).distinct()
    n_rel = rel.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_relevant"))
    cut = ranked.where(F.col("rank") <= k).join(rel.withColumn("rel", F.lit(True)), [query_id, id_col], "left")
    got = cut.groupBy(query_id, "method").agg(F.count_if("rel").alias("hits"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"))
    grid = queries.select(query_id).distinct().withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    out = grid.join(n_rel, query_id, "left").join(got, [query_id, "method"], "left")
    n = F.coalesce("n_relevant", F.lit(0))
    return out.select(
        query_id, "method", n.alias("n_relevant"),
        F.round(F.when(n > 0, F.coalesce("hits", F.lit(0)) / n).otherwise(0.0), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.when(F.coalesce("hits", F.lit(0)) > 0, 1).otherwise(0).alias("hit"),
    )


def summary(scores: DataFrame, by: str) -> DataFrame:
    """Means per method, and per method and ``by``, in one pass; the overall row has ``by`` null and overall 1."""
    g = scores.groupingSets([["method"], ["method", by]], "method", by)
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return g.agg(F.grouping(by).cast("int").alias("overall"), F.count(F.lit(1)).alias("queries"), mean("recall"), mean("mrr"), F.round(F.avg("hit"), 6).alias("hit"))


def pool(ranked: DataFrame, query_id: str, id_col: str, methods: list[str], depth: int) -> DataFrame:
    """Ordered distinct union of the first ``depth`` of each method: query_id, id_col, place."""
    order = F.create_map(*[x for i, m in enumerate(methods) for x in (F.lit(m), F.lit(i * depth))])
    placed = ranked.where(F.col("rank") <= depth).withColumn("place", order[F.col("method")] + F.col("rank"))
    return placed.groupBy(query_id, id_col).agg(F.min("place").alias("place"))


def compare(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """after minus before by key; a key without a row before counts as 0."""
    b = before.select(*keys, *[F.col(m).alias(f"{m}_before") for m in metrics])
    j = after.join(b, keys, "left")
    zero = lambda m: F.coalesce(f"{m}_before", F.lit(0.0))
    return j.select(*keys, *metrics, *[zero(m).alias(f"{m}_before") for m in metrics], *[F.round(F.col(m) - zero(m), 6).alias(f"{m}_delta") for m in metrics])


def preferences(scores: DataFrame, query_id: str, a: str, b: str, metric: str) -> DataFrame:
    """Per query which of two methods scores better: query_id, preferred (a, b or tie). A missing score is a tie."""
    both = scores.where(F.col("method").isin(a, b)).groupBy(query_id).agg(F.max(F.when(F.col("method") == a, F.col(metric))).alias("_a"), F.max(F.when(F.col("method") == b, F.col(metric))).alias("_b"))
    return both.select(query_id, F.when(F.col("_a") > F.col("_b"), a).when(F.col("_b") > F.col("_a"), b).otherwise("tie").alias("preferred"))


def ab_summary(runs: DataFrame, rubrics: list[str]) -> DataFrame:
    """One row of an A/B run (variant, preferred, seconds and rubric columns): means per variant, deltas, preference counts, time ratio.

    An unknown preference counts as a tie; the ratio's denominator is 0.01 at least.
    """
    pick = lambda v, c: F.avg(F.when(F.col("variant") == v, F.col(c)))
    cols = []
    for r in rubrics:
        cols += [F.round(pick("A", r), 2).alias(f"{r}_a"), F.round(pick("B", r), 2).alias(f"{r}_b"), F.round(pick("B", r) - pick("A", r), 2).alias(f"{r}_delta")]
    liked = F.when(F.col("preferred").isin("A", "B"), F.col("preferred")).otherwise("tie")
    mine = F.col("variant") == "A"  # a preference stands in both rows of a query
    cols += [F.count_if(mine & (liked == x)).alias(f"prefer_{x.lower()}") for x in ("A", "B", "tie")]
    seconds = lambda v: F.coalesce(F.sum(F.when(F.col("variant") == v, F.col("seconds"))), F.lit(0.0))
    return runs.agg(*cols, F.round(seconds("B") / F.greatest(seconds("A"), F.lit(0.01)), 2).alias("time_ratio"))


def scenario_checks(traces: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Whether each scenario's traces have all expected events and none that are forbidden: scenario, missing, forbidden, passed.

    ``traces``: scenario, type. ``scenarios``: scenario, expect, forbid (arrays; null is empty). A scenario without traces misses all.
    """
    seen = traces.groupBy("scenario").agg(F.collect_set("type").alias("seen"))  # event types are few
    none = F.array().cast("array<string>")
    j = scenarios.join(seen, "scenario", "left").withColumn("seen", F.coalesce("seen", none))
    j = j.select("scenario", F.array_except(F.coalesce("expect", none), "seen").alias("missing"), F.array_intersect(F.coalesce("forbid", none), "seen").alias("forbidden"))
    return j.withColumn("passed", (F.size("missing") == 0) & (F.size("forbidden") == 0))


def mean_relevant(scores: DataFrame, query_id: str) -> DataFrame:
    """One row: the queries and their mean number of relevant ids; 0 without queries."""
    per = scores.select(query_id, "n_relevant").distinct()
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.coalesce(F.avg("n_relevant"), F.lit(0.0)), 6).alias("mean_relevant"))


def feature_usage(events: DataFrame, features: dict[str, Column]) -> DataFrame:
    """One row counting, for each feature, the runs (id) with at least one event that its condition holds for."""
    per = events.groupBy("id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in features.items()])
    return per.agg(F.count(F.lit(1)).alias("runs"), *[F.count_if(n).alias(n) for n in features])


def report_lines(summaries: DataFrame, label: str, metrics: list[str], signed: bool = False) -> DataFrame:
    """summaries with ``line``: a row of a markdown table, the label and the metrics with three decimals (with their sign if ``signed``)."""
    number = "%+.3f" if signed else "%.3f"
    return summaries.withColumn("line", F.format_string("| %s | " + " | ".join([number] * len(metrics)) + " |", label, *[X.python_round(F.col(m), 3) for m in metrics]))
