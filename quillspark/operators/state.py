"""The state store as tables: current views of change logs, lifecycles, windows over histories, cascades.

Messages may be delivered twice; every operator here takes rows as they are, so pass ``once`` rows. Groups may be
large: top rows of a group are cut before they are gathered, and nothing collects a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ordering import numbered
from quillspark.settings import Settings
from quillspark.shared import Scratch


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered several times under one key count once."""
    return df.dropDuplicates([key])


def current_view(log: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The latest row of each key by ``version``; rows repeated in all columns are one."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_l"))
    return last.select(key, *[F.col("_l")[c].alias(c) for c in rest])


def recent(messages: DataFrame, window: int) -> DataFrame:
    """The last ``window`` messages of each session by id, with ``back`` (1 for the last)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= window)


def to_summarise(messages: DataFrame, summaries: DataFrame, settings: Settings) -> DataFrame:
    """Messages a new summary has to take in: session_id, id. Sessions over the threshold, after their last summary, before the recent window."""
    total = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > settings.summary_threshold)
    since = summaries.groupBy("session_id").agg(F.max_by("summarized_up_to", "id").alias("upto"))
    until = recent(messages, settings.history_window).groupBy("session_id").agg(F.min("id").alias("until"))
    span = total.join(until, "session_id").join(since, "session_id", "left").select("session_id", "until", F.coalesce("upto", F.lit(0)).alias("upto"))
    return messages.join(span, "session_id").where((F.col("id") > F.col("upto")) & (F.col("id") < F.col("until"))).select("session_id", "id")


def upsert_summaries(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """The newest summary of each session after a merge: ``new`` (session_id, summary, summarized_up_to) replaces or adds."""
    old = current_view(summaries.select("session_id", "id", "summary", "summarized_up_to"), "session_id", ["id"])
    n = new.select("session_id", F.col("summary").alias("n_summary"), F.col("summarized_up_to").alias("n_upto"))
    j = old.join(n, "session_id", "full_outer")
    return j.select("session_id", F.coalesce("n_summary", "summary").alias("summary"), F.coalesce("n_upto", "summarized_up_to").alias("summarized_up_to"), F.when(F.col("n_upto").isNull(), "kept").when(F.col("id").isNull(), "added").otherwise("updated").alias("action"))


def insert(table: DataFrame, key: str, new: DataFrame, order: list[str], scratch: Scratch, last: int = 0) -> DataFrame:
    """table with the rows of ``new`` (the other columns) appended under new ids, counted on by ``order``.

    Ids go on from the largest of the table and from ``last``, the largest ever given, so that ids of deleted rows
    aren't used again. The rows are numbered by range, not in one task.
    """
    top = max(table.agg(F.max(key)).first()[0] or 0, last)
    rest = [c for c in table.columns if c != key]
    made = numbered(new.select(rest), [], order, "_n", scratch)
    return table.unionByName(made.select((F.col("_n") + F.lit(top)).cast(dict(table.dtypes)[key]).alias(key), *rest))


def joined_tokens(tokens: DataFrame, key: str) -> DataFrame:
    """key, answer: the text pieces (key, seq, text) of each answer in order, without blanks around. An answer is a bounded text."""
    parts = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("p"))
    return parts.select(key, F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), ""), r"(?U)^\s+|\s+$", "").alias("answer"))


def partial_update(table: DataFrame, key: str, changes: DataFrame, columns: list[str]) -> DataFrame:
    """table with the non-null values of ``changes`` in ``columns``; changes for unknown keys have no effect."""
    c = changes.select(key, *[F.col(x).alias(f"_n_{x}") for x in columns])
    return table.join(c, key, "left").select(*[F.coalesce(f"_n_{x}", x).alias(x) if x in columns else F.col(x) for x in table.columns])


def stale(table: DataFrame, cutoff: Column) -> DataFrame:
    """table with rows still processing and older than ``cutoff`` failed."""
    old = (F.col("status") == "processing") & (F.col("created_at") < cutoff)
    marked = table.withColumn("was_stale", F.coalesce(old, F.lit(False)))
    return marked.withColumn("status", F.when(F.col("was_stale"), "failed").otherwise(F.col("status")))


def cascade_delete(parent: DataFrame, key: str, gone: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """parent and its children without the rows of the keys in ``gone``; children with a null key stay."""
    keys = gone.select(F.col(key)).distinct()
    out = {"parent": parent.join(keys, key, "left_anti")}
    for name, (df, ref) in children.items():
        out[name] = df.join(keys.withColumnRenamed(key, ref), ref, "left_anti")
    return out


def drift(table_ids: DataFrame, index_ids: DataFrame) -> DataFrame:
    """One row comparing an index's ids with the table's: missing, extra, both, in_sync."""
    t = table_ids.select(F.col(table_ids.columns[0]).alias("i")).distinct().withColumn("t", F.lit(1))
    x = index_ids.select(F.col(index_ids.columns[0]).alias("i")).distinct().withColumn("x", F.lit(1))
    j = t.join(x, "i", "full_outer")
    out = j.agg(F.count_if(F.col("x").isNull()).alias("missing"), F.count_if(F.col("t").isNull()).alias("extra"), F.count_if(F.col("t").isNotNull() & F.col("x").isNotNull()).alias("both"))
    return out.withColumn("in_sync", (F.col("missing") == 0) & (F.col("extra") == 0))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Distinct keys that the cache doesn't have."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


TRACE = "array<struct<type:string,data:variant>>"


def trace_events(messages: DataFrame) -> DataFrame:
    """Trace events of messages without 'thinking': id, seq from 1, type, data (JSON text). Traces that aren't JSON have none."""
    events = F.expr("try_variant_get(try_parse_json(trace), '$', 'array<variant>')")
    each = messages.select("id", F.posexplode(events).alias("p", "e"))
    kind, data = F.expr("try_variant_get(e, '$.type', 'string')"), F.expr("to_json(try_variant_get(e, '$.data', 'variant'))")
    return each.select("id", (F.col("p") + 1).alias("seq"), kind.alias("type"), data.alias("data")).where("type is null or type != 'thinking'")
