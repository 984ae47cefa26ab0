"""p2: conversations from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.conversations import SHOWS, clear_role, conversations, resolve, root_to_leaf, shows
from quillspark.llm.lookalikes import INVISIBLE
from quillspark.operators.ordering import with_previous
from quillspark.shared import Scratch


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = spark.read.parquet(f"{d}/messages.parquet").select("id", "session_id", "role", "content", "status", "created_at")
    return m, spark.read.parquet(f"{d}/sessions.parquet").select("id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per message of each kept conversation, in order."""
    return conversations(*_tables(spark, d)).select("session_id", "turn_no", "message_id")


def p2_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Kept conversations by their number of turns."""
    per = p2_found(spark, d).groupBy("session_id").agg(F.max("turn_no").alias("turns"))
    return per.groupBy("turns").agg(F.count(F.lit(1)).alias("conversations"))


def p2_flaws(spark: SparkSession, d: str) -> DataFrame:
    """Per session what is wrong with single messages: unknown roles, blank contents, statuses other than complete."""
    m, _ = _tables(spark, d)
    one = m.dropDuplicates(["id"])
    known = F.coalesce(clear_role("role").isin("user", "assistant"), F.lit(False))
    n = lambda c: F.count_if(c)
    return one.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), n(~known).alias("unknown_role"), n(~shows("content")).alias("blank"), n(F.coalesce(F.col("status") != "complete", F.lit(True))).alias("not_complete"))


def _threads(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    """Messages with a parent planted by their id: mostly the message before in the session, for one id in ten the one
    before that (a branch), for some none (a root), one that has no row (an orphan), or the message itself (a cycle)."""
    m = spark.read.parquet(f"{d}/messages.parquet").select("id", "session_id", "created_at").where("id is not null").dropDuplicates(["id"])
    m = with_previous(m, ["session_id"], ["created_at", "id"], {"id": "p1"}, scratch)
    m = with_previous(m, ["session_id"], ["created_at", "id"], {"p1": "p2"}, scratch)
    i = F.col("id")
    parent = F.when(i % 101 == 7, i).when(i % 97 == 5, -i).when(i % 23 == 0, F.lit(None)).when(i % 10 == 3, F.col("p2")).otherwise(F.col("p1"))
    return scratch.save(m.select("id", parent.alias("parent")), "threads")


def p2_threads(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and state of every message in threads with branches, orphans and cycles."""
    scratch = Scratch(spark)
    return resolve(_threads(spark, d, scratch), "id", "parent", scratch).select(F.col("id").alias("message_id"), "root", "depth", "state")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """The root-to-leaf paths of these threads."""
    scratch = Scratch(spark)
    return root_to_leaf(_threads(spark, d, scratch), "id", "parent", scratch).select("leaf", "turn", F.col("id").alias("message_id"), "state")


_BLANK = r"\s\p{Z}\p{Cc}" + INVISIBLE
_ROLE = f"lower(regexp_replace(role, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'))"
_ONE = f"""one as (select distinct id, session_id, created_at, {_ROLE} as role, status, coalesce(regexp_matches(content, '{SHOWS}'), false) as shows from messages)"""
_KEPT = f"""
with {_ONE},
  turns as (select session_id, id, role, (row_number() over w)::int as turn_no, count(*) over (partition by session_id) as n,
      coalesce(status = 'complete' and shows, false) as good
    from one where session_id in (select id from sessions) and id is not null window w as (partition by session_id order by created_at nulls first, id)),
  kept as (select session_id from turns group by 1 having coalesce(bool_and(coalesce(good and role = case turn_no % 2 when 1 then 'user' else 'assistant' end, false)), false) and max(n) % 2 = 0)
"""


_THREADS = """
with recursive m as (select distinct id, session_id, created_at from messages where id is not null),
  l as (select id, lag(id) over w as p1, lag(id, 2) over w as p2 from m window w as (partition by session_id order by created_at nulls first, id)),
  t as materialized (select id, case when id % 101 = 7 then id when id % 97 = 5 then -id when id % 23 = 0 then null when id % 10 = 3 then p2 else p1 end as parent from l),
  down as (select id, id as root, 0::bigint as depth, case when parent is null then 'ok' else 'orphan' end as state from t where parent is null or parent not in (select id from t)
    union all select t.id, root, depth + 1, state from down join t on t.parent = down.id)
"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_lengths": p2_lengths, "p2_flaws": p2_flaws, "p2_threads": p2_threads, "p2_paths": p2_paths}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _KEPT + "select session_id, turn_no, id as message_id from turns where session_id in (from kept)",
        "p2_lengths": _KEPT + "select turns, count(*) as conversations from (select session_id, max(turn_no) as turns from turns where session_id in (from kept) group by 1) group by 1",
        "p2_threads": _THREADS + "select t.id as message_id, root, depth, coalesce(state, 'cycle') as state from t left join down using (id)",
        "p2_paths": _THREADS + """, ends as (select id, depth, state from down where id not in (select parent from t where parent is not null)),
            up as (select id as leaf, id, depth, state from ends union all select leaf, t.parent, depth - 1, state from up join t on t.id = up.id where depth > 0)
            select leaf, (depth + 1)::int as turn, id as message_id, state from up""",
        "p2_flaws": f"with {_ONE} select session_id, count(*) as messages, count(*) filter (where not coalesce(role in ('user', 'assistant'), false)) as unknown_role, count(*) filter (where not shows) as blank, count(*) filter (where coalesce(status != 'complete', true)) as not_complete from one group by 1",
    }
