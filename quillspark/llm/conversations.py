"""Conversations rebuilt from message rows, by pointer jumping over parent pointers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lookalikes import INVISIBLE
from quillspark.operators.ordering import with_previous
from quillspark.operators.skew import skew_join
from quillspark.shared import Scratch

BLANK = r"\s\p{Z}\p{Cc}" + INVISIBLE
SHOWS = f"[^{BLANK}]"


def shows(col: str) -> Column:
    """Whether a text shows something: it isn't null and holds more than blanks and invisible characters."""
    return F.coalesce(F.col(col).rlike(SHOWS), F.lit(False))


def clear_role(col: str) -> Column:
    """A role without surrounding blanks, in lower case."""
    return F.lower(F.regexp_replace(col, f"^[{BLANK}]+|[{BLANK}]+$", ""))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def resolve(nodes: DataFrame, id_col: str, parent_col: str, scratch: Scratch) -> DataFrame:
    """id, parent, root, depth and state of every node of a forest of parent pointers.

    Each round replaces a node's pointer by its target's pointer, so chains of length n take log2(n) joins; only nodes
    that haven't reached their root are written again. State is ``ok``, ``orphan`` (the topmost node points to an id
    that has no row; it acts as root) or ``cycle`` (no root: root and depth are null). A round in which no node reaches
    its root leaves only cycles. A null parent is a root. Repeated ids count once, null ids are left out.
    """
    edges = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("id is not null").dropDuplicates(["id"])
    edges = scratch.save(edges, "edges")
    first = edges.join(edges.select(F.col("id").alias("there")), F.col("parent") == F.col("there"), "left")
    is_root, orphan = F.col("parent").isNull(), F.col("there").isNull()
    last = scratch.save(
        first.select(
            "id", "parent",
            F.when(~is_root & ~orphan, F.col("parent")).alias("up"),
            F.when(is_root | orphan, 0).otherwise(1).cast("bigint").alias("dist"),
            F.when(is_root | orphan, F.col("id")).alias("root"),
            F.when(is_root, "ok").when(orphan, "orphan").alias("state"),
        ),
        "state",
    )
    scratch.drop(edges)
    done, lost = [last.where("up is null")], last.where("up is not null")
    left = lost.count()
    while left:
        to = _union([*done, lost]).select(F.col("id").alias("t_id"), F.col("up").alias("t_up"), F.col("dist").alias("t_dist"), F.col("root").alias("t_root"), F.col("state").alias("t_state"))
        jumped = lost.select("id", "parent", "up", "dist").join(to, F.col("up") == F.col("t_id"))
        jumped = jumped.select("id", "parent", F.col("t_up").alias("up"), (F.col("dist") + F.col("t_dist")).alias("dist"), F.col("t_root").alias("root"), F.col("t_state").alias("state"))
        last = scratch.save(jumped, "state")
        done, lost, before = [*done, last.where("up is null")], last.where("up is not null"), left
        left = lost.count()
        if left == before:
            break
    cyclic = lost.select("id", "parent", F.lit(None).cast(dict(last.dtypes)["root"]).alias("root"), F.lit(None).cast("bigint").alias("depth"), F.lit("cycle").alias("state"))
    return _union([*[d.select("id", "parent", "root", F.col("dist").alias("depth"), "state") for d in done], cyclic])


def root_to_leaf(nodes: DataFrame, id_col: str, parent_col: str, scratch: Scratch) -> DataFrame:
    """All root-to-leaf paths: leaf, id, turn (1 for the root), state. A node with several leaves below comes once for each.

    A thread with one leaf is a single path, which the nodes' roots and depths already give. In branching threads
    paths double in each round: every (leaf, node) is joined with the node's ancestor twice as far as before. Nodes
    on or below a cycle have no path; a node whose parent has no row is a root (state ``orphan`` along its paths).
    """
    ok = scratch.save(resolve(nodes, id_col, parent_col, scratch).where("state != 'cycle'"), "ok")
    inner = ok.where("depth > 0").select(F.col("parent").alias("id")).distinct()
    leaves = scratch.save(ok.join(inner, "id", "left_anti").select("root", F.col("id").alias("leaf"), "depth", "state"), "leaves")
    per = leaves.groupBy("root").agg(F.min("leaf").alias("leaf"), F.count(F.lit(1)).alias("leaves"))
    single = skew_join(ok, per.where("leaves = 1").select("root", "leaf"), ["root"], spread=["id"]).select("leaf", "id", "depth", "state")
    branching = scratch.save(per.where("leaves > 1").select("root"), "branching")
    out = [single]
    if branching.limit(1).count():
        inside = skew_join(ok.where("depth > 0"), branching, ["root"], "left_semi", spread=["id"])
        jump = scratch.save(inside.select("id", F.col("parent").alias("up")), "jump")
        paths = scratch.save(skew_join(leaves, branching, ["root"], "left_semi", spread=["leaf"]).select("leaf", F.col("leaf").alias("id"), "depth", "state"), "paths")
        deepest, step = paths.agg(F.max("depth")).first()[0], 1
        while step <= deepest:
            further = skew_join(paths, jump, ["id"], spread=["leaf"]).select("leaf", F.col("up").alias("id"), (F.col("depth") - step).alias("depth"), "state")
            longer = scratch.save(paths.unionByName(further), "paths")
            twice = scratch.save(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "jump")
            scratch.drop(paths, jump)
            paths, jump, step = longer, twice, step * 2
        out.append(paths)
    return _union(out).select("leaf", "id", (F.col("depth") + 1).cast("int").alias("turn"), "state")


def conversations(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages of kept conversations: session_id, turn_no from 1, message_id, role.

    The messages of a session are linked in order of created_at, then id, and come out as root-to-leaf paths. A
    conversation is kept if its session has a row in ``sessions``, it starts with user, strictly alternates user and
    assistant, ends with assistant, and each message is complete and shows something. Roles are read regardless of case
    and surrounding blanks. Rows repeated under one id count once; messages without session or id are left out; null
    created_at come first. Sessions that hold a bad message or unknown role are left out before the links are followed.
    """
    scratch = Scratch(messages.sparkSession)
    one = messages.where("session_id is not null and id is not null").select("id", "session_id", "created_at", clear_role("role").alias("role"), (shows("content") & (F.col("status") == "complete")).alias("good")).dropDuplicates(["id"])
    fine = F.coalesce(F.col("good") & F.col("role").isin("user", "assistant"), F.lit(False))
    one = scratch.save(one.select("id", "session_id", "created_at", "role", fine.alias("fine")), "one")
    whole = one.groupBy("session_id").agg(F.min("fine").alias("fine")).where("fine").select("session_id")
    whole = whole.join(sessions.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_semi")
    rows = skew_join(one, whole, ["session_id"], "left_semi", spread=["id"]).select("id", "session_id", "created_at", "role")
    linked = scratch.save(with_previous(rows, ["session_id"], ["created_at", "id"], {"id": "parent"}, scratch), "linked")
    scratch.drop(one)
    paths = root_to_leaf(linked, "id", "parent", scratch)
    turns = scratch.save(paths.join(linked.select("id", "session_id", "role"), "id"), "turns")
    in_turn = F.col("role") == F.when(F.col("turn") % 2 == 1, "user").otherwise("assistant")
    kept = turns.groupBy("leaf").agg(F.min((F.col("state") == "ok") & in_turn).alias("in_turn"), F.max("turn").alias("turns")).where("in_turn and turns % 2 = 0").select("leaf")
    return skew_join(turns, kept, ["leaf"], "left_semi", spread=["id"]).select("session_id", F.col("turn").alias("turn_no"), F.col("id").alias("message_id"), "role")
