from datetime import datetime as T

from quillspark.llm.conversations import conversations, resolve, root_to_leaf
from quillspark.shared import Scratch

M = "id bigint, session_id string, role string, content string, status string, created_at timestamp, turn_no int"


def test_resolve_orphans_cycles_chains(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    other = [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 77777), (2001, 2000), (3000, None), (3000, None), (None, 5)]
    got = {r.id: (r.root, r.depth, r.state) for r in resolve(spark.createDataFrame(chain + other, "id long, parent long"), "id", "parent", Scratch(spark)).collect()}
    assert all(got[i] == (0, i, "ok") for i in range(300))
    assert all(got[i] == (None, None, "cycle") for i in (1000, 1001, 1002, 1003))
    assert got[2000] == (2000, 0, "orphan") and got[2001] == (2000, 1, "orphan") and got[3000] == (3000, 0, "ok") and len(got) == 307
    assert resolve(spark.createDataFrame([], "id long, parent long"), "id", "parent", Scratch(spark)).collect() == []


def test_paths_of_a_tree(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3), (5, 3), (6, 5), (9, 9), (8, 404)], "id long, parent long")
    paths = {}
    for r in root_to_leaf(tree, "id", "parent", Scratch(spark)).collect():
        paths.setdefault(r.leaf, []).append((r.turn, r.id))
    assert {k: [i for _, i in sorted(v)] for k, v in paths.items()} == {2: [1, 2], 4: [1, 3, 4], 6: [1, 3, 5, 6], 8: [8]}


def test_kept_conversations(spark):
    t = lambda s: T(2024, 1, 1, 0, 0, s)
    rows = []

    def say(session, *turns, start=0):
        for k, (role, content, status) in enumerate(turns):
            rows.append((len(rows) + 1, session, role, content, status, t(start + k), 9))

    ok = "complete"
    say("good", (" User ", "a", ok), ("ASSISTANT", "b", ok), ("user", "c", ok), ("assistant", "x" * 100_000, ok))
    rows.append(rows[0])
    say("no row", ("user", "a", ok), ("assistant", "b", ok))
    say("no reply", ("user", "a", ok), ("assistant", "b", ok), ("user", "c", ok))
    say("twice", ("user", "a", ok), ("user", "b", ok), ("assistant", "c", ok))
    say("blank", ("user", " ​ \n", ok), ("assistant", "b", ok))
    say("null", ("user", None, ok), ("assistant", "b", ok))
    say("failed", ("user", "a", ok), ("assistant", "b", "failed"))
    say("odd role", ("user", "a", ok), ("tool", "b", ok))
    say("no role", (None, "a", ok), ("assistant", "b", ok))
    rows += [(101, "ties", "assistant", "b", ok, t(0), 1), (100, "ties", "user", "a", ok, t(0), 1), (99, "late", "assistant", "b", ok, t(5), 1), (103, "late", "user", "a", ok, t(1), 1), (104, None, "user", "a", ok, t(1), 1)]
    m = spark.createDataFrame(rows, M)
    s = spark.createDataFrame([(x,) for x in ("good", "no reply", "twice", "blank", "null", "failed", "odd role", "no role", "ties", "late", "empty", "good")], "id string")
    got = sorted((r.session_id, r.turn_no, r.message_id) for r in conversations(m, s).collect())
    assert got == [("good", 1, 1), ("good", 2, 2), ("good", 3, 3), ("good", 4, 4), ("late", 1, 103), ("late", 2, 99), ("ties", 1, 100), ("ties", 2, 101)]
    assert conversations(m.limit(0), s).collect() == [] and conversations(m, s.limit(0)).collect() == []
