import random

from quillspark.llm import splitting as S


def brute(text, limit):
    return next((x for x in S.LEVELS[:-1] if all(e - s <= limit for s, e in S.units(text, x))), "none")


def greedy(units, limit):
    """Starts of pieces by walking."""
    starts, at = [], 0
    while at < len(units):
        starts.append(at)
        s = units[at][0]
        nxt = at
        while nxt < len(units) and units[nxt][1] - s <= limit:
            nxt += 1
        at = nxt
    return starts


def test_levels_and_cuts_against_walking():
    rng = random.Random(4)
    texts = []
    for _ in range(300):
        texts.append("".join(rng.choice(["Từ này", "dài. ", " ", "\n", "\n\n", "\r\n \r\n", "câu! ", "x" * rng.randint(1, 30)]) for _ in range(rng.randint(1, 60))))
    found, at = S.coarsest(texts, 60)
    assert found == [brute(t, 60) for t in texts]
    fit = [u for u in at.values() if u]
    b = S.Boundaries(fit, 60)
    marked, fits = b.cuts(b.successors(60))
    assert fits.all()
    for k, u in enumerate(fit):
        assert [i for i, m in enumerate(marked[b.first[k] : b.first[k + 1]]) if m] == greedy(u, 60)


def test_pieces_cover_and_stay_within_the_limit():
    rng = random.Random(5)
    for _ in range(150):
        t = "".join(rng.choice(["Một câu. ", "từ ", "\n\n", "。学", "y" * rng.randint(1, 90), " "]) for _ in range(rng.randint(5, 120)))
        (ps,) = S.pieces([t], 80, 20)
        covered = 0
        for k, (s, f, e) in enumerate(ps):
            assert s <= f <= e and e - s <= 80 or len(t) <= 80
            assert f - s <= 20 and not t[covered:f].strip() and (k == 0 or s >= ps[k - 1][0] and f >= ps[k - 1][2])
            covered = e
        assert not t[covered:].strip()


def test_frames(spark):
    rows = [(1, 7, 0, "a", "short", "z"), (2, 7, 1, None, "Một câu dài. " * 200, "z"), (2, 7, 1, None, "Một câu dài. " * 200, "z"), (3, 7, 1, "c", "x" * 2500, "z"), (4, None, None, "d", "ngắn", "z"), (5, 7, 9, "e", None, "z"), (6, 7, 9, "e", "", "z"), (7, 8, 0, "f", " " * 1500, "z"), (None, 9, 0, "f", "x" * 1500, "z")]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, section string, text string, base string")
    assert sorted(map(tuple, S.coarsest_boundaries(df, "id", "text").collect())) == [(2, "sentence"), (3, "none"), (7, "paragraph")]
    out = S.split_oversized(df, "id", "document_id", "chunk_index", "text", ["section"]).collect()
    seven = sorted((r.piece_index, r.id, len(r.piece), r.section) for r in out if r.document_id == 7)
    assert [x[0] for x in seven] == list(range(len(seven))) and seven[0][1] == 1 and max(x[2] for x in seven) <= 1000 and {x[1] for x in seven} == {1, 2, 3}
    assert [(r.piece_index, r.overlap) for r in out if r.document_id is None] == [(0, 0)]
    assert S.split_oversized(df.limit(0), "id", "document_id", "chunk_index", "text", []).collect() == []


def test_long_words_between_words():
    (ps,) = S.pieces(["từ " * 100 + "x" * 3_000 + " từ" * 100], 1_000, 150)
    assert all(e - s <= 1_000 and f - s <= 150 for s, f, e in ps) and ps[0][2] == 1_000 and len(ps) == 5
    assert len(S.units("y" * 1_000_000, "none", 50)) == 20_000
