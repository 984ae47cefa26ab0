import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import neighbours as N


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    return {i: sorted(((-s[a, b], j) for b, j in enumerate(ids) if b != a))[:k] for a, i in enumerate(ids)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>, gid int")


def clusters(seed, groups, size, dims):
    rng = np.random.default_rng(seed)
    return np.vstack([c + 0.15 * rng.standard_normal((size, dims)) for c in rng.standard_normal((groups, dims))]).astype(np.float32)


def recall(spark, x, k, **how):
    ids = [3 * i + 1 for i in range(len(x))]
    got = {}
    for r in N.most_similar(frame(spark, [(i, v.tolist(), 0) for i, v in zip(ids, x)]), "id", "embedding", k=k, dims=x.shape[1], **how).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(ids, x.astype(np.float64), k)
    return np.mean([len({j for _, j in want[i]} & got.get(i, set())) / len(want[i]) for i in ids])


def test_recall_against_brute_force(spark):
    assert recall(spark, clusters(1, 40, 20, 32), 5) > 0.97


def test_split_buckets_keep_recall(spark):
    assert recall(spark, clusters(2, 10, 60, 32), 5, bucket_rows=20) > 0.9


def test_lonely_vectors_are_compared_with_all(spark):
    assert recall(spark, np.random.default_rng(3).standard_normal((90, 16)).astype(np.float32), 4) == 1.0


def test_copies_and_unusable(spark):
    a, b = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0]
    rows = [(i, a, 0) for i in range(1, 9)] + [(1, a, 0), (20, b, 0), (21, [2.0, 0.0, 0.0], 0), (30, None, 0), (None, [1.0, 0.0, 0.0], 0), (31, [0.0] * 3, 0), (32, [1.0, float("nan"), 0.0], 0), (33, [1.0, 2.0], 0), (34, [1.0, None, 2.0], 0), (35, [float("inf"), 1.0, 1.0], 0)]
    out = N.most_similar(frame(spark, rows), "id", "embedding", k=3, dims=3).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.other)
    assert got == {1: [2, 3, 4], 2: [1, 3, 4], 3: [1, 2, 4], **{i: [1, 2, 3] for i in (4, 5, 6, 7, 8, 20, 21)}}


def test_empty_and_single(spark):
    df = frame(spark, [(1, [1.0, 2.0], 0)])
    assert N.most_similar(df, "id", "embedding", dims=2).collect() == [] and N.most_similar(df.limit(0), "id", "embedding", dims=2).collect() == []


def test_scaled_copies_are_taken_together(spark):
    rng = np.random.default_rng(5)
    way = rng.standard_normal(32)
    cloud = np.outer(rng.uniform(0.5, 2, 300), way)
    x = np.vstack([cloud, way + 0.1 * rng.standard_normal((30, 32)), rng.standard_normal((30, 32))]).astype(np.float32)
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    firsts = df.select("id", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"), N.direction("embedding").alias("d"), F.col("id").alias("gid"), F.lit(1).cast("bigint").alias("n")).drop("id")
    groups = N._groups(firsts, 5, N.Scratch(spark)).select("gid", "n").distinct().collect()
    assert len(groups) < 60 + 100 and max(r.n for r in groups) > 30 and min(r.gid for r in groups) == 0
    got, want = {}, brute(list(range(360)), x.astype(np.float64), 5)
    for r in N.most_similar(df, "id", "embedding", k=5, dims=32).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    for i in range(300):
        assert [o for _, o in sorted(got[i])] == [j for _, j in want[i]]
    assert all(len(v) == 5 for v in got.values()) and len(got) == 360


def test_dense_clouds_are_exact(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(32)
    clouds = [centre + noise * rng.standard_normal((400, 32)) for noise in (1e-2, 1e-5)]
    x = np.vstack([*clouds, rng.standard_normal((100, 32))])[rng.permutation(900)].astype(np.float32)
    got, want = {}, brute(list(range(900)), x.astype(np.float64), 5)
    for r in N.most_similar(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), "id", "embedding", k=5, dims=32, bucket_rows=50).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    dense = [i for i, v in enumerate(x) if v @ centre > 0.9 * np.linalg.norm(v) * np.linalg.norm(centre)]
    assert len(dense) == 800 and all([o for _, o in sorted(got[i])] == [j for _, j in want[i]] for i in dense)


def test_blockwise_nearest_against_brute_force():
    rng = np.random.default_rng(7)
    x = np.vstack([1 + 1e-4 * rng.standard_normal((700, 8)), rng.standard_normal((300, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(5_000)[:1_000]
    best = N.Nearest(ids, x, 4, N._floor(x, x[::3], 4))
    for s in np.array_split(rng.permutation(1_000), 20):
        s = s[np.argsort(ids[s])]
        best.meet(ids[s], x[s], np.arange(1_000))
    want = brute(ids.tolist(), x, 4)
    assert all(best.others[a].tolist() == [j for _, j in want[i]] for a, i in enumerate(ids.tolist()))


def test_probing_reaches_loose_neighbours(spark):
    """Vectors that find too few candidates by their own substrings find more at one differing bit; every plan keeps its recall."""
    rng = np.random.default_rng(9)
    x = np.vstack([c + 0.35 * rng.standard_normal((12, 24)) for c in rng.standard_normal((20, 24))]).astype(np.float32)
    for plan in ((12, 16), (18, 20), (28, 24)):
        assert recall(spark, x, 5, plan=plan) > 0.9, plan
