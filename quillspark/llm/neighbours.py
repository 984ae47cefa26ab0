"""The k most similar vectors for every vector, by multi-index hashing over learned rotated binary codes.

1. Exact copies are taken together: one representative, the smallest id, stands for all rows of a vector. So are
   more than k vectors of one direction, which differ by their norm only.
2. On a bounded sample, rotations are learned that make the signs of the coordinates a good code (iterative
   quantisation), and centres that tell which vectors lie together.
3. Each code is split into substrings, each with its own index. By the pigeonhole principle two codes that differ
   in fewer bits than there are substrings agree in one, so probing each index with a code's own substring finds
   every code within that radius, and many beyond. Vectors that find fewer than k candidates so probe the
   substrings at one differing bit too, which doubles the radius.
4. Buckets with many rows tell nothing apart and are left out of the indexes; their rows are compared exactly.
5. Candidate pairs whose codes differ in at most 5/16 of their bits are reranked by their cosine in double precision,
   placed by centre so that a vector travels once for each place that needs it and not once for each pair.
6. Rows of large buckets, and vectors that still have fewer than k candidates, are compared with all vectors that may
   be among their best, in blocks: the sample gives a similarity that the k-th reaches, and the angle around each
   centre tells which centres have nothing above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.skew import skew_join
from quillspark.shared import Scratch

#: Rows that the rotations and centres are learned from, at most.
SAMPLE_ROWS = 20_000
#: Rows up to which a plan of (substrings, bits each) is used: a few random rows for each bucket.
PLANS = [(1 << 20, 12, 16), (1 << 24, 18, 20), (1 << 62, 28, 24)]
#: The rows of a bucket with more rows than this are compared exactly. It is the same for tables of any size, so a row
#: meets at most this many others in each index.
BUCKET_ROWS = 2_000
#: Share of differing code bits up to which a candidate pair is reranked; 5/16 is a cosine of about 0.55.
MOST_DIFFERING = 5 / 16
#: Centres; pairs reranked in one place at most.
CENTRES, PLACE_PAIRS = 256, 400_000
#: Steps to which the coordinates of a unit vector are rounded to tell directions: finer than 6 decimals of a cosine, coarser than float32.
DIRECTION_STEPS = 5_000_000
#: Vectors compared with others in one pass of the blockwise comparison; of these at a time; vectors that they meet at a time.
BLOCK_ROWS, SLICE_ROWS, STRIPE_ROWS = 32_768, 4_096, 512


def usable(embedding: str, dims: int) -> Column:
    """Whether an embedding has ``dims`` finite numbers that aren't all zero."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return e.isNotNull() & (F.size(e) == dims) & finite & F.exists(e, lambda x: x != 0)


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Orthogonal rotations, ``bits`` columns in all, whose signs lose little of the rows of x (iterative quantisation)."""
    rng, d, out = np.random.default_rng(seed), x.shape[1], []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds if len(x) >= d else 0):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ vt).T
        out.append(r)
    return np.hstack(out)[:, :bits]


def learn_centres(x: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _matrix(col: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Coder:
    """Codes of unit vectors: substrings by learned rotations, and the nearest centre."""

    def __init__(self, sample: np.ndarray, dims: int, parts: int, width: int, seed: int = 1):
        self.parts, self.width = parts, width
        unit = _unit(sample) if len(sample) else np.zeros((1, dims))
        self.mean = unit.mean(0)
        self.turn = learn_rotation(unit - self.mean, parts * width, seed)
        self.centres = learn_centres(unit, CENTRES, seed)
        self.ways = self.centres / np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-300)
        self.unit = unit if len(sample) else unit[:0]

    def __getstate__(self) -> dict:
        """What tasks need: all but the sample."""
        return {k: v for k, v in self.__dict__.items() if k != "unit"}

    def _subs(self, signs: np.ndarray) -> np.ndarray:
        return signs.reshape(len(signs), self.parts, self.width) @ (1 << np.arange(self.width, dtype=np.int64))

    def substrings(self, x: np.ndarray) -> np.ndarray:
        return self._subs((x - self.mean) @ self.turn > 0)

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - (self.centres * self.centres).sum(1) / 2).argmax(1)

    def words(self, subs: np.ndarray) -> list[np.ndarray]:
        """Substrings, several to a 64-bit word."""
        each, out = 64 // self.width, []
        for i in range(0, self.parts, each):
            some = subs[:, i : i + each].astype(np.uint64)
            out.append((some << (np.arange(some.shape[1], dtype=np.uint64) * np.uint64(self.width))).sum(1, dtype=np.uint64).view(np.int64))
        return out


def _words(parts: int, width: int) -> list[str]:
    return [f"c{i}" for i in range(-(-parts // (64 // width)))]


def _substring(word: Column, i: int, width: int) -> Column:
    return F.shiftrightunsigned(word, i % (64 // width) * width).bitwiseAND(F.lit((1 << width) - 1))


def encode(vectors: DataFrame, dims: int, coder: Coder) -> DataFrame:
    """``vectors`` with c0, c1, ... (the code) and home (the nearest centre)."""
    words = _words(coder.parts, coder.width)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column("v"), dims))
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, coder.words(coder.substrings(x))), pa.array(coder.home(x).astype(np.int32))], names=[*b.schema.names, *words, "home"])

    return vectors.mapInArrow(run, ", ".join([*kinds, *[f"{w} bigint" for w in words], "home int"]))


def _keys(coder: Coder, bits: list[int]) -> Column:
    """The index keys of a row's code, with each of the ``bits`` masks applied to every substring."""
    parts, width, each = coder.parts, coder.width, 64 // coder.width
    return F.array(*[F.lit(i << width).cast("bigint") + _substring(F.col(f"c{i // each}"), i, width).bitwiseXOR(F.lit(b)) for i in range(parts) for b in bits])


def index_rows(coded: DataFrame, coder: Coder, bucket_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the indexes, one for each substring of a code: gid, home, the code's words, key.

    Buckets with more than ``bucket_rows`` rows are left out; the second frame, gid, has the rows in these, or is None.
    """
    rows = coded.select("gid", "home", *_words(coder.parts, coder.width), F.explode(_keys(coder, [0])).alias("key"))
    # at most substrings * rows / bucket_rows buckets: a table, which Spark broadcasts if it is small
    large = scratch.save(rows.groupBy("key").count().where(F.col("count") > bucket_rows).select("key"), "large")
    if not large.limit(1).count():
        return rows, None
    dense = scratch.save(skew_join(rows.select("gid", "key"), large, ["key"], "left_semi", spread=["gid"]).select("gid").distinct(), "dense")
    return skew_join(rows, large, ["key"], "left_anti", spread=["gid"]), dense


def _near(left: str, right: str, coder: Coder) -> Column:
    """Whether two codes differ in few enough bits to be reranked."""
    apart = [F.col(f"{left}{w}").bitwiseXOR(F.col(f"{right}{w}")) for w in _words(coder.parts, coder.width)]
    return reduce(Column.__add__, map(F.bit_count, apart)) <= int(coder.parts * coder.width * MOST_DIFFERING)


def candidate_pairs(rows: DataFrame, coder: Coder, whole: bool) -> DataFrame:
    """Pairs a < b of codes that agree in some substring: a, b, home_a, home_b. Each pair comes once.

    ``rows`` are index rows, whose buckets are bounded. ``whole``: no bucket was left out.
    """
    parts, width, each = coder.parts, coder.width, 64 // coder.width
    left = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    right = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    on = [F.col("a_key") == F.col("b_key"), F.col("a_gid") < F.col("b_gid"), _near("a_", "b_", coder)]
    if whole:
        for i in range(parts - 1):  # found by an earlier substring
            apart = F.col(f"a_c{i // each}").bitwiseXOR(F.col(f"b_c{i // each}"))
            on.append((F.col("a_key") < ((i + 1) << width)) | (_substring(apart, i, width) != 0))
    found = left.join(right, reduce(Column.__and__, on)).select(F.col("a_gid").alias("a"), F.col("b_gid").alias("b"), F.col("a_home").alias("home_a"), F.col("b_home").alias("home_b"))
    return found if whole else found.distinct()


def probed_pairs(some: DataFrame, rows: DataFrame, coder: Coder) -> DataFrame:
    """Pairs of the coded vectors ``some`` with those whose substring differs in one bit: a, b, home_a, home_b, a < b."""
    words = _words(coder.parts, coder.width)
    keys = _keys(coder, [1 << b for b in range(coder.width)])
    left = some.select(F.col("gid").alias("q_gid"), F.col("home").alias("q_home"), *[F.col(w).alias(f"q_{w}") for w in words], F.explode(keys).alias("key"))
    hit = left.join(rows, "key").where((F.col("q_gid") != F.col("gid")) & _near("q_", "", coder))
    first = F.col("q_gid") < F.col("gid")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return hit.select(pick("q_gid", "gid", "a"), pick("gid", "q_gid", "b"), pick("q_home", "home", "home_a"), pick("home", "q_home", "home_b")).distinct()


def _best(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k most similar others of each id, ties by the smaller other."""
    order = np.lexsort((others, -sims, ids))
    s = ids[order]
    first = np.r_[True, s[1:] != s[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return order[np.arange(len(s)) - start < k]


def rerank(pairs: DataFrame, vectors: DataFrame, dims: int, k: int) -> DataFrame:
    """The best k others of each vector among the pairs: src, dst, sim (cosine in double precision, 6 decimals), copied.

    Each pair is computed where its second vector is placed, by its centre; a centre with many pairs has several
    places. First vectors travel to the places that need them and aren't their own. In a place only the best k of
    each vector are kept, which loses nothing. ``copied``: whether dst or src stands for several rows.
    """
    load = pairs.groupBy(F.col("home_b").alias("home")).agg(F.ceil(F.count(F.lit(1)) / PLACE_PAIRS).cast("bigint").alias("places")).where("places > 1")
    several = {r.home: r.places for r in load.collect()}  # at most one row for each centre
    spread = F.create_map(*[F.lit(x) for pair in several.items() for x in pair]) if several else None

    def place(home: str, key: str) -> Column:
        salt = F.pmod(F.xxhash64(key), F.coalesce(spread[F.col(home)], F.lit(1).cast("bigint"))) if several else F.lit(0)
        return (F.col(home).cast("bigint") * 1_000_000 + salt).alias("place")

    placed = pairs.select("a", "b", place("home_b", "b"), place("home_a", "a").alias("own"))
    needs = placed.where("place != own").select(F.col("a").alias("gid"), F.col("place").alias("at")).distinct()
    sent = needs.join(vectors.select("gid", "v", "n"), "gid").unionByName(vectors.select("gid", "v", "n", place("home", "gid").alias("at")))
    placed = placed.select("a", "b", "place")

    def run(p: pa.Table, v: pa.Table) -> pa.Table:
        if not p.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "sim": pa.array([], pa.float64()), "copied": pa.array([], pa.bool_())})
        ids, x, n = v.column("gid").to_numpy(), _unit(_matrix(v.column("v"), dims)), v.column("n").to_numpy()
        order = np.argsort(ids)
        ids, x, n = ids[order], x[order], n[order]
        a, b = p.column("a").to_numpy(), p.column("b").to_numpy()
        ia, ib = np.searchsorted(ids, a), np.searchsorted(ids, b)
        sims = np.empty(len(a))
        for at in range(0, len(a), 20_000):
            s = slice(at, at + 20_000)
            sims[s] = np.einsum("ij,ij->i", x[ia[s]], x[ib[s]])
        sims = np.round(sims, 6)
        src, dst, sim = np.r_[a, b], np.r_[b, a], np.r_[sims, sims]
        copied = np.tile((n[ia] > 1) | (n[ib] > 1), 2)
        keep = _best(src, dst, sim, k)
        return pa.table({"src": src[keep], "dst": dst[keep], "sim": sim[keep], "copied": copied[keep]})

    return placed.groupBy("place").cogroup(sent.groupBy("at")).applyInArrow(run, "src bigint, dst bigint, sim double, copied boolean")


class Nearest:
    """The best k others of each query so far, ties by the smaller other."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.x, self.k, self.floor = ids, x, k, floor
        self.sims, self.others = np.full((len(ids), k), -9.0), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> None:
        """Compares the queries at the positions ``at`` with vectors x, whose ids are ascending."""
        sims = self.x[at] @ x.T
        pos = np.minimum(np.searchsorted(ids, self.ids[at]), len(ids) - 1)
        own = np.nonzero(ids[pos] == self.ids[at])[0]
        sims[own, pos[own]] = -9
        # a tie counts only if some id here is smaller than the last one kept; the margins hold for any rounding
        last, other = self.sims[at, -1], self.others[at, -1]
        bound = np.maximum(np.where(ids[0] < other, last - 6e-7, last + 4e-7), self.floor[at] - 6e-7)
        some = np.nonzero(sims.max(1) >= bound)[0]
        if not len(some):
            return
        sims, at, k = sims[some], at[some], self.k
        # whole numbers that order by rounded similarity, then by the smaller id
        key = np.rint(np.round(sims, 6) * 1e6) * len(ids) - np.arange(len(ids))
        top = np.argpartition(-key, k - 1, axis=1)[:, :k] if len(ids) > k else np.tile(np.arange(len(ids)), (len(some), 1))
        sims = np.c_[self.sims[at], np.round(np.take_along_axis(sims, top, 1), 6)]
        others = np.c_[self.others[at], ids[top]]
        order = np.lexsort((others, -sims), axis=1)[:, :k]
        self.sims[at], self.others[at] = np.take_along_axis(sims, order, 1), np.take_along_axis(others, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero((self.sims > -9) & (self.sims >= self.floor[:, None] - 6e-7))
        return self.ids[row], self.others[row, col], self.sims[row, col]


def _floor(x: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each row of x, a rounded similarity that its k-th other reaches: the one of the k + 1st of the sample, which may hold the row itself."""
    if len(sample) <= k:
        return np.full(len(x), -2.0)
    at = len(sample) - k - 1
    sims = [np.partition(x[i : i + 1_024] @ sample.T, at, axis=1)[:, at] for i in range(0, len(x), 1_024)]
    return np.round(np.concatenate(sims) - 1e-9, 6)  # 1e-9: products may differ in their last bits


def spread_of_homes(vectors: DataFrame, dims: int, coder: Coder) -> np.ndarray:
    """The largest angle between a centre's direction and a vector placed by it; -1 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(len(coder.centres), -1.0)
        for b in batches:
            if b.num_rows:
                h = b.column("home").to_numpy()
                np.maximum.at(most, h, _angle((_unit(_matrix(b.column("v"), dims)) * coder.ways[h]).sum(1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most), dtype=np.int32)), pa.array(most)], names=["home", "most"])

    out = np.full(len(coder.centres), -1.0)
    for r in vectors.select("home", "v").mapInArrow(run, "home int, most double").groupBy("home").agg(F.max("most").alias("most")).collect():
        out[r.home] = r.most
    return out


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def against_all(queries: DataFrame, vectors: DataFrame, dims: int, k: int, coder: Coder, spread: np.ndarray) -> DataFrame:
    """The exact best k others of each query among all vectors, in one pass over those that may be among them: src, dst, sim.

    ``queries`` has at most BLOCK_ROWS rows and goes to every task. ``spread`` is of spread_of_homes. A home is left
    out for the queries whose floor is above all that its angles allow.
    """
    q = queries.select("gid", "v").toArrow()
    q_ids, q_x = q.column("gid").to_numpy(), _unit(_matrix(q.column("v"), dims))
    floor = _floor(q_x, coder.unit, k)
    reach = np.maximum(_angle(q_x @ coder.ways.T) - spread - 1e-6, 0)  # 1e-6: angles are less exact near 0
    needed = (np.cos(reach) >= floor[:, None] - 2e-6) & (spread >= 0)
    homes = np.nonzero(needed.any(0))[0].tolist()
    kind = np.unique(needed.T, axis=0, return_inverse=True)[1].ravel()  # homes that the same queries need go together
    asking = {g: np.nonzero(needed[:, np.argmax(kind == g)])[0] for g in np.unique(kind[homes]).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(q_ids, q_x, k, floor)
        for b in batches:
            if not b.num_rows:
                continue
            ids, group, x = b.column("gid").to_numpy(), kind[b.column("home").to_numpy()], _unit(_matrix(b.column("v"), dims))
            order = np.argsort(ids)
            for g in np.unique(group).tolist():
                inside = order[group[order] == g]
                for i in range(0, len(inside), STRIPE_ROWS):
                    s = inside[i : i + STRIPE_ROWS]
                    for at in range(0, len(asking[g]), SLICE_ROWS):
                        best.meet(ids[s], x[s], asking[g][at : at + SLICE_ROWS])
        yield pa.RecordBatch.from_arrays(list(map(pa.array, best.found())), names=["src", "dst", "sim"])

    # few tasks: each returns up to k rows for a query
    return vectors.where(F.col("home").isin(homes)).select("gid", "v", "home").coalesce(vectors.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "src bigint, dst bigint, sim double")


def _blocks(rest: DataFrame) -> tuple[DataFrame, int]:
    """``rest`` with ``block``: rows of one home together, at most about half of BLOCK_ROWS to a block; and the number of blocks."""
    half, first, share, block, filled = BLOCK_ROWS // 2, {}, {}, 0, 0
    for r in sorted(rest.groupBy("home").count().collect(), key=lambda r: r.home):
        if filled and filled + r["count"] > half:
            block, filled = block + 1, 0
        first[r.home], share[r.home] = block, -(-r["count"] // half)
        block, filled = block + share[r.home] - 1, filled + r["count"] if share[r.home] == 1 else half
    of = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("home")]
    return rest.withColumn("block", of(first) + F.pmod(F.xxhash64("gid", F.lit(7)), of(share))), block + 1


def direction(v: str) -> Column:
    """A hash of the unit vector's rounded coordinates; all vectors have one length."""

    def run(a: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.int64())
        x = _unit(_matrix(a, len(a[0])))
        factors = np.random.default_rng(1).integers(0, 1 << 64, x.shape[1], dtype=np.uint64)
        return pa.array((np.rint(x * DIRECTION_STEPS).astype(np.int64).view(np.uint64) * factors).sum(1, dtype=np.uint64).view(np.int64))

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")(v)


def _groups(firsts: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """``firsts`` (h1, h2, d, gid, n) with more than ``k`` vectors of one direction d under their smallest gid: h1, h2, gid, n.

    Fewer stay apart, each compared as itself. More are each other's k most similar rows at 1.0, and what
    others see of them differs by at most two units of the 6th decimal, mostly none. A direction whose coordinates lie
    on an edge of rounding becomes a few groups, which find each other like any vectors.
    """
    wide = scratch.save(firsts.groupBy("d").agg(F.min("gid").alias("_gid"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_c")).where(F.col("_c") > k).drop("_c"), "wide")
    if not wide.limit(1).count():
        return firsts.drop("d")
    inside = skew_join(firsts, wide, ["d"], spread=["gid"]).select("h1", "h2", F.col("_gid").alias("gid"), F.col("_n").alias("n"))
    outside = skew_join(firsts, wide, ["d"], how="left_anti", spread=["gid"]).select("h1", "h2", "gid", "n")
    return scratch.save(outside.unionByName(inside), "groups")


def most_similar(df: DataFrame, id_col: str, embedding: str, k: int = 10, dims: int = 64, bucket_rows: int = BUCKET_ROWS, plan: tuple[int, int] | None = None) -> DataFrame:
    """The k most similar others of every row with a usable embedding: id, other, sim, rank from 1.

    Usable is an embedding of ``dims`` finite numbers that aren't all zero; other rows, and rows without id, are left
    out. Rows repeated under one id count once. Similarity is the cosine in double precision rounded to 6 decimals, ties
    go to the smaller id. Copies, exact or scaled, are each other's neighbours like any rows. Fewer than k others exist
    only where the table has no more. An empty table gives an empty result.

    ``plan`` is the number of substrings and the bits of each; by default both grow with the rows, so that a bucket
    holds a few random ones. The search is approximate: a true neighbour is missed if its code agrees in no substring,
    or differs in more than 5/16 of its bits, while k other candidates are found. Rows in buckets of more than
    ``bucket_rows`` rows, and rows with too few candidates, have their exact neighbours; the time for a dense cloud grows
    with the square of its rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.where(usable(embedding, dims) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("v"))
    digests = rows.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).distinct()
    firsts = rows.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), direction("v").alias("d")).distinct()
    firsts = scratch.save(firsts.groupBy("h1", "h2", "d").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("n")), "firsts")
    groups = _groups(firsts, k, scratch)
    copies = scratch.save(digests.join(groups.where("n > 1"), ["h1", "h2"]).select("id", "gid"), "copies")
    vectors = rows.withColumnRenamed("id", "gid").join(groups.select("gid", "n").distinct(), "gid").dropDuplicates(["gid"])
    vectors = scratch.save(vectors, "vectors")
    scratch.drop(firsts)
    n = vectors.count()
    parts, width = plan or next(p[1:] for p in PLANS if n <= p[0])
    sample = vectors.orderBy(F.xxhash64("gid")).limit(SAMPLE_ROWS).select("v").toArrow()
    coder = Coder(_matrix(sample.column("v"), dims), dims, parts, width)
    coded = scratch.save(encode(vectors, dims, coder), "coded")
    scratch.drop(vectors)
    index, dense = index_rows(coded, coder, bucket_rows, scratch)
    vectors = coded.select("gid", "v", "n", "home")
    by, whole = Window.partitionBy("src").orderBy(F.desc("sim"), "dst"), Window.partitionBy("src")
    top = lambda df: df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    counted = lambda df: top(df).withColumn("copied", F.max("copied").over(whole)).withColumn("found", F.count(F.lit(1)).over(whole))

    def ranked(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs, "pairs")
        out = scratch.save(counted(rerank(pairs, vectors, dims, k)), "best")
        scratch.drop(pairs)
        return out

    def short_of(best: DataFrame) -> DataFrame:
        full = best.where((F.col("rank") == 1) & (F.col("found") >= min(k, max(n - 1, 0)))).select(F.col("src").alias("gid"))
        return (full if dense is None else full.join(dense, "gid", "left_anti")).distinct()

    best = ranked(candidate_pairs(index, coder, dense is None))
    few = coded.join(short_of(best), "gid", "left_anti")
    few = scratch.save(few if dense is None else few.join(dense, "gid", "left_anti"), "few")
    if few.limit(1).count():
        more = ranked(probed_pairs(few, index, coder)).select("src", "dst", "sim", "copied")
        asked = few.select(F.col("gid").alias("src"))
        again = best.join(asked, "src", "left_semi").select("src", "dst", "sim", "copied").unionByName(more.join(asked, "src", "left_semi")).dropDuplicates(["src", "dst"])
        best = scratch.save(best.join(asked, "src", "left_anti").unionByName(counted(again).select(best.columns)), "best")
    # vectors with too few candidates, and those in large buckets, are compared with all others that may be nearer
    rest = scratch.save(vectors.join(short_of(best), "gid", "left_anti"), "rest")
    best = best.drop("found")
    if rest.limit(1).count():
        rest, blocks = _blocks(rest)
        rest = scratch.save(rest, "rest")
        spread = spread_of_homes(vectors, dims, coder)
        exact = [scratch.save(top(against_all(rest.where(F.col("block") == i), vectors, dims, k, coder, spread)), "exact") for i in range(blocks)]
        exact = reduce(DataFrame.unionByName, exact).withColumn("copied", F.lit(True))
        best = best.join(rest.select(F.col("gid").alias("src")), "src", "left_anti").unionByName(exact)
    return _with_copies(best, copies, k)


def _with_copies(best: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """From representatives to rows: id, other, sim, rank.

    A list in which some group has several rows names the smallest k + 1 ids of every group in it, its own
    included, and each row of its own group leaves itself out.
    """
    plain = best.where(~F.col("copied")).select(F.col("src").alias("id"), F.col("dst").alias("other"), "sim", "rank")
    w = Window.partitionBy("gid").orderBy("id")
    named = copies.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).select(F.col("gid").alias("dst"), "id")
    own = copies.select(F.col("gid").alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("sim"))
    mixed = best.where("copied").select("src", "dst", "sim").unionByName(own).join(named, "dst", "left").select("src", "sim", F.coalesce("id", "dst").alias("other"))
    by = Window.partitionBy("src").orderBy(F.desc("sim"), "other")
    packed = mixed.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k + 1).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("_r", "sim", "other"))).alias("l"))
    members = copies.select("id", F.col("gid").alias("src"))
    single = packed.join(own.select("src"), "src", "left_anti").select(F.col("src").alias("id"), "l")
    many = single.unionByName(skew_join(members, packed, ["src"], spread=["id"]).select("id", "l")).select("id", F.expr(f"slice(filter(l, x -> x.other != id), 1, {k})").alias("l"))
    return plain.unionByName(many.select("id", F.posexplode("l").alias("p", "x")).select("id", "x.other", "x.sim", (F.col("p") + 1).alias("rank")))
