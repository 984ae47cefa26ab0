"""Retrieval for many queries at once: BM25, inner products, rank fusion, candidates, final answers.

All rankings break ties by the smaller id. Scores are rounded before they are ranked, so that a ranking doesn't
depend on the order in which partial sums were added.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.settings import Settings
from quillspark.shared import Scratch

#: Query rows (terms) up to which the query side is sent to every task; more are joined by shuffle.
BROADCAST_QUERY_ROWS = 200_000
#: Query vectors that one pass over the vectors is made for, and vectors that a task multiplies them with at a time.
QUERY_SLICE, VECTOR_BATCH = 4_096, 1_024
#: Postings of a query's rarest terms that its first bound is taken from, in multiples of k.
SEED_POSTINGS = 4
#: Matching postings of all queries up to which each is scored: finding bounds takes longer then. The result is the same.
DIRECT_POSTINGS = 10_000_000
#: Scores closer than this to a bound are never left out by it.
MARGIN = 1e-5
INDEX_VERSION = 2


def small_side(saved: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How frames with at most as many rows as ``saved`` are sent to joins: by broadcast if a count shows that it is small."""
    return F.broadcast if saved.count() <= BROADCAST_QUERY_ROWS else lambda df: df


def query_side(df: DataFrame) -> DataFrame:
    """Marks a query side for broadcast if a count shows that it is small."""
    return small_side(df)(df)


@dataclass(frozen=True)
class Index:
    """An inverted index as tables: postings (id, term, tf, gain) and terms (term, df, idf, most).

    ``gain`` is what a posting's count is worth before the term's idf, ``most`` the largest gain of a term.
    """

    postings: DataFrame
    terms: DataFrame


def _index(postings: DataFrame, terms: DataFrame, n_docs: int, length: int, floor: float, settings: Settings) -> Index:
    """The index over written tables: gains and idfs follow from the counts as they are read."""
    s, f = settings, F.col("tf")
    gain = f * (s.k1 + 1) / (f + s.k1 * (1 - s.b + s.b * F.col("doc_len") / F.lit(max(length / max(n_docs, 1), 1e-12))))
    idf = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return Index(postings.select("id", "term", "tf", gain.alias("gain")), terms.select("term", "df", F.when(idf < 0, F.lit(floor)).otherwise(idf).alias("idf"), "most"))


def _counted(docs: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """id, term, doc_len, tf of documents."""
    # a row that comes out of explode is made once, however often it is used
    made = docs.select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.array(tokens)).alias("tokens"))
    one = made.select("id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    return one.groupBy("id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def write_index(docs: DataFrame, id_col: str, tokens: str, path: str, settings: Settings, clustered: bool = True) -> Index:
    """Writes the index of documents (id_col, tokens): postings, terms and, last of all, the stats that make it valid.

    ``clustered``: postings are ordered by term, so that later searches read the terms they ask for; an index for the
    searches of one job can do without. Documents without tokens count for the average length. A negative idf is
    replaced by epsilon times the mean idf of the vocabulary, negatives included.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    tf = _counted(docs, id_col, tokens)
    if clustered:  # by term and id, so that a frequent term has several ranges
        tf = tf.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
    tf.write.mode("overwrite").parquet(f"{path}/postings")
    return _finish_index(spark, path, n_docs, settings, clustered)


def _finish_index(spark: SparkSession, path: str, n_docs: int, settings: Settings, stats: bool = True) -> Index:
    """Terms and statistics of written postings."""
    postings = spark.read.schema("id bigint, term string, doc_len int, tf bigint").parquet(f"{path}/postings")
    length = postings.agg(F.sum("tf")).first()[0] or 0
    bare = _index(postings, spark.createDataFrame([], "term string, df bigint, most double"), n_docs, length, 0.0, settings).postings
    terms = bare.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("gain").alias("most"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.schema(terms.schema).parquet(f"{path}/terms")
    idf = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    floor = settings.epsilon * (terms.agg(F.avg(idf)).first()[0] or 0.0)
    if stats:
        spark.createDataFrame([(n_docs, length, floor, INDEX_VERSION)], "n_docs bigint, length bigint, floor double, version int").write.mode("overwrite").parquet(f"{path}/stats")
    return _index(postings, terms, n_docs, length, floor, settings)


def open_index(spark: SparkSession, path: str, settings: Settings) -> Index:
    """The index written at ``path``; one of another version has to be written again."""
    stats = spark.read.parquet(f"{path}/stats").first()
    if stats["version"] != INDEX_VERSION:
        raise ValueError("the index has another version: write it again")
    return _index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), stats["n_docs"], stats["length"], stats["floor"], settings)


def append_to_index(index_path: str, docs: DataFrame, id_col: str, tokens: str, path: str, settings: Settings) -> Index:
    """The index at ``index_path`` with new documents, written to ``path``: old postings are copied, statistics are made anew. Documents it has already are left out."""
    spark = docs.sparkSession
    old = spark.read.parquet(f"{index_path}/postings")
    was = spark.read.parquet(f"{index_path}/stats").first()
    new = docs.join(old.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    every = old.unionByName(_counted(new, id_col, tokens)).repartitionByRange("term", "id").sortWithinPartitions("term", "id")
    every.write.mode("overwrite").parquet(f"{path}/postings")
    return _finish_index(spark, path, was["n_docs"] + new.count(), settings)


def build_index(docs: DataFrame, id_col: str, tokens: str, settings: Settings, scratch: Scratch) -> Index:
    """An index of documents for the searches of one job, in the shared folder."""
    return write_index(docs, id_col, tokens, f"{scratch.at}/index-{uuid.uuid4().hex[:8]}", settings, clustered=False)


def top_k(df: DataFrame, query: str, score: str, key: str, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def query_terms(queries: DataFrame, query_id: str, tokens: str) -> DataFrame:
    """q, term, times: the distinct terms of each query and how often they stand in it."""
    return queries.select(F.col(query_id).alias("q"), F.explode(tokens).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times"))


def _sums(postings: DataFrame, terms: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """q, id and the summed worth of the postings of ``terms`` (q, term, weight). ``hint`` marks small query sides."""
    return postings.join(hint(terms.select("q", "term", "weight")), "term").groupBy("q", "id").agg(F.sum(F.col("weight") * F.col("gain")).alias("part"))


def _complete(found: DataFrame, postings: DataFrame, terms: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """q, id, score: ``found`` (q, id, part) with the worth of ``terms`` in those documents, looked up by document and term."""
    wanted = found.select("q", "id").join(hint(terms.select("q", "term", "weight")), "q")
    listed = postings.join(hint(terms.select("term").distinct()), "term", "left_semi")
    more = wanted.join(listed, ["id", "term"]).select("q", "id", (F.col("weight") * F.col("gain")).alias("part"))
    return found.select("q", "id", "part").unionByName(more).groupBy("q", "id").agg(F.sum("part").alias("score"))


def best_scored(postings: DataFrame, terms: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The k best documents of each query by summed worth: q, id, score (6 decimals), rank. Only positive scores.

    ``terms``: q, term, weight, df, most (the largest gain of the term). Exact, without scoring every document that
    holds some query term: the rarest terms give each query a score that its k-th document reaches; terms that can't
    add up to that even together bring no candidates, and are looked up for the candidates of the others alone.
    """
    terms = scratch.save(terms, "terms")
    n, matching = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    hint = F.broadcast if n <= BROADCAST_QUERY_ROWS else lambda df: df
    if matching <= DIRECT_POSTINGS:
        scored = _sums(postings, terms, hint).select("q", "id", F.round("part", 6).alias("score")).where("score > 0")
        return top_k(scored, "q", "score", "id", k)
    over = Window.partitionBy("q").orderBy(F.desc("bound"), "df", "term")
    before, after = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(0, Window.unboundedFollowing)
    t = terms.withColumn("bound", F.greatest(F.col("weight") * F.col("most"), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("bound").over(after)).withColumn("seen", F.coalesce(F.sum("df").over(before), F.lit(0)))
    t = t.withColumn("least", F.sum(F.least(F.col("weight") * F.col("most"), F.lit(0.0))).over(Window.partitionBy("q")))
    t = scratch.save(t, "terms")
    seeds = _sums(postings, t.where(F.col("seen") < SEED_POSTINGS * k), hint)
    # what is left out by rank is smaller, so the k-th of those kept is the k-th
    kth = top_k(seeds, "q", "part", "id", k).groupBy("q").agg(F.min("part").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    t = t.join(hint(kth.select("q", "kth")), "q", "left").withColumn("need", F.col("kth") + F.col("least") - MARGIN)
    t = scratch.save(t.withColumn("leads", F.col("need").isNull() | (F.col("rest") >= F.col("need"))), "terms")
    follow = t.where("not leads")
    found = _sums(postings, t.where("leads"), hint)
    if follow.limit(1).count():
        reach = follow.groupBy("q").agg(F.max("rest").alias("more"), F.max("need").alias("need"))
        hopeful = found.join(hint(reach), "q", "left").where(F.col("need").isNull() | (F.col("part") + F.col("more") >= F.col("need")))
        scored = _complete(hopeful.select("q", "id", "part"), postings, follow, hint)
    else:
        scored = found.withColumnRenamed("part", "score")
    scored = scored.select("q", "id", F.round("score", 6).alias("score")).where("score > 0")
    return top_k(scored, "q", "score", "id", k)


def bm25(index: Index, queries: DataFrame, query_id: str, query_tokens: str, id_col: str, k: int, scratch: Scratch) -> DataFrame:
    """Top k documents of each query: query_id, id_col, score, rank. Repeated query terms count as often as they stand.

    Only documents with a positive score are returned.
    """
    terms = query_terms(queries, query_id, query_tokens).join(index.terms, "term").select("q", "term", (F.col("times") * F.col("idf")).alias("weight"), "df", "most")
    return best_scored(index.postings, terms, k, scratch).select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def _counting(index: Index, queries: DataFrame, query_id: str, query_tokens: str) -> tuple[DataFrame, DataFrame]:
    """Postings worth 1 each, and the distinct query terms (q, term, weight, df, most, n), n being the query's number of terms."""
    terms = query_terms(queries, query_id, query_tokens)
    n = terms.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    terms = terms.join(n, "q").join(index.terms.select("term", "df"), "term").select("q", "term", F.lit(1.0).alias("weight"), "df", F.lit(1.0).alias("most"), "n")
    return index.postings.select("id", "term", F.lit(1.0).alias("gain")), terms


def overlap(index: Index, queries: DataFrame, query_id: str, query_tokens: str, id_col: str, k: int, scratch: Scratch) -> DataFrame:
    """The k documents of each query that hold the largest share of its distinct terms: query_id, id_col, score, rank."""
    postings, terms = _counting(index, queries, query_id, query_tokens)
    terms = scratch.save(terms, "counted")
    found = best_scored(postings, terms.drop("n"), k, scratch).join(small_side(terms)(terms.select("q", "n").distinct()), "q")
    return found.select(F.col("q").alias(query_id), F.col("id").alias(id_col), F.round(F.col("score") / F.col("n"), 6).alias("score"), "rank")


def overlap_of(index: Index, pairs: DataFrame, queries: DataFrame, query_id: str, query_tokens: str, id_col: str, scratch: Scratch) -> DataFrame:
    """The share of the query's distinct terms in the document, for given pairs: query_id, id_col, share. Pairs that share none are left out."""
    postings, terms = _counting(index, queries, query_id, query_tokens)
    terms = scratch.save(terms, "counted")
    hint = small_side(terms)
    asked = pairs.select(F.col(query_id).alias("q"), F.col(id_col).alias("id")).distinct().withColumn("part", F.lit(0.0))
    found = _complete(asked, postings, terms, hint).where("score > 0").join(hint(terms.select("q", "n").distinct()), "q")
    return found.select(F.col("q").alias(query_id), F.col("id").alias(id_col), F.round(F.col("score") / F.col("n"), 6).alias("share"))


def overlap_at_least(index: Index, queries: DataFrame, query_id: str, query_tokens: str, id_col: str, share: float, scratch: Scratch) -> DataFrame:
    """All pairs in which the document holds at least ``share`` of the query's distinct terms: query_id, id_col, share.

    A document with m of a query's n terms holds one of any n - m + 1 of them, so only the rarest n - m + 1 bring
    candidates; terms that no document has count among these. Where all terms together match few postings, each is counted.
    """
    postings, known = _counting(index, queries, query_id, query_tokens)
    need = F.ceil(F.col("n") * F.lit(share) - 1e-9)
    over = Window.partitionBy("q").orderBy("df", "term")
    missing = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("q"))
    t = scratch.save(known.withColumn("leads", F.row_number().over(over) + missing <= F.col("n") - need + 1), "counted")
    rows, matching = t.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    hint = F.broadcast if rows <= BROADCAST_QUERY_ROWS else lambda df: df
    if matching <= DIRECT_POSTINGS:
        scored = _sums(postings, t, hint).withColumnRenamed("part", "score")
    else:
        found = scratch.save(_sums(postings, t.where("leads"), hint), "found")
        scored = _complete(found, postings, t.where("not leads"), hint)
    scored = scored.join(hint(t.select("q", "n").distinct()), "q")
    out = scored.select(F.col("q").alias(query_id), F.col("id").alias(id_col), F.round(F.col("score") / F.col("n"), 6).alias("share"))
    return out.where(F.col("share") >= share)


class _Best:
    """The best k vectors of each query so far, ties by the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def meet(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in the rounded scores of vectors whose ids are ascending."""
        some = np.flatnonzero(scores.max(1) >= self.scores[:, -1])
        if not len(some):
            return
        scores = scores[some]
        if scores.shape[1] > self.k:
            # whole numbers that order by score, then by the smaller id
            key = np.rint(scores * 1e6) * len(ids) - np.arange(len(ids))
            top = np.argpartition(-key, self.k - 1, axis=1)[:, : self.k]
        else:
            top = np.tile(np.arange(len(ids)), (len(some), 1))
        scores = np.c_[self.scores[some], np.take_along_axis(scores, top, 1)]
        other = np.c_[self.ids[some], ids[top]]
        order = np.lexsort((other, -scores), axis=1)[:, : self.k]
        self.scores[some], self.ids[some] = np.take_along_axis(scores, order, 1), np.take_along_axis(other, order, 1)


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def dense(vectors: DataFrame, id_col: str, vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int, normalise: bool = True) -> DataFrame:
    """The exact top k vectors of each query by inner product (cosine if ``normalise``): query_id, id_col, score, rank.

    Queries go to the tasks in slices of about QUERY_SLICE, each in one pass over the vectors. A task keeps a running
    best k of each query, and only those are shuffled. The queries' length is the longest among them; null vectors and
    those of another length have no score, and NaN scores are left out.
    """
    q = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).cast("bigint").alias("q"), F.col(query_vec).cast("array<double>").alias("v"))
    n, dims = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    slices = max(1, -(-n // QUERY_SLICE))
    fine = lambda c: (F.size(c) == dims) & (F.lit(dims) > 0) & F.forall(c, lambda x: x.isNotNull())
    right = vectors.where(F.col(vec).isNotNull() & fine(vec)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    turn = _units if normalise else lambda x: x

    def one(at: int) -> DataFrame:
        asked = q.where((F.pmod(F.xxhash64("q"), F.lit(slices)) == at) & fine("v")).toArrow()
        q_ids = asked.column("q").to_numpy()
        q_x = turn(asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, max(dims, 1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(q_ids), k)
            for b in batches:
                ids = b.column("id").to_numpy()
                x = turn(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                order = np.argsort(ids, kind="stable")
                for i in range(0, len(order), VECTOR_BATCH):
                    part = order[i : i + VECTOR_BATCH]
                    if len(q_ids):
                        best.meet(np.nan_to_num(np.round(q_x @ x[part].T, 6), nan=-np.inf), ids[part])
            r, c = np.nonzero(best.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(best.ids[r, c]), pa.array(best.scores[r, c])], names=["q", "id", "score"])

        return right.mapInArrow(run, "q bigint, id bigint, score double")

    found = reduce(DataFrame.unionByName, [one(at) for at in range(slices)])
    return top_k(found, "q", "score", "id", k).select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def rrf(first: DataFrame, second: DataFrame, query_id: str, id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: query_id, id_col, rrf, rank_1, rank_2, score_1, score_2, sources, pos.

    One shuffle: both lists are tagged, united and grouped. Ties keep the order of the first list, then of the second.
    """
    tag = lambda df, n: df.select(query_id, id_col, F.lit(n).alias("leg"), "rank", "score")
    both = tag(first, 1).unionByName(tag(second, 2))
    pick = lambda n, c: F.max(F.when(F.col("leg") == n, F.col(c)))
    fused = both.groupBy(query_id, id_col).agg(
        F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("rrf"), pick(1, "rank").alias("rank_1"), pick(2, "rank").alias("rank_2"),
        pick(1, "score").alias("score_1"), pick(2, "score").alias("score_2"), F.sum("leg").alias("legs"),
    )
    w = Window.partitionBy(query_id).orderBy(F.desc("rrf"), F.asc_nulls_last("rank_1"), "rank_2", id_col)
    return fused.withColumn("pos", F.row_number().over(w)).drop("legs")


def hybrid(fused: DataFrame, query_id: str, id_col: str, settings: Settings, score: Column | None = None) -> DataFrame:
    """The final rows of each query: the first candidates by fusion, ordered by the reranker's ``score`` where it has one.

    Metadata is to be joined after this cut.
    """
    cut = fused.where(F.col("pos") <= settings.rerank_top_n)
    cut = cut.withColumn("final", F.coalesce(score, F.col("rrf")) if score is not None else F.col("rrf"))
    w = Window.partitionBy(query_id).orderBy(F.desc("final"), "pos")
    return cut.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= settings.final_top_k)


def first_wins(pool: DataFrame, query_id: str, id_col: str, order: list[str]) -> DataFrame:
    """The first row of each id in a query's pool, by ``order``."""
    w = Window.partitionBy(query_id, id_col).orderBy(*order)
    return pool.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
