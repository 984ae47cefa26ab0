"""References to records that do not exist."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.skew import skew_join
from quillspark.shared import Scratch


def null_mask(keys: list[str]) -> Column:
    """Bit i is set where key i is not null."""
    return sum((F.when(F.col(k).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)), F.lit(0))


def orphans(references: DataFrame, keys: list[str], target: DataFrame, match: str = "simple", valid: Column | None = None, target_keys: list[str] | None = None) -> DataFrame:
    """Rows of ``references`` whose composite key leads nowhere in ``target``.

    References are grouped by null mask; the rows of each mask are anti-joined on their non-null columns.
    ``match`` says what partial nulls mean: ``simple``, a key with any null is no reference; ``full``, all
    null is no reference and partly null is an orphan; ``partial``, the non-null columns must all agree
    with some row. ``valid`` is a further condition that a target row must meet for a reference (for
    example that it isn't later); it may use columns of both sides, whose names must differ.

    Repeated references stay repeated, an empty target makes every reference an orphan, hot keys are salted.
    """
    if match not in ("simple", "full", "partial"):
        raise ValueError(f"match: {match}")
    target_keys = target_keys or keys
    side = target
    for k, t in zip(keys, target_keys):
        side = side.withColumnRenamed(t, f"_t_{k}")
    extra = [c for c in side.columns if c not in {f"_t_{k}" for k in keys}]
    every = (1 << len(keys)) - 1
    masks = [every] if match in ("simple", "full") else [sum(1 << i for i in c) for n in range(len(keys), 0, -1) for c in combinations(range(len(keys)), n)]
    marked = references.withColumn("_mask", null_mask(keys))
    parts = []
    for mask in masks:
        used = [k for i, k in enumerate(keys) if mask >> i & 1]
        right = side.select(*[F.col(f"_t_{k}").alias(k) for k in used], *extra)
        if not extra:
            right = right.distinct()
        parts.append(skew_join(marked.where(F.col("_mask") == mask), right, used, "left_anti", residual=valid))
    if match == "full":
        parts.append(marked.where((F.col("_mask") > 0) & (F.col("_mask") < every)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_mask")


def orphan_parts(references: DataFrame, targets: dict[str, tuple[DataFrame, str]], valid: Column | None = None) -> DataFrame:
    """Orphans among references whose columns each lead to a table of their own (match ``each``).

    ``targets``: column -> (table, its key). References are grouped by the null mask over these columns; the rows of
    each mask are anti-joined with the target of each of its non-null columns. A row comes out once for every column
    that leads nowhere: its other columns, ref_column and ref_id (as bigint). An all-null reference is none. ``valid``
    is a further condition on a target row, as in ``orphans``.
    """
    keys = list(targets)
    keep = [c for c in references.columns if c not in keys]
    marked = references.withColumn("_mask", null_mask(keys))
    parts = []
    for mask in range(1, 1 << len(keys)):
        rows = marked.where(F.col("_mask") == mask)
        for i, k in enumerate(keys):
            if mask >> i & 1:
                target, key = targets[k]
                refs = rows.select(*keep, F.lit(k).alias("ref_column"), F.col(k).cast("bigint").alias("ref_id")).distinct()
                parts.append(orphans(refs, ["ref_id"], target, valid=valid, target_keys=[key]))
    return reduce(DataFrame.unionByName, parts).distinct()


def cited_ids(messages: DataFrame) -> DataFrame:
    """One row per citation of a message: id, created_at, chunk_id, document_id (null where it has none).

    Citations that aren't a valid JSON list hold none. Ids may be numbers or numbers in quotes; anything
    else counts as null.
    """
    item = F.explode(F.expr("try_variant_get(try_parse_json(citations), '$', 'array<variant>')"))
    one = messages.where(F.col("citations").isNotNull()).select("id", "created_at", item.alias("c"))
    as_id = lambda k: F.expr(f"try_cast(trim(try_variant_get(c, '$.{k}', 'string')) as bigint)")
    return one.select("id", "created_at", as_id("chunk_id").alias("chunk_id"), as_id("document_id").alias("document_id"))


def deleted_documents(log: DataFrame) -> DataFrame:
    """Ids whose last log entry is a deletion. At equal times a restoration counts as the later."""
    last = log.groupBy("document_id").agg(F.max(F.struct("changed_at", "change")).alias("e"))
    return last.where(F.col("e.change") == "delete").select("document_id")


def orphan_references(messages: DataFrame, chunks: DataFrame, documents: DataFrame, log: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct orphan references: src_table, period, src_id, ref_table, ref_id.

    A citation is one composite reference (chunk, document), either half of which may be null; a chunk refers to its
    document alone. Each half that is there is a reference to its own table. It is an orphan where its key has no row, is
    a deleted document, or its row is created later than the source. Null created_at is later than nothing; its period
    is null. Null keys are no references.
    """
    month = F.date_format("created_at", "yyyy-MM").alias("period")
    source = lambda df, name, chunk: df.select(F.lit(name).alias("src_table"), month, F.col("id").alias("src_id"), F.col("created_at").alias("src_at"), chunk.cast("bigint").alias("chunks"), F.col("document_id").alias("documents"))
    cited = source(cited_ids(messages.dropDuplicates(["id"])), "messages", F.col("chunk_id"))
    refs = scratch.save(cited.unionByName(source(chunks, "chunks", F.lit(None))).distinct(), "references")  # citations are parsed once
    alive = documents.join(deleted_documents(log).withColumnRenamed("document_id", "doc_id"), "doc_id", "left_anti")
    known = lambda df, key: scratch.save(df.groupBy(F.col(key).alias("key")).agg(F.min("created_at").alias("ref_at")), "known")
    in_time = ~F.coalesce(F.col("ref_at") > F.col("src_at"), F.lit(False))
    found = orphan_parts(refs, {"chunks": (known(chunks, "id"), "key"), "documents": (known(alive, "doc_id"), "key")}, valid=in_time)
    return found.select("src_table", "period", "src_id", F.col("ref_column").alias("ref_table"), "ref_id").distinct()
