"""Positions within groups of any size: sorted by range, so that no group has to fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import Scratch


def _ranged(df: DataFrame, group: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """df with ``_part`` (range partition) and ``_at`` (position in it), written down so both stay fixed."""
    # no fixed number of ranges: adaptive execution joins small neighbouring ones
    placed = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    return scratch.save(placed, "ranged")


def _carried(ranged: DataFrame, group: list[str], agg) -> DataFrame:
    """One row per range partition whose first group began in an earlier one: at most as many rows as partitions."""
    parts = ranged.groupBy(*group, "_part").agg(*agg)
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts, w


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, scratch: Scratch, start: int = 1) -> DataFrame:
    """df with ``name``: the position of the row in its group by ``order``, from ``start``.

    Null groups form one group, null order values come first, ties are broken arbitrarily unless ``order``
    is unique. A group that spans several range partitions is numbered in each and shifted by the rows before.
    """
    ranged = _ranged(df, group, order, scratch)
    parts, w = _carried(ranged, group, [F.count(F.lit(1)).alias("_n")])
    before = parts.withColumn("_before", F.sum("_n").over(w)).where("_before > 0").select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_before")
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_at"))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_part") == F.col("_p")]
    out = ranged.withColumn("_own", own).join(F.broadcast(before), on, "left")
    return out.withColumn(name, (F.col("_own") + F.coalesce("_before", F.lit(0)) + (start - 1)).cast("int")).drop("_own", "_before", "_p", "_part", "_at", *[f"_g_{g}" for g in group])


def with_previous(df: DataFrame, group: list[str], order: list[str], take: dict[str, str], scratch: Scratch) -> DataFrame:
    """df with, for each ``take`` column, its value in the row before in the group, under the given new name.

    Null for the first row of a group. Works like ``lag`` over groups of any size: the last rows of earlier
    range partitions are carried over, at most one for each partition.
    """
    ranged = _ranged(df, group, order, scratch)
    last = F.max_by(F.struct(*take), F.col("_at")).alias("_last")
    parts, w = _carried(ranged, group, [last])
    carried = parts.withColumn("_carry", F.last("_last", ignorenulls=True).over(w)).where(F.col("_carry").isNotNull()).select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_carry")
    own = F.lag(F.struct(*take)).over(Window.partitionBy(*group, "_part").orderBy("_at"))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_part") == F.col("_p")]
    out = ranged.withColumn("_own", own).join(F.broadcast(carried), on, "left").withColumn("_prev", F.coalesce("_own", "_carry"))
    return out.select(*df.columns, *[F.col("_prev")[c].alias(n) for c, n in take.items()])


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str, scratch: Scratch) -> DataFrame:
    """df with ``name``: the sum of ``value`` over the earlier rows of the group by ``order``; 0 for its first row.

    Null values count as 0. Works over groups of any size, as ``numbered`` does.
    """
    ranged = _ranged(df, group, order, scratch)
    amount = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    parts, w = _carried(ranged, group, [F.sum(amount).alias("_n")])
    before = parts.withColumn("_before", F.sum("_n").over(w)).where("_before > 0").select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_before")
    own = F.sum(amount).over(Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_part") == F.col("_p")]
    out = ranged.withColumn("_own", own).join(F.broadcast(before), on, "left")
    return out.withColumn(name, F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))).select(*df.columns, name)
