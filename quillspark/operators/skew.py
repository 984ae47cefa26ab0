"""Equi-joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this many rows of the left side; each further share adds a salt.
HOT_ROWS = 50_000
#: The most shares one key is cut into.
MOST_SHARES = 512


def hot_keys(left: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of shares each is cut into.

    There are at most rows/hot_rows of them. The count is combined on the map side.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    return counts.select(*keys, F.least(F.ceil(F.col("_n") / hot_rows), F.lit(MOST_SHARES)).cast("int").alias("_shares"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", spread: list[str] | None = None, residual: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left.join(right, keys, how)`` with hot keys of ``left`` cut into shares.

    Rows of a hot key are spread over shares by a hash of ``spread`` (all left columns by default) and the
    matching right rows are repeated once a share; other rows are left alone. ``how`` may be inner, left,
    left_semi or left_anti: each left row meets every right row of its key exactly once, so these are exact.
    Null keys match nothing, as in Spark. ``residual`` is a further condition on the columns of both sides,
    which must have different names apart from ``keys``.
    """
    hot = hot_keys(left, keys, hot_rows)
    shares = {k: f"_hot_{k}" for k in keys}
    hot_l = hot.select(*[F.col(k).alias(v) for k, v in shares.items()], "_shares")
    on_l = [left[k] == F.col(v) for k, v in shares.items()]
    salt = F.when(F.col("_shares").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*(spread or left.columns)), F.col("_shares").cast("bigint")).cast("int"))
    l2 = left.join(hot_l, on_l, "left").withColumn("_salt", salt).drop("_shares", *shares.values())
    r_names = {k: f"_right_{k}" for k in keys}
    r2 = right.join(hot, keys, "left").withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1))).drop("_shares")
    for k, v in r_names.items():
        r2 = r2.withColumnRenamed(k, v)
    on = [F.col(k) == F.col(v) for k, v in r_names.items()] + [F.col("_salt") == F.col("_rsalt")]
    if residual is not None:
        on.append(residual)
    return l2.join(r2, on, how).drop("_salt", "_rsalt", *r_names.values())
