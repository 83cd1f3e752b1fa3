"""First row, top rows and row numbers per group, written so that one huge group is no bottleneck."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtrends.functions.nulls import null_safe_join


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key by an explicit order.

    ``row_number() = 1`` lets Spark keep one candidate per key *before* the shuffle
    (WindowGroupLimit), so a key holding a third of all rows sends one row per map task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key, also limited before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def number_rows(
    df: DataFrame, keys: Sequence[str], id_col: Column, order: Sequence,
    name: str = "rn", salts: int = 32, size: str | None = None,
) -> DataFrame:
    """Exact 1..n numbering per key, ordered by (salt, order).

    A plain window would put a whole key into one task. Here each key is cut into ``salts`` pieces by
    a hash of its row id; pieces are numbered in parallel and shifted by the sizes of the pieces before
    them (at most ``salts`` rows per key).
    """
    keys = list(keys)
    salted = df.withColumn("__salt", F.pmod(id_col.cast("bigint"), F.lit(salts).cast("bigint")))
    pieces = keys + ["__salt"]
    inner = W.partitionBy(*pieces).orderBy(*order)
    numbered = salted.withColumn("__in", F.row_number().over(inner))
    sizes = salted.groupBy(*pieces).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = sizes.select(
        *pieces,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("__total"),
    )
    joined = null_safe_join(numbered, offsets, pieces, "inner")
    out = joined.withColumn(name, (F.col("__before") + F.col("__in")).cast("bigint"))
    if size:
        out = out.withColumn(size, F.col("__total").cast("bigint"))
    return out.drop("__salt", "__in", "__before", "__total")
