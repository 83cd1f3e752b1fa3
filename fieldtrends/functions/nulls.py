"""Missing-value rules of the source analysis, stated as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def not_in(col: Column, values: Sequence) -> Column:
    """Negated membership that keeps NULL (a missing value is not in any list)."""
    return F.coalesce(~col.isin(list(values)), F.lit(True))


def n_distinct_with_null(col: Column) -> Column:
    """Distinct count in which NULL counts as one more value."""
    return (F.count_distinct(col) + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0))).cast("bigint")


def strict_avg(col: Column) -> Column:
    """Mean that is NULL as soon as one value is missing."""
    return F.when(F.count(F.lit(1)) == F.count(col), F.avg(col))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where NULL matches NULL; the right-hand keys are dropped.

    ``eqNullSafe`` stays an equi-join for Catalyst (hash or sort-merge), unlike ``a = b OR both NULL``.
    """
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])
