"""Writers and completeness checks of result sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_mask_table(df: DataFrame, path: str, by: Sequence[str] = ("mask",), files_per_key: int | None = None) -> None:
    """S05. One Parquet dataset partitioned by mask; rerunning a mask replaces that mask only.

    Without ``files_per_key`` tasks write what they hold (no shuffle). With it, rows are spread over
    that many files per key, so a mask with most of the rows is still written by many tasks.
    """
    if files_per_key:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
        df = df.repartition(*[F.col(c) for c in by], salt)
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by).parquet(path)
    )


def write_report(tables: dict[str, DataFrame], root: str, sep: str = ",") -> None:
    """S06. Report tables as delimited text, one directory per sheet; arrays become text."""
    for name, df in tables.items():
        flat = df.select(*[
            F.concat_ws(", ", c).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes
        ])
        flat.write.mode("overwrite").option("header", True).option("sep", sep).csv(f"{root}/{name}")


def upsert_latest_year(old: DataFrame, new: DataFrame, year: int, order: Sequence[str] = ()) -> DataFrame:
    """S09. Stored results with one year replaced by a fresh run."""
    out = old.filter(not_equal_or_null("year", year)).unionByName(new.filter(F.col("year") == year))
    return out.orderBy(*order) if order else out


def not_equal_or_null(col: str, value):
    return ~F.col(col).eqNullSafe(F.lit(value))


def check_complete(expected: DataFrame, found: DataFrame, keys: Sequence[str] = ("mask", "sim")) -> DataFrame:
    """S10. Expected result partitions that are absent."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def require_complete(expected: DataFrame, found: DataFrame, keys: Sequence[str] = ("mask", "sim")) -> None:
    """S10. Refuse to gather while any expected partition is missing."""
    missing = check_complete(expected, found, keys).limit(5).collect()
    if missing:
        raise ValueError(f"results incomplete, for example {[tuple(r) for r in missing]}")


def found_partitions(spark: SparkSession, root: str, keys: Sequence[str] = ("mask", "sim")) -> DataFrame:
    """Partition values present in a result dataset."""
    return spark.read.option("basePath", root).parquet(root).select(*keys).distinct()
