"""Differences between data releases and attribute tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fieldtrends.functions.nulls import null_safe_join


def release_delta(old: DataFrame, new: DataFrame, latest: int, columns: Sequence[str], species: str = "scientific_name") -> DataFrame:
    """M28. Rows of the latest year, rows added to the past, rows deleted from the past.

    Past rows of a name that no longer exists in the new past are renames, not deletions. ``subtract``
    compares whole rows with NULL equal to NULL and removes duplicates, as the source does.
    """
    cols = list(columns)
    now = new.filter(F.col("year") == latest).select(*cols)
    past_new = new.filter((F.col("year") != latest) & (F.col("cyear") >= 1900)).select(*cols)
    past_old = old.filter(F.col("cyear") >= 1900).select(*cols).join(past_new.select(species).distinct(), species, "left_semi").select(*cols)
    tag = lambda df, t: df.withColumn("change", F.lit(t))
    return tag(now, "current").unionByName(tag(past_new.subtract(past_old), "added")).unionByName(
        tag(past_old.subtract(past_new), "deleted"))


def full_duplicates(df: DataFrame, new: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """M29. Rows that occur more than once (all copies), and the rows of the new release that match them.

    Copies are counted by aggregation and exploded again, so a row with very many copies is no hot window.
    """
    cols = list(columns)
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    copies = counted.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n")))).select(*cols)
    replacements = null_safe_join(new.select(*cols), counted.select(*cols), cols, "left_semi")
    return copies, replacements


def attribute_changes(old: DataFrame, new: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """M30. (attribute, key, old, new) for every value that changed; new species are not changes.

    Both tables are unpivoted once, so all attributes are compared in a single join.
    """
    def rows(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias(name)) for a in attributes])
        return df.select(key, F.explode(pairs).alias("p")).select(key, "p.*").distinct()

    j = rows(new, "new_value").join(rows(old, "old_value"), [key, "attribute"])
    return j.filter(~F.col("new_value").eqNullSafe(F.col("old_value")))


def refresh_attribute(df: DataFrame, mapping: DataFrame, key: str, column: str) -> DataFrame:
    """M31. Replace a column by the mapping's newest value, keeping the column order."""
    m = mapping.select(F.col(key), F.col(column).alias("__new")).distinct()
    return df.drop(column).join(m, key, "left").withColumnRenamed("__new", column).select(*df.columns)


def crosswalk(names: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """M31. Names to another checklist, with a validity flag instead of a stop."""
    m = mapping.select(F.col(old).alias("name"), F.col(new).alias("name_new")).distinct()
    return names.join(m, "name", "left").withColumn("valid", F.col("name_new").isNotNull())


def require_valid(walked: DataFrame) -> DataFrame:
    bad = walked.filter("NOT valid").select("name").limit(5).collect()
    if bad:
        raise ValueError(f"unknown names, for example {[r['name'] for r in bad]}")
    return walked


def append_database(database: DataFrame, batch: DataFrame, year: int) -> DataFrame:
    """M31. Append a release to the running database, tagged with its year."""
    return database.unionByName(batch.withColumn("release", F.lit(year)), allowMissingColumns=True)
