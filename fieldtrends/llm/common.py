"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six characters that separate words in every contract of this package.
SPACES = "\x20\t\n\x0b\x0c\r"

#: A key is hot when it holds more than one part in HOT_PARTS of all rows; at most HOT_PARTS keys can be.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def quoted(name: str) -> str:
    """A column name as it is, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of a row as one struct, so that no name of theirs can clash with a working column."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(name)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def without_spaces(text: Column) -> Column:
    """The text without the six space characters (plain replacements, no regular expression)."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """Inner join of many rows with a table that has one row per key and the number of rows of that key.

    A key with more than ``total / HOT_PARTS`` rows is hot. Since the counts add up to ``total``, at most
    HOT_PARTS keys are hot, so their rows are broadcast whatever the size of the data; all other keys are
    joined by shuffle, where none brings more than one part in HOT_PARTS of the rows. ``rows`` is read
    twice and should be a stored table.
    """
    hot = F.broadcast(keyed.filter(F.col(count) > total / HOT_PARTS))
    cold = keyed.filter(F.col(count) <= total / HOT_PARTS)
    keys = list(keys)
    left = rows.join(hot, keys)
    right = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    return left.unionByName(right)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """``mapInArrow`` with one state object per task: ``make()`` returns a function from a record batch to
    record batches. Batches stream, so a task never holds its whole partition."""

    def run(batches: Iterator) -> Iterator:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)
