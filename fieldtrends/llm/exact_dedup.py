"""Exact dedup by deterministic block naming, with DataFrame operations only.

Each normalised text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and
named by integers; then adjacent pairs of names are sorted and named, level by level, until each document
has one name. Equal names mean equal texts and the other way round: a name is given to the content itself,
never to a hash of it.

A block's text is shuffled once, to be named. Fingerprints only carry the names back to the blocks: where two
different blocks share a fingerprint, the join compares the blocks as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrends.llm.common import join_counted, text_or_empty, whole_row, without_spaces
from fieldtrends.session import staged

BLOCK = 1024


def content_print(block: Column) -> Column:
    return F.xxhash64(block)


def _blocks(text: Column, size: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(found)


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Sorts the distinct rows of each partition and numbers them: a unique integer per row, the same on every run
    over the same partitions. The result is stored before it is used."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _block_names(rows: DataFrame, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """Names of distinct blocks: print, n (blocks with that fingerprint), kinds (distinct ones), name and, if kinds > 1, block."""
    pairs = rows.select(F.explode("blocks").alias("block")).withColumn("print", fingerprint(F.col("block")))
    # one content per fingerprint, or a few if fingerprints collide
    seen = pairs.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.collect_set("block").alias("contents"))
    names = staged(
        _named(seen.select("print", "n", F.size("contents").alias("kinds"), F.explode("contents").alias("block")), ["block"])
        .select("print", "n", "kinds", "name", F.when(F.col("kinds") > 1, F.col("block")).alias("block"))
    )
    return names


def _level_zero(rows: DataFrame, names: DataFrame, fingerprint: Callable[[Column], Column]) -> DataFrame:
    prints = staged(rows.select("rid", F.posexplode(F.transform("blocks", fingerprint)).alias("pos", "print")))
    total = prints.count()
    out = join_counted(prints, names.filter("kinds = 1").select("print", "n", "name"), ["print"], "n", total).select("rid", "pos", "name")
    shared = names.filter("kinds > 1").select("print", "block", "name", "n")
    if not shared.isEmpty():
        blocks = rows.select("rid", F.posexplode("blocks").alias("pos", "block")).withColumn("print", fingerprint(F.col("block")))
        doubtful = staged(blocks.join(shared.select("print").distinct(), "print", "left_semi"))
        named = join_counted(doubtful, shared, ["print", "block"], "n", total)
        out = out.unionByName(named.select("rid", "pos", "name"))
    return staged(out)


def _next_level(rows: DataFrame) -> DataFrame:
    """Names of adjacent pairs; a last name without a partner is paired with -1."""
    pairs = staged(
        rows.groupBy("rid", (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
    )
    names = staged(_named(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"]))
    return staged(join_counted(pairs, names, ["a", "b"], "n", pairs.count()).select("rid", "pos", "name"))


def identities(
    docs: DataFrame, block: int = BLOCK, fingerprint: Callable[[Column], Column] = content_print, carried: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows, names): rows with a row id ``rid``, and ``rid, level, name``, where (level, name) is equal for equal texts only.

    If ``carried``, rows also hold the columns of docs, as ``row``: stored with the row id, so that one of two equal rows can be told.
    """
    text = text_or_empty()
    flat = docs.select(
        *([whole_row(docs)] if carried else []),
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.length(text).cast("bigint").alias("points"), without_spaces(text).alias("flat"),
    )
    held = "row" if carried else _blocks(F.col("flat"), block).alias("blocks")  # a carried text is stored once, and cut again where blocks are read
    rows = staged(flat.select(
        held, "rid", "doc_id", "points", F.sha2(F.col("flat"), 256).alias("text_sha256"), F.ceil(F.length("flat") / block).cast("int").alias("n_blocks"),
    ))
    if carried:
        rows = rows.withColumn("blocks", _blocks(without_spaces(text_or_empty("row.text")), block))
    most = rows.agg(F.max("n_blocks")).first()[0] or 0
    level = _level_zero(rows, _block_names(rows, fingerprint), fingerprint)
    done, depth, reach = [], 0, 1
    while True:
        ends = rows.filter((F.col("n_blocks") <= reach) & (F.col("n_blocks") > (reach // 2 if depth else -1))).select("rid")
        done.append(level.join(ends, "rid", "left_semi").select("rid", F.lit(depth).alias("level"), "name"))
        if reach >= most:
            break
        longer = rows.filter(F.col("n_blocks") > reach).select("rid")
        level = _next_level(level.join(longer, "rid", "left_semi"))
        depth, reach = depth + 1, reach * 2
    names = done[0]
    for d in done[1:]:
        names = names.unionByName(d)
    return rows, names


def _decided(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256, level, name; of each group exactly one rid is kept."""
    facts = staged(rows.select("rid", "doc_id", "points", "text_sha256").join(names, "rid"))
    best = F.min(F.struct((-F.col("points")).alias("shorter"), "doc_id", "rid"))
    groups = staged(
        facts.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    )
    out = join_counted(facts, groups, ["level", "name"], "group_size", facts.count())
    return out.select(
        "rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", "level", "name",
    )


def exact_groups(docs: DataFrame, block: int = BLOCK, fingerprint: Callable[[Column], Column] = content_print) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Texts are equal when identical without the six space characters. The row with the most code points stays,
    then the one with the smallest doc_id; of rows that agree in both exactly one stays. Null text counts as
    empty, and all empty texts are one group. Rows without doc_id are ordered before others. More columns are
    ignored. An empty table gives no rows.
    """
    return _decided(*identities(docs, block, fingerprint)).drop("rid")


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that ``exact_groups`` keeps, one row of each group, with all their columns, whatever their names.

    Null and empty texts are one group, repeated rows leave one, and an empty table stays empty.
    """
    rows, names = identities(docs, block, carried=True)
    stay = _decided(rows, names).filter("kept").select("rid")
    return rows.select("rid", "row").join(stay, "rid", "left_semi").select("row.*")
