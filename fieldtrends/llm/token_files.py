"""Token-ID files: Parquet list columns with chosen encodings, row groups and page indexes.

Layout of a folder:

``tokens/``  one file per range of doc_id, rows sorted by doc_id: ``doc_id``, ``part`` (number of the
             file), ``start_in_part`` (ids of the documents before it in the file), ``n_tokens``, ``ids``.
``parts/``   one row per file: ``part``, ``n_docs``, ``part_tokens``, ``part_start`` (ids in all files before it).

Metadata columns are delta-encoded, ids are dictionary-encoded (a dictionary page per row group, delta where
it would grow too large). Small pages with column and offset indexes let a reader with a filter on doc_id
touch only the pages of those rows, and a reader of metadata never touches ids.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fieldtrends.llm.common import map_batches, shuffle_partitions, text_or_empty
from fieldtrends.llm.tokens import encoder

TOKEN_SCHEMA = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of each document and its place in its partition; partitions are ranges of doc_id in order."""

    def make():
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, end, before = TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little"), 0
        encode = encoder(tokenizer).encode

        def step(batch):
            nonlocal before
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                raw = [encode(t) + end for t in piece.column("text").to_pylist()]
                n = np.fromiter((len(b) // 4 for b in raw), dtype=np.int64, count=len(raw))
                stops = np.cumsum(n)
                ids = pa.Array.from_buffers(pa.int32(), int(stops[-1]), [None, pa.py_buffer(b"".join(raw))])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(raw), part, dtype=np.int32)),
                     pa.array(before + stops - n), pa.array(n), lists],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                before += int(stops[-1])

        return step

    return map_batches(docs, TOKEN_SCHEMA, make)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, files: int | None = None,
    row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10, page_rows: int = 500,
) -> None:
    """Encode ``docs`` (doc_id, text; more columns are ignored) and write the folder.

    Null text counts as empty: only the end id. Rows without doc_id come first; rows with equal doc_id are
    ordered by text, and repeated rows are all written. An empty table gives files without rows. A text is one
    row whatever its length.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ranged = rows.repartitionByRange(files or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        _encoded(ranged, tokenizer, end_id).write
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd")
        .parquet(f"{folder}/tokens")
    )
    sizes = (
        spark.read.schema(TOKEN_SCHEMA).parquet(f"{folder}/tokens").groupBy("part")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("part_tokens"))
    )
    # one row per file: the only window without a key, and as small as a folder listing
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes.withColumn("part_start", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0))).write.parquet(f"{folder}/parts")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if asked for, ids."""
    parts = spark.read.schema("part int, n_docs bigint, part_tokens bigint, part_start bigint").parquet(f"{folder}/parts")
    rows = spark.read.schema(TOKEN_SCHEMA).parquet(f"{folder}/tokens").join(parts.select("part", "part_start"), "part")
    out = rows.select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", *["ids"] * with_ids)
    return out


def with_crc(rows: DataFrame) -> DataFrame:
    """Replaces ``ids`` by the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def make():
        import numpy as np
        import pyarrow as pa

        def step(batch):
            lists = batch.column("ids")
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            crc = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())
            keep = [i for i, f in enumerate(batch.schema) if f.name != "ids"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [crc], names=[batch.schema[i].name for i in keep] + ["ids_crc32"])

        return step

    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "ids")
    return map_batches(rows, f"{kept}, ids_crc32 bigint", make)
