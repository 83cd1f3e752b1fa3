"""Line dedup with two Bloom filters.

One filter holds the keys seen once, the other those seen in a second document. Tasks fill pairs of filters of
their own, and pairs merge bit by bit: ``twice = twice | twice' | (once & once')``, so a key of two documents is
in the merged second filter wherever its documents lie. Only lines found there are suspects; they are counted
exactly, by a 128-bit digest of the key, and only they are shuffled.

The filters have a fixed largest size. A corpus with more lines is worked off in slices of the key space, each
with filters of its own, and each reads only its slice of the digests.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrends.llm.common import SPACES, join_counted, map_batches, shuffle_partitions, text_or_empty, whole_row
from fieldtrends.session import staged, work_folder

MIN_DOCS = 10
BITS_PER_LINE = 8
LEAST_BITS, MOST_BITS = 2 ** 16, 2 ** 28
BLOCK_WORDS = 8192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without the six space characters at both ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _digest(line: Column) -> Column:
    key = line_key(line)
    return F.when(F.length(key) > 0, F.unhex(F.substring(F.sha2(key, 256), 1, 32)))


def filter_size(lines: int, most_bits: int = MOST_BITS) -> tuple[int, int]:
    """(bits, slices): a power of two of at least BITS_PER_LINE for each line of a slice, and the number of slices."""
    wanted = max(LEAST_BITS, BITS_PER_LINE * lines)
    slices = -(-wanted // most_bits)
    return min(most_bits, 1 << (-(-wanted // slices) - 1).bit_length()), slices


def places(h, words: int):
    """The word of each hash and its four bits there."""
    import numpy as np

    one, low = np.uint64(1), np.uint64(63)
    mask = (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low)) | (one << ((h >> np.uint64(18)) & low))
    return (h >> np.uint64(24)) & np.uint64(words - 1), mask


class Entries:
    """The lines with a key in a batch of rows: row, pos, hash (first half of the digest), rest (second half), digest."""

    def __init__(self, batch):
        import numpy as np

        lists = batch.column("digests")
        values = lists.flatten()
        ends = np.asarray(lists.value_lengths().fill_null(0)).cumsum()
        here = np.flatnonzero(np.asarray(values.is_valid()))
        self.row = np.searchsorted(ends, here, side="right")
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else np.empty(0, dtype=np.int64)
        self.pos = here - starts[self.row] if "pos" not in batch.schema.names else np.asarray(batch.column("pos").flatten())[here]
        self.digest = values.drop_null()
        joined = b"".join(self.digest.to_pylist())
        halves = np.frombuffer(joined, dtype="<u8").reshape(-1, 2)
        self.hash, self.rest = halves[:, 0], halves[:, 1]


def _fill(rows: DataFrame, bits: int) -> DataFrame:
    """block, once, twice: the filters of each task, in blocks that are not empty, compressed."""
    words = bits // 64

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        once, twice = np.zeros(words, dtype=np.uint64), np.zeros(words, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            e = Entries(batch)
            order = np.lexsort((e.row, e.hash))
            h, row = e.hash[order], e.row[order]
            new = np.ones(len(h), dtype=bool)  # a document counts once for a key
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, n = np.unique(h[new], return_counts=True)
            at, mask = places(h, words)
            again = (n > 1) | (once[at] & mask == mask)
            np.bitwise_or.at(twice, at[again], mask[again])
            np.bitwise_or.at(once, at, mask)
        for lo in range(0, words, BLOCK_WORDS):
            a, b = once[lo:lo + BLOCK_WORDS], twice[lo:lo + BLOCK_WORDS]
            if a.any():
                packed = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lo // BLOCK_WORDS], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], names=["block", "once", "twice"])

    return rows.mapInArrow(run, "block int, once binary, twice binary")


def _merged(filters: DataFrame, bits: int) -> DataFrame:
    """block, twice: blocks of all tasks merged one after the other, so a task holds two blocks whatever their number."""
    size = min(BLOCK_WORDS, bits // 64) * 8

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def unpacked(x):
            return np.frombuffer(pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint64)

        def out():
            packed = pa.compress(twice.tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "twice"])

        block = None
        for batch in batches:
            for number, a, b in zip(*(batch.column(i) for i in range(3))):
                a, b = unpacked(a.as_py()), unpacked(b.as_py())
                if number.as_py() != block:
                    if block is not None:
                        yield out()
                    block, once, twice = number.as_py(), a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if block is not None:
            yield out()

    dealt = filters.repartition(shuffle_partitions(filters.sparkSession), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "block int, twice binary")


def _twice_seen(rows: DataFrame, bits: int):
    """The merged second filter, as a broadcast of at most MOST_BITS bits."""
    import numpy as np
    import pyarrow as pa

    words = np.zeros(bits // 64, dtype=np.uint64)
    size = min(BLOCK_WORDS, len(words)) * 8
    for block, twice in _merged(_fill(rows, bits), bits).collect():  # bits / 8 bytes at most
        at = block * BLOCK_WORDS
        words[at:at + BLOCK_WORDS] = np.frombuffer(pa.decompress(bytes(twice), decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint64)
    return rows.sparkSession.sparkContext.broadcast(words)


def _suspects(rows: DataFrame, twice) -> DataFrame:
    """rid, doc, pos, digest of the lines found in the filter; first marks a document's first line of that key."""

    def make():
        def step(batch):
            import numpy as np
            import pyarrow as pa

            e = Entries(batch)
            words = twice.value
            at, mask = places(e.hash, len(words))
            hit = np.flatnonzero(words[at] & mask == mask)
            row, pos, h, rest = e.row[hit], e.pos[hit], e.hash[hit], e.rest[hit]
            order = np.lexsort((pos, rest, h, row))
            first = np.ones(len(hit), dtype=bool)
            a, b = order[1:], order[:-1]
            first[a] = (row[a] != row[b]) | (h[a] != h[b]) | (rest[a] != rest[b])
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(pa.array(row)), batch.column("doc").take(pa.array(row)), pa.array(pos.astype(np.int32)),
                     e.digest.take(pa.array(hit)), pa.array(first)], names=["rid", "doc", "pos", "digest", "first"])

        return step

    return map_batches(rows, "rid bigint, doc bigint, pos int, digest binary, first boolean", make)


def _sliced(rows: DataFrame, slices: int) -> DataFrame:
    """The digests, stored by slice of the key space, so that each slice reads its own files."""

    def make():
        def step(batch):
            import numpy as np
            import pyarrow as pa

            e = Entries(batch)
            part = (e.rest % np.uint64(slices)).astype(np.int32)
            order = np.lexsort((e.pos, e.row, part))
            part, row, pos = part[order], e.row[order], e.pos[order]
            head = np.ones(len(part), dtype=bool)
            head[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
            starts = pa.array(np.append(np.flatnonzero(head), len(part)).astype(np.int32))
            if len(part):
                at = pa.array(row[head])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[head]), batch.column("rid").take(at), batch.column("doc").take(at),
                     pa.ListArray.from_arrays(starts, pa.array(pos.astype(np.int32))), pa.ListArray.from_arrays(starts, e.digest.take(pa.array(order)))],
                    names=["slice", "rid", "doc", "pos", "digests"])

        return step

    path = f"{work_folder(rows.sparkSession)}/slices-{uuid.uuid4().hex}"
    map_batches(rows, "slice int, rid bigint, doc bigint, pos array<int>, digests array<binary>", make).write.partitionBy("slice").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _without(text: Column, drop: Column) -> Column:
    """The text without the lines at the given places; null where the text is."""

    def kept(t, places):
        gone = set(places)
        return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)

    def run(texts, drops):
        import pandas as pd

        return pd.Series([None if t is None else kept(t, p) for t, p in zip(texts, drops)], dtype=object)

    return F.pandas_udf(run, "string")(text, drop)


def judged_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: row (all its columns), n_lines (before dropping), n_dropped, kept (the text without dropped lines).

    A text is split at \\n; a line's key is the line without the six space characters at both ends, A-Z as a-z.
    Keys found in at least ``min_docs`` (2 or more) documents lose all their lines in every document; with ``keep_first``
    the first occurrence stays (smallest doc_id, rows without one first, then the smallest place). Lines without a
    key stay. Null text is empty, an empty text is one empty line, and a text whose lines all go becomes empty.
    Repeated rows are documents of their own. Texts and lines may have any length. Columns of docs may have any
    name; an empty table gives no rows. Keys are held equal by the first 128 bits of their SHA-256.
    """
    if min_docs < 2:
        raise ValueError("a key of one document is no repeat: min_docs starts at 2")
    docs = docs.select(whole_row(docs))
    text = text_or_empty("row.text")
    rows = staged(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("row.doc_id").cast("bigint").alias("doc"), "row",
        F.transform(F.split(text, "\n", -1), _digest).alias("digests")))
    digests = rows.select("rid", "doc", "digests")
    bits, slices = filter_size(digests.agg(F.sum(F.size("digests"))).first()[0] or 0, most_bits)
    parts = [digests]
    if slices > 1:
        stored = _sliced(digests, slices)
        parts = [stored.filter(F.col("slice") == k).drop("slice") for k in range(slices)]
    dropped = None
    for part in parts:
        twice = _twice_seen(part, bits)
        suspects = staged(_suspects(part, twice))
        twice.destroy()
        counted = suspects.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("first"), 1)).alias("n_docs"), F.min(F.struct("doc", "rid", "pos")).alias("origin"))
        repeats = staged(counted.filter(F.col("n_docs") >= min_docs))
        gone = join_counted(suspects, repeats, ["digest"], "n_rows", repeats.agg(F.sum("n_rows")).first()[0] or 0)
        if keep_first:
            gone = gone.filter((F.col("rid") != F.col("origin.rid")) | (F.col("pos") != F.col("origin.pos")))
        gone = gone.select("rid", "pos")
        dropped = gone if dropped is None else dropped.unionByName(gone)
    per_doc = dropped.groupBy("rid").agg(F.collect_list("pos").alias("drop"))
    out = rows.select("rid", "row", F.size("digests").cast("bigint").alias("n_lines")).join(per_doc, "rid", "left")
    cut = _without(F.when(F.col("drop").isNotNull(), F.col("row.text")), F.col("drop"))
    return out.select(
        "row", "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce(cut, text_or_empty("row.text")).alias("kept"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, and texts without the lines that ``judged_lines`` drops."""
    judged = judged_lines(docs, **options)
    return judged.select(F.col("row").withField("text", F.col("kept")).alias("row")).select("row.*")
