"""Sums and unions over sets of replicates, position by position.

A set of replicates is a binary column with one bit per replicate, so a row stands for all replicates it is part
of and is never multiplied. ``summed`` and ``united`` add up such rows per key: tasks combine what they hold, and
only one short array per key and task is shuffled, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

HELD = 4096  # keys that a task combines before it hands them on
SLICE = 512  # rows that are spread out to positions at a time: their counts take 8 bytes a replicate


def slices(source: Iterator) -> Iterator:
    """Batches cut to ``SLICE`` rows, so that a task's memory does not follow the size of a batch."""
    for batch in source:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def bits_of(column, n: int):
    """A binary column as a matrix of 0 and 1: one row per value, one column per replicate."""
    import numpy as np

    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1)[:, :n]


def _per_key(batch, keys: Sequence[str], values, add):
    """(key, combined row of ``values``) for each key of a batch."""
    import numpy as np

    number: dict = {}
    at = np.fromiter((number.setdefault(k, len(number)) for k in zip(*(batch.column(c).to_pylist() for c in keys))), dtype=np.int64, count=batch.num_rows)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(number)))
    return zip(number, add.reduceat(values[order], starts, axis=0))


def _combined(rows: DataFrame, keys: Sequence[str], name: str, read, dtype: str, union: bool, partitions: int) -> DataFrame:
    key_fields = [rows.schema[c] for c in keys]
    schema = T.StructType([*key_fields, T.StructField(name, T.BinaryType())])
    keys = list(keys)

    def batches(found: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        part = []
        shape = to_arrow_schema(schema)
        for key, value in found:
            part.append((*key, value.tobytes()))
            if len(part) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), shape)], schema=shape)
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), shape)], schema=shape)

    def operation():
        import numpy as np

        return np.bitwise_or if union else np.add

    def first(source: Iterator) -> Iterator:
        held: dict = {}
        for batch in slices(source):
            for key, value in _per_key(batch, keys, read(batch), operation()):
                held[key] = operation()(held[key], value) if key in held else value.copy()  # a view would hold its whole slice
            if len(held) > HELD:
                yield from batches(iter(held.items()))
                held = {}
        yield from batches(iter(held.items()))

    def second(source: Iterator) -> Iterator:
        import numpy as np

        def merged():
            now, sums = None, None
            for batch in slices(source):
                for *key, value in zip(*(batch.column(c).to_pylist() for c in (*keys, name))):
                    value = np.frombuffer(value, dtype=dtype)
                    if key == now:
                        sums = operation()(sums, value)
                    else:
                        if now is not None:
                            yield now, sums
                        now, sums = key, value
            if now is not None:
                yield now, sums

        yield from batches(merged())

    part = rows.mapInArrow(first, schema)
    return part.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(second, schema)


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def united(rows: DataFrame, keys: Sequence[str], sims: str = "sims") -> DataFrame:
    """keys and ``sims``: the replicates of any row of the key."""

    def read(batch):
        import numpy as np

        column = batch.column(sims).to_pylist()
        return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)

    return _combined(rows.select(*keys, sims), keys, sims, read, "uint8", True, _partitions(rows))


def summed(rows: DataFrame, keys: Sequence[str], n: int, sims: str = "sims", weights: str | None = None, name: str = "counts") -> DataFrame:
    """keys and ``counts`` (n 64-bit integers, as binary): per replicate the number of rows that are part of it, or the
    sum of their ``weights``, a column of the same form."""

    def read(batch):
        import numpy as np

        bits = bits_of(batch.column(sims), n)
        if weights is None:
            return bits.astype(np.int64)
        return bits * np.frombuffer(b"".join(batch.column(weights).to_pylist()), dtype=np.int64).reshape(len(bits), n)

    more = [weights] if weights else []
    return _combined(rows.select(*keys, sims, *more), keys, name, read, "int64", False, _partitions(rows))


def by_replicate(rows: DataFrame, names: Sequence[str], n: int) -> DataFrame:
    """Rows per replicate (``sim`` from 1): columns made by ``summed`` become numbers; replicates in which all are zero are left out."""
    names = list(names)
    rest = [c for c in rows.columns if c not in names]
    schema = T.StructType([*[rows.schema[c] for c in rest], *[T.StructField(c, T.ArrayType(T.LongType())) for c in names]])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            lists = []
            for c in names:
                values = [np.zeros(n, np.int64) if v is None else np.frombuffer(v, dtype=np.int64) for v in batch.column(c).to_pylist()]
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), pa.array(np.concatenate(values))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *lists], names=[*rest, *names])

    wide = rows.select(*rest, *names).mapInArrow(run, schema)
    long = wide.select(*rest, F.posexplode(F.arrays_zip(*names)).alias("i", "v"))
    long = long.select(*rest, (F.col("i") + 1).cast("bigint").alias("sim"), *[F.col(f"v.{c}").alias(c) for c in names])
    some = F.lit(False)
    for c in names:
        some = some | (F.col(c) > 0)
    return long.filter(some)
