"""Seeded resampling of checklists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from fieldtrends.functions import portable
from fieldtrends.functions.nulls import null_safe_join
from fieldtrends.functions.positions import bits_of
from fieldtrends.functions.ranking import first_per, number_rows
from fieldtrends.operators.clean import numeric_group_id

KEYS = ["locality_id", "month", "timegroup"]
SIM_STRIDE = 4099
OWN_SEEDS = 1_000_003


def sample_one(frame: DataFrame, seed: int, keys: Sequence[str] = KEYS, group: str = "group_id") -> DataFrame:
    """R01. One random checklist per (locality, month, time group): the smallest hash wins."""
    no = numeric_group_id(F.col(group))
    df = frame.withColumns({"__no": no, "__h": portable.hash31(no, seed)})
    return first_per(df, list(keys), ["__h", "__no", group]).select(*keys, group)


def replicate_sets(
    frame: DataFrame, n: int, seed: int, keys: Sequence[str] = KEYS, group: str = "group_id", salts: int = 32,
) -> DataFrame:
    """R02. ``n`` replicates in one pass: per group and replicate one member, with replacement.

    keys, group and ``sims``, the replicates that drew the member, one bit each; members that none drew have no row. A group's
    ``n`` draws are made in one row and leave it as one set per position drawn, so no step has rows times replicates.
    Members are numbered per group by the salted numbering (a huge group is spread over tasks) and meet the draws in an
    equi-join on (group, position).
    """
    keys = list(keys)
    no = numeric_group_id(F.col(group))
    members = number_rows(frame.withColumn("__no", no), keys, F.col("__no"), ["__no", group], name="rn", salts=salts)
    own = [k for k in keys if k not in KEYS]  # further keys, such as the mask, draw numbers of their own
    start = F.lit(seed).cast("bigint") + F.pmod(F.xxhash64(*own), F.lit(OWN_SEEDS)) if own else F.lit(seed).cast("bigint")
    groups = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"), F.min(no).alias("__key")).withColumn("__start", start)
    schema = T.StructType([*[groups.schema[k] for k in keys], *T.StructType.fromDDL("rn bigint, sims binary").fields])

    def draw(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                key, size, begin = (np.asarray(part.column(c)).astype(np.int64)[:, None] for c in ("__key", "__size", "__start"))
                u = portable.uniform_of(key * SIM_STRIDE + np.arange(1, n + 1), begin)
                rn = 1 + np.floor(u * size).astype(np.int64)
                row, sim = np.repeat(np.arange(len(rn)), n), np.tile(np.arange(n), len(rn))
                drawn, which = np.unique(np.stack([row, rn.ravel()]), axis=1, return_inverse=True)
                bits = np.zeros((drawn.shape[1], n), dtype=np.uint8)
                bits[which.ravel(), sim] = 1
                sets = [x.tobytes() for x in np.packbits(bits, axis=1)]
                at = pa.array(drawn[0])
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(at) for k in keys], pa.array(drawn[1]), pa.array(sets, pa.binary())],
                                                 names=[*keys, "rn", "sims"])

    drawn = groups.select(*keys, "__size", "__key", "__start").mapInArrow(draw, schema)
    return null_safe_join(drawn, members, [*keys, "rn"], "inner").select(*keys, group, "sims")


def replicate_numbers(sets: DataFrame, n: int) -> DataFrame:
    """``sims`` as an array of replicate numbers, from 1."""
    rest = [c for c in sets.columns if c != "sims"]
    schema = T.StructType([*[sets.schema[c] for c in rest], T.StructField("sims", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                row, sim = np.nonzero(bits_of(batch.column("sims"), n))
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((sim + 1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], lists], names=[*rest, "sims"])

    return sets.select(*rest, "sims").mapInArrow(run, schema)


def replicates(
    frame: DataFrame, n: int, seed: int, keys: Sequence[str] = KEYS, group: str = "group_id", salts: int = 32,
) -> DataFrame:
    """R02 as rows (sim, keys, group): for jobs that treat every replicate by itself."""
    rows = replicate_numbers(replicate_sets(frame, n, seed, keys, group, salts), n)
    return rows.select(F.explode(F.col("sims").cast("array<bigint>")).alias("sim"), *keys, group)


def apply_sets(obs: DataFrame, sets: DataFrame, group: str = "group_id") -> DataFrame:
    """R03. Observations with the replicates they are part of: one row each, whatever the number of replicates."""
    return obs.join(sets.select(group, "sims"), group)


def apply_replicates(obs: DataFrame, reps: DataFrame, group: str = "group_id") -> DataFrame:
    """R03 as rows: observations of each replicate, tagged with ``sim``. Never written out."""
    return obs.join(reps.select("sim", group), group)
