"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows are sorted along a Hilbert curve through the dimensions that vary most and stored as Parquet rows of BLOCK
vectors, each with the smallest and largest value of every dimension. Interval arithmetic on these zones bounds the
inner product of an anchor with any row of a block from both sides, so zones alone tell which blocks an anchor's
windows must read: first those that can hold one of its best positives, then those that can hold a score between
the share asked for and the score of a positive. The bounds never lose a row; where the data are spread evenly
over many dimensions they are wide, and most blocks are read.

Anchors are handled in tiles, so a task multiplies matrices; of each block only the best rows per window go on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from fieldtrends.llm.common import shuffle_partitions
from fieldtrends.session import staged

BLOCK = 512
TILE = 1024
GROUP_ROWS = 32_768  # rows per partition of the curve; its blocks are one group of zones
CURVE_DIMS, CURVE_BITS = 8, 8
NONE = -(2 ** 62)  # below all scores


def usable(rows: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (floor(scale * component) as bigint) of the rows that take part: no null id, label, vector or component, all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & ~bad
    return rows.filter(F.coalesce(part, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vector"))


def hilbert_keys(x, bits: int = CURVE_BITS):
    """Places on the Hilbert curve of the points x (n, dims) of integers below 2 ** bits, as unsigned 64-bit integers."""
    import numpy as np

    x = x.astype(np.uint64).T.copy()
    dims = len(x)
    high = np.uint64(1 << (bits - 1))
    q = high
    while q > 1:  # undo the excess work of the axes, from the highest bit down
        p = q - np.uint64(1)
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = high
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def padded(column, dims: int):
    """A list column as a matrix of int64; missing components are zero."""
    import numpy as np

    n = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), dtype=np.int64)
    out = np.zeros((len(n), dims), dtype=np.int64)
    out[np.arange(dims)[None, :] < n[:, None]] = values
    return out


def _spread(rows: DataFrame) -> list:
    """Per dimension: dim, low, high, variance."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column("vector")
            dims = int(max(np.asarray(column.value_lengths()), default=0))
            if dims:
                x = padded(column, dims)
                f = x.astype(float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dims, dtype=np.int32)), pa.array(x.min(0)), pa.array(x.max(0)), pa.array(f.sum(0)), pa.array((f * f).sum(0)),
                     pa.array(np.full(dims, len(x)))], names=["dim", "low", "high", "s", "ss", "n"])

    per = rows.select("vector").mapInArrow(run, "dim int, low bigint, high bigint, s double, ss double, n bigint")
    wide = per.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("variance"))
    return wide.orderBy("dim").collect()  # one row per dimension


class Space:
    """Dimensions, the integer type that holds all components, and the curve's dimensions."""

    def __init__(self, spread: list):
        self.dims = max(1, len(spread))
        most = max([1, *(max(abs(r.low), abs(r.high)) for r in spread)])
        self.dtype = "<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<i8"
        self.exact = most * most * self.dims < 2 ** 53
        best = sorted(spread, key=lambda r: (-r.variance, r.dim))[:CURVE_DIMS]
        self.curve = [(r.dim, r.low, max(1, r.high - r.low)) for r in best] or [(0, 0, 1)]

    def matrix(self, data: bytes):
        import numpy as np

        return np.frombuffer(data, dtype=self.dtype).reshape(-1, self.dims)

    def product(self, a, b):
        """Inner products of the rows of a and b, as int64."""
        import numpy as np

        if self.exact:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        return (a.astype(object) @ b.astype(object).T).astype(np.int64)

    def bounds(self, a, low, high):
        """Smallest and largest inner product of each row of a with any point of each box (low, high)."""
        import numpy as np

        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return self.product(up, low) + self.product(down, high), self.product(up, high) + self.product(down, low)


def _blocks(rows: DataFrame, space: Space, total: int) -> DataFrame:
    """Blocks along the curve: grp, block, ids (ascending), labels, data, low, high."""

    def keyed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = padded(batch.column("vector"), space.dims)
                cells = np.stack([np.minimum(((x[:, d] - lo).astype(float) * 2 ** CURVE_BITS / (width + 1)).astype(np.int64), 2 ** CURVE_BITS - 1)
                                  for d, lo, width in space.curve], axis=1)
                key = (hilbert_keys(cells) ^ np.uint64(1 << 63)).view(np.int64)
                data = [row.tobytes() for row in x.astype(space.dtype)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(key), pa.array(data, pa.binary())],
                                                 names=["vec_id", "label", "key", "data"])

    def packed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def out(t):
            nonlocal number
            ids, labels = np.asarray(t.column("vec_id")), np.asarray(t.column("label"))
            x = space.matrix(b"".join(t.column("data").to_pylist()))
            order = np.argsort(ids, kind="stable")
            row = [[part], [part * 2 ** 32 + number], [ids[order]], [labels[order]], [x[order].tobytes()], [x.min(0).tobytes()], [x.max(0).tobytes()]]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, shape)], schema=shape)

        shape = pa.schema([("grp", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())),
                           ("data", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                t = pa.Table.from_batches(held)
                yield out(t.slice(0, BLOCK))
                held = t.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    parts = max(1, -(-total // GROUP_ROWS), min(shuffle_partitions(rows.sparkSession), -(-total // BLOCK)))
    line = rows.mapInArrow(keyed, "vec_id bigint, label bigint, key bigint, data binary")
    line = line.repartitionByRange(parts, "key", "vec_id").sortWithinPartitions("key", "vec_id")
    return line.mapInArrow(packed, "grp int, block bigint, ids array<bigint>, labels array<bigint>, data binary, low binary, high binary")


def _anchors(blocks: DataFrame, space: Space, every: int, n_positives: int) -> DataFrame:
    """Anchors of each block: block, vec_id, label, data and seed, the score of the last of its best rows of the same label in its own block."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for block, ids, labels, data in zip(*(batch.column(c) for c in ("block", "ids", "labels", "data"))):
                ids, labels, x = np.asarray(ids.values), np.asarray(labels.values), space.matrix(data.as_py())
                own = np.flatnonzero(ids % every == 0)
                if not len(own):
                    continue
                s = space.product(x[own], x)
                s[(labels[own][:, None] != labels[None, :]) | (ids[own][:, None] == ids[None, :])] = NONE
                seed = -np.sort(-s, axis=1)[:, n_positives - 1] if s.shape[1] >= n_positives else np.full(len(own), NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block.as_py())), pa.array(ids[own]), pa.array(labels[own]),
                     pa.array([v.tobytes() for v in x[own]], pa.binary()), pa.array(seed)], names=["block", "vec_id", "label", "data", "seed"])

    return blocks.select("block", "ids", "labels", "data").mapInArrow(run, "block bigint, vec_id bigint, label bigint, data binary, seed bigint")


def _numbered(anchors: DataFrame, total: int) -> DataFrame:
    """Anchors with their tile and place there, along the curve."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(part * 2 ** 32 + place // TILE), pa.array((place % TILE).astype(np.int32)), *batch.columns],
                                             names=["tile", "place", *batch.schema.names])

    line = anchors.repartitionByRange(max(1, -(-total // TILE)), "block", "vec_id").sortWithinPartitions("block", "vec_id")
    return line.mapInArrow(run, "tile bigint, place int, block bigint, vec_id bigint, label bigint, data binary, seed bigint")


def _chosen(anchors: DataFrame, blocks: DataFrame, space: Space, groups: int) -> DataFrame:
    """The blocks that windows must read, by tile: block, tile, most (largest bound) and the anchors to hold against it.

    anchors: tile, place, vec_id, label, data, lows, highs (arrays of equal length: the windows). One zone group meets one tile
    at a time, and only zones are read here.
    """
    whole = anchors.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "label", "data", "lows", "highs"))).alias("a"))  # TILE rows
    asked = whole.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    zones = blocks.groupBy("grp").agg(F.collect_list(F.struct("block", "low", "high")).alias("zones"))  # the blocks of one partition

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for tile, a, zones in zip(*(batch.column(c) for c in ("tile", "a", "zones"))):
                a, zones = a.values, zones.values
                x = space.matrix(b"".join(a.field("data").to_pylist()))
                low, high = (space.matrix(b"".join(zones.field(c).to_pylist())) for c in ("low", "high"))
                least, most = space.bounds(x, low, high)
                lows, highs = (np.array(a.field(c).to_pylist(), dtype=np.int64).reshape(len(x), -1) for c in ("lows", "highs"))
                met = ((lows[:, None, :] <= most[:, :, None]) & (highs[:, None, :] >= least[:, :, None]) & (lows <= highs)[:, None, :]).any(axis=2)
                for j, block in enumerate(zones.field("block").to_pylist()):
                    on = np.flatnonzero(met[:, j])
                    if len(on):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block]), tile_column(tile, 1), pa.array([int(most[on, j].max())]), pa.array([most[on, j]], pa.list_(pa.int64())),
                             pa.array([a.take(pa.array(on)).to_pylist()], pa.list_(a.type))], names=["block", "tile", "most", "bounds", "a"])

    def tile_column(tile, n):
        import pyarrow as pa

        return pa.array([tile.as_py()] * n, pa.int64())

    one = "array<struct<place:int,vec_id:bigint,label:bigint,data:binary,lows:array<bigint>,highs:array<bigint>>>"
    return asked.join(zones, "grp").select("tile", "a", "zones").mapInArrow(run, f"block bigint, tile bigint, most bigint, bounds array<bigint>, a {one}")


def _best(chosen: DataFrame, blocks: DataFrame, space: Space, same_label: bool, n: int) -> DataFrame:
    """tile, place, win, vec_id, score: the n best rows of each window among the chosen blocks of a task.

    Blocks with high bounds come first, and an anchor whose windows are all filled above a block's bound skips it.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tile, best, names = None, None, None

        def out():
            at = np.argwhere(best > NONE)
            if len(at):
                i, w, k = at.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), tile)), pa.array(i.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(names[i, w, k]), pa.array(best[i, w, k])],
                    names=["tile", "place", "win", "vec_id", "score"])

        for batch in batches:
            for now, bounds, a, ids, labels, data in zip(*(batch.column(c) for c in ("tile", "bounds", "a", "ids", "labels", "data"))):
                a = a.values
                lows, highs = (np.array(a.field(c).to_pylist(), dtype=np.int64).reshape(len(a), -1) for c in ("lows", "highs"))
                if now.as_py() != tile:
                    if tile is not None:
                        yield from out()
                    tile = now.as_py()
                    best = np.full((TILE, lows.shape[1], n), NONE)
                    names = np.zeros_like(best)
                place = np.asarray(a.field("place"))
                open_ = (np.asarray(bounds.values)[:, None] >= best[place][:, :, -1]).any(axis=1)
                on = np.flatnonzero(open_)
                if not len(on):
                    continue
                place, lows, highs = place[on], lows[on], highs[on]
                mine, own = np.asarray(a.field("vec_id"))[on], np.asarray(a.field("label"))[on]
                ids, labels = np.asarray(ids.values), np.asarray(labels.values)
                s = space.product(space.matrix(b"".join(a.field("data").take(pa.array(on)).to_pylist())), space.matrix(data.as_py()))
                equal = own[:, None] == labels[None, :]
                s[~equal | (mine[:, None] == ids[None, :]) if same_label else equal] = NONE
                order = np.argsort(-s, axis=1, kind="stable")  # ids ascend, so ties go to the smaller one
                s = np.take_along_axis(s, order, axis=1)
                for w in range(lows.shape[1]):
                    start = (s > highs[:, w, None]).sum(axis=1)
                    at = start[:, None] + np.arange(n)[None, :]
                    inside = at < s.shape[1]
                    at = np.minimum(at, s.shape[1] - 1)
                    got = np.take_along_axis(s, at, axis=1)
                    got = np.where(inside & (got >= lows[:, w, None]), got, NONE)
                    both = np.concatenate((best[place, w], got), axis=1)
                    who = np.concatenate((names[place, w], ids[np.take_along_axis(order, at, axis=1)]), axis=1)
                    first = np.lexsort((who, -both), axis=1)[:, :n]
                    best[place, w] = np.take_along_axis(both, first, axis=1)
                    names[place, w] = np.take_along_axis(who, first, axis=1)
        if tile is not None:
            yield from out()

    met = chosen.join(blocks.select("block", "ids", "labels", "data"), "block").sortWithinPartitions("tile", F.desc("most"), "block")
    found = met.select("tile", "bounds", "a", "ids", "labels", "data").mapInArrow(run, "tile bigint, place int, win int, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("tile", "place", "win").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n)


def mine(
    rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, vector (array of integers; see ``usable``). A score is the integer inner product with the anchor; higher
    ones come first, ties by smaller vec_id. Anchors are the rows whose vec_id is divisible by ``every``; positives of an anchor are
    its first rows of the same label with another vec_id. For each positive the first rows of other labels with
    ``share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score`` are returned, all if there are fewer.

    Vectors may differ in length: missing components are zero. Scores must be below 2 ** 62 in size. A negative positive score has
    no negatives. Rows that repeat a vec_id are rows of their own, and as anchors each brings its own result. An empty table gives
    no rows. More columns are ignored.
    """
    rows = staged(rows.select("vec_id", "label", "vector"))
    space, total = Space(_spread(rows)), rows.count()
    blocks = staged(_blocks(rows, space, total))
    groups = (blocks.agg(F.max("grp")).first()[0] or 0) + 1
    found = staged(_anchors(blocks, space, every, n_positives))
    anchors = staged(_numbered(found, found.count()))
    own = ["tile", "place", "vec_id", "label", "data"]
    first = anchors.select(*own, F.array("seed").alias("lows"), F.array(F.lit(2 ** 62 - 1)).alias("highs"))
    positives = staged(_best(staged(_chosen(first, blocks, space, groups)), blocks, space, True, n_positives))
    pairs = positives.select(
        "tile", "place", (F.col("rank") - 1).alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    def window(score: Column) -> Column:  # ceil(share of the score) without rounding
        return F.ceil(score.cast("decimal(20,0)") * share[0] / share[1]).cast("bigint")

    per = pairs.groupBy("tile", "place").agg(F.array_sort(F.collect_list(F.struct("win", "positive_score"))).alias("p"))
    empty = F.array_repeat(F.lit(NONE), n_positives - F.size("p"))
    second = anchors.join(per, ["tile", "place"]).select(
        *own, F.concat(F.transform("p", lambda p: window(p["positive_score"])), F.transform(empty, lambda x: x + 1)).alias("lows"),
        F.concat(F.transform("p", lambda p: p["positive_score"]), empty).alias("highs"))
    negatives = _best(staged(_chosen(second, blocks, space, groups)), blocks, space, False, n_negatives)
    named = anchors.select("tile", "place", F.col("vec_id").alias("anchor_id"))
    out = negatives.select("tile", "place", "win", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    return out.join(pairs, ["tile", "place", "win"]).join(named, ["tile", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
