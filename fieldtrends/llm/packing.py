"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits into one sequence. The program: use as few
sequences as possible so that the chosen configurations hold every length as often as it occurs. It is
solved by multiplicative weights: each length has a price, a knapsack dynamic program finds the dearest
configurations, they are used a little more, and the prices of what they cover fall. The fractional
solution is rounded to whole sequences, and what rounding leaves is packed by best fit over its histogram.

Only the histogram (at most ``capacity`` numbers) reaches the driver; the plan's size does not depend on
the number of documents. Pieces get their place by their rank within their length.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window as W, functions as F

from fieldtrends.llm.common import map_batches, text_or_empty
from fieldtrends.llm.tokens import encoder
from fieldtrends.session import staged

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents, each with its rank among the pieces of its length in its task."""

    def make():
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")

        def step(batch):
            for lo in range(0, batch.num_rows, 512):
                rows = []
                part = batch.slice(lo, 512)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    raw = encode(text) + end
                    for piece, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                        rows.append((doc_id, piece, start, n, zlib.crc32(raw[4 * start:4 * (start + n)]), task, int(seen[n])))
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(rows, PIECE_SCHEMA, make)


def priced(price, capacity: int):
    """Best value for every room 0..capacity when each length may be used any number of times, and the last length used.

    ``price[n]`` is the value of length n, minus infinity where there is none."""
    import numpy as np

    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        got = best[room - 1::-1] + price[1:room + 1]
        n = int(got.argmax()) + 1
        best[room] = best[room - 1]
        if got[n - 1] > best[room]:
            best[room], last[room] = got[n - 1], n
    return best, last


def configuration(room: int, last) -> dict[int, int]:
    """The lengths behind the best value for ``room``."""
    used: dict[int, int] = {}
    while room > 0:
        n = int(last[room])
        if n:
            used[n] = used.get(n, 0) + 1
        room -= n or 1
    return used


def fractional(histogram: dict[int, int], capacity: int, sharpness: float = 0.2, rounds: int = 3000, per_round: int = 64, pace: float = 0.5):
    """Configurations with how often to use them, and a lower bound on the number of sequences.

    Multiplicative weights for the covering program: the price of a length is its part of a sequence times a
    weight that falls exponentially with the share of it that is covered, and in each round the configurations
    within ``sharpness`` of the dearest are used for a small share of their lengths. Prices over the value of
    the dearest configuration are a dual solution, so they bound the optimum from below.
    """
    import numpy as np

    lengths = np.array(sorted(histogram))
    counts = np.zeros(capacity + 1)
    counts[lengths] = [histogram[n] for n in lengths.tolist()]
    share, used, bound = np.zeros(capacity + 1), {}, 0.0
    steepness = np.log(len(lengths) + 1) / sharpness
    step = pace / steepness
    price = np.full(capacity + 1, -np.inf)  # no such length
    for _ in range(rounds):
        weight = np.exp(-steepness * (share[lengths] - share[lengths].min()))
        price[lengths] = weight * lengths / capacity
        best, last = priced(price, capacity)
        bound = max(bound, float(price[lengths] @ counts[lengths] / best[capacity]))
        with_first = price[lengths] + best[capacity - lengths]
        good = lengths[with_first >= (1 - sharpness) * best[capacity]]
        for n in good[np.argsort(share[good], kind="stable")[:per_round]].tolist():
            config = configuration(capacity - n, last)
            config[n] = config.get(n, 0) + 1
            much = step * min(counts[m] / k for m, k in config.items())
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0.0) + much
            for m, k in config.items():
                share[m] += k * much / counts[m]
        if share[lengths].min() >= 1:
            break
    scale = float(share[lengths].min()) or 1.0
    return {c: x / scale for c, x in used.items()}, bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit, longest first, over a histogram: equal sequences are kept as one entry with a count.

    Each length splits at most one entry and opens at most two, so the work does not grow with the counts.
    """
    rooms: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]
    for n in sorted(left, reverse=True):
        todo = left[n]
        room = n
        while todo > 0:
            while room <= capacity and not rooms[room]:
                room += 1
            times, config = rooms[room].pop() if room <= capacity else (todo, {})
            space = min(room, capacity)
            copies = min(space // n, todo)
            filled = min(times, todo // copies)
            if room <= capacity and times > filled:
                rooms[room].append((times - filled, config))
            rooms[space - copies * n].append((filled, config | {n: copies}))
            todo -= copies * filled
            room = n
    return [entry for entries in rooms for entry in entries]


def rounded(histogram: dict[int, int], capacity: int, solved: dict[tuple, float], part: float) -> list[tuple[int, list[tuple[int, int]]]]:
    """Whole sequences: ``part`` of each fractional use, rounded down, most used first; best fit for the lengths left."""
    left, out = dict(histogram), []
    for key, x in sorted(solved.items(), key=lambda e: (-e[1], e[0])):
        if part * x < 1:
            break
        times = min(int(part * x), *(left[n] // k for n, k in key))
        if times > 0:
            for n, k in key:
                left[n] -= k * times
            out.append((times, list(key)))
    return out + [(times, sorted(config.items())) for times, config in best_fit(left, capacity)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, [(length, copies)]) so that every length is placed exactly as often as it occurs.

    The program is rounded with several parts of its solution, from nearly all of it down to none (then all
    is best fit); the one with the fewest sequences is taken, and of
    equal ones that with most of the solution. The number of entries depends on the capacity, not on how often the lengths occur.
    """
    full = [(histogram[capacity], [(capacity, 1)])] if histogram.get(capacity) else []
    small = {n: c for n, c in histogram.items() if n < capacity and c > 0}
    if not small:
        return full
    solved, bound = fractional(small, capacity)
    best = None
    for part in (0.95, 0.8, 0.5, 0.2, 0.0):
        entries = rounded(small, capacity, solved, part)
        if best is None or sum(t for t, _ in entries) < sum(t for t, _ in best):
            best = entries
        if sum(t for t, _ in best) <= bound:
            break
    return full + best


def slots(entries: list[tuple[int, list[tuple[int, int]]]]):
    """Per length: where runs of ranks begin, and the sequence, copies and offset of each run."""
    import numpy as np

    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, config in entries:
        offset = 0
        for length, copies in config:
            at = taken.get(length, 0)
            runs.setdefault(length, []).append((at, sequence, copies, offset))
            taken[length] = at + times * copies
            offset += length * copies
        sequence += times
    return {n: np.array(r, dtype=np.int64).T for n, r in runs.items()}


def place(ranked: DataFrame, entries) -> DataFrame:
    """sequence_id and offset of each piece from its rank within its length."""
    runs = slots(entries)

    def make():
        import numpy as np
        import pyarrow as pa

        def step(batch):
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, seq, copies, off = runs[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                inner = rank[at] - first[k]
                sequence[at] = seq[k] + inner // copies[k]
                offset[at] = off[k] + inner % copies[k] * n
            keep = PACKED[:5]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(sequence), pa.array(offset)], names=PACKED)

        return step

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return map_batches(ranked.select(*PACKED[:5], "rank"), schema, make)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Packs all documents (doc_id, text; more columns are ignored) into sequences of at most ``capacity`` ids.

    A document is its ids and the end id; null or empty text is the end id alone. A longer document is cut
    into pieces, of which only the first may be shorter than the capacity. Each row is a document of its own,
    so repeated rows and doc_ids are packed as often as they occur. An empty table gives no rows.
    """
    cut_up = staged(pieces(docs, tokenizer, end_id, capacity))
    per_task = cut_up.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = staged(per_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ranked = cut_up.join(before.drop("n"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("rank"))
    return place(ranked, plan(histogram, capacity))
