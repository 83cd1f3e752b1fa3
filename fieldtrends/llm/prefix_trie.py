"""Conversation prefix trie by a splitter skeleton.

A conversation is the path of its turns' digests. Paths are sorted and cut into shards by sampled splitters,
where equal paths are told apart by conversation. A node with members in two shards is a prefix of the splitter
between them, so the trie of the splitter paths, the skeleton, holds every node that no shard sees whole. It is
broadcast; each task walks its sorted shard once, finishes all other nodes, and returns partial aggregates of the
skeleton nodes on its two borders, which are reduced by key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from fieldtrends.llm.common import shuffle_partitions
from fieldtrends.session import staged

WIDTH = 16  # bytes of a turn's digest
SHARD_TURNS = 20_000  # turns per shard, on average
MOST_SHARDS = 10_000
SAMPLE = 32  # sampled conversations per shard
SKELETON_TURNS = 2 ** 20  # turns of all splitters together, at most
CHUNK_IDS = 4096  # ids per row of a skeleton node's ends

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: in order of turn (null first), ties by digest; of each turn the digest of role and text, and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return per.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"], t["chars"])).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % every, then c's own turns after its first h; h = crc32(c) % most."""
    own = turns_of(conversations).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    own = staged(own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every))
    heads = own.filter("conv_id = base").select("base", F.slice("turns", 1, most - 1).alias("head"))
    none = F.slice("turns", 1, 0)
    joined = own.join(heads, "base", "left")
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(none)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), rest).alias("turns"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests one after the other), chars (code points per turn)."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return turns.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def common_turns(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths share."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    lo, hi = 0, n  # the first lo turns are equal, the first hi are not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid * WIDTH] == b[:mid * WIDTH]:
            lo = mid
        else:
            hi = mid
    return lo


def splitters(rows: DataFrame, shards: int, conversations: int) -> list[tuple[bytes, int]]:
    """Sorted borders of the shards: every SAMPLE-th of about SAMPLE * shards sampled (path, conv_id), SKELETON_TURNS turns in all.

    A longer path is cut, and cut paths are not told apart by conversation.
    """
    if shards < 2:
        return []
    size = WIDTH * (SKELETON_TURNS // shards)
    chance = min(1.0, SAMPLE * shards / conversations)
    sample = rows.filter(F.pmod(F.xxhash64("conv_id"), F.lit(2 ** 20)) < chance * 2 ** 20).select(
        F.substring("path", 1, size).alias("path"), F.when(F.length("path") <= size, F.col("conv_id")).otherwise(F.lit(-(2 ** 63))).alias("conv_id"))
    numbered = sample.withColumn("place", F.row_number().over(Window.orderBy("path", "conv_id")))
    return sorted({(bytes(r.path), r.conv_id) for r in numbered.filter(F.col("place") % SAMPLE == 0).collect()})


class Skeleton:
    """The trie of the splitter paths: splitter i adds the nodes (i, depth) for depths above ``shared[i]``; (0, 0) is the root."""

    def __init__(self, borders: list[tuple[bytes, int]]):
        self.borders = borders
        self.depth = [len(p) // WIDTH for p, _ in borders]
        self.shared = [common_turns(borders[i - 1][0], p) if i else 0 for i, (p, _) in enumerate(borders)]

    def owners(self, i: int) -> list[int]:
        """For each depth of splitter i's path, the splitter that added the node."""
        out = [i] * (self.depth[i] + 1)
        need, k = self.shared[i], i
        while need > 0 and k > 0:
            k -= 1
            if self.shared[k] < need:
                for d in range(self.shared[k] + 1, need + 1):
                    out[d] = k
                need = self.shared[k]
        out[0] = 0
        return out

    def nodes(self) -> list[tuple[int, int]]:
        """All nodes in preorder."""
        return [(0, 0)] + [(i, d) for i in range(len(self.borders)) for d in range(self.shared[i] + 1, self.depth[i] + 1)]


class Open:
    """A node whose members are being read; key is its place in the skeleton, if it is there."""

    __slots__ = ("first", "n", "children", "leaves", "saved", "chars", "key", "sha", "kids", "ids", "chunk")

    def __init__(self, chars: int, key):
        import hashlib

        self.first, self.n, self.children, self.leaves, self.saved, self.chars, self.key = None, 0, 0, 0, 0, chars, key
        self.sha = hashlib.sha256()
        self.kids: list[list] = []  # rows of the children, which wait for the smallest member
        self.ids: list[int] = []  # members that end here; with a key they are handed on in chunks
        self.chunk = 0

    def add(self, first: int, n: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)


def walk(rows: Iterator, skeleton: Skeleton) -> Iterator[dict]:
    """Reads (shard, path, conv_id, chars) sorted by the first three and gives result rows of three kinds:

    "node": a finished node; the children of a skeleton node carry its place (owner, level) in place of the parent;
    "part": sums of a skeleton node over one shard, without its skeleton children;
    "ends": ids of the members that end at a skeleton node, in chunks.

    Held are the nodes of the current path and the rows of the subtree below its deepest skeleton node.
    """
    borders = skeleton.borders
    stack: list[Open] = []
    held: list[list] = []
    shard, before, low, high, low_path, high_path = None, b"", [0], [0], b"", b""

    def handed_on(x: Open) -> dict:
        out = {"kind": "ends", "owner": x.key[0], "level": x.key[1], "shard": shard, "chunk": x.chunk, "ids": ",".join(map(str, x.ids))}
        x.chunk, x.ids = x.chunk + 1, []
        return out

    def close() -> Iterator[dict]:
        x = stack.pop()
        up = stack[-1] if stack else None
        if up is not None:
            up.add(x.first, x.n)
        if x.key is not None:
            if x.ids:
                yield handed_on(x)
            yield {"kind": "part", "owner": x.key[0], "level": x.key[1], "conv_id": x.first, "n_convs": x.n, "n_children": x.children,
                   "n_leaves": x.leaves, "saved_tokens": x.saved, "chars": x.chars}
            return
        x.leaves = x.leaves or 1
        x.saved += (x.n - 1) * x.chars
        for r in x.kids:
            r["parent_conv_id"] = x.first
        row = {"kind": "node", "conv_id": x.first, "depth": len(stack), "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves,
               "saved_tokens": x.saved, "ends_sha256": x.sha.hexdigest()}
        held.append(row)
        up.children += 1
        up.leaves += x.leaves
        up.saved += x.saved
        if up.key is None:
            up.kids.append(row)
        else:
            row["owner"], row["level"] = up.key
            yield from held
            held.clear()

    for now, path, conv, chars in rows:
        if now != shard:
            while stack:
                yield from close()
            shard, before = now, b""
            low_path, low = (borders[now - 1][0], skeleton.owners(now - 1)) if now > 0 else (b"", [0])
            high_path, high = (borders[now][0], skeleton.owners(now)) if now < len(borders) else (b"", [0])
            stack.append(Open(0, (0, 0)))
        same = common_turns(before, path)
        while len(stack) > same + 1:
            yield from close()
        n = len(path) // WIDTH
        in_low, in_high = common_turns(low_path, path), common_turns(high_path, path)
        for d in range(len(stack), n + 1):
            stack.append(Open(chars[d - 1], (low[d], d) if d <= in_low else (high[d], d) if d <= in_high else None))
        x = stack[n]
        x.add(conv, 1)
        if x.key is None:
            x.sha.update(f",{conv}".encode() if x.chunk else str(conv).encode())
            x.chunk = 1
        else:
            x.ids.append(conv)
            if len(x.ids) == CHUNK_IDS:
                yield handed_on(x)
        before = path
    while stack:
        yield from close()


FOUND = ("kind string, owner int, level int, shard int, chunk int, ids string, chars bigint, conv_id bigint, depth bigint, parent_conv_id bigint, "
         "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")


def _batches(rows: Iterator[dict], schema: str, size: int = 4096) -> Iterator:
    """Record batches of at most ``size`` rows."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    part: list[dict] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_pylist(part, fields)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, fields)


def _walked(rows: DataFrame, borders, shards: int) -> DataFrame:
    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                own = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([bisect_right(borders.value, x) for x in own], pa.int32()), *batch.columns],
                                                 names=["shard", *batch.schema.names])

    def read(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "chars")))

    dealt = rows.select("path", "conv_id", "chars").mapInArrow(deal, "shard int, path binary, conv_id bigint, chars array<int>")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    return dealt.mapInArrow(lambda batches: _batches(walk(read(batches), Skeleton(borders.value)), FOUND), FOUND)


def _ends(found: DataFrame) -> DataFrame:
    """owner, level, ends_sha256: the chunks of a skeleton node are hashed one after the other, in order."""

    def run(batches):
        import hashlib

        def hashed():
            key, sha = None, None
            for batch in batches:
                for *now, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "level", "ids"))):
                    if now != key:
                        if key is not None:
                            yield {"owner": key[0], "level": key[1], "ends_sha256": sha.hexdigest()}
                        key, sha = now, hashlib.sha256(ids.encode())
                    else:
                        sha.update(b"," + ids.encode())
            if key is not None:
                yield {"owner": key[0], "level": key[1], "ends_sha256": sha.hexdigest()}

        return _batches(hashed(), "owner int, level int, ends_sha256 string")

    rows = found.filter("kind = 'ends'").select("owner", "level", "shard", "chunk", "ids")
    dealt = rows.repartition(shuffle_partitions(found.sparkSession), "owner", "level").sortWithinPartitions("owner", "level", "shard", "chunk")
    return dealt.mapInArrow(run, "owner int, level int, ends_sha256 string")


def _finished(reduced: DataFrame, borders) -> DataFrame:
    """The skeleton's nodes from their reduced sums: subtrees are intervals of the preorder. One task, at most SKELETON_TURNS + 1 rows."""
    schema = FOUND.split(", ", 7)[7] + ", owner int, level int"

    def run(batches):
        import hashlib

        got = {(r["owner"], r["level"]): r for batch in batches for r in batch.to_pylist()}
        if not got:
            return
        order = Skeleton(borders.value).nodes()
        above: list[int] = []
        rows, up, kids = [got[k] for k in order], [], [0] * len(order)
        for i, (_, d) in enumerate(order):
            del above[d:]
            up.append(above[-1] if above else None)
            if above:
                kids[above[-1]] += 1
            above.append(i)
        leaves = [r["n_leaves"] + (not r["n_children"] and not kids[i]) for i, r in enumerate(rows)]
        saved = [r["saved_tokens"] + (r["n_convs"] - 1) * r["chars"] for r in rows]
        for i in range(len(order) - 1, 0, -1):
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
        none = hashlib.sha256().hexdigest()
        yield from _batches(({
            "conv_id": r["conv_id"], "depth": order[i][1], "parent_conv_id": None if up[i] is None else rows[up[i]]["conv_id"], "n_convs": r["n_convs"],
            "n_children": r["n_children"] + kids[i], "n_leaves": leaves[i], "saved_tokens": saved[i], "ends_sha256": r["ends_sha256"] or none,
            "owner": order[i][0], "level": order[i][1]} for i, r in enumerate(rows)), schema)

    return reduced.coalesce(1).mapInArrow(run, schema)


def trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the prefix trie of conversations (conv_id, turns as in ``turns_of``; conv_id is unique).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (over the subtree, members but one times the code points of the node's last text), ends_sha256 (digest
    of the ids of the members that end there, ascending, joined by commas). (conv_id, depth) is unique. A conversation without turns
    is a member of the root. Equal conversations share all nodes. No conversations: no rows, not even a root.
    """
    rows = staged(paths(turns))
    total, conversations = rows.agg(F.sum(F.size("chars")), F.count(F.lit(1))).first()
    shards = max(1, min(MOST_SHARDS, -(-((total or 0) + conversations) // shard_turns)))
    borders = rows.sparkSession.sparkContext.broadcast(splitters(rows, shards, conversations))
    found = staged(_walked(rows, borders, len(borders.value) + 1))
    parts = found.filter("kind = 'part'").groupBy("owner", "level").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("chars").alias("chars"))
    skeleton = staged(_finished(parts.join(_ends(found), ["owner", "level"], "left"), borders))
    columns = [x.split()[0] for x in NODE.split(", ")]
    top = F.broadcast(skeleton.select("owner", "level", F.col("conv_id").alias("above")))  # at most SKELETON_TURNS + 1 rows
    nodes = found.filter("kind = 'node'").join(top, ["owner", "level"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return nodes.select(columns).unionByName(skeleton.select(columns))


def prefix_trie(conversations: DataFrame, **options) -> DataFrame:
    """``trie`` of conversations given by rows of turns (conv_id, turn, role, text), as they are.

    Turns are ordered by turn, null first, and equal ones by digest; null role and text are empty, rows without conv_id take
    no part, repeated rows are repeated turns, and more columns are ignored.
    """
    return trie(turns_of(conversations), **options)
