"""N-gram Jaccard join by MinHash banding.

Texts with equal n-gram sets form a class. Class representatives are signed with MinHash; band and row
counts follow from the similarity and the recall asked for. Representatives meet by band hash and every pair
is verified on the full n-gram sets, in the first band that it shares, so it counts once.

Pairs never become rows: a task compares the members of a bucket, at most two blocks of BLOCK of them, and
returns for each member its number of links and the smallest member it is connected with. A larger bucket is
cut into blocks, and each pair of blocks is a task of its own, so every pair is still compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from fieldtrends.llm.common import join_counted, map_batches, shuffle_partitions, text_or_empty, whole_row
from fieldtrends.session import staged

N = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction: the comparison is exact
RECALL = 0.9999
BLOCK = 512
WORDS_KEPT = 500_000


def bands_for(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest false candidates, for which a pair at the threshold
    meets with probability ``recall`` within ``most_hashes`` hashes."""
    for rows in range(most_hashes, 0, -1):
        meet = threshold ** rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-meet)) if meet < 1 else 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("more hashes are needed for this recall")


class WordHashes(dict):
    """64-bit hashes of words, kept per task; a full table is emptied."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x):
    """Bijective mixing of 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_set(text: bytes, words: WordHashes, n: int):
    """Sorted distinct hashes of all n-grams of words; a text of fewer than n words is one n-gram, one without words has none."""
    import numpy as np

    found = text.split()  # bytes are split at exactly the six space characters
    if not found:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k:len(w) - size + 1 + k])
    return np.unique(h)


def band_hashes(grams, bands: int, rows: int):
    """One 64-bit hash per band, with the number of the band in it."""
    import numpy as np

    if not len(grams):
        return np.empty(0, dtype=np.uint64)
    draw = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flip, odd = (draw[:bands * rows] >> np.uint64(32)).astype(np.uint32), (draw[bands * rows:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(high), 2048):  # bounded memory for texts of any length
        values = (high[at:at + 2048, None] ^ flip) * odd
        values ^= values >> np.uint32(15)
        np.minimum(least, values.min(axis=0), out=least)
    per_band = least.reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + per_band[:, k])
    return h


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key (md5 of the text), set_key (digest of the n-gram set), bands."""

    def make():
        import pyarrow as pa

        words = WordHashes()

        def step(batch):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t.encode() for t in part.column("text").to_pylist()]
                keys, sets, bucket = [], [], []
                for t in texts:
                    grams = ngram_set(t, words, n)
                    keys.append(hashlib.md5(t).hexdigest())
                    sets.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                    bucket.append(band_hashes(grams, bands, rows).view("int64"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(keys, pa.string()), pa.array(sets, pa.binary()), pa.array(bucket, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "set_key", "bands"])

        return step

    rows_in = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(rows_in, "doc_id bigint, text_key string, set_key binary, bands array<bigint>", make)


GROUP = ["bucket", "low", "high"]


def _groups(batches: Iterator) -> Iterator:
    """Tables of the rows of one (bucket, low, high) each, from batches sorted by it; a group is at most two blocks."""
    import pyarrow as pa

    held: list = []
    key = None
    for batch in batches:
        at = 0
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in GROUP]
        while at < batch.num_rows:
            now = tuple(int(c[at]) for c in cols)
            end = at + 1
            while end < batch.num_rows and all(c[end] == k for c, k in zip(cols, now)):
                end += 1
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield key, pa.Table.from_batches(held)


def _first_meetings(bands, own, bucket: int, low: int, high: int):
    """For each member, the later members that it meets in this bucket for the first time (as index arrays)."""
    import numpy as np

    for i in range(len(bands) - 1):
        later = np.arange(i + 1, len(bands))
        if low != high:
            later = later[own[i + 1:] != own[i]]
            if not len(later):
                continue
        same = bands[later] == bands[i]
        yield i, later[bands[i][same.argmax(axis=1)] == bucket]


def _by_group(df: DataFrame, schema: str, run) -> DataFrame:
    dealt = df.repartition(shuffle_partitions(df.sparkSession), *GROUP).sortWithinPartitions(*GROUP, "rep")
    return dealt.mapInArrow(lambda batches: run(_groups(batches)), schema)


def _needed(members: DataFrame) -> DataFrame:
    """Members of bucket blocks that have a pair to verify there."""

    def run(groups):
        import numpy as np
        import pyarrow as pa

        for (bucket, low, high), t in groups:
            bands = np.vstack(t.column("bands").to_numpy())
            own = t.column("own").to_numpy()
            hit = np.zeros(len(bands), dtype=bool)
            for i, later in _first_meetings(bands, own, bucket, low, high):
                if len(later):
                    hit[i] = True
                    hit[later] = True
            if hit.any():
                yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    return _by_group(members, "bucket bigint, low int, high int, own int, rep string, rep_doc bigint, bands array<bigint>", run)


def _verified(members: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """rep, links (partners of the pairs verified in this bucket block), root (smallest member connected by them)."""
    over, under = threshold

    def run(groups):
        import numpy as np
        import pyarrow as pa

        words = WordHashes()
        for (bucket, low, high), t in groups:
            reps = t.column("rep").to_pylist()
            bands = np.vstack(t.column("bands").to_numpy())
            own = t.column("own").to_numpy()
            sets = [ngram_set(x.as_py().encode(), words, n) for x in t.column("text")]
            sizes = np.array([len(s) for s in sets])
            # membership of every gram in every set, over the grams of the group: rows are sorted (gram, member)
            grams, ids = np.unique(np.concatenate(sets), return_inverse=True)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            links = np.zeros(len(reps), dtype=np.int64)
            root = list(range(len(reps)))

            def top(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            mark = np.zeros(len(grams), dtype=bool)
            for i, later in _first_meetings(bands, own, bucket, low, high):
                if not len(later):
                    continue
                mine = ids[bounds[i]:bounds[i + 1]]
                mark[mine] = True
                for j in later.tolist():
                    if min(sizes[i], sizes[j]) * under < max(sizes[i], sizes[j]) * over:
                        continue
                    both = int(np.count_nonzero(mark[ids[bounds[j]:bounds[j + 1]]]))
                    if both * under >= over * (sizes[i] + sizes[j] - both):
                        links[i] += 1
                        links[j] += 1
                        a, b = top(i), top(j)
                        root[max(a, b)] = min(a, b)
                mark[mine] = False
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([reps[i] for i in some]), pa.array(links[some]), pa.array([reps[top(i)] for i in some])], names=["rep", "links", "root"])

    return _by_group(members, "rep string, links bigint, root string", run)


def similar_texts(
    docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links).

    rows: doc_id, set_key per document. classes: set_key, rep (text key of the representative, the row with
    the smallest doc_id, null first), rep_doc (its doc_id), class_id (smallest doc_id that is not null), n_docs, n_links (other
    classes at the threshold or above).
    links: rep, root; following roots connects each class with all classes that it is linked to.
    """
    bands, per_band = bands_for(threshold[0] / threshold[1], recall)
    rows = staged(signatures(docs, n, bands, per_band))
    best = F.min(F.struct("doc_id", "text_key", "bands")).alias("best")
    classes = staged(
        rows.groupBy("set_key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("class_id"), best)
        .select("set_key", "n_docs", "class_id", F.col("best.text_key").alias("rep"), F.col("best.doc_id").alias("rep_doc"), F.col("best.bands").alias("bands"))
    )
    entries = classes.select("rep", F.explode("bands").alias("bucket"))
    sizes = staged(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = join_counted(entries, sizes, ["bucket"], "n", max(1, sizes.agg(F.sum("n")).first()[0] or 0))
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    members = (
        met.join(classes.select("rep", "rep_doc", "bands"), "rep")
        .withColumn("parts", parts).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "rep_doc", "bands")
    )
    needed = staged(_needed(members))
    # one row per text before any shuffle: repeated rows would all meet in one task
    every = docs.select(text_or_empty().alias("text")).select(F.md5("text").alias("rep"), "text").dropDuplicates(["rep"])
    texts = every.join(needed.select("rep").distinct(), "rep")
    found = staged(_verified(needed.join(texts, "rep"), n, threshold))
    per_rep = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    classes = staged(classes.drop("bands").join(per_rep, "rep", "left").fillna(0, ["n_links"]))
    return rows.select("doc_id", "set_key"), classes, found.select("rep", "root").distinct()


def components(links: DataFrame) -> DataFrame:
    """(rep, label): label is the smallest rep connected with it. Smallest labels spread along links and then jump to
    the label of the label, so the number of rounds grows with the logarithm of a chain; each round is stored."""
    both = links.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(links.select("root", "rep"))
    ends = staged(both.union(both.select("a", "a")).distinct())
    labels = staged(ends.groupBy("a").agg(F.min("b").alias("label")))
    while True:
        spread = staged(
            ends.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a")
            .agg(F.min("label").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        )
        if spread.filter("label < old").isEmpty():
            return labels.withColumnRenamed("a", "rep")
        jumped = spread.select("a", F.col("label").alias("via")).join(spread.select(F.col("a").alias("via"), "label"), "via")
        labels = staged(jumped.select("a", "label"))


def grouped(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with ``label``, the same for all classes that links connect: the group of near copies."""
    return classes.join(components(links), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def near_links(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, copy_id, n_copies, n_links.

    class_id is the smallest doc_id of the document's group, the texts that links connect, and class_size the group's number of
    documents. Inside a group copy_id is the smallest doc_id among the texts with the same set of n-grams, n_copies their number, and
    n_links the number of other such sets whose Jaccard similarity with the document's is at least the threshold. Null and
    empty texts have no n-grams: they are one group without links. A text of fewer than n words is one n-gram. Ids ignore rows without doc_id
    (null if there are only such). Repeated rows are returned as often as they occur; more columns are ignored; an empty table gives no rows.
    """
    rows, classes, links = similar_texts(docs, **options)
    every = staged(grouped(classes, links))
    groups = every.groupBy("label").agg(F.min("class_id").alias("group_id"), F.sum("n_docs").alias("class_size"))
    every = staged(every.join(groups, "label").select("set_key", "n_docs", "n_links", F.col("class_id").alias("copy_id"), F.col("group_id").alias("class_id"), "class_size"))
    total = every.agg(F.sum("n_docs")).first()[0] or 1
    out = join_counted(rows, every, ["set_key"], "n_docs", total)
    return out.select("doc_id", "class_id", "class_size", "copy_id", F.col("n_docs").alias("n_copies"), "n_links")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group of linked texts, the one with the smallest doc_id; all columns stay.

    Groups are the connected components of the links; rows without doc_id come before others. Of rows that agree in doc_id and
    text one stays. Null and empty texts are one group. Texts may have any length and columns any name; an empty table stays empty.
    """
    _, classes, links = similar_texts(docs, **options)
    stay = grouped(classes, links).groupBy("label").agg(F.min(F.struct("rep_doc", "rep")).alias("best"))
    stay = stay.select(F.coalesce("best.rep_doc", F.lit(0)).alias("doc"), F.col("best.rep_doc").isNull().alias("none"), F.col("best.rep").alias("key"))
    doc = F.col("doc_id").cast("bigint")
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), doc.isNull().alias("none"), F.md5(text_or_empty()).alias("key"), whole_row(docs))
    return rows.dropDuplicates(["doc", "none", "key"]).join(stay, ["doc", "none", "key"], "left_semi").select("row.*")
