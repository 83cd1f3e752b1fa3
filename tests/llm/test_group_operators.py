"""Line dedup, the prefix trie and hard negatives against plain versions on small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldtrends.llm import hard_negatives, line_dedup, prefix_trie
from fieldtrends.session import staged

SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- 13 line dedup
def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_lines(rows, least, keep_first=False):
    """[(doc_id, text)] -> [(doc_id, n_lines, n_dropped, kept)] in the order of the rows."""
    split = [(t or "").split("\n") for _, t in rows]
    keys = [[ascii_lower(x.strip(SPACES)) for x in lines] for lines in split]
    found = Counter(k for ks in keys for k in set(ks) if k)
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        for j, k in enumerate(keys[i]):
            first.setdefault(k, (i, j))
    out = []
    for i, (lines, ks) in enumerate(zip(split, keys)):
        gone = [k != "" and found[k] >= least and not (keep_first and first[k] == (i, j)) for j, k in enumerate(ks)]
        out.append((rows[i][0], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


LINE_DOCS = (
    [(1, None), (2, ""), (3, "\n\n"), (4, " \t \n"), (5, "Common LINE \nown five\nmid"), (6, "common line\r\n\nsix É"), (6, "common line\r\n\nsix É"),
     (7, "x\ncommon line\nCOMMON line\nx"), (None, "common line\nmid"), (None, "common line\nmid"), (9, "é\nÉ\né"), (10, "\x0bmid\x0c"),
     (11, "long " * 30_000 + "\ncommon line"), (12, "\n".join(f"line {i % 700}" for i in range(3000)))]
    + [(100 + i, f"only {i}\n" + "boiler plate of all\n" * (1 + i % 2) + f"tail {i % 3}") for i in range(40)])


@pytest.mark.parametrize("least, keep_first, most_bits", [(5, False, line_dedup.MOST_BITS), (2, False, 2 ** 16), (5, True, line_dedup.MOST_BITS), (2, True, 2 ** 9)])
def test_lines(spark, least, keep_first, most_bits, monkeypatch):
    if most_bits < 2 ** 16:  # several slices
        monkeypatch.setattr(line_dedup, "LEAST_BITS", 2 ** 9)
        assert line_dedup.filter_size(3300, most_bits)[1] > 50
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in LINE_DOCS], "doc_id bigint, text string, digests string, rid int, `a.b` string").coalesce(1)
    got = line_dedup.judged_lines(docs, least, keep_first, most_bits).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(plain_lines(LINE_DOCS, least, keep_first), key=key)


def test_lines_keep_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", 7)] * 2, "doc_id bigint, text string, `row.text` string, drop int")
    out = line_dedup.drop_repeated_lines(docs, min_docs=2)
    assert out.columns == docs.columns and list(map(tuple, out.collect())) == [(1, "", "x", 7)] * 2
    with pytest.raises(ValueError):
        line_dedup.judged_lines(docs, min_docs=1)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.judged_lines(none).count() == 0 and line_dedup.drop_repeated_lines(none).columns == ["doc_id", "text"]


def test_merged_filters_lose_no_repeat(spark):
    """Every key of two documents is a suspect, wherever the documents lie; hardly any other is."""
    rows = [(i, f"pair {i % 500}\nsingle {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    part = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("doc"), F.transform(F.split("text", "\n"), line_dedup._digest).alias("digests"))
    part = staged(part)
    twice = line_dedup._twice_seen(part, 2 ** 16)
    found = line_dedup._suspects(part, twice).groupBy("pos").count().collect()
    n = {r["pos"]: r["count"] for r in found}
    assert n[0] == 1000 and n.get(1, 0) < 50


def test_filter_size():
    assert line_dedup.filter_size(0) == (2 ** 16, 1)
    assert line_dedup.filter_size(10 ** 6) == (2 ** 23, 1)
    bits, slices = line_dedup.filter_size(10 ** 9)
    assert bits == line_dedup.MOST_BITS and slices * bits >= line_dedup.BITS_PER_LINE * 10 ** 9


# ---------------------------------------------------------------- 12 prefix trie
def plain_trie(convs):
    """{conv_id: [(role, text)]} -> set of node rows."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * (len(p[-1][1]) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
             sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)))) for p, m in members.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def talk():
    """Hot first turns, a large group of equal conversations, long shared prefixes, single ones."""
    convs = {}
    for c in range(400):
        if c % 3 == 0:
            turns = [("user", "same start"), ("assistant", "same reply")]
        elif c % 3 == 1:
            turns = [("user", "same start"), ("assistant", f"reply {c % 5}"), ("user", f"x{c}")] + [("user", "é🙂" * (c % 4))] * (c % 6)
        else:
            turns = [("user", f"t{k}") for k in range(c % 37)] + [("assistant", f"{c % 7}")]
        convs[c] = turns
    convs[5000] = [("user", f"t{k}") for k in range(500)]
    convs[-7] = [("", "")]
    return convs


def turn_rows(spark, convs):
    rows = [(c, t, r or None, x or None, "junk") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string")


@pytest.mark.parametrize("size", [prefix_trie.SHARD_TURNS, 150])
def test_trie(spark, size):
    convs = {c: t for c, t in talk().items() if t}
    got = prefix_trie.prefix_trie(turn_rows(spark, convs), shard_turns=size).collect()
    want = plain_trie(convs)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_with_cut_splitters_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SKELETON_TURNS", 120)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    convs = {c: t for c, t in talk().items() if t and c < 1000}
    rows = turn_rows(spark, convs)
    assert {tuple(r) for r in prefix_trie.prefix_trie(rows, shard_turns=250).collect()} == plain_trie(convs)


def test_trie_of_rebuilt_conversations(spark):
    convs = {c: t for c, t in talk().items() if t} | {c: [("user", "one")] for c in range(7001, 7041)}
    rows = turn_rows(spark, convs)
    want = plain_rebuilt(convs)
    assert any(not t for t in want.values())
    assert {tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(rows), shard_turns=300).collect()} == plain_trie(want)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, "user", "second"), (1, 1, "user", "twice"), (1, 1, "user", "twice"),
            (2, 0, None, None), (3, 0, "", ""), (4, 0, "us", "er1"), (5, 0, "user", "1")]
    got = {tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    same = {1: [("user", "first"), ("user", "second"), ("user", "twice"), ("user", "twice")], 2: [("", "")], 3: [("", "")], 4: [("us", "er1")], 5: [("user", "1")]}
    assert got == plain_trie(same)
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0 and prefix_trie.trie(prefix_trie.rebuilt(none)).count() == 0


def test_skeleton_owners():
    def path(s):
        return b"".join(c.encode() * prefix_trie.WIDTH for c in s)

    borders = [(path(s), 0) for s in ["abc", "abd", "abd", "abdz", "b"]]
    sk = prefix_trie.Skeleton(borders)
    assert sk.shared == [0, 2, 3, 3, 0]
    assert sk.owners(3) == [0, 0, 0, 1, 3] and sk.owners(4) == [0, 4]
    assert sk.nodes() == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (3, 4), (4, 1)]


# ---------------------------------------------------------------- 11 hard negatives
def plain_negatives(rows, every, n_pos=5, n_neg=5):
    out = []
    for i, (a, la, va) in enumerate(rows):
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), j, lb) for b, (j, lb, v) in enumerate(rows) if j != a), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == la][:n_pos]:
            found = [x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(found[:n_neg], 1)]
    return sorted(out)


def vectors(n, dims, spread, seed=3):
    x, out = seed, []
    for i in range(n):
        v = []
        for d in range(dims):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2 ** 64
            v.append((x >> 33) / 2 ** 31 * spread + (0.5 if d == i % 4 else 0.0))
        out.append((i, i % 3, [float(c) for c in v]))
    return out


def quantised(rows):
    return [(i, lb, [math.floor(256 * c) for c in v]) for i, lb, v in rows]


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, label int, embedding array<double>, block string, tile int")
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.usable(df, "embedding"), **options).collect()))


@pytest.mark.parametrize("block, tile", [(512, 1024), (16, 8)])
def test_negatives(spark, monkeypatch, block, tile):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 10 * block)
    rows = vectors(400, 6, 1.0)
    # a large group of equal vectors, zero vectors, negative scores
    rows += [(1000 + i, i % 2, [0.25] * 6) for i in range(200)] + [(2000 + i, i % 3, [0.0] * 6) for i in range(20)] + [(3000, 1, [-1.0] * 6), (3001, 1, [2.0] * 6)]
    assert mined(spark, rows, every=50) == plain_negatives(quantised(rows), 50)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 2, [1.0, 1.9]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [nan, 1.0]),
            (7, 2, [inf, 1.0]), (8, 2, [-inf, 1.0]), (None, 2, [1.0, 1.0]), (9, 2, []), (10, 2, [0.9, 0.05]), (11, 2, [3e6, -3e6]), (100, 7, [1.0, 1.0])]
    good = [r for r in rows if r[0] not in (3, 4, 5, 6, 7, 8, None)]
    assert mined(spark, rows) == plain_negatives(quantised(good), 100)
    assert mined(spark, []) == []


def test_negatives_of_long_components(spark):
    """Components beyond the range in which floating-point products are exact."""
    rows = [(i, i % 2, [float(2 ** 21 + i), float(2 ** 20 - 3 * i), 1.0]) for i in range(30)]
    assert mined(spark, rows, every=10) == plain_negatives(quantised(rows), 10)


def test_zones_bound_and_prune(spark):
    """Zones never lose a row, and where rows are clustered most blocks are not read."""
    import numpy as np

    rows = vectors(4000, 6, 0.02)
    df = hard_negatives.usable(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"), "embedding")
    space = hard_negatives.Space(hard_negatives._spread(df))
    blocks = hard_negatives._blocks(df, space, len(rows)).collect()
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(4000))
    anchor = np.array([r[2] for r in quantised(rows)[:1]])
    read = 0
    for b in blocks:
        low, high = space.matrix(bytes(b["low"])), space.matrix(bytes(b["high"]))
        least, most = space.bounds(anchor, low, high)
        s = space.product(anchor, space.matrix(bytes(b["data"])))
        assert least[0, 0] <= s.min() and s.max() <= most[0, 0]
        read += most[0, 0] >= 0.9 * 128 * 128
    assert read <= len(blocks) // 2 + 1


def test_hilbert_curve_is_a_path():
    import itertools

    import numpy as np

    points = np.array(list(itertools.product(range(8), repeat=3)))
    key = hard_negatives.hilbert_keys(points, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
