"""The corpus pipeline against plain versions of its stages, and its entries."""

import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from fieldtrends.llm import packing  # noqa: E402
from fieldtrends.session import staged  # noqa: E402

D = "/root/testdata/sf0.001"


def test_entries():
    q = entry.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, D))
        if name != "packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality rules":
            base = {i: brute.quality_base(t)["base_failed"] for i, t in before.items()}
            assert not any(base[i] for i in after)
            assert all(i in after for i in before if not base[i] and labels.get(i) == 1)
        elif name == "exact dedup":
            assert set(after) == {i for i, _, _, kept, _ in brute.exact_groups(list(before.items())) if kept}
        elif name == "near dedup":
            sets = {i: brute.shingles(t) for i, t in before.items()}
            group = {i: {i} for i in before}
            for a in before:
                for b in before:
                    if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                        joined = group[a] | group[b]
                        for x in joined:
                            group[x] = joined
            assert set(after) == {min(g) for g in group.values()}
        elif name == "personal data":
            assert set(after) == set(before)
            for i, t in after.items():
                assert not brute.pii_base(t), i
                if not brute.pii_base(before[i]):
                    assert "[" in t or t == before[i]
        before = after
    rows = docs.collect()
    lengths, used = defaultdict(int), defaultdict(int)
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] += r["length"]
    assert set(lengths) == set(before) and max(used.values()) <= 1024
    assert all(n == 0 or len(packing.cut(n, 1024)) == sum(r["doc_id"] == i for r in rows) for i, n in lengths.items())
