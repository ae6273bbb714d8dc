"""Bounds against trying every choice, batches against the budget."""

from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.llm.packing import length_bin, optimal_bounds, pack


def padded(longest, counts, bounds):
    return sum(c * min(b for b in bounds if b >= x) for x, c in zip(longest, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_bounds_are_optimal(hist, buckets):
    longest, counts = np.array(sorted(hist)), np.array([hist[x] for x in sorted(hist)])
    bounds = optimal_bounds(longest, counts, buckets)
    best = min(padded(longest, counts, (*c, longest[-1])) for k in range(buckets) for c in combinations(longest[:-1], min(k, len(longest) - 1)))
    assert len(bounds) <= buckets and padded(longest, counts, bounds) == best


def test_bins_bound_error(spark):
    rows = spark.range(0, 70_000, 7).selectExpr("id", f"{length_bin('id')} as b").collect()
    assert all(r["id"] <= r["b"] <= r["id"] * (1 + 1 / 64) + 1 and (r["id"] > 256 or r["b"] == r["id"]) for r in rows)


def test_batches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack(docs, buckets=4, token_budget=2000, block_rows=40).collect()
    words = {r["doc_id"]: len(r["text"].encode().split()) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == words and len(rows) == len(words)
    bounds = sorted({r["pad_to"] for r in rows})
    batches = Counter(r["batch_id"] for r in rows)
    for r in rows:
        assert r["pad_to"] == min(b for b in bounds if b >= r["n_tokens"])
        assert r["batch_docs"] == batches[r["batch_id"]] and r["slot"] < r["batch_docs"]
        assert r["batch_docs"] * r["pad_to"] <= 2000 or r["batch_docs"] == 1
    assert len({(r["batch_id"], r["slot"]) for r in rows}) == len(rows)
    for b in bounds:  # at most one part-filled batch per block
        parts = {r["batch_id"].rsplit("-", 1)[0] for r in rows if r["pad_to"] == b and r["batch_docs"] < max(1, 2000 // b)}
        assert len(parts) == len({r["batch_id"] for r in rows if r["pad_to"] == b and r["batch_docs"] < max(1, 2000 // b)})


def test_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "a b", 1), (2, "a b", 1), (3, "x " * 100_000, 1)], "doc_id long, text string, bucket int")
    rows = pack(df).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 2, 2, 100_000]
    assert [r["batch_docs"] for r in rows if r["n_tokens"] == 100_000] == [1]
    assert pack(df.limit(0)).count() == 0 and pack(df.limit(0)).columns == pack(df).columns
