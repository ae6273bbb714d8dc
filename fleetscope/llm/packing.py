"""Packing into length buckets whose bounds minimise padding, and token-budget batches inside each bucket.

The global histogram of lengths has a bounded number of bins (exact up to 256, then 64 to each doubling). A dynamic
programme over it chooses at most ``buckets`` bounds so that padding every document to the bound of its bucket costs
least. Inside a bucket, a batch holds as many documents as the token budget allows at the padded length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stage, word_count

EXACT = 256


def length_bin(n: str) -> str:
    """SQL for the bin of a length: itself up to 256, above it the value rounded up to 7 significant bits."""
    return f"if({n} <= {EXACT}, {n}, cast(ceil({n} / pow(2D, floor(log2({n} - 1)) - 6)) * pow(2D, floor(log2({n} - 1)) - 6) as long))"


def optimal_bounds(longest: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bounds (ascending, the last is the longest) that minimise the padded total. Inputs are ordered by length."""
    n = len(longest)
    if n == 0:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = upto[1:] * longest  # one bucket over bins 0..j
    cuts: list[np.ndarray] = []
    for _ in range(min(buckets, n) - 1):
        nxt, cut = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + (upto[j + 1] - upto[1 : j + 1]) * longest[j]
            i = int(cost.argmin())
            if cost[i] < nxt[j]:
                nxt[j], cut[j] = cost[i], i
        cuts.append(cut)
        best = nxt
    bounds, j = [], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            bounds.append(int(longest[j]))
            j = int(cut[j])
    bounds.append(int(longest[j]))
    return bounds[::-1]


def pack(
    docs: DataFrame, tokens: Column | None = None, buckets: int = 16, token_budget: int = 32768, block_rows: int = 100_000
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, bucket, pad_to, batch_id, slot, and the size of the batch.

    A null text counts 0 tokens, as an empty one does. A document longer than the budget is a batch of its own, whole.
    Ties in length share a bucket; repeated rows get a slot each. A bucket with many rows is cut into blocks of about
    ``block_rows`` by a hash of the id, so no task orders a whole bucket; each block ends with at most one part-filled
    batch. An empty table gives an empty result. The histogram is the only thing collected (at most 3,800 rows).
    """
    spark = docs.sparkSession
    slim = stage(docs.select("doc_id", (tokens if tokens is not None else word_count(F.col("text"))).cast("long").alias("n_tokens")).fillna({"n_tokens": 0}), "pack-lengths")
    hist = sorted(
        slim.selectExpr("n_tokens", f"{length_bin('n_tokens')} as _bin").groupBy("_bin").agg(F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("longest")).collect(),
        key=lambda r: r["longest"],
    )
    if not hist:
        schema = "doc_id long, n_tokens long, bucket int, pad_to long, batch_id string, slot int, batch_docs int"
        return spark.createDataFrame([], schema)
    counts, longest = np.array([r["n"] for r in hist]), np.array([r["longest"] for r in hist])
    bounds = optimal_bounds(longest, counts, buckets)
    rows = [int(counts[(longest <= b) & (longest > a)].sum()) for a, b in zip([-1, *bounds], bounds)]
    caps = [max(1, token_budget // max(b, 1)) for b in bounds]
    lit = lambda xs, kind: "array(" + ",".join(f"cast({x} as {kind})" for x in xs) + ")"
    placed = slim.selectExpr("*", f"size(filter({lit(bounds, 'long')}, b -> b < n_tokens)) as bucket").selectExpr(
        "*",
        f"{lit(bounds, 'long')}[bucket] as pad_to",
        f"{lit(caps, 'int')}[bucket] as _cap",
        f"cast(pmod(xxhash64(doc_id), {lit([-(-n // block_rows) for n in rows], 'long')}[bucket]) as int) as _block",
    )
    ranked = placed.selectExpr("*", "row_number() over (partition by bucket, _block order by xxhash64(doc_id, 1), doc_id, n_tokens) - 1 as _rank")
    return ranked.selectExpr(
        "doc_id", "n_tokens", "bucket", "pad_to",
        "concat_ws('-', bucket, _block, cast(floor(_rank / _cap) as long)) as batch_id",
        "cast(_rank % _cap as int) as slot",
        "cast(least(_cap, count(1) over (partition by bucket, _block) - floor(_rank / _cap) * _cap) as int) as batch_docs",
    )
