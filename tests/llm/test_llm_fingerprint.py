"""Multiset algebra of fingerprints and the edit report against Python."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from fleetscope.llm.fingerprint import PIECE, as_hex, block_of, combine, edit_report, fingerprints, id_bounds, lanes, likeness, with_next


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in edit_report(docs).collect()}
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    prints = {}
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    long = [r for r in rows.values() if r["n_chars"] > 300]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.98 * len(long)


def test_algebra(spark):
    a, b, ab, ba = "alpha beta. gamma", "delta end. x", "alpha beta. gamma\ndelta end. x", "delta end. x\nalpha beta. gamma"
    df = spark.createDataFrame([(a, b, ab, ba)], "a string, b string, ab string, ba string")
    fp = df.select(*[F.expr(lanes(c)).alias(c) for c in df.columns])
    r = fp.selectExpr(
        "ab = ba as unordered", f"{combine('a', 'b')} = ab as inserted", f"{combine('ab', 'b', -1)} = a as deleted",
        "a = b as same", f"{likeness('a', 'a')} as one", f"length({as_hex('ab')}) as width",
    ).first()
    assert (r["unordered"], r["inserted"], r["deleted"], r["same"], r["one"], r["width"]) == (True, True, True, False, 1.0, 1088)


def test_algebra_of_indented_lines(spark):
    a, b = "def run(x):\n    return x. \n\tend", "  - first point.\n \n   it goes on"
    df = spark.createDataFrame([(a, b, f"{a}\n{b}", f"{b}\n{a}", "foo.\n bar", " bar\nfoo.")], "a string, b string, ab string, ba string, c string, d string")
    fp = df.select(*[F.expr(lanes(c)).alias(c) for c in df.columns])
    r = fp.selectExpr("ab = ba as unordered", f"{combine('a', 'b')} = ab as inserted", f"{combine('ab', 'b', -1)} = a as deleted", "c = d as turned").first()
    assert all(r)


def test_wraps(spark):
    r = spark.createDataFrame([("Word\n" * 70_000,)], "t string").select(F.expr(lanes("t")).alias("f")).first()["f"]
    assert all(0 <= v < 1 << 32 for v in r[:8]) and all(-(1 << 31) <= v < 1 << 31 for v in r[8:])


def test_likeness_of_very_many_equal_pieces(spark):
    rows = [("w. " * 32_768, "qq. " * 32_768), ("w. " * 70_000, "w. " * 70_000 + "zz"), ("a line\n" * 70_000, "other text\n" * 70_000), ("a line\n" * 70_000, "a line\n" * 69_000)]
    fp = spark.createDataFrame(rows, "a string, b string").select(F.expr(lanes("a")).alias("a"), F.expr(lanes("b")).alias("b"))
    near = [r[0] for r in fp.select(F.expr(likeness("a", "b"))).collect()]
    assert near[0] < 0.4 and near[1] > 0.99 and near[2] < 0.4 and 0.99 < near[3] <= 1


def brute_lanes(pieces):
    """The likeness lanes of a list of pieces, from Spark's hash of each."""
    return np.sum([[1 if (h >> j) & 1 else -1 for h in hs for j in range(64)] for hs in pieces], axis=0)


def test_likeness_against_brute_force(spark):
    a, b = "one two. three and four, five\nsix seven", "one two. three and four, five\neight nine. six seven"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(F.expr(lanes("a")).alias("a"), F.expr(lanes("b")).alias("b")).select(F.expr(likeness("a", "b"))).first()[0]
    sums = []
    for t in (a, b):
        pieces = [p for p in re.split(PIECE, t) if p]
        hs = spark.createDataFrame([(p,) for p in pieces], "p string").select(F.xxhash64(F.lit(100), "p"), F.xxhash64(F.lit(101), "p")).collect()
        sums.append(brute_lanes([[h & ((1 << 64) - 1) for h in r] for r in hs]))
    want = sums[0] @ sums[1] / np.sqrt(float(sums[0] @ sums[0]) * float(sums[1] @ sums[1]))
    assert abs(got - max(0.0, want)) < 1e-9


def test_blocks_follow_the_ids(spark):
    ids = [*range(4000), 10**15, (1 << 63) - 1, -(1 << 63), None]
    df = fingerprints(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string"))
    bounds = id_bounds(df, 100, 1000)
    sizes = [r["count"] for r in df.selectExpr(f"{block_of(bounds)} as b").groupBy("b").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 300
    order = sorted((i for i in ids if i is not None)) + [None]
    got = {r["doc_id"]: r["next_text"] for r in with_next(df, per_block=100).collect()}
    assert got == {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_edges(spark):
    rows = [(5, "abcdefgh"), (None, "zz yy"), (-3, None), (9, ""), (9, "same id"), (10**15, "far away"), (5, "abcdefgh")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    out = edit_report(df).collect()
    assert len(out) == 7
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        want.append((i, hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in out), key=str) == sorted(want, key=str)
    assert edit_report(df.limit(0)).count() == 0
    one = edit_report(df.where("doc_id = -3")).first()
    assert (one["n_chars"], one["near_next"], one["near_edited"]) == (0, 1.0, 1.0)
    assert fingerprints(df).columns == [*df.columns, "fp"]
