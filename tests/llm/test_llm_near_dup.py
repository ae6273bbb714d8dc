"""Groups of near-duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from fleetscope.llm import near_dup
from fleetscope.llm.common import stage
from fleetscope.llm.near_dup import compare_blocks, connected, minima, near_duplicates, shingle_set

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """doc_id -> (n, component) by comparing all sets that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i in sorted(sets):
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


@pytest.fixture()
def family():
    """A chain of edits, star-shaped copies, and texts that share one long passage but are not alike."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(200)]
    rows, i = [], 0
    for step in range(60):  # each three words further from the first
        chain = base[:]
        for k in range(step):
            chain[(k * 3) % 200] = f"{word()}{k}"
        rows.append((i := i + 1, " ".join(chain)))
    for _ in range(60):
        star = base[:]
        star[rng.randrange(200)] = word()
        star[rng.randrange(200)] = word().upper()
        rows.append((i := i + 1, "\n".join(star)))
    passage = [word() for _ in range(60)]
    for _ in range(60):
        rows.append((i := i + 1, " ".join([word() for _ in range(rng.randrange(5, 60))] + passage)))
    rng.shuffle(rows)
    return rows


def test_chains_and_shared_passages(spark, family):
    check(spark, family)


def test_hot_groups_are_cut(spark, family, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    check(spark, family)


def test_blocks_find_cross_component_pairs(spark, family):
    sets = [(i, shingle_set(t)) for i, t in family]
    rows = [(7, i, i, len(s), near_dup.fine(s), [7, i + 100], i, len(sets)) for i, s in sets]
    members = spark.createDataFrame(rows, "key long, node long, h1 long, n long, fine binary, bands array<long>, comp long, size long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in compare_blocks(members, 75).collect()}
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            both = len(np.intersect1d(s, t))
            if 100 * both >= 75 * (len(s) + len(t) - both):
                assert tuple(sorted((i, j))) in got


def test_minima_estimate_similarity():
    a, b = (shingle_set(" ".join(f"w{i}" for i in range(k, 2000 + k))) for k in (0, 200))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minima(a) == minima(b)).mean() - true) < 0.12


@pytest.mark.parametrize("n", [30, 300, 3000, 30_000])
def test_finer_estimates(n):
    words = lambda s: np.frombuffer(near_dup.fine(s), np.uint64).reshape(1, -1)
    for trial in range(20):
        a, b = (shingle_set(" ".join(f"v{trial}w{i}" for i in range(k, n + k))) for k in (0, n // 7))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(float(near_dup._similar_fine(words(a), words(b))[0, 0]) - true) < near_dup.FINE_MARGIN


def test_short_texts_at_the_threshold(spark):
    """Pairs of exactly 0.75 with 3 to 20 shingles: a text and the same with a third more words; 6 of 7 and 7 shingles."""
    rows = []
    for i in range(4000):
        n = (3, 3, 6, 9, 12, 15)[i % 6]
        words = [f"p{i}w{k}" for k in range(n + n // 3 + 4)]
        rows += [(2 * i, " ".join(words[: n + 4])), (2 * i + 1, " ".join(words))]
    for i in range(4000, 6000):
        words = [f"p{i}w{k}" for k in range(12)]
        rows += [(2 * i, " ".join(words[:11])), (2 * i + 1, " ".join(words[1:]))]
    check(spark, rows)


def test_finer_signatures_keep_every_small_link():
    rng = np.random.default_rng(5)
    words = lambda s: np.frombuffer(near_dup.fine(s), np.uint64).reshape(1, -1)
    for trial in range(3000):
        n = int(rng.integers(3, 64))
        common = -(-3 * n // 4)
        at = np.uint64(trial % 60 + 1)  # the same few slices again and again
        a, b = (np.unique(np.r_[s, x]) for s in [rng.integers(0, 1 << 63, common, np.int64).astype(np.uint64) >> at] for x in (np.zeros(0, np.uint64), rng.integers(0, 1 << 63, n - common, np.int64).astype(np.uint64) >> at))
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 75 * (len(a) + len(b) - both)
        assert near_dup._possible_fine(words(a), np.array([len(a)]), words(b), np.array([len(b)]), 75)[0, 0] or not linked


def test_connected(spark):
    edges = [(1, 2), (3, 2), (9, 3), (20, 21), (22, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    roots = {r["node"]: r["root"] for r in connected(stage(spark.createDataFrame(edges, "a long, b long"), "t")).collect()}
    assert roots == {2: 1, 3: 1, 9: 1, 21: 20, 22: 20} | {101 + i: 100 for i in range(40)}


def test_edges(spark):
    text = "one two three four five six"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Ab c"), (5, "aB  c"), (6, text), (6, text), (7, text.upper()), (None, text), (8, "x " * 50_000), (9, "é\x85 b"), (10, "É\x85 b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert out == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (6, 2, 6, True), (7, 2, 6, False), (None, 2, None, True), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 10, True)],
        key=str,
    )
    assert near_duplicates(df.limit(0)).count() == 0


def test_connected_with_heavy_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HEAVY", 20)
    edges = [(k, 5_000) for k in range(300)] + [(k, 6_000) for k in range(400, 700)] + [(5_000, 9_000), (8_000, 8_001)] + [(k, k + 1) for k in range(10_000, 10_030)]
    roots = {r["node"]: r["root"] for r in connected(stage(spark.createDataFrame(edges, "a long, b long"), "t")).collect()}
    want = {**{k: 0 for k in [*range(1, 300), 5_000, 9_000]}, **{k: 400 for k in [*range(401, 700), 6_000]}, 8_001: 8_000, **{k: 10_000 for k in range(10_001, 10_031)}}
    assert roots == want
