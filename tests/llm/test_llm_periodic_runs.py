"""Runs against a brute-force search by period, the registered query against Python, long and odd texts."""

import hashlib
import random
import zlib

from fleetscope.llm.periodic_runs import periodic_runs, search
from fleetscope.llm.queries import op11_periodic_runs


def brute(words, least=12):
    """(start, length, period) of all runs, by looking at every period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def without_repeats(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_random_texts_of_few_words():
    rng, texts = random.Random(11), []
    for _ in range(1500):
        k, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 60)
        base = [b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 9))]
        words = [b"%d" % rng.randrange(k) for _ in range(n)] if rng.random() < 0.5 else (base * 20)[:n]
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = b"x"
        texts.append(words)
    for least in (2, 12):
        for words, (runs, rest) in zip(texts, search(texts, least), strict=True):
            want = brute(words, least)
            assert [tuple(r) for r in runs.tolist()] == want
            assert rest == b" ".join(without_repeats(words, want))


def test_hand_made():
    (runs, rest), (none, same) = search([b"x a b c a b c a b c a b c a y".split(), b"a a a a a a a a a a a".split()], 12)
    assert runs.tolist() == [[1, 13, 3]] and rest == b"x a b c y"
    assert not len(none) and same == b"a a a a a a a a a a a"
    nested = (b"p p p p p p p p p p p p q " * 3).split()
    assert [tuple(r) for r in search([nested], 12)[0][0].tolist()] == brute(nested)


def test_very_long_texts():
    for words, want in (([b"a"] * 150_000, [[0, 150_000, 1]]), ([b"%d" % (i % 701) for i in range(150_000)], [[0, 150_000, 701]])):
        runs, rest = search([words], 12)[0]
        assert runs.tolist() == want and len(rest.split()) == want[0][2]


def test_query_against_python(spark, sf):
    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = (d["text"] or "").encode().split()
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs, r = brute(words) if n < 3000 else [tuple(x) for x in search([words], 12)[0][0].tolist()], got[d["doc_id"]]
        assert r["n_runs"] == len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda x: (x[0], x[2])))
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(without_repeats(words, runs))).hexdigest()
    assert planted > 5 and any(r["n_runs"] for r in got.values())


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "é " * 13), (3, "b " * 12), (3, "b " * 12), (4, "one two")]
    df = spark.createDataFrame([(*r, 7, "old") for r in rows], "doc_id long, text string, runs int, h string")
    out = periodic_runs(df)
    assert out.columns == ["doc_id", "text", "h", "runs", "collapsed"]
    found = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()]
    assert sorted(found, key=str) == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 13, 1)], "é"), (3, [(0, 12, 1)], "b"), (3, [(0, 12, 1)], "b"), (4, [], "one two")], key=str)
    assert periodic_runs(df.limit(0)).count() == 0
