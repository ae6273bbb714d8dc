"""Spelling variants against a comparison of all pairs, hot chunks, chains of forms, odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from fleetscope.llm import spelling
from fleetscope.llm.queries import op12_spelling_variants


def deletions(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def brute(counts, ratio=2):
    """word -> (form, root, n, n_near, form_n)."""
    by_gap, near = {}, {w: set() for w in counts}
    for w in counts:  # one replaced code point: equal but for one place
        for i in range(len(w)):
            by_gap.setdefault((w[:i], w[i + 1 :]), []).append(w)
        for v in deletions(w) & counts.keys():
            near[w].add(v)
            near[v].add(w)
    for group in by_gap.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def rows_of(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("group", [500, 6])
def test_random_words_and_hot_chunks(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(2, 8))) for _ in range(500)} | {"x" * k for k in range(2, 30)}
    words |= {"prefix" + rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(40)}
    counts = {w: rng.choice([3, 6, 13, 30, 90]) for w in words}
    df = spark.createDataFrame([(w, n, "z", 1) for w, n in counts.items()], "word string, n long, form string, l int")
    assert rows_of(spelling.spelling_variants(df)) == brute(counts)


def test_query_against_python(spark, sf):
    counts = Counter()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", d["text"] or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d['doc_id']}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    want = brute({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})
    got = rows_of(op12_spelling_variants(spark, sf))
    assert got == want and any(v[0] for v in got.values())


def test_chain_of_forms(spark):
    words = ["a" * k + "b" * (12 - k) for k in range(13)]
    df = spark.createDataFrame([(w, 2**k) for k, w in enumerate(words)], "word string, n long")
    got = rows_of(spelling.spelling_variants(df))
    assert [got[w][0] for w in words] == [*words[1:], None] and {v[1] for v in got.values()} == {"a" * 12}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "Größe größe GRÖSSE 12 ÀÖ a-b", "x"), (3, "word " * 100_000, "x")], "doc_id long, text string, word string")
    words = spelling.words_of(docs)
    assert Counter(r["word"] for r in words.where("doc_id is null").collect()) == Counter(["größe", "größe", "grÖsse", "ÀÖ", "a", "b"])
    assert spelling.words_of(docs).where("doc_id in (1, 2)").count() == 0
    assert [(r["word"], r["n"]) for r in spelling.count_words(words, 4).collect()] == [("word", 100_000)]
    odd = spark.createDataFrame([("house", 4), ("house", 6), ("mouse", None), (None, 9), ("houses", 40)], "word string, n int")
    assert rows_of(spelling.spelling_variants(odd)) == {"house": ("houses", "houses", 10, 2, 40), "mouse": ("house", "houses", 0, 1, 10), "houses": (None, "houses", 40, 1, None)}
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
