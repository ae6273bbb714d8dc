"""Targets against resharing by hand, the selection against a sort of each source."""

import math

import pytest

from fleetscope.llm.mixing import mix_sources, take_mixed

ROWS = [(i, f"s{i % 3}" if i % 7 else None, "w " * (i % 13)) for i in range(400)] + [(1000 + i, "s0", "word " * 30) for i in range(300)]


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    return [r.asDict() for r in mix_sources(df, bins=8).collect()]


def test_targets_and_sums(mixed):
    assert len(mixed) == len(ROWS)
    sizes = {}
    for _, s, t in ROWS:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    for s, n in sizes.items():
        mine = [r for r in mixed if r["source"] == s]
        assert {r["source_size"] for r in mine} == {n}
        assert all(math.isclose(r["target"], want[s]) for r in mine)
        assert abs(sum(r["size"] * r["copies"] for r in mine) - want[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
    assert all(r["copies"] <= 2 for r in mixed)


def test_epochs_then_best_keys(spark, mixed):
    import pyspark.sql.functions as F

    from fleetscope.llm.mixing import keyed, text_quality

    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    key = {r["doc_id"]: r["_r"] for r in keyed(df, F.lit(1), text_quality(F.col("text")), 8, 17).collect()}
    for s in {r["source"] for r in mixed}:
        mine = sorted((r for r in mixed if r["source"] == s), key=lambda r: -key[r["doc_id"]])
        copies = [r["copies"] for r in mine if r["size"]]
        assert copies == sorted(copies, reverse=True) and copies[0] - copies[-1] <= 1


def test_reruns_agree_and_rows_repeat(spark, mixed):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string").repartition(5)
    again = [r.asDict() for r in mix_sources(df, bins=8).collect()]
    assert sorted(map(str, again)) == sorted(map(str, mixed))
    taken = take_mixed(mix_sources(df, bins=8), df.columns)
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in mixed)


def test_edges(spark):
    schema = "doc_id long, source string, text string, size string, target int"
    df = spark.createDataFrame([(None, None, None, "x", 1), (1, "a", "", "x", 1), (2, "a", "b c", "x", 1), (2, "a", "b c", "x", 1)], schema)
    rows = mix_sources(df).collect()
    assert len(rows) == 4 and sum(r["size"] for r in rows) == 4 and all(r["copies"] <= 2 for r in rows)
    assert mix_sources(df.limit(0)).count() == 0
