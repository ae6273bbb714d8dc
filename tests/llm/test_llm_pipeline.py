"""Stages of the corpus pipeline, each on what the one before it kept."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fleetscope.llm.common import stage

from test_llm_near_dup import brute
from test_llm_secrets import brute as secrets_of


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, step in corpus_pipeline.STAGES:
        docs.append(stage(step(spark, docs[-1], sf), f"test-{name}"))
    return docs


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()} and "pipeline" in entry.queries()


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[1:5])


def test_toxic_documents_go(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in steps[:2])
    gone = before - after
    assert gone and sum(labels.get(i) == 1 for i in gone) >= 0.8 * sum(i in labels for i in gone)
    clean = {i for i in before if labels.get(i) == 0}
    assert len(clean & after) >= 0.98 * len(clean)


def test_one_of_each_group_stays(steps):
    groups = brute([(r["doc_id"], r["text"]) for r in steps[1].collect()])
    assert {r["doc_id"] for r in steps[2].collect()} == {i for i, (_, c) in groups.items() if i == c}


def test_secrets_are_redacted_and_documents_stay(steps):
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in steps[2:4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert (r["text"] == before[i]["text"]) == (not secrets_of(before[i]["text"])) and not secrets_of(r["text"])
        assert r["n_chars"] == len(r["text"]) or r["text"] == before[i]["text"]


def test_mix_and_packing(steps):
    size = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    before, after, packed = steps[3].collect(), steps[4].collect(), steps[5].collect()
    assert abs(size(after) - 1.5 * size(before)) < 0.1 * size(before)
    assert len(packed) == len(after) and sum(r["n_tokens"] for r in packed) == size(after)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id password=hunter2hunter2", "en", "a", 29), (3, "one two three", "en", None, 13), (3, "one two three", "en", None, 13), (4, "ab cd " * 60_000, "en", "b", 360_000)]
EXTRA = ["_id", "_src", "_size", "_r", "_bin", "_salt", "_rules", "_row", "row", "copy", "rules", "block", "fp", "node", "h1", "gram"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_clashing_names(spark, name):
    sf = "/root/testdata/sf0.001"
    step = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    docs = spark.createDataFrame([(*r, *[f"keep {c}" for c in EXTRA]) for r in ODD], schema)
    out = step(spark, docs, sf)
    rows = out.collect()
    assert step(spark, docs.limit(0), sf).count() == 0
    if name == "packing":
        assert len(rows) == len(ODD) and sum(r["n_tokens"] for r in rows) == 3 + 3 + 3 + 120_000
        return
    assert out.columns == docs.columns and all(r[c] == f"keep {c}" for r in rows for c in EXTRA)
    kept = {(r["doc_id"], r["text"] and r["text"][:9]) for r in rows}
    if name == "minhash_dedup":
        assert len(rows) == len(ODD)
    if name == "secret_scan":
        assert len(rows) == len(ODD) and (None, "no id [SE") in kept
