"""Rollups against a recount, replays, lost commits, compaction."""

import re

import pytest

from fleetscope.llm.queries import FINE, op10_token_counts
from fleetscope.llm.token_counts import commit_batch, compact, totals

SCHEMA = "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long, n_tokens int"


def changes(spark, *rows):
    return spark.createDataFrame([(*r, 9) for r in rows], SCHEMA)


def state_of(spark, path):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in totals(spark, path).collect()}


def test_life_of_a_rollup(spark, tmp_path):
    s = f"file://{tmp_path}/a"
    assert state_of(spark, s) == {}
    first = changes(spark, ("insert", "x", "en", "t", None, 5), ("insert", "x", "en", "t", None, 7), ("insert", None, None, "t", None, None))
    assert commit_batch(spark, s, "1", first) and not commit_batch(spark, s, "1", first)
    assert state_of(spark, s) == {("x", "en", "t"): (2, 12), (None, None, "t"): (1, 0)}
    assert commit_batch(spark, s, "2", changes(spark, ("revise", "x", "en", "t", 7, 9), ("delete", "x", "en", "t", 5, None), ("delete", None, None, "t", None, 3)))
    assert state_of(spark, s) == {("x", "en", "t"): (1, 9)}
    assert commit_batch(spark, s, "3", changes(spark).limit(0)) and not commit_batch(spark, s, "2", first)
    compact(spark, s, f"{s}-folded")
    assert state_of(spark, f"{s}-folded") == {("x", "en", "t"): (1, 9)}
    assert not commit_batch(spark, f"{s}-folded", "2", first) and commit_batch(spark, f"{s}-folded", "4", first)
    assert state_of(spark, f"{s}-folded")[("x", "en", "t")] == (3, 21)


def test_deltas_without_commit_do_not_count(spark, tmp_path):
    s = f"file://{tmp_path}/b"
    one = changes(spark, ("insert", "x", "en", "t", None, 5))
    commit_batch(spark, s, "1", one)
    spark.createDataFrame([("x", "en", "t", 1, 99, "lost")], "source string, lang string, tokenizer string, d_docs long, d_tokens long, attempt string").write.mode("append").parquet(f"{s}/deltas")
    spark.createDataFrame([("1", "zzz")], "batch_id string, attempt string").write.mode("append").parquet(f"{s}/commits")
    assert state_of(spark, s) == {("x", "en", "t"): (1, 5)}


def test_unknown_op_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="unknown op"):
        commit_batch(spark, f"file://{tmp_path}/c", "1", changes(spark, ("upsert", "x", "en", "t", None, 5)))
    assert state_of(spark, f"file://{tmp_path}/c") == {}


def test_query_counts_every_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("source", "lang", "text")
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in op10_token_counts(spark, sf).collect()}
    want = {}
    for r in docs.collect():
        t = (r["text"] or "")
        for name, n in (("words-1", sum(bool(set(w) - set("#*$%&|<>")) for w in re.split(r"[\x20\x09-\x0D]+", t) if w)), ("fine-1", len(re.findall(FINE, t)))):
            d, k = want.get((r["source"], r["lang"], name), (0, 0))
            want[(r["source"], r["lang"], name)] = (d + 1, k + n)
    assert got == want and sum(d for d, _ in got.values()) == 2 * docs.count()
