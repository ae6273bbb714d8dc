"""Compaction of logs of epochs: same rows before, during and after, read cost, lost attempts."""

import glob

import pytest

from fleetscope.streaming import jobs as J
from fleetscope.streaming import log as L

SCHEMA = "client_id string, pid long, type string, t long, seq long, v long"


@pytest.fixture
def log(spark, tmp_path):
    out = str(tmp_path / "log")

    def write(epoch, *rows):
        J._write_epoch(spark.createDataFrame([("c", 1, "1s", t, seq, v) for t, seq, v in rows], SCHEMA).coalesce(1), out, epoch)

    for e in range(6):
        write(e, (e, 10 * e, e), (0, 10 * e + 1, 100 + e))
    return out, write


def rows(df):
    return sorted(tuple(r) for r in df.select("t", "seq", "v").collect())


def test_latest_over_generations(spark, log):
    out, write = log
    want = rows(J.latest(spark, out))
    before = J.latest(spark, out)  # a reader that began before the compaction
    assert J.compact_latest(spark, out) and not J.compact_latest(spark, out)
    assert rows(before) == want
    assert len(L.paths(spark, out)) == 2 and rows(J.latest(spark, out)) == want
    write(5, (5, 50, 5), (0, 51, 105))  # the newest epoch is written again
    assert rows(J.latest(spark, out)) == want
    write(6, (0, 61, 106))
    write(7, (7, 70, 7))
    before = J.latest(spark, out)
    newer = rows(before)
    assert J.compact_latest(spark, out) and len(L.paths(spark, out)) == 2
    L.clean_up(spark, out)
    assert rows(before) == newer  # the generation it reads is still kept
    assert rows(J.latest(spark, out)) == [(0, 61, 106), *[(e, 10 * e, e) for e in range(1, 6)], (7, 70, 7)]
    assert len(glob.glob(f"{out}/data/epoch=*")) == 3 and len(glob.glob(f"{out}/merged/*")) == 2


def test_read_cost_does_not_grow_with_epochs(spark, log):
    out, write = log
    for e in range(6, 14):
        write(e, (e, 10 * e, e))
    J.compact_latest(spark, out)
    assert len(L.read_log(spark, out).inputFiles()) <= 3 and L.read_log(spark, out).count() == 13 + 1


def test_a_lost_attempt_changes_nothing(spark, log):
    out, write = log
    want = rows(J.latest(spark, out))
    spark.createDataFrame([("c", 1, "1s", 0, 999, 999)], SCHEMA).write.parquet(f"{out}/merged/generation=0")  # no manifest was written
    assert rows(J.latest(spark, out)) == want
    assert J.compact_latest(spark, out) and rows(J.latest(spark, out)) == want


def test_ring_over_generations(spark, tmp_path):
    out = str(tmp_path / "ring")
    for e in range(5):
        J._write_epoch(spark.range(4).selectExpr("'c' as client_id", "1L as pid", f"id + {4 * e} as t", "'x' as category", "'n' as name", "cast(id as double) as value"), out, e)
    want = sorted(r["t"] for r in J.read_ring(spark, out, 6).collect())
    assert J.compact_ring(spark, out, 6) and sorted(r["t"] for r in J.read_ring(spark, out, 6).collect()) == want == list(range(14, 20))
