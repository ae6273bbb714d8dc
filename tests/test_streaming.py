"""Streams over several files and batches equal their batch twins."""


import glob
import os

import pytest

from fleetscope.operators import rules as R
from fleetscope.operators import telemetry as T
from fleetscope.plans import inputs as I
from fleetscope.sources import records as S
from fleetscope.streaming import jobs as J


def drop(df, path, files, order):
    """Write ``df`` as that many files that arrive in the given order (the source goes by modification time)."""
    df.repartitionByRange(files, order).write.parquet(path)
    for i, f in enumerate(sorted(glob.glob(path + "/part-*.parquet"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ingest_over_batches(spark, sf, tmp_path):
    raw = I.raw_records(spark, sf)
    src = drop(raw, str(tmp_path / "in"), 6, "v")  # sorted by value: writes of one second land in different batches
    J.ingest_latest(J.file_stream(spark, src, raw.schema, files_per_batch=1), str(tmp_path / "out")).awaitTermination()
    cols = ["client_id", "pid", "type", "t", "seq", "v"]
    assert rows(J.latest(spark, str(tmp_path / "out")).select(cols)) == rows(S.flush_latest_wins(raw).select(cols))


@pytest.mark.parametrize("files", [1, 5])
def test_cooldown_over_batches(spark, sf, tmp_path, files):
    hits = I.view(spark, sf, "fx_hits").select("client_id", "rule_id", "t", "event_id", "cooldown")
    src = drop(hits, str(tmp_path / "in"), files, "t")
    J.cooldown(J.file_stream(spark, src, hits.schema, files_per_batch=1), str(tmp_path / "out")).awaitTermination()
    cols = ["client_id", "rule_id", "t", "event_id"]
    got = rows(J.read_output(spark, str(tmp_path / "out")).select(cols))
    assert got == rows(R.rule_cooldown(hits).select(cols))


def test_counter_delta_over_batches(spark, sf, tmp_path):
    ticks = I.flat_1s(spark, sf).selectExpr("client_id", "pid", "t", "p0_ip as rx", "p0_op as tx", "p0_ie as errors")
    src = drop(ticks, str(tmp_path / "in"), 4, "t")
    J.counter_delta(J.file_stream(spark, src, ticks.schema, files_per_batch=1), str(tmp_path / "out")).awaitTermination()
    got = J.read_output(spark, str(tmp_path / "out"))
    want = T.previous_row(ticks, ["client_id", "pid"], "t", ["rx", "tx", "errors"]).where("prev is not null")
    assert rows(got.select("client_id", "pid", "t", "rx", "tx", "errors")) == rows(
        want.selectExpr("client_id", "pid", "t", "rx - prev.rx", "tx - prev.tx", "errors - prev.errors"))


def test_ring_over_batches(spark, sf, tmp_path):
    s = I.flat_1s(spark, sf).selectExpr("client_id", "pid", "t", "'c' as category", "'n' as name", "cast(p0_ip as double) as value")
    src = drop(s, str(tmp_path / "in"), 4, "t")
    J.ring_buffer(J.file_stream(spark, src, s.schema, files_per_batch=1), str(tmp_path / "out"), 25).awaitTermination()
    cols = s.columns
    assert rows(J.read_ring(spark, str(tmp_path / "out"), 25).select(cols)) == rows(T.ring_buffer_last_n(s, 25).select(cols))


def test_windows_over_batches(spark, sf, tmp_path):
    flat = I.flat_1s(spark, sf)
    src = drop(flat, str(tmp_path / "in"), 5, "t")
    stream = I.nest_1s(J.file_stream(spark, src, flat.schema, files_per_batch=1))
    J.fast_features(stream, str(tmp_path / "out"), "10 seconds", "20 seconds").awaitTermination()
    got = {(r.client_id, r.pid, r.win, r.port): r.rx_packets for r in J.read_output(spark, str(tmp_path / "out")).collect()}
    want = {(r.client_id, r.pid, r.win, r.port): r.rx_packets for r in T.port_stats(I.records_1s(spark, sf)).collect()}
    newest = max(k[2] for k in want)
    assert got and all(want[k] == v for k, v in got.items())
    assert {k for k in want if k[2] <= newest - 40} <= set(got)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    df = spark.range(5)
    J._write_epoch(df, str(tmp_path), 3)
    J._write_epoch(df, str(tmp_path), 3)
    assert J.read_output(spark, str(tmp_path)).count() == 5
