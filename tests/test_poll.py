"""The polling loop in one query, against its batch twin, over several batches, with late rows and hot keys."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import features as FE
from fleetscope.operators import rules as R
from fleetscope.plans import inputs as I
from fleetscope.streaming import jobs as J
from fleetscope.streaming import poll as P


def drop(df, path, files, order):
    """Write ``df`` as that many files that arrive in the given order (the source goes by modification time)."""
    df.repartitionByRange(files, order).write.parquet(path)
    for i, f in enumerate(sorted(glob.glob(path + "/part-*.parquet"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def state_rows(q):
    return sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])


@pytest.fixture(scope="module")
def records(spark, sf, tmp_path_factory):
    """Both cadences in four files each, by time, and the time of the last record."""
    base = str(tmp_path_factory.mktemp("records"))
    one, five = I.flat_1s(spark, sf), I.flat_5s(spark, sf)
    drop(one, f"{base}/one", 4, "t")
    drop(five, f"{base}/five", 4, "t")
    return base, one, five, one.agg(F.max("t")).first()[0]


def streams(spark, records):
    base, one, five, _ = records
    nested = (I.nest_1s(J.file_stream(spark, f"{base}/one", one.schema, files_per_batch=1)), I.nest_5s(J.file_stream(spark, f"{base}/five", five.schema, files_per_batch=1)))
    return nested


def test_poll_equals_its_batch_twin(spark, sf, records, tmp_path):
    rules, out = R.default_rules(spark), str(tmp_path / "out")
    start = lambda clock: J.to_folder(P.poll(*streams(spark, records), rules, clock), out)
    q = P.run_and_close(spark, start, str(tmp_path / "clock"), records[3] + 10_000)
    feats = FE.log_features(I.records_1s(spark, sf), I.records_5s(spark, sf))
    hits = R.rule_eval(feats, rules)
    fires = R.rule_cooldown(hits.selectExpr("client_id", "rule_id", "win as t", "rule_no as event_id", "cooldown_sec as cooldown"))
    got = J.read_output(spark, out)
    assert got.count() > 20 and got.select("epoch").distinct().count() >= 3
    assert rows(got.selectExpr("client_id", "rule_id", "win")) == rows(fires.selectExpr("client_id", "rule_id", "t"))
    # Every fire is a hit of the batch twin, with its values.
    keys = ["client_id", "pid", "win", "rule_id"]
    both = got.select(*keys, "severity", "metric", F.round("value", 6).alias("value")).exceptAll(hits.select(*keys, "severity", "metric", F.round("value", 6).alias("value")))
    assert both.count() == 0
    assert state_rows(q) == 0


def test_features_equal_the_batch_ones(spark, sf, records, tmp_path):
    out = str(tmp_path / "out")
    cols = [c for c in FE.FEATURE_COLUMNS if c not in ("risk_breakdown",)]
    start = lambda clock: J.to_folder(P.poll_features(*streams(spark, records), clock).select(*cols), out)
    P.run_and_close(spark, start, str(tmp_path / "clock"), records[3] + 10_000)
    want = FE.log_features(I.records_1s(spark, sf), I.records_5s(spark, sf)).select(*cols)
    assert rows(J.read_output(spark, out).select(*cols)) == rows(want)


@pytest.mark.parametrize("kind", ["rule", "severity"])
def test_cooldown_puts_late_hits_in_order(spark, sf, tmp_path, kind):
    """Files overlap in time: hits come up to 50 seconds late, within the delay."""
    hits = I.view(spark, sf, "fx_hits").select("client_id", "rule_id", "severity", "t", "event_id", "cooldown")
    src, out = drop(hits.withColumn("at", F.col("t") + F.col("event_id") * 37 % 50), str(tmp_path / "in"), 5, "at"), str(tmp_path / "out")
    job = {"rule": P.rule_cooldown, "severity": P.severity_cooldown}[kind]
    stream = lambda: J.file_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
    last = hits.agg(F.max("t")).first()[0]
    q = P.run_and_close(spark, lambda clock: J.to_folder(job(stream(), clock, "60 seconds"), out), str(tmp_path / "clock"), last + 10_000)
    want = {"rule": R.rule_cooldown, "severity": R.severity_cooldown}[kind](hits)
    cols = ["client_id", {"rule": "rule_id", "severity": "severity"}[kind], "t", "event_id"]
    assert rows(J.read_output(spark, out).select(cols)) == rows(want.select(cols))
    assert state_rows(q) == 0


def test_hits_behind_the_watermark_are_left_out(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, t in enumerate([[100, 105], [400], [101, 390]]):
        spark.createDataFrame([("c", "r", x, 10 * i + k, 20) for k, x in enumerate(t)], "client_id string, rule_id string, t long, event_id long, cooldown long").coalesce(1).write.mode("append").parquet(src)
        new = max(glob.glob(src + "/part-*.parquet"), key=os.path.getmtime)
        os.utime(new, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = lambda: J.file_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
    P.run_and_close(spark, lambda clock: J.to_folder(P.rule_cooldown(stream(), clock, "60 seconds"), out), str(tmp_path / "clock"), 9999)
    assert sorted(r["t"] for r in J.read_output(spark, out).collect()) == [100, 390]


def test_one_key_with_very_many_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(1_000_000).selectExpr("'c' as client_id", "'r' as rule_id", "id div 4 as t", "id as event_id", "7L as cooldown").write.parquet(src)
    stream = lambda: J.file_stream(spark, src, spark.read.parquet(src).schema)
    P.run_and_close(spark, lambda clock: J.to_folder(P.rule_cooldown(stream(), clock, "10 seconds"), out), str(tmp_path / "clock"), 10_000_000)
    got = sorted((r["t"], r["event_id"]) for r in J.read_output(spark, out).collect())
    assert got == [(t, 4 * t) for t in range(0, 250_000, 7)]
