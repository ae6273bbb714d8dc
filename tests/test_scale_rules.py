"""Plans and settings that decide whether a job survives at scale."""

import re

import pytest

from fleetscope import session
from fleetscope.functions.small import small_side
from fleetscope.operators import crash_text as C
from fleetscope.operators import rules as R
from fleetscope.plans import inputs as I
from fleetscope.plans import QUERIES, q_rules
from fleetscope.plans.q_telemetry import features_with_baseline
from fleetscope.streaming import jobs as J
from fleetscope.operators.fleet import registry_diff


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_shuffle_by_no_metric_and_no_flag(spark, sf):
    hits = R.rule_eval(features_with_baseline(spark, sf), R.default_rules(spark))
    assert not re.search(r"hashpartitioning\(metric", plan(hits))
    flags = q_rules._flags_long(spark, sf)
    rules = q_rules._flag_rules(spark)
    for f in (R.max_severity, R.needs_escalation):
        assert not re.search(r"hashpartitioning\(flag#\d+,", plan(f(flags, rules, ["client_id", "t"])))


def test_device_classes_are_sent_round(spark):
    devices = spark.range(1000).selectExpr("cast(id as string) slot", "'0200' class_code", "'v' vendor", "'d' device", "'ice' driver")
    classes = spark.createDataFrame([("network", "02", None, None)], "category string, class2 string, vendor string, device string")
    assert "BuildRight" in plan(C.device_binding(devices, classes))


def test_small_side_has_a_bound(spark):
    assert "ResolvedHint" in small_side(spark.range(10), 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small_side(spark.range(11), 10)._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(("master", "fine"), [("local", True), ("local[8]", True), ("local-cluster[3,2,1000]", False), ("yarn", False), ("spark://h:7077", False)])
def test_no_local_folder_on_a_cluster(master, fine):
    session._local_root.cache_clear()
    if fine:
        assert session._local_root(master)
    else:
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            session._local_root(master)
    session._local_root.cache_clear()


@pytest.mark.parametrize("files", [1, 3, 7])
def test_registry_sync_over_batches(spark, sf, tmp_path, files):
    inst = I.view(spark, sf, "fx_instances")
    now = inst.where("status = 'running'")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    inst.selectExpr("1L as sync", "client_id", "pid").unionByName(now.selectExpr("2L as sync", "client_id", "pid")).repartition(files).write.parquet(src)
    J.registry_sync(J.file_stream(spark, src, "sync long, client_id string, pid long", files_per_batch=1), out).awaitTermination()
    known = inst.where("registered")
    key = lambda df: sorted(map(tuple, df.select("client_id", "pid", "action").collect()))
    assert key(J.read_registry_actions(spark, out, known)) == key(registry_diff(now, known))
    assert key(J.read_registry_actions(spark, out, known, sync=1)) == key(registry_diff(inst, known))


@pytest.mark.parametrize("name", ["frame_parse", "stack_annotate", "crash_snapshot", "crash_type", "crash_frame", "parse_warnings"])
def test_text_is_parsed_once(spark, sf, name):
    text = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < len(re.findall(r"\b(?:split|regexp_replace|regexp_extract|regexp_extract_all|RLIKE)\(", text)) < 60
