"""Layers and patterns from tables: the shipped ones give what the built-in labels give, others change them."""

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import crash_graph as G
from fleetscope.operators import crash_rules as X
from fleetscope.plans import inputs as I
from fleetscope.plans import q_crash_graph as Q


def test_shipped_layers(spark):
    names = ["??", "", "__libc_start_main", "__libc_foo", "clone3x", "mlx5_rx", "rte_eal_init", "rte_panic", "rte_panics", "mp_handle", "rte_ring_x", "main", "rte", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, func string")
    got = {r.i: r.layer for r in X.with_layers(df, X.default_layers(spark)).collect()}
    assert got == {r.i: r.layer for r in df.select("i", G.frame_layer("func").alias("layer")).collect()}


def test_a_table_changes_the_labels(spark):
    rules = spark.createDataFrame([(2, "prefix", "app_", "app"), (1, "prefix", "app_net_", "network"), (0, "exact", "app_net_poll", "idle"), (3, "prefix", None, "x"), (4, "other", "main", "x")], X.LAYER_RULES)
    df = spark.createDataFrame([(n, "keep") for n in ("app_net_poll", "app_net_tx", "app_main", "main", None)], "func string, layer string")
    assert {r.func: r.layer for r in X.with_layers(df, rules, other="rest").collect()} == {"app_net_poll": "idle", "app_net_tx": "network", "app_main": "app", "main": "rest", None: "rest"}
    assert X.with_layers(df.limit(0), rules).count() == 0 and {r.layer for r in X.with_layers(df, rules.limit(0)).collect()} == {"user_app"}


def test_ten_thousand_rules(spark):
    rules = spark.range(10_000).selectExpr("cast(id as int) as rule_no", "if(id % 3 = 0, 'exact', 'prefix') as match", "concat('f', id, '_') as text", "concat('layer', id) as layer")
    df = spark.range(20_000).selectExpr("id", "concat('f', id % 10000, '_', if(id % 3 = 0, '', 'x')) as func")
    out = X.with_layers(df, rules)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = out.selectExpr("layer = concat('layer', id % 10000) as own", "layer = 'user_app' as none").groupBy("own", "none").count().collect()
    wrong = [r for r in out.where("layer <> concat('layer', id % 10000)").limit(20).collect() if r.layer != "user_app"]
    assert sum(r["count"] for r in got) == 20_000 and sum(r["count"] for r in got if r["own"]) > 10_000 and not wrong


def test_shipped_patterns(spark, sf):
    c, meta = Q.canon(spark, sf), Q.dump_meta(spark, sf)
    got = X.crash_patterns(c, meta, X.default_layers(spark), X.default_patterns(spark))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, G.crash_pattern(c, meta).collect()), key=str)


@pytest.fixture
def dump(spark):
    frames = spark.createDataFrame([(1, 0, 0, "worker", "0x1"), (1, 0, 1, "loop", "0x2"), (1, 1, 0, "hidden", "0x3"), (2, 0, 0, "drv_tx", "0x4"), (3, 0, 0, "idle", "0x5")], "dump_id bigint, tid bigint, gdb_idx bigint, func string, address string")
    meta = spark.createDataFrame([(1, "SIGSEGV", "heap", "0x8"), (2, "SIGBUS", None, None)], "dump_id bigint, signal_name string, region string, fault_addr string")
    return G.exec_order(frames), meta


def test_own_patterns(spark, dump):
    layers = spark.createDataFrame([(0, "prefix", "drv_", "driver")], X.LAYER_RULES)
    rows = [(1, "loop near null", ["loop"], None, None, True, None), (0, "other thread", ["hidden"], None, None, None, None), (2, "any bus error", None, None, ["SIGBUS"], None, None),
            (3, "driver", None, "driver", None, None, None), (9, "rest", None, None, None, None, None)]
    got = {r.dump_id: r.pattern for r in X.crash_patterns(*dump, layers, spark.createDataFrame(rows, X.PATTERN_RULES)).collect()}
    assert got == {1: "loop near null", 2: "any bus error", 3: "rest"}
    got = {r.dump_id: (r.crash_layer, r.pattern) for r in X.crash_patterns(*dump, layers, spark.createDataFrame(rows[3:4], X.PATTERN_RULES)).collect()}
    assert got == {1: ("user_app", None), 2: ("driver", "driver"), 3: ("user_app", None)}


def test_no_frame_is_lost(spark, sf):
    f = I.frames(spark, sf)
    assert X.with_layers(f, X.default_layers(spark)).where(F.col("layer") != G.frame_layer("func")).count() == 0
    assert X.with_layers(f, X.default_layers(spark)).count() == f.count()
