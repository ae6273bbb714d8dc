"""Hand-computed rows for statistics, labels and scores."""

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.operators import features as FE
from fleetscope.operators import telemetry as T


def rec(spark, rows):
    """rows: (t, {port: ipackets})"""
    port = ("struct<ipackets:bigint,opackets:bigint,ibytes:bigint,obytes:bigint,ierrors:bigint,oerrors:bigint,rx_nombuf:bigint,q_ipackets:array<bigint>>")
    data = [("c", 1, t, True, {p: (ip, ip, ip * 100, ip * 100, 0, 0, 0, [ip, 0]) for p, ip in ports.items()}, {}, {}) for t, ports in rows]
    return spark.createDataFrame(data, f"client_id string, pid bigint, t bigint, is_alive boolean, ethdev_stats map<string,{port}>, "
                                       "ethdev_link map<string,struct<status:string,speed:bigint,duplex:string>>, "
                                       "mempool_stats map<string,struct<size:bigint,common_pool_count:bigint>>")


def test_port_missing_at_window_start_counts_absolute(spark):
    r = rec(spark, [(0, {"0": 10}), (4, {"0": 30, "1": 7}), (8, {"0": 50, "1": 9})])
    got = {x.port: (x.rx_packets, x.rx_pps) for x in T.port_stats(r).collect()}
    assert got == {"0": (40, 5.0), "1": (9, 9 / 8)}


def test_port_gone_from_last_snapshot_is_left_out(spark):
    r = rec(spark, [(0, {"0": 10, "1": 5}), (8, {"0": 50})])
    assert [x.port for x in T.port_stats(r).collect()] == ["0"]


def test_snapshot_without_ports_still_spans_the_window(spark):
    r = rec(spark, [(0, {}), (5, {"0": 20}), (9, {"0": 29})])
    x = T.port_stats(r).collect()[0]
    assert (x.rx_packets, x.window_seconds, x.samples) == (29, 9.0, 3)


def test_lcore_duplicates_keep_most_cycles(spark):
    s = "struct<lcore_ids:array<int>,total_cycles:array<bigint>,busy_cycles:array<bigint>,usage_ratio:array<string>>"
    usage = {"0": ([1, 2, 3], [100, 50, 0], [10, 5, 0], ["10%", "x%"]), "1": ([1], [200], [100], ["50%"])}
    df = spark.createDataFrame([("c", 1, 0, usage)], f"client_id string, pid bigint, t bigint, lcore_usage map<string,{s}>")
    got = {r.lcore_id: (r.usage_ratio, r.cycles_ratio) for r in T.lcore_stats(df).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.1)}
    s = T.lcore_summary(df).collect()[0]
    assert (s.active_lcores, s.avg_usage, s.max_usage, s.hottest_lcore) == (2, 0.25, 0.5, 1)


BASE = dict(rx_pps=5e4, tx_pps=1.0, rx_avg_size=200.0, rx_good=0, window_seconds_5s=5.0, points=None, peak=None, jitter=None, short_trend=None,
            imbalance_ratio=0.0, mempool_free=0.9, heap_free_ratio=0.9, heap_frag=0.0, avg_usage=0.1, max_usage=0.1, hottest_lcore=1,
            rx_errors=0, tx_errors=0, rx_nombuf=0, rx_missed=0)
SCHEMA = ("rx_pps double, tx_pps double, rx_avg_size double, rx_good bigint, window_seconds_5s double, points int, peak double, jitter double, "
          "short_trend string, imbalance_ratio double, mempool_free double, heap_free_ratio double, heap_frag double, avg_usage double, "
          "max_usage double, hottest_lcore int, rx_errors bigint, tx_errors bigint, rx_nombuf bigint, rx_missed bigint")

CASES = [
    ({}, dict(traffic_level="medium", trend="unknown", mem_status="healthy", queue_status="balanced", cpu_status="idle", risk_score=0,
              risk_level="low", insight=["system operating normally"], risk=[])),
    ({"mempool_free": 0.1}, dict(mem_status="warning", risk_score=20, risk_level="medium")),
    ({"mempool_free": 0.09}, dict(mem_status="critical", risk_score=50, risk_level="high", insight=[fixed.INSIGHT["mem"]])),
    ({"mempool_free": 0.0}, dict(mem_trend="unknown")),
    ({"imbalance_ratio": 0.2}, dict(queue_status="slight_skew", risk_score=10)),
    ({"imbalance_ratio": 0.5}, dict(queue_status="severe_skew", risk_score=20)),
    ({"heap_free_ratio": 0.05, "heap_frag": 0.6}, dict(heap_status="warning", risk_score=25, risk=["heap_memory_pressure"])),
    ({"heap_free_ratio": 0.04}, dict(heap_status="critical", risk_score=40)),
    ({"avg_usage": 0.7}, dict(cpu_status="high", risk_score=30)),
    ({"rx_errors": 1}, dict(error_severity="low", risk_score=1)),
    ({"rx_missed": 2}, dict(error_severity="medium", missed=2)),
    ({"rx_nombuf": 5, "mempool_free": 0.2}, dict(error_severity="high", risk=["packet_loss_due_to_mempool"], risk_score=100)),
    ({"rx_good": 100_000}, dict(trend="increasing", risk_score=10)),
    ({"rx_good": 400_000}, dict(trend="decreasing")),
    ({"rx_pps": 2e6, "rx_good": 100_000}, dict(traffic_level="high", trend="increasing", risk=["traffic_surge"], risk_score=20)),
    ({"rx_pps": 5.0, "rx_good": 400_000}, dict(traffic_level="low", trend="stable", short_trend="stable", stability="stable")),
    ({"jitter": 0.6, "points": 7, "peak": 9e4, "short_trend": "stable"}, dict(stability="unstable", insight=["system operating normally"])),
    ({"jitter": 0.6, "points": 7, "peak": 9e4, "rx_errors": 1}, dict(insight=["traffic is highly unstable"])),
    ({"jitter": 0.3, "points": 7, "peak": 9e4}, dict(stability="slightly_unstable")),
    ({"points": 7, "peak": 9e4, "short_trend": "decreasing_fast"}, dict(insight=["traffic dropping rapidly"])),
    ({"points": 6, "peak": 9e4, "short_trend": "decreasing_fast"}, dict(insight=["system operating normally"])),
    ({"rx_avg_size": 127.0}, dict(packet_type="small")), ({"rx_avg_size": 1001.0}, dict(packet_type="large")),
]


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.createDataFrame([tuple({**BASE, **c}.values()) for c, _ in CASES], SCHEMA).coalesce(1)
    return FE.label_windows(df).collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_labels(labelled, i):
    for k, v in CASES[i][1].items():
        assert labelled[i][k] == v, (CASES[i][0], k, labelled[i][k])


def test_baseline_gives_mempool_trend(spark):
    df = spark.createDataFrame([tuple({**BASE, "mempool_free": 0.2}.values())], SCHEMA).withColumn("ref_mempool_free", F.lit(0.8))
    r = FE.label_windows(df).collect()[0]
    assert (r.mem_trend, r.risk, r.risk_score) == ("decreasing", ["mempool_exhaustion_risk"], 50)


def test_series_labels(spark):
    df = spark.createDataFrame([([10.0] * 3 + [20.0] * 3,), ([20.0] * 3 + [10.0] * 3,), ([1.0] * 6,), ([9.0] * 5,), ([0.0] * 3 + [9.0] * 3,), ([10.0] * 7,)], "v array<double>").coalesce(1)
    got = [r.x for r in df.select(T.short_trend_of(F.col("v")).alias("x")).collect()]
    assert got == ["increasing_fast", "decreasing_fast", "stable", "unknown", "unknown", "stable"]
    j = [r.x for r in spark.createDataFrame([([1.0, 3.0],), ([0.1, 0.2],), ([],)], "v array<double>").coalesce(1).select(T.jitter_of(F.col("v")).alias("x")).collect()]
    assert j == [0.5, 0.0, 0.0]


def test_asof_latest_respects_age(spark):
    left = spark.createDataFrame([("c", 100), ("c", 400), ("c", 1000), ("d", 50)], "k string, t bigint")
    right = spark.createDataFrame([("c", 90, 1), ("c", 100, 2), ("c", 399, 3)], "k string, rt bigint, v int")
    got = {(r.k, r.t): r.v for r in FE.asof_latest(left, right, ["k"], "t", "rt", 300, ["v"]).collect()}
    assert got == {("c", 100): 2, ("c", 400): 3, ("c", 1000): None, ("d", 50): None}
