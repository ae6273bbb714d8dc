import random

import pytest

from fleetscope.operators import rules as R
from fleetscope.sources.rules import load_rules


def brute(hits):
    last, out = {}, set()
    for k, t, i, c in sorted(hits, key=lambda h: (h[0], h[1], h[2])):
        if k not in last or t >= last[k] + c:
            last[k] = t
            out.add((k, t, i))
    return out


@pytest.mark.parametrize("span", [50, 97, 1000, 10**6])
@pytest.mark.parametrize("density", [3, 40])
def test_cooldown_matches_walk(spark, span, density):
    rng = random.Random(span + density)
    cool = {"hot": 17, "a": 60, "b": 1, "c": 300}
    hits = []
    for i in range(2500):
        k = "hot" if rng.random() < 0.6 else rng.choice("abc")
        hits.append((k, rng.randrange(2500 * density // 10), i, cool[k]))
    df = spark.createDataFrame(hits, "k string, t bigint, event_id bigint, cooldown bigint")
    got = {tuple(r) for r in R.cooldown(df, ["k"], span=span).select("k", "t", "event_id").collect()}
    assert got == brute(hits)


def test_conditions(spark):
    cases = [("gt", 2.0, 1.0, None, True), ("gt", 1.0, 1.0, None, False), ("lt", 0.5, 1.0, None, True), ("gte", 1.0, 1.0, None, True),
             ("lte", 1.0, 1.0, None, True), ("eq", 1.0, 1.0, None, True), ("ref_ratio", 4.0, 3.0, 1.0, True), ("ref_ratio", 3.0, 3.0, 1.0, False),
             ("ref_ratio", 9.0, 3.0, 0.0, False), ("ref_ratio", 9.0, 3.0, None, False), ("ref_ratio_lt", 0.2, 0.5, 1.0, True),
             ("ref_ratio_lt", 0.6, 0.5, 1.0, False), ("ref_delta", 5.0, 3.0, 1.0, True), ("ref_delta", 5.0, 3.0, None, False),
             ("other", 5.0, 3.0, 1.0, False)]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, condition string, value double, threshold double, ref double")
    got = {r.i: r.ok for r in df.selectExpr("i", f"{R.CONDITION_SQL} as ok").collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_yaml_defaults(spark, tmp_path):
    p = tmp_path / "r.yaml"
    p.write_text("rules:\n  - {id: A, metric: rx_pps, condition: gt, threshold: 5}\n"
                 "  - {id: B, name: n, severity: critical, metric: cpu_avg, condition: lt, threshold: 0.5, cooldown_sec: 9, escalate_to_fault: true, enabled: false}\n")
    got = {r.rule_id: r for r in load_rules(spark, str(p)).collect()}
    a, b = got["A"], got["B"]
    assert (a.name, a.severity, a.threshold, a.cooldown_sec, a.escalate, a.enabled) == ("", "info", 5.0, 60, False, True)
    assert (b.name, b.severity, b.cooldown_sec, b.escalate, b.enabled) == ("n", "critical", 9, True, False)


def test_shipped_rules(spark):
    assert R.default_rules(spark).count() == 18


def test_map_sorted_groups_keeps_groups_whole(spark):
    import pandas as pd

    from fleetscope.functions.groups import map_sorted_groups

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.range(2000).selectExpr("id % 7 as k", "id as t")
        count = lambda rows, starts: pd.DataFrame({
            "k": rows["k"].to_numpy()[starts], "n": [b - a for a, b in zip(starts, [*starts[1:], len(rows)])]})
        got = {r.k: r.n for r in map_sorted_groups(df, ["k"], ["t"], count, "k bigint, n bigint").collect()}
        assert got == {k: len(range(k, 2000, 7)) for k in range(7)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
