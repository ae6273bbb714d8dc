"""Labels, insights, risk score and baselines over the window statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.scalars import label_sql, rate_sql, ratio_sql
from fleetscope.operators.telemetry import (
    INSTANCE, WINDOW, series_summary, statistic_1s, statistic_5s, window_statistic,
)


def _trend(r: str, up: float, down: float) -> str:
    return f"case when {r} > {up} then 'increasing' when {r} < {down} then 'decreasing' else 'stable' end"


def _add(df: DataFrame, **cols: str) -> DataFrame:
    """Add or replace columns given as SQL text, in one projection."""
    keep = [c for c in df.columns if c not in cols]
    return df.selectExpr(*keep, *[f"{x} as {n}" for n, x in cols.items()])


def traffic_features(stats: DataFrame) -> DataFrame:
    """Traffic level, stability, short and long trend and packet type.

    ``stats`` is ``window_statistic`` left-joined with ``series_summary``. The 5 s rate is the good-packet delta
    over the 5 s window; with almost no traffic all trends are called stable.
    """
    low = fixed.LOW_TRAFFIC_PPS
    df = _add(
        stats,
        traffic_level="case when rx_pps < 1e3 then 'low' when rx_pps < 1e6 then 'medium' else 'high' end",
        rx_pps_5s=f"case when rx_good > 0 then {rate_sql('rx_good', 'window_seconds_5s')} else 0.0D end",
        _quiet=f"rx_pps < 1e3 and coalesce(peak, 0.0D) < {low}", points="coalesce(points, 0)",
    )
    df = _add(
        df, rx_jitter="case when _quiet then 0.0D else coalesce(jitter, 0.0D) end",
        short_trend="case when _quiet then 'stable' else coalesce(short_trend, 'unknown') end",
        _long=ratio_sql("(rx_pps + 1e-6)", "(rx_pps_5s + 1e-6)"),
    )
    df = _add(
        df,
        stability="""case when traffic_level = 'low' then 'stable' when rx_jitter > 0.5 then 'unstable'
            when rx_jitter > 0.2 then 'slightly_unstable' else 'stable' end""",
        trend=f"case when rx_pps < {low} then 'stable' when rx_pps_5s > 0 then {_trend('_long', 1.2, 0.8)} else 'unknown' end",
        packet_type="case when rx_avg_size < 128 then 'small' when rx_avg_size > 1000 then 'large' else 'normal' end",
    )
    return df.drop("_quiet", "_long")


def resource_status(df: DataFrame) -> DataFrame:
    """Queue, mempool, heap and cpu labels.

    The slow cadence carries no mempool, so the free-share trend compares with the baseline where one is joined
    (column ``ref_mempool_free``) and with itself otherwise. The fast cadence carries no lcores: its trend is stable.
    """
    against = "coalesce(ref_mempool_free, mempool_free, 1.0D)" if "ref_mempool_free" in df.columns else "coalesce(mempool_free, 1.0D)"
    df = _add(
        df, mempool_free="coalesce(mempool_free, 1.0D)", _mem=ratio_sql("coalesce(mempool_free, 1.0D)", against),
        heap_free="coalesce(heap_free_ratio, 1.0D)", heap_frag="coalesce(heap_frag, 0.0D)",
        cpu_avg="coalesce(avg_usage, 0.0D)", cpu_max="coalesce(max_usage, 0.0D)", hot_lcore="hottest_lcore",
    )
    return _add(
        df,
        queue_status=label_sql("imbalance_ratio", fixed.QUEUE_STEPS), mem_status=label_sql("mempool_free", fixed.MEMPOOL_STEPS),
        mem_trend=f"case when _mem <> 0 then {_trend('_mem', 1.3, 0.7)} else 'unknown' end",
        heap_status=label_sql("heap_free", fixed.HEAP_STEPS), cpu_status=label_sql("cpu_avg", fixed.CPU_STEPS),
        cpu_trend="'stable'",
    ).drop("_mem", "heap_free_ratio", "avg_usage", "max_usage", "hottest_lcore")


def error_severity(df: DataFrame) -> DataFrame:
    """Weighted error count and its label. Missed packets come from the slow cadence, the only one that has them."""
    df = _add(df, nombuf="rx_nombuf", missed="coalesce(rx_missed, 0)",
              error_score="rx_errors + tx_errors + rx_nombuf * 10 + coalesce(rx_missed, 0) * 5")
    return _add(df, error_severity=label_sql("error_score", fixed.ERROR_STEPS))


def insights(df: DataFrame) -> DataFrame:
    """Ordered texts of everything that stands out; one normal text when nothing does.

    An instability that is hidden because of low traffic still counts as found: no normal text is added then.
    """
    t = fixed.INSIGHT
    tests = {
        "mem": "mem_status = 'critical'", "queue": "queue_status <> 'balanced'", "cpu": "cpu_status = 'high'",
        "errors": "error_severity in ('medium', 'high')", "traffic_up": "trend = 'increasing'",
        "mem_down": "mem_trend = 'decreasing'", "cpu_up": "cpu_trend = 'increasing'",
        "burst_up": "short_trend = 'increasing_fast'",
        "burst_down": "short_trend = 'decreasing_fast' and points / 10 > 0.6",
        "unstable": "_shaky and not (traffic_level = 'low' and _calm)", "heap_out": "heap_status = 'critical'",
        "heap_low": "heap_status = 'warning'", "heap_frag": "heap_frag > 0.5",
    }
    df = _add(df, _calm="error_severity = 'none' and queue_status = 'balanced'",
              _shaky="""stability = 'unstable' and not (error_severity = 'none' and queue_status = 'balanced'
                  and mem_status = 'healthy')""")
    said = ", ".join(f"case when {x} then '{t[k]}' end" for k, x in tests.items())
    df = _add(df, _said=f"array_compact(array({said}))")
    return _add(df, insight=f"case when size(_said) = 0 and not _shaky then array('{t['normal']}') else _said end").drop(
        "_calm", "_shaky", "_said")


def risk_score(df: DataFrame) -> DataFrame:
    """Partial scores per resource, their capped sum and the level."""
    df = _add(
        df,
        risk_mempool="""case mem_status when 'critical' then 50 when 'warning' then 20 else 0 end
            + case mem_trend when 'decreasing' then 30 else 0 end + least(nombuf * 10, 100)""",
        risk_cpu="case cpu_status when 'high' then 30 else 0 end + case cpu_trend when 'increasing' then 20 else 0 end",
        risk_queue="case queue_status when 'severe_skew' then 20 when 'slight_skew' then 10 else 0 end",
        risk_traffic="case trend when 'increasing' then 10 else 0 end + case traffic_level when 'high' then 10 else 0 end",
        risk_heap="case heap_status when 'critical' then 40 when 'warning' then 15 else 0 end + case when heap_frag > 0.5 then 10 else 0 end",
        risk_errors="least(error_score, 100)",
    )
    df = _add(df, risk_score="cast(least(" + " + ".join(f"risk_{p}" for p in RISK_PARTS) + ", 100) as bigint)")
    return _add(df, risk_level=label_sql("risk_score", fixed.RISK_STEPS))


RISK_PARTS = ("mempool", "cpu", "queue", "traffic", "heap", "errors")


def risk_tags(df: DataFrame) -> DataFrame:
    """Named risks in fixed order and the nonzero parts of the score."""
    tests = {
        "mem_imminent": "mem_status = 'critical' and mem_trend = 'decreasing'",
        "mem_risk": "mem_status = 'warning' and mem_trend = 'decreasing'",
        "cpu": "cpu_status = 'high' and cpu_trend = 'increasing'",
        "queue": "queue_status = 'severe_skew' and trend = 'increasing'",
        "mbuf": "nombuf > 0 and mem_status <> 'healthy'", "surge": "traffic_level = 'high' and trend = 'increasing'",
        "heap": "heap_status in ('critical', 'warning')",
    }
    tags = ", ".join(f"case when {x} then '{fixed.RISK_TAGS[k]}' end" for k, x in tests.items())
    parts = ", ".join(f"'{p}', cast(risk_{p} as double)" for p in RISK_PARTS)
    return _add(df, risk=f"array_compact(array({tags}))", risk_breakdown=f"map_filter(map({parts}), (k, v) -> v <> 0)")


def label_windows(stats: DataFrame) -> DataFrame:
    """All labels and scores over joined statistics; no shuffle."""
    return risk_tags(risk_score(insights(error_severity(resource_status(traffic_features(stats))))))


def window_inputs(rec_1s: DataFrame, rec_5s: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    return window_statistic(rec_1s, rec_5s, width).join(series_summary(rec_1s, width), WINDOW, "left")


def log_features(rec_1s: DataFrame, rec_5s: DataFrame, width: int = fixed.FEATURE_WINDOW,
                 baseline: DataFrame | None = None) -> DataFrame:
    """The whole feature row per (client, pid, window). A window counts only when both cadences reported."""
    stats = window_inputs(rec_1s, rec_5s, width)
    if baseline is not None:
        ref = baseline.select(*INSTANCE, F.col("win").alias("ref_t"), F.col("mempool_free").alias("ref_mempool_free"))
        stats = asof_latest(stats, ref, INSTANCE, "win", "ref_t", fixed.BASELINE_WINDOW, ["ref_mempool_free"])
    return label_windows(stats)


FEATURE_COLUMNS = [
    *WINDOW, "window_seconds", "window_seconds_5s", "is_alive", "rx_pps", "tx_pps", "traffic_level", "trend",
    "short_trend", "stability", "packet_type", "imbalance_ratio", "queue_status", "mempool_free", "mem_status",
    "mem_trend", "heap_free", "heap_frag", "heap_status", "cpu_avg", "cpu_status", "cpu_trend", "hot_lcore",
    "rx_errors", "tx_errors", "nombuf", "missed", "error_severity", "insight", "risk", "risk_score", "risk_level",
    "risk_breakdown",
]


def reference_features(rec_1s: DataFrame, rec_5s: DataFrame, width: int = fixed.BASELINE_WINDOW,
                       exclude_last: int = 0) -> DataFrame:
    """Baseline row per long window: 12 metrics, window seconds and sample count.

    The window is tumbling and ends at ``win``; ``exclude_last`` leaves its newest seconds out.
    """
    if exclude_last:
        cut = lambda d: d.where(F.pmod(F.col("t"), F.lit(width)) < width - exclude_last)
        rec_1s, rec_5s = cut(rec_1s), cut(rec_5s)
    a = statistic_1s(rec_1s, width).select(
        *WINDOW, "rx_pps", "tx_pps", "rx_errors", "tx_errors", F.col("rx_nombuf").alias("nombuf"),
        F.col("imbalance_ratio").alias("queue_imbalance"), F.coalesce("mempool_free", F.lit(1.0)).alias("mempool_free"),
        "window_seconds", F.col("samples").alias("sample_count"))
    b = statistic_5s(rec_5s, width).select(
        *WINDOW, F.col("rx_missed").alias("missed"), F.coalesce("heap_free_ratio", F.lit(1.0)).alias("heap_free"),
        F.coalesce("heap_frag", F.lit(0.0)).alias("heap_frag"), F.col("avg_usage").alias("cpu_avg"),
        F.col("max_usage").alias("cpu_max"))
    zero = {c: 0 for c in ("rx_errors", "tx_errors", "nombuf", "missed", "sample_count")}
    zero |= {c: 0.0 for c in ("rx_pps", "tx_pps", "queue_imbalance", "window_seconds", "heap_frag", "cpu_avg", "cpu_max")}
    return a.join(b, WINDOW, "full").fillna(zero).fillna(1.0, ["mempool_free", "heap_free"])


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, ttl: int,
                cols: list[str]) -> DataFrame:
    """Latest right row at or before each left row, not older than ``ttl``; NULLs when there is none.

    Time is cut into slots of ``ttl``; a right row is copied into its own and the next slot, so each
    (key, slot) is solved alone with one ordered pass: no pairs are built and a hot key is split by time.
    """
    slot = lambda c: F.floor(F.col(c) / F.lit(float(ttl))).cast("bigint")
    payload = F.struct(F.col(right_t).alias("_rt"), *cols)
    types = {f.name: f.dataType for f in right.select(payload.alias("p")).schema["p"].dataType.fields}
    empty = F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    r = right.select(
        *keys, F.explode(F.array(slot(right_t), slot(right_t) + 1)).alias("_slot"), F.col(right_t).alias("_t"),
        F.lit(0).alias("_side"), payload.alias("_p"))
    lcols = [c for c in left.columns if c not in keys]
    l_row = F.struct(*lcols)
    l_type = left.select(l_row.alias("x")).schema["x"].dataType
    l_part = left.select(*keys, slot(left_t).alias("_slot"), F.col(left_t).alias("_t"), F.lit(1).alias("_side"),
                         empty.alias("_p"), l_row.alias("_l"))
    both = l_part.unionByName(r.withColumn("_l", F.lit(None).cast(l_type)))
    w = W.partitionBy(*keys, "_slot").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    hit = both.withColumn("_h", F.last("_p", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    fresh = (F.col("_t") - F.col("_h._rt")) <= ttl
    out = [F.when(fresh, F.col(f"_h.{c}")).alias(c) for c in cols]
    rt = [F.when(fresh, F.col("_h._rt")).cast(types["_rt"]).alias(right_t)]
    return hit.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in lcols], *rt, *out)


def baseline_asof(features: DataFrame, baseline: DataFrame, ttl: int = fixed.BASELINE_WINDOW) -> DataFrame:
    """Attach the newest baseline that is at most ``ttl`` old as ``ref_<metric>`` columns."""
    metrics = [c for c in baseline.columns if c not in WINDOW]
    ref = baseline.select(*INSTANCE, F.col("win").alias("ref_win"), *[F.col(c).alias(f"ref_{c}") for c in metrics])
    return asof_latest(features, ref, INSTANCE, "win", "ref_win", ttl, [f"ref_{c}" for c in metrics])


def log_summary(rec_1s: DataFrame, rec_5s: DataFrame, requests: DataFrame, width: int = fixed.FEATURE_WINDOW, most: int | None = None) -> DataFrame:
    """Feature rows for requested (client_id, pid, seconds); bad spans (below 1, above ``most``) and unknown instances get a message."""
    ok = F.col("seconds") >= 1
    ok = ok if most is None else ok & (F.col("seconds") <= most)
    asked = requests.where(ok).select(*INSTANCE, "seconds").distinct()
    one = rec_1s.join(asked.select(*INSTANCE), INSTANCE, "left_semi")
    five = rec_5s.join(asked.select(*INSTANCE), INSTANCE, "left_semi")
    feats = log_features(one, five, width)
    newest = feats.groupBy(*INSTANCE).agg(F.max("win").alias("newest"))
    picked = (
        asked.join(newest, INSTANCE, "left").join(feats, INSTANCE, "left")
        .where(F.col("win").isNull() | (F.col("win") > F.col("newest") - F.col("seconds")))
    )
    found = picked.withColumn("message", F.when(F.col("win").isNull(), "unknown client or process"))
    bad = requests.where(~ok).select(*INSTANCE, "seconds").distinct().withColumn("message", F.lit(f"seconds must be within 1..{most or ''}"))
    return found.unionByName(bad, allowMissingColumns=True)
