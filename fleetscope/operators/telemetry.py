"""Snapshots of cumulative counters to windowed statistics and chart series.

Input records carry ``client_id, pid, t`` (numeric seconds) plus the nested maps of the collector:
1 s records hold ``ethdev_stats``, ``ethdev_link`` and ``mempool_stats``; 5 s records hold ``ethdev_xstats``,
``lcore_usage`` and ``heap_stats``. A window is the tumbling range [end - width, end) named by ``win`` = end.
Every snapshot is reduced to plain numbers before it is shuffled, so first/last per window is one hash
aggregate and no nested value crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.blocked import last_n_per_key, previous_row
from fleetscope.functions.scalars import rate_sql, ratio, ratio_sql, rows_of, tumbling_end, window_end_sql

INSTANCE = ["client_id", "pid"]
WINDOW = [*INSTANCE, "win"]


# ---- per-snapshot columns -------------------------------------------------------------------------------

def queue_balance(q) -> dict[str, Column]:
    """Active queues, total, largest queue, share of the largest (only with >1 active queue and >= 100 packets)."""
    q = F.coalesce(F.col(q) if isinstance(q, str) else q, F.array().cast("array<bigint>"))
    total = F.aggregate(q, F.lit(0).cast("bigint"), lambda a, x: a + x)
    active = F.size(F.filter(q, lambda x: x > 0)).cast("bigint")
    largest = F.coalesce(F.array_max(q), F.lit(0).cast("bigint"))
    share = F.when((active > 1) & (total >= 100), ratio(largest, total)).otherwise(F.lit(0.0))
    return {"active_queues": active, "total_packets": total, "max_queue_packets": largest, "imbalance_ratio": share}


def mempool_stats(records: DataFrame) -> DataFrame:
    """One row per snapshot and pool with its free share and cache share."""
    return records.select(*INSTANCE, "t", F.explode("mempool_stats").alias("pool", "p")).select(
        *INSTANCE, "t", F.coalesce("p.name", "pool").alias("pool"), "p.size", "p.populated_size", "p.cache_size",
        "p.elt_size", "p.common_pool_count", "p.total_cache_count",
        ratio("p.common_pool_count", "p.size").alias("free_ratio"),
        ratio("p.total_cache_count", "p.size").alias("cache_pressure"),
    )


def _fragmentation(greatest: Column, free: Column) -> Column:
    return F.when(free != 0, 1.0 - ratio(greatest, free)).otherwise(F.lit(0.0))


def heap_stats(records: DataFrame) -> DataFrame:
    """One row per snapshot and heap with free share and fragmentation."""
    return records.select(*INSTANCE, "t", F.explode("heap_stats").alias("heap_id", "h")).select(
        *INSTANCE, "t", "heap_id", F.coalesce(F.col("h.Name"), F.concat(F.lit("heap_"), "heap_id")).alias("name"),
        F.col("h.Heap_size").alias("heap_size"), F.col("h.Free_size").alias("free_size"),
        F.col("h.Alloc_size").alias("alloc_size"), F.col("h.Greatest_free_size").alias("greatest_free_size"),
        ratio("h.Free_size", "h.Heap_size").alias("free_ratio"),
        _fragmentation(F.col("h.Greatest_free_size"), F.col("h.Free_size")).alias("fragmentation"),
    )


def with_lcore_entries(records: DataFrame) -> DataFrame:
    """Add ``_lcores``: the parallel arrays of all groups as one entry per lcore, the one with most total cycles."""
    zipped = records.selectExpr("*", """flatten(transform(map_values(lcore_usage),
        g -> arrays_zip(g.lcore_ids, g.total_cycles, g.busy_cycles, g.usage_ratio))) as _z""")
    rows = zipped.selectExpr("*", """filter(transform(_z, (e, i) -> named_struct(
        'total_cycles', cast(coalesce(e.total_cycles, 0) as bigint), 'rank', -i, 'lcore_id', cast(e.lcore_ids as int),
        'busy_cycles', cast(coalesce(e.busy_cycles, 0) as bigint),
        'usage_ratio', round(coalesce(try_cast(trim(both '%' from e.usage_ratio) as double) / 100, 0.0D), 6))),
        e -> e.lcore_id is not null and (e.total_cycles <> 0 or e.busy_cycles <> 0)) as _l""").drop("_z")
    return rows.selectExpr("*", """transform(array_distinct(_l.lcore_id),
        id -> array_max(filter(_l, e -> e.lcore_id = id))) as _lcores""").drop("_l")


def lcore_stats(records: DataFrame) -> DataFrame:
    """One row per snapshot and lcore that ran at all."""
    e = rows_of(with_lcore_entries(records), [*INSTANCE, "t"], "_lcores", "l")
    return e.selectExpr(*INSTANCE, "t", "l.lcore_id", "l.usage_ratio",
                        f"round({ratio_sql('l.busy_cycles', 'l.total_cycles')}, 6) as cycles_ratio",
                        "l.busy_cycles", "l.total_cycles")


def with_lcore_summary(records: DataFrame) -> DataFrame:
    """Active lcores, mean and largest usage, the id of the busiest (NULL when none ran)."""
    x = with_lcore_entries(records).selectExpr("*", """aggregate(_lcores, 0.0D, (a, e) -> a + e.usage_ratio) as _u""", """array_max(
        transform(_lcores, (e, i) -> named_struct('u', e.usage_ratio, 'o', -i, 'id', e.lcore_id))) as _top""")
    return x.selectExpr(
        *records.columns, "cast(greatest(size(_lcores), 0) as bigint) as active_lcores",
        f"round({ratio_sql('_u', 'size(_lcores)')}, 6) as avg_usage", "coalesce(round(_top.u, 6), 0.0D) as max_usage",
        "_top.id as hottest_lcore")


def lcore_summary(records: DataFrame) -> DataFrame:
    return with_lcore_summary(records).select(*INSTANCE, "t", "active_lcores", "avg_usage", "max_usage", "hottest_lcore")


# ---- first / last of a window -----------------------------------------------------------------------------

def _first_last(rows: DataFrame, group: list[str], counters: list[str], lasts: list[str]) -> DataFrame:
    """Per (window, port): first and last value of each counter, last value of the other columns.

    All aggregated columns are plain scalars, so rows are combined before the shuffle.
    """
    exprs = ["min(t) as t0", "max(t) as t1", "sum(case when coalesce(pos, 0) = 0 then 1 else 0 end) as n"]
    exprs += [f"min_by({c}, t) as first_{c}" for c in counters] + [f"max_by({c}, t) as last_{c}" for c in counters]
    return rows.groupBy(*group).agg(*[F.expr(e) for e in exprs + [f"max_by({c}, t) as {c}" for c in lasts]])


def _windowed_deltas(agg: DataFrame, counters: list[str]) -> DataFrame:
    """Counter deltas of the ports present in the last snapshot.

    A port that is missing from the first snapshot of the window counts with its absolute values.
    """
    over = "over (partition by " + ", ".join(WINDOW) + ")"
    x = agg.selectExpr("*", f"min(t0) {over} as t_start", f"max(t1) {over} as t_end", f"sum(n) {over} as samples")
    keep = [c for c in agg.columns if c not in ("t0", "t1", "n") and not c.startswith(("first_", "last_"))]
    return x.where("port is not null and t1 = t_end").selectExpr(
        *keep, "t_start", "t_end", "samples", "cast(t_end - t_start as double) as window_seconds",
        *[f"last_{c} - case when t0 = t_start then first_{c} else 0 end as d_{c}" for c in counters])


_PORT_LAST = ["pos", "link_status", "link_speed", "link_duplex", "active_queues", "total_packets",
              "max_queue_packets", "imbalance_ratio", "is_alive", "pool_size", "pool_free", "pools"]


def _port_rows(records: DataFrame, width: int) -> DataFrame:
    """One row per snapshot and port, reduced to scalars; a snapshot without ports keeps one row."""
    base = records.selectExpr(
        *INSTANCE, "t", f"{window_end_sql(width)} as win", "is_alive",
        "try_element_at(map_values(mempool_stats), 1).size as pool_size",
        "try_element_at(map_values(mempool_stats), 1).common_pool_count as pool_free",
        "coalesce(size(mempool_stats), 0) as pools", "ethdev_link",
        "posexplode_outer(ethdev_stats) as (pos, port, s)",
    )
    flat = base.selectExpr(
        *WINDOW, "t", "port", "pos", "is_alive", "pool_size", "pool_free", "pools",
        *[f"try_element_at(ethdev_link, port).{c} as link_{c}" for c in ("status", "speed", "duplex")],
        *[f"coalesce(s.{c}, 0) as {c}" for c in fixed.PORT_COUNTERS],
        "cast(greatest(size(filter(s.q_ipackets, x -> x > 0)), 0) as bigint) as active_queues",
        "coalesce(aggregate(s.q_ipackets, 0L, (a, x) -> a + x), 0L) as total_packets",
        "coalesce(array_max(s.q_ipackets), 0L) as max_queue_packets")
    return flat.selectExpr("*", f"""case when active_queues > 1 and total_packets >= 100
        then {ratio_sql('max_queue_packets', 'total_packets')} else 0.0D end as imbalance_ratio""")


def port_windows(records: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    counters = list(fixed.PORT_COUNTERS)
    agg = _first_last(_port_rows(records, width), [*WINDOW, "port"], counters, _PORT_LAST)
    return _windowed_deltas(agg, counters)


def port_stats(records: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    """First against last snapshot of each window, per port: deltas, rates, sizes, link, queue balance."""
    def side(name: str, packets: str, octets: str) -> list[str]:
        return [f"d_{packets} as {name}_packets", f"d_{octets} as {name}_bytes",
                f"{rate_sql('d_' + packets, 'window_seconds')} as {name}_pps",
                f"{rate_sql('(d_' + octets + ' * 8)', 'window_seconds')} as {name}_bps",
                f"{ratio_sql('d_' + octets, 'd_' + packets)} as {name}_avg_size"]

    return port_windows(records, width).selectExpr(
        *WINDOW, "port", "window_seconds", "link_status", "link_speed", "link_duplex",
        *side("rx", "ipackets", "ibytes"), "d_ierrors as rx_errors", "d_rx_nombuf as rx_nombuf",
        *side("tx", "opackets", "obytes"), "d_oerrors as tx_errors",
        "active_queues", "total_packets", "max_queue_packets", "imbalance_ratio", "pos", "samples", "t_start",
        "t_end", "is_alive", "pool_size", "pool_free", "pools",
    )


_X_LAST = ["pos", "is_alive", "heap_total", "heap_free", "heap_greatest", "heaps", "active_lcores", "avg_usage",
           "max_usage", "hottest_lcore"]


def _xstat_rows(records: DataFrame, width: int) -> DataFrame:
    base = with_lcore_summary(records).selectExpr(
        *INSTANCE, "t", f"{window_end_sql(width)} as win", "is_alive", "active_lcores", "avg_usage", "max_usage", "hottest_lcore",
        "try_element_at(map_values(heap_stats), 1).Heap_size as heap_total",
        "try_element_at(map_values(heap_stats), 1).Free_size as heap_free",
        "try_element_at(map_values(heap_stats), 1).Greatest_free_size as heap_greatest",
        "coalesce(size(heap_stats), 0) as heaps", "posexplode_outer(ethdev_xstats) as (pos, port, x)",
    )
    rest = [c for c in base.columns if c != "x"]
    return base.selectExpr(*rest, *[f"coalesce(try_element_at(x, '{full}'), 0) as {short}"
                                    for short, full in fixed.XSTAT_NAMES.items()])


def xstat_windows(records: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    counters = list(fixed.XSTAT_NAMES)
    return _windowed_deltas(_first_last(_xstat_rows(records, width), [*WINDOW, "port"], counters, _X_LAST), counters)


def traffic_pattern(records: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    """Extended counters of each window and the share of special packets among the good ones."""
    return xstat_windows(records, width).selectExpr(
        *WINDOW, "port", "window_seconds", *[f"d_{c} as {c}" for c in fixed.XSTAT_NAMES],
        *[f"{ratio_sql('d_' + c, 'd_rx_good')} as {c}_ratio" for c in ("multicast", "broadcast", "undersize")],
        "pos", "samples", "t_start", "t_end", "is_alive", "heap_total", "heap_free", "heap_greatest", "heaps",
        "active_lcores", "avg_usage", "max_usage", "hottest_lcore",
    )


def _first_port(stats: DataFrame) -> DataFrame:
    """The port that comes first in the last snapshot stands for the instance."""
    first = "row_number() over (partition by " + ", ".join(WINDOW) + " order by pos) as _r"
    return stats.selectExpr("*", first).where("_r = 1").drop("_r", "pos")


def statistic_1s(records: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    s = _first_port(port_stats(records, width))
    return s.selectExpr("*", f"case when pools > 0 then {ratio_sql('pool_free', 'pool_size')} end as mempool_free")


def statistic_5s(records: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    s = _first_port(traffic_pattern(records, width))
    return s.selectExpr(
        "*", f"case when heaps > 0 then {ratio_sql('heap_free', 'heap_total')} end as heap_free_ratio",
        f"""case when heaps > 0 then case when heap_free <> 0 then 1.0D - {ratio_sql('heap_greatest', 'heap_free')}
            else 0.0D end end as heap_frag""")


# columns both cadences have; those of the slow one get a suffix
_BOTH = ("port", "window_seconds", "samples", "t_start", "t_end", "rx_errors", "tx_errors")


def window_statistic(rec_1s: DataFrame, rec_5s: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    """Statistics of both cadences for every window that has both."""
    b = statistic_5s(rec_5s, width).drop("is_alive")
    b = b.selectExpr(*[f"{c} as {c}_5s" if c in _BOTH else c for c in b.columns])
    return statistic_1s(rec_1s, width).join(b, WINDOW)


# ---- rate series ----------------------------------------------------------------------------------------

def pps_series(records: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    """The valid pairs of ``pps_pairs``."""
    return pps_pairs(records, width).where("valid").drop("valid")


def pps_pairs(records: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    """Receive rate of the busiest port for every pair of neighbouring snapshots inside a window.

    ``valid`` tells pairs whose gap and rate are believable; the others stay in the result, for whoever counts them.
    """
    entries = F.map_entries("ethdev_stats")
    top = F.array_max(F.transform(entries, lambda e, i: F.struct(
        e["value"]["ipackets"].alias("ip"), (-i).alias("o"), e["key"].alias("port"))))
    slim = records.select(
        *INSTANCE, "t", tumbling_end("t", width).alias("win"), top["ip"].alias("ip"), top["port"].alias("port"),
        F.transform_values("ethdev_stats", lambda _, s: s["ipackets"]).alias("by_port"),
    )
    w = W.partitionBy(*WINDOW).orderBy("t")
    x = slim.select("*", F.lag("t").over(w).alias("pt"), F.lag("by_port").over(w).alias("pm"))
    before = F.try_element_at("pm", F.col("port"))
    dt = (F.col("t") - F.col("pt")).cast("double")
    x = x.withColumns({"dt": dt, "pps": F.try_divide(F.greatest(F.col("ip") - before, F.lit(0)).cast("double"), dt)})
    valid = (F.col("dt") > fixed.MIN_PAIR_GAP) & (F.col("dt") <= fixed.MAX_PAIR_GAP) & F.col("pps").between(0, fixed.MAX_PPS)
    return x.where(before.isNotNull()).select(*WINDOW, "t", "port", "dt", "pps", F.coalesce(valid, F.lit(False)).alias("valid"))


def ema_smooth(series: DataFrame, alpha: float = fixed.EMA_ALPHA) -> DataFrame:
    """Exponential smoothing inside each window, seeded with the first value. Windows hold at most ``width`` points."""
    keep = 1 - alpha
    g = series.groupBy(*WINDOW).agg(F.array_sort(F.collect_list(F.struct("t", "pps"))).alias("pts"))
    vals = F.transform("pts", lambda p: p["pps"])
    empty = F.array().cast("array<double>")
    folded = F.aggregate(vals, empty, lambda acc, v: F.concat(acc, F.array(
        F.when(F.size(acc) == 0, v).otherwise(F.lit(alpha) * v + F.lit(keep) * F.element_at(acc, -1)))))
    return g.select(*WINDOW, F.transform("pts", lambda p: p["t"]).alias("ts"), folded.alias("ema"))


def _mean(arr: Column) -> Column:
    return ratio(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), F.size(arr))


def jitter_of(arr: Column) -> Column:
    """Population deviation over mean; 0 for no values or a mean below 1."""
    m = _mean(arr)
    var = ratio(F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), F.size(arr))
    return F.when((F.size(arr) > 0) & (m >= 1.0), F.sqrt(var) / m).otherwise(F.lit(0.0))


def short_trend_of(arr: Column) -> Column:
    """Mean of the later half against the earlier half."""
    n = F.size(arr)
    half = F.floor(n / 2).cast("int")
    early = _mean(F.slice(arr, F.lit(1), half))
    late = _mean(F.slice(arr, half + 1, n - half))
    r = late / early
    return (
        F.when(n < 6, "unknown").when(F.array_max(arr) < 5, "stable").when(early < 1e-6, "unknown")
        .when(r > 1.2, "increasing_fast").when(r < 0.8, "decreasing_fast").otherwise("stable")
    )


def series_summary(records: DataFrame, width: int = fixed.FEATURE_WINDOW) -> DataFrame:
    """Smoothed series of every window reduced to its length, maximum, jitter and short trend."""
    e = ema_smooth(pps_series(records, width))
    a = F.col("ema")
    return e.select(*WINDOW, F.size(a).alias("points"), F.array_max(a).alias("peak"),
                    jitter_of(a).alias("jitter"), short_trend_of(a).alias("short_trend"))


# ---- dashboard series -------------------------------------------------------------------------------------

def dash_pool_heap_pct(rec_1s: DataFrame, rec_5s: DataFrame) -> DataFrame:
    """Free share in percent; a pool counts its cache as free."""
    def pct(free, size):
        return F.when(size > 0, free.cast("double") / size * 100).otherwise(F.lit(0.0))

    pools = rec_1s.select(*INSTANCE, "t", F.explode("mempool_stats").alias("name", "p")).select(
        *INSTANCE, "t", F.lit("mempool").alias("category"), "name",
        pct(F.col("p.common_pool_count") + F.col("p.total_cache_count"), F.col("p.size")).alias("value"))
    heaps = rec_5s.select(*INSTANCE, "t", F.explode("heap_stats").alias("id", "h")).select(
        *INSTANCE, "t", F.lit("heap").alias("category"),
        F.coalesce(F.col("h.Name"), F.concat(F.lit("heap_"), F.col("id"))).alias("name"),
        pct(F.col("h.Free_size"), F.col("h.Heap_size")).alias("value"))
    return pools.unionByName(heaps)


_TICK = ["ipackets", "opackets", "ibytes", "obytes", "ierrors", "rx_nombuf", "q_ipackets"]
# series of a port: category, name, change per tick
_TICK_SERIES = [("traffic", "rx_pps", "ipackets - prev.ipackets"), ("traffic", "tx_pps", "opackets - prev.opackets"),
                ("traffic", "rx_bps", "(ibytes - prev.ibytes) * 8"), ("traffic", "tx_bps", "(obytes - prev.obytes) * 8"),
                ("errors", "rx_ierrors", "ierrors - prev.ierrors"), ("errors", "rx_nombuf", "rx_nombuf - prev.rx_nombuf")]
_COUNTER_POINTS = "array(" + ", ".join(
    f"named_struct('category', '{c}', 'name', '{n}', 'value', cast({x} as double))" for c, n, x in _TICK_SERIES) + ")"
_QUEUE_POINTS = """filter(transform(zip_with(q_ipackets, prev.q_ipackets, (a, b) -> a - b), (d, i) -> named_struct(
    'category', 'queue_distribution', 'name', concat('queue_', cast(i as string)), 'value', cast(d as double))), p -> p.value > 0)"""


def _port_points(rec_1s: DataFrame, port: str, points: str) -> DataFrame:
    """Points of one port against its previous tick; the first tick has none."""
    s = F.try_element_at("ethdev_stats", F.lit(port))
    one = rec_1s.where(s.isNotNull()).select(*INSTANCE, "t", *[s[n].alias(n) for n in _TICK])
    d = previous_row(one, INSTANCE, "t", _TICK).where(F.col("prev").isNotNull())
    return rows_of(d, [*INSTANCE, "t"], F.expr(points), "p").select(*INSTANCE, "t", "p.category", "p.name", "p.value")


def _missed_points(rec_5s: DataFrame, port: str) -> DataFrame:
    x = F.try_element_at("ethdev_xstats", F.lit(port))
    five = rec_5s.where(x.isNotNull()).select(*INSTANCE, "t", F.try_element_at(x, F.lit("rx_missed_errors")).alias("missed"))
    m = previous_row(five, INSTANCE, "t", ["missed"]).where(F.col("prev").isNotNull())
    return m.selectExpr(*INSTANCE, "t", "'rx_missed' as category", "'rx_missed' as name", "cast(missed - prev.missed as double) as value")


def dash_counter_deltas(rec_1s: DataFrame, rec_5s: DataFrame, port: str = "0") -> DataFrame:
    """Per-tick deltas of one port. They are not divided by time; the first tick yields nothing."""
    return _port_points(rec_1s, port, _COUNTER_POINTS).unionByName(_missed_points(rec_5s, port))


def dash_queue_deltas(rec_1s: DataFrame, port: str = "0") -> DataFrame:
    """Packets per queue and tick, only for queues that moved."""
    return _port_points(rec_1s, port, _QUEUE_POINTS)


def dash_lcore_series(rec_5s: DataFrame) -> DataFrame:
    """Usage text of every lcore as a number."""
    zipped = F.flatten(F.transform(F.map_values("lcore_usage"), lambda g: F.arrays_zip(g["lcore_ids"], g["usage_ratio"])))
    e = rows_of(rec_5s, [*INSTANCE, "t"], zipped, "l")
    return e.where(F.col("l.lcore_ids").isNotNull() & F.col("l.usage_ratio").isNotNull()).select(
        *INSTANCE, "t", F.lit("lcore_usage").alias("category"),
        F.concat(F.lit("lcore_"), F.col("l.lcore_ids").cast("string")).alias("name"),
        F.regexp_replace("l.usage_ratio", "%+$", "").try_cast("double").alias("value"))


def ring_buffer_last_n(series: DataFrame, n: int = fixed.RING_1S) -> DataFrame:
    """Newest n points of each series."""
    return last_n_per_key(series, [*INSTANCE, "category", "name"], "t", n)


def dashboard_series(rec_1s: DataFrame, rec_5s: DataFrame, n_1s: int = fixed.RING_1S, n_5s: int = fixed.RING_5S, port: str = "0") -> DataFrame:
    """All chart series, each cut to its ring size; counters and queues come from one pass over the neighbours."""
    pools = dash_pool_heap_pct(rec_1s, rec_5s)
    fast = _port_points(rec_1s, port, f"concat({_COUNTER_POINTS}, {_QUEUE_POINTS})").unionByName(pools.where("category = 'mempool'"))
    slow = _missed_points(rec_5s, port).unionByName(dash_lcore_series(rec_5s)).unionByName(pools.where("category = 'heap'"))
    return ring_buffer_last_n(fast, n_1s).unionByName(ring_buffer_last_n(slow, n_5s))


def xstats_normalize(df: DataFrame, raw: str = "xstats_json", out: str = "xstats") -> DataFrame:
    """Counters sent as a JSON object or as a list of {name, value} become one map."""
    as_list = F.from_json(raw, "array<struct<name:string,value:bigint>>")
    as_map = F.from_json(raw, "map<string,bigint>")
    is_list = F.ltrim(F.col(raw)).startswith("[")
    return df.withColumn(out, F.when(is_list, F.map_from_entries(as_list)).otherwise(as_map))


def optional_device_stats(records: DataFrame, kinds=("dma_stats", "ipsec_stats", "eventdev_stats", "nix_stats")) -> DataFrame:
    """Counters of optional devices as long rows; records without such a device give no row."""
    have = [k for k in kinds if k in records.columns]
    out = None
    for k in have:
        dev = records.select(*INSTANCE, "t", F.lit(k).alias("kind"), F.explode(k).alias("device", "stats"))
        one = dev.select(*INSTANCE, "t", "kind", "device", F.explode("stats").alias("counter", "value"))
        out = one if out is None else out.unionByName(one)
    return out
