"""Registered queries: windowed telemetry statistics, chart series and the feature row."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.scalars import delta, level, rate, ratio, threshold_label
from fleetscope.functions.blocked import previous_row
from fleetscope.operators import features as FE
from fleetscope.operators import telemetry as T
from fleetscope.plans import inputs as I
from fleetscope.plans.common import tidy
from fleetscope.plans.registry import cte, query

W10 = "CAST((floor(t / 10.0) + 1) * 10 AS BIGINT)"
W300 = "CAST((floor(t / 300.0) + 1) * 300 AS BIGINT)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 OR {b} IS NULL THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def per_sec(a: str, dt: str = "dt") -> str:
    return f"(CASE WHEN {dt} > 0 THEN CAST({a} AS DOUBLE) / {dt} ELSE 0.0 END)"


def label(v: str, steps) -> str:
    body = " ".join(f"WHEN {v} < {b} THEN '{n}'" for b, n in steps if b != float("inf"))
    return f"(CASE {body} ELSE '{steps[-1][1]}' END)"


@query("safe_ratio_rate", f"""
SELECT client_id, pid, t, round(CAST(p0_ip - coalesce(pip, 0) AS DOUBLE), 6) AS delta_packets,
  round({div('p0_ib', 'p0_ip')}, 6) AS avg_size, round({per_sec('p0_ip - pip', 'gap')}, 6) AS pps
FROM (SELECT *, LAG(p0_ip) OVER w AS pip, CAST(t - LAG(t) OVER w AS DOUBLE) AS gap FROM fx_1s
      WINDOW w AS (PARTITION BY client_id, pid ORDER BY t)) x""")
def safe_ratio_rate(spark, sf):
    f = I.flat_1s(spark, sf).select("client_id", "pid", "t", "p0_ip", "p0_ib")
    x = previous_row(f, ["client_id", "pid"], "t", ["t", "p0_ip"])
    gap = F.col("t") - F.col("prev.t")
    return tidy(x.select(
        "client_id", "pid", "t", delta(F.coalesce("prev.p0_ip", F.lit(0)), "p0_ip").alias("delta_packets"),
        ratio("p0_ib", "p0_ip").alias("avg_size"), rate(F.col("p0_ip") - F.col("prev.p0_ip"), gap).alias("pps")))


_ACTIVE = " + ".join(f"CASE WHEN q{i} > 0 THEN 1 ELSE 0 END" for i in range(4))
cte("ora_queue", f"""SELECT *, CASE WHEN active_queues > 1 AND total_packets >= 100
  THEN CAST(max_queue_packets AS DOUBLE) / total_packets ELSE 0.0 END AS imbalance_ratio FROM (
  SELECT *, CAST({_ACTIVE} AS BIGINT) AS active_queues, q0 + q1 + q2 + q3 AS total_packets,
  greatest(q0, q1, q2, q3) AS max_queue_packets FROM fx_ports) q""")


@query("queue_balance", """SELECT client_id, pid, t, port, active_queues, total_packets, max_queue_packets,
  round(imbalance_ratio, 6) AS imbalance_ratio FROM ora_queue""")
def queue_balance(spark, sf):
    r = I.records_1s(spark, sf).select("client_id", "pid", "t", F.explode("ethdev_stats").alias("port", "s"))
    return tidy(r.select("client_id", "pid", "t", "port", *[c.alias(n) for n, c in T.queue_balance(F.col("s.q_ipackets")).items()]))


@query("mempool_stats", """SELECT client_id, pid, t, 'mbuf_pool' AS pool, mp_size AS size, mp_size AS populated_size,
  CAST(256 AS BIGINT) AS cache_size, CAST(2176 AS BIGINT) AS elt_size, mp_common AS common_pool_count, mp_cache AS total_cache_count,
  round(CAST(mp_common AS DOUBLE) / mp_size, 6) AS free_ratio, round(CAST(mp_cache AS DOUBLE) / mp_size, 6) AS cache_pressure FROM fx_1s""")
def mempool_stats(spark, sf):
    return tidy(T.mempool_stats(I.records_1s(spark, sf)))


_FRAG = "CASE WHEN heap_free <> 0 THEN 1.0 - CAST(heap_greatest AS DOUBLE) / heap_free ELSE 0.0 END"


@query("heap_stats", f"""SELECT client_id, pid, t, '0' AS heap_id, 'socket_0' AS name, heap_size, heap_free AS free_size,
  heap_size - heap_free AS alloc_size, heap_greatest AS greatest_free_size,
  round(CAST(heap_free AS DOUBLE) / heap_size, 6) AS free_ratio, round({_FRAG}, 6) AS fragmentation FROM fx_5s""")
def heap_stats(spark, sf):
    return tidy(T.heap_stats(I.records_5s(spark, sf)))


cte("ora_lcore", """SELECT client_id, pid, t, id AS lcore_id, round(CAST(rtrim(u, '%') AS DOUBLE) / 100, 6) AS usage_ratio,
  round(CASE WHEN total = 0 THEN 0.0 ELSE CAST(busy AS DOUBLE) / total END, 6) AS cycles_ratio, busy AS busy_cycles, total AS total_cycles FROM (
  SELECT client_id, pid, t, CAST(1 AS BIGINT) AS id, lc0 AS u, busy0 AS busy, total0 AS total FROM fx_5s UNION ALL
  SELECT client_id, pid, t, 2, lc1, busy1, total1 FROM fx_5s UNION ALL
  SELECT client_id, pid, t, 3, lc2, busy2, total2 FROM fx_5s) l WHERE total <> 0 OR busy <> 0""")
cte("ora_lsum", """SELECT client_id, pid, t, COUNT(*) AS active_lcores, round(AVG(usage_ratio), 6) AS avg_usage,
  round(MAX(usage_ratio), 6) AS max_usage, arg_max(lcore_id, usage_ratio * 1000000 - lcore_id) AS hottest_lcore
  FROM ora_lcore GROUP BY client_id, pid, t""")


@query("lcore_stats", "SELECT * FROM ora_lcore")
def lcore_stats(spark, sf):
    return tidy(T.lcore_stats(I.records_5s(spark, sf)))


@query("lcore_summary", "SELECT * FROM ora_lsum")
def lcore_summary(spark, sf):
    return tidy(T.lcore_summary(I.records_5s(spark, sf)))


# ---- windows ----------------------------------------------------------------------------------------------

def _port_cte(name: str, win: str) -> None:
    n = ["ip", "ib", "op", "ob", "ie", "oe", "nb"]
    deltas = ", ".join(f"arg_max({c}, t) - arg_min({c}, t) AS d_{c}" for c in n)
    cte(name, f"""SELECT client_id, pid, {win} AS win, port, {deltas}, CAST(MAX(t) - MIN(t) AS DOUBLE) AS dt, COUNT(*) AS samples,
  MIN(t) AS t_start, MAX(t) AS t_end, arg_max(active_queues, t) AS active_queues, arg_max(total_packets, t) AS total_packets,
  arg_max(max_queue_packets, t) AS max_queue_packets, arg_max(imbalance_ratio, t) AS imbalance_ratio
  FROM ora_queue GROUP BY client_id, pid, {win}, port""")


_port_cte("ora_port10", W10)
_port_cte("ora_port300", W300)

_PORT_OUT = f"""client_id, pid, win, port, dt AS window_seconds, 'up' AS link_status, CAST(10000 AS BIGINT) AS link_speed,
  'full-duplex' AS link_duplex, d_ip AS rx_packets, d_ib AS rx_bytes, round({per_sec('d_ip')}, 6) AS rx_pps,
  round({per_sec('(d_ib * 8)')}, 6) AS rx_bps, round({div('d_ib', 'd_ip')}, 6) AS rx_avg_size, d_ie AS rx_errors, d_nb AS rx_nombuf,
  d_op AS tx_packets, d_ob AS tx_bytes, round({per_sec('d_op')}, 6) AS tx_pps, round({per_sec('(d_ob * 8)')}, 6) AS tx_bps,
  round({div('d_ob', 'd_op')}, 6) AS tx_avg_size, d_oe AS tx_errors, active_queues, total_packets, max_queue_packets,
  round(imbalance_ratio, 6) AS imbalance_ratio"""


@query("port_stats", f"SELECT {_PORT_OUT} FROM ora_port10")
def port_stats(spark, sf):
    return tidy(T.port_stats(I.records_1s(spark, sf)).drop(
        "pos", "samples", "t_start", "t_end", "is_alive", "pool_size", "pool_free", "pools"))


def _x_cte(name: str, win: str) -> None:
    pairs = {"x_good": "rx_good", "x_missed": "rx_missed", "x_rxerr": "rx_errors_x", "x_txerr": "tx_errors_x",
             "x_mbuf": "mbuf_errors", "x_multi": "multicast", "x_bcast": "broadcast", "x_under": "undersize"}
    deltas = ", ".join(f"arg_max(f.{c}, f.t) - arg_min(f.{c}, f.t) AS {o}" for c, o in pairs.items())
    w = win.replace("(t /", "(f.t /")
    cte(name, f"""SELECT f.client_id, f.pid, {w} AS win, {deltas}, CAST(MAX(f.t) - MIN(f.t) AS DOUBLE) AS dt5, COUNT(*) AS samples5,
  arg_max(CAST(heap_free AS DOUBLE) / heap_size, f.t) AS heap_free_ratio, arg_max({_FRAG}, f.t) AS heap_frag,
  arg_max(s.avg_usage, f.t) AS cpu_avg, arg_max(s.max_usage, f.t) AS cpu_max, arg_max(s.hottest_lcore, f.t) AS hot_lcore,
  arg_max(s.active_lcores, f.t) AS active_lcores
  FROM fx_5s f JOIN ora_lsum s ON f.client_id = s.client_id AND f.pid = s.pid AND f.t = s.t GROUP BY f.client_id, f.pid, {w}""")


_x_cte("ora_x10", W10)
_x_cte("ora_x300", W300)


@query("traffic_pattern", f"""SELECT client_id, pid, win, '0' AS port, dt5 AS window_seconds, rx_good, rx_missed, rx_errors_x AS rx_errors,
  tx_errors_x AS tx_errors, mbuf_errors, multicast, broadcast, undersize, round({div('multicast', 'rx_good')}, 6) AS multicast_ratio,
  round({div('broadcast', 'rx_good')}, 6) AS broadcast_ratio, round({div('undersize', 'rx_good')}, 6) AS undersize_ratio FROM ora_x10""")
def traffic_pattern(spark, sf):
    x = T.traffic_pattern(I.records_5s(spark, sf))
    return tidy(x.select(*T.WINDOW, "port", "window_seconds", *fixed.XSTAT_NAMES, "multicast_ratio", "broadcast_ratio", "undersize_ratio"))


def _stat_cte(name: str, port: str, x: str, win: str, how: str) -> None:
    cte(name, f"""SELECT p.*, x.* EXCLUDE (client_id, pid, win), m.mempool_free FROM {port} p
  {how} {x} x ON p.client_id = x.client_id AND p.pid = x.pid AND p.win = x.win
  JOIN (SELECT client_id, pid, {win} AS win, arg_max(CAST(mp_common AS DOUBLE) / mp_size, t) AS mempool_free FROM fx_1s GROUP BY 1, 2, 3) m
  ON p.client_id = m.client_id AND p.pid = m.pid AND p.win = m.win WHERE p.port = '0'""")


_stat_cte("ora_stat", "ora_port10", "ora_x10", W10, "JOIN")
_stat_cte("ora_stat300", "ora_port300", "ora_x300", W300, "LEFT JOIN")


@query("window_statistic", f"""SELECT client_id, pid, win, samples, samples5 AS samples_5s, dt AS window_seconds, dt5 AS window_seconds_5s,
  t_start, t_end, TRUE AS is_alive, round({per_sec('d_ip')}, 6) AS rx_pps, round(imbalance_ratio, 6) AS imbalance_ratio,
  round(mempool_free, 6) AS mempool_free, rx_good, round(heap_free_ratio, 6) AS heap_free_ratio, round(heap_frag, 6) AS heap_frag,
  active_lcores, round(cpu_avg, 6) AS avg_usage, round(cpu_max, 6) AS max_usage, hot_lcore AS hottest_lcore FROM ora_stat""")
def window_statistic(spark, sf):
    s = T.window_statistic(I.records_1s(spark, sf), I.records_5s(spark, sf))
    return tidy(s.select(*T.WINDOW, "samples", "samples_5s", "window_seconds", "window_seconds_5s", "t_start", "t_end", "is_alive",
                         "rx_pps", "imbalance_ratio", "mempool_free", "rx_good", "heap_free_ratio", "heap_frag", "active_lcores",
                         "avg_usage", "max_usage", "hottest_lcore"))


cte("ora_allpairs", f"""SELECT client_id, pid, win, t, port, CAST(t - pt AS DOUBLE) AS dt,
  CAST(greatest(ip - pip, 0) AS DOUBLE) / CAST(t - pt AS DOUBLE) AS pps FROM (
  SELECT client_id, pid, {W10} AS win, t, CASE WHEN p0_ip >= p1_ip THEN '0' ELSE '1' END AS port, greatest(p0_ip, p1_ip) AS ip,
  CASE WHEN p0_ip >= p1_ip THEN LAG(p0_ip) OVER w ELSE LAG(p1_ip) OVER w END AS pip, LAG(t) OVER w AS pt
  FROM fx_1s WINDOW w AS (PARTITION BY client_id, pid, {W10} ORDER BY t)) p
  WHERE pt IS NOT NULL""")
cte("ora_pairs", "SELECT * FROM ora_allpairs WHERE dt <= 3 AND pps <= 1e7")
cte("ora_ema", """SELECT client_id, pid, win, ts, [list_reduce(list_slice(ps, 1, i), lambda a, b: CAST(0.3 AS DOUBLE) * b + CAST(0.7 AS DOUBLE) * a)
  for i in range(1, len(ps) + 1)] AS ema FROM (SELECT client_id, pid, win, list(t ORDER BY t) AS ts, list(pps ORDER BY t) AS ps
  FROM ora_pairs GROUP BY client_id, pid, win) g""")
cte("ora_half", "SELECT client_id, pid, win, ema, len(ema) AS n, CAST(floor(len(ema) / 2.0) AS BIGINT) AS mid, list_avg(ema) AS m FROM ora_ema")
cte("ora_series", """SELECT client_id, pid, win, n AS points, list_max(ema) AS peak,
  CASE WHEN m >= 1 THEN sqrt(list_sum(list_transform(ema, lambda x: (x - m) * (x - m))) / n) / m ELSE 0.0 END AS jitter,
  CASE WHEN n < 6 THEN 'unknown' WHEN list_max(ema) < 5 THEN 'stable' WHEN list_avg(ema[1:mid]) < 1e-6 THEN 'unknown'
    WHEN list_avg(ema[mid + 1:n]) / list_avg(ema[1:mid]) > 1.2 THEN 'increasing_fast'
    WHEN list_avg(ema[mid + 1:n]) / list_avg(ema[1:mid]) < 0.8 THEN 'decreasing_fast' ELSE 'stable' END AS short_trend FROM ora_half""")


@query("pps_series", "SELECT client_id, pid, win, t, port, dt, round(pps, 6) AS pps, dt <= 3 AND pps <= 1e7 AS valid FROM ora_allpairs")
def pps_series(spark, sf):
    return tidy(T.pps_pairs(I.records_1s(spark, sf)))


@query("ema_smooth", """SELECT client_id, pid, win, unnest(ts) AS t, unnest(ema) AS ema FROM ora_ema""")
def ema_smooth(spark, sf):
    e = T.ema_smooth(T.pps_series(I.records_1s(spark, sf)))
    z = e.select(*T.WINDOW, F.explode(F.arrays_zip("ts", "ema")).alias("z"))
    return z.select(*T.WINDOW, F.col("z.ts").alias("t"), F.col("z.ema").alias("ema"))


@query("jitter", "SELECT client_id, pid, win, points, round(jitter, 6) AS jitter FROM ora_series")
def jitter(spark, sf):
    return tidy(T.series_summary(I.records_1s(spark, sf)).select(*T.WINDOW, "points", "jitter"))


@query("short_trend", "SELECT client_id, pid, win, points, short_trend FROM ora_series")
def short_trend(spark, sf):
    return tidy(T.series_summary(I.records_1s(spark, sf)).select(*T.WINDOW, "points", "short_trend"))


# ---- dashboard ----------------------------------------------------------------------------------------------

cte("ora_pct", """SELECT client_id, pid, t, 'mempool' AS category, 'mbuf_pool' AS name, CAST(mp_common + mp_cache AS DOUBLE) / mp_size * 100 AS value FROM fx_1s
  UNION ALL SELECT client_id, pid, t, 'heap', 'socket_0', CAST(heap_free AS DOUBLE) / heap_size * 100 FROM fx_5s""")
_D = {"rx_pps": ("traffic", "p0_ip", 1), "tx_pps": ("traffic", "p0_op", 1), "rx_bps": ("traffic", "p0_ib", 8), "tx_bps": ("traffic", "p0_ob", 8),
      "rx_ierrors": ("errors", "p0_ie", 1), "rx_nombuf": ("errors", "p0_nb", 1)}
cte("ora_deltas", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT client_id, pid, t, '{cat}' AS category, '{n}' AS name, CAST(({c} - LAG({c}) OVER (PARTITION BY client_id, pid ORDER BY t)) * {k} AS DOUBLE) AS value FROM fx_1s"
    for n, (cat, c, k) in _D.items())
    + " UNION ALL SELECT client_id, pid, t, 'rx_missed', 'rx_missed', CAST(x_missed - LAG(x_missed) OVER (PARTITION BY client_id, pid ORDER BY t) AS DOUBLE) FROM fx_5s) d WHERE value IS NOT NULL")
cte("ora_qdeltas", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT client_id, pid, t, 'queue_distribution' AS category, 'queue_{i}' AS name, CAST(p0_q{i} - LAG(p0_q{i}) OVER (PARTITION BY client_id, pid ORDER BY t) AS DOUBLE) AS value FROM fx_1s"
    for i in range(4)) + ") q WHERE value > 0")
cte("ora_lcs", " UNION ALL ".join(
    f"SELECT client_id, pid, t, 'lcore_usage' AS category, 'lcore_{i + 1}' AS name, CAST(rtrim(lc{i}, '%') AS DOUBLE) AS value FROM fx_5s" for i in range(3)))
cte("ora_dash", """SELECT client_id, pid, t, category, name, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id, pid, category, name ORDER BY t DESC) AS rn FROM (
  SELECT *, 300 AS cap FROM ora_deltas WHERE category <> 'rx_missed' UNION ALL SELECT *, 300 FROM ora_qdeltas
  UNION ALL SELECT *, 300 FROM ora_pct WHERE category = 'mempool' UNION ALL SELECT *, 180 FROM ora_deltas WHERE category = 'rx_missed'
  UNION ALL SELECT *, 180 FROM ora_lcs UNION ALL SELECT *, 180 FROM ora_pct WHERE category = 'heap') u) r WHERE rn <= cap""")
_SER = "SELECT client_id, pid, t, category, name, round(value, 6) AS value FROM "


@query("dash_pool_heap_pct", _SER + "ora_pct")
def dash_pool_heap_pct(spark, sf):
    return tidy(T.dash_pool_heap_pct(I.records_1s(spark, sf), I.records_5s(spark, sf)))


@query("dash_counter_deltas", _SER + "ora_deltas")
def dash_counter_deltas(spark, sf):
    return tidy(T.dash_counter_deltas(I.records_1s(spark, sf), I.records_5s(spark, sf)))


@query("dash_queue_deltas", _SER + "ora_qdeltas")
def dash_queue_deltas(spark, sf):
    return tidy(T.dash_queue_deltas(I.records_1s(spark, sf)))


@query("dash_lcore_series", _SER + "ora_lcs")
def dash_lcore_series(spark, sf):
    return tidy(T.dash_lcore_series(I.records_5s(spark, sf)))


@query("ring_buffer_last_n", _SER + """(SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id, pid, name ORDER BY t DESC) AS rn
  FROM ora_deltas WHERE category <> 'rx_missed') x WHERE rn <= 300""")
def ring_buffer_last_n(spark, sf):
    s = T.dash_counter_deltas(I.records_1s(spark, sf), I.records_5s(spark, sf)).where("category <> 'rx_missed'")
    return tidy(T.ring_buffer_last_n(s, fixed.RING_1S))


@query("instance_dashboard", _SER + "ora_dash")
def instance_dashboard(spark, sf):
    return tidy(T.dashboard_series(I.records_1s(spark, sf), I.records_5s(spark, sf)))


cte("ora_export", """SELECT client_id, pid, category, name, COUNT(*) AS points, MIN(t) AS first_t, MAX(t) AS last_t,
  string_agg(concat(CAST(t AS VARCHAR), '=', CAST(CAST(floor(value * 1000 + 0.5) AS BIGINT) AS VARCHAR)), ',' ORDER BY t) AS series
  FROM ora_dash GROUP BY client_id, pid, category, name""")


@query("series_export", "SELECT * FROM ora_export")
def series_export(spark, sf):
    from fleetscope.sources.records import series_export as export
    d = export(T.dashboard_series(I.records_1s(spark, sf), I.records_5s(spark, sf)))
    text = F.transform("points", lambda p: F.concat(
        p["timestamp"].cast("string"), F.lit("="), F.floor(p["value"] * 1000 + 0.5).cast("bigint").cast("string")))
    return d.select("client_id", "pid", "category", "name", F.size("points").cast("bigint").alias("points"),
                    F.element_at("points", 1)["timestamp"].alias("first_t"), F.element_at("points", -1)["timestamp"].alias("last_t"),
                    F.array_join(text, ",").alias("series"))


@query("xstats_normalize", """SELECT event_id, v AS good, k AS missed FROM fx_e""")
def xstats_normalize(spark, sf):
    e = I.events(spark, sf)
    text = F.when(F.col("k") % 2 == 0, F.format_string(
        '{"rx_good_packets": %d, "rx_missed_errors": %d}', "v", "k")).otherwise(F.format_string(
            '[{"name": "rx_good_packets", "value": %d}, {"name": "rx_missed_errors", "value": %d}]', "v", "k"))
    x = T.xstats_normalize(e.withColumn("xstats_json", text))
    return x.select("event_id", F.col("xstats")["rx_good_packets"].alias("good"), F.col("xstats")["rx_missed_errors"].alias("missed"))


@query("optional_device_stats", """SELECT client_id, pid, t, 'dma_stats' AS kind, 'dma0' AS device, 'submitted' AS counter, p0_ip AS value FROM fx_1s WHERE mp_cache < 50
  UNION ALL SELECT client_id, pid, t, 'dma_stats', 'dma0', 'completed', p0_op FROM fx_1s WHERE mp_cache < 50
  UNION ALL SELECT client_id, pid, t, 'ipsec_stats', 'sa0', 'errors', p0_ie FROM fx_1s WHERE mp_cache >= 80""")
def optional_device_stats(spark, sf):
    f = I.flat_1s(spark, sf)
    dma = F.create_map(F.lit("dma0"), F.create_map(F.lit("submitted"), F.col("p0_ip"), F.lit("completed"), F.col("p0_op")))
    sa = F.create_map(F.lit("sa0"), F.create_map(F.lit("errors"), F.col("p0_ie")))
    r = f.select("client_id", "pid", "t", F.when(F.col("mp_cache") < 50, dma).alias("dma_stats"),
                 F.when(F.col("mp_cache") >= 80, sa).alias("ipsec_stats"))
    return T.optional_device_stats(r)


# ---- features ----------------------------------------------------------------------------------------------

@query("threshold_label", f"""SELECT client_id, pid, t, {label('k', [(10, 'low'), (50, 'mid'), (80, 'top')])} AS steps,
  CASE WHEN p < 1000 THEN 'low' WHEN p < 1000000 THEN 'medium' ELSE 'high' END AS lvl FROM (SELECT client_id, pid, t, mp_cache AS k, p0_ip AS p FROM fx_1s) f""")
def threshold(spark, sf):
    f = I.flat_1s(spark, sf)
    return f.select("client_id", "pid", "t", threshold_label("mp_cache", [(10, "low"), (50, "mid"), (80, "top")]).alias("steps"),
                    level("p0_ip", 1e3, 1e6).alias("lvl"))


def _trend(r, up, down):
    return f"CASE WHEN {r} > {up} THEN 'increasing' WHEN {r} < {down} THEN 'decreasing' ELSE 'stable' END"


cte("ora_traffic0", f"""SELECT s.*, {per_sec('d_ip')} AS rx_pps, {per_sec('d_op')} AS tx_pps, {div('d_ib', 'd_ip')} AS avg_size,
  CASE WHEN rx_good > 0 THEN {per_sec('rx_good', 'dt5')} ELSE 0.0 END AS rx_pps_5s, coalesce(e.points, 0) AS points, coalesce(e.peak, 0.0) AS peak,
  e.jitter AS j0, e.short_trend AS st0 FROM ora_stat s LEFT JOIN ora_series e ON s.client_id = e.client_id AND s.pid = e.pid AND s.win = e.win""")
cte("ora_traffic1", """SELECT *, CASE WHEN rx_pps < 1000 THEN 'low' WHEN rx_pps < 1000000 THEN 'medium' ELSE 'high' END AS traffic_level,
  rx_pps < 1000 AND peak < 10 AS quiet FROM ora_traffic0""")
cte("ora_traffic", f"""SELECT *, CASE WHEN traffic_level = 'low' THEN 'stable' WHEN rx_jitter > 0.5 THEN 'unstable' WHEN rx_jitter > 0.2 THEN 'slightly_unstable' ELSE 'stable' END AS stability,
  CASE WHEN rx_pps < 10 THEN 'stable' WHEN rx_pps_5s > 0 THEN {_trend('(rx_pps + 1e-6) / (rx_pps_5s + 1e-6)', 1.2, 0.8)} ELSE 'unknown' END AS trend,
  CASE WHEN avg_size < 128 THEN 'small' WHEN avg_size > 1000 THEN 'large' ELSE 'normal' END AS packet_type
  FROM (SELECT *, CASE WHEN quiet THEN 0.0 ELSE coalesce(j0, 0.0) END AS rx_jitter, CASE WHEN quiet THEN 'stable' ELSE coalesce(st0, 'unknown') END AS short_trend FROM ora_traffic1) q""")


@query("traffic_features", """SELECT client_id, pid, win, round(rx_pps, 6) AS rx_pps, round(rx_pps_5s, 6) AS rx_pps_5s, traffic_level,
  round(rx_jitter, 6) AS rx_jitter, stability, short_trend, trend, packet_type FROM ora_traffic""")
def traffic_features(spark, sf):
    x = FE.traffic_features(FE.window_inputs(I.records_1s(spark, sf), I.records_5s(spark, sf)))
    return tidy(x.select(*T.WINDOW, "rx_pps", "rx_pps_5s", "traffic_level", "rx_jitter", "stability", "short_trend", "trend", "packet_type"))


def _status_cte(name, source, mem_ratio):
    cte(name, f"""SELECT *, {label('imbalance_ratio', fixed.QUEUE_STEPS)} AS queue_status, {label('mempool_free', fixed.MEMPOOL_STEPS)} AS mem_status,
  CASE WHEN {mem_ratio} <> 0 THEN {_trend(mem_ratio, 1.3, 0.7)} ELSE 'unknown' END AS mem_trend,
  {label('heap_free_ratio', fixed.HEAP_STEPS)} AS heap_status, {label('cpu_avg', fixed.CPU_STEPS)} AS cpu_status, 'stable' AS cpu_trend,
  d_ie + d_oe + d_nb * 10 + rx_missed * 5 AS error_score, {label('(d_ie + d_oe + d_nb * 10 + rx_missed * 5)', fixed.ERROR_STEPS)} AS error_severity FROM {source}""")


_status_cte("ora_status", "ora_traffic", div("mempool_free", "mempool_free"))


@query("queue_mem_heap_cpu_status", """SELECT client_id, pid, win, queue_status, mem_status, mem_trend, heap_status, cpu_status, cpu_trend, hot_lcore FROM ora_status""")
def queue_mem_heap_cpu_status(spark, sf):
    s = FE.resource_status(T.window_statistic(I.records_1s(spark, sf), I.records_5s(spark, sf)))
    return tidy(s.select(*T.WINDOW, "queue_status", "mem_status", "mem_trend", "heap_status", "cpu_status", "cpu_trend", "hot_lcore"))


@query("error_severity", """SELECT client_id, pid, win, d_ie AS rx_errors, d_oe AS tx_errors, d_nb AS nombuf, rx_missed AS missed,
  CAST(error_score AS BIGINT) AS error_score, error_severity FROM ora_status""")
def error_severity(spark, sf):
    s = FE.error_severity(T.window_statistic(I.records_1s(spark, sf), I.records_5s(spark, sf)))
    return tidy(s.select(*T.WINDOW, "rx_errors", "tx_errors", "nombuf", "missed", "error_score", "error_severity"))


def _when(test, text):
    return f"CASE WHEN {test} THEN '{text}' END"


def _labels_cte(prefix, status):
    t, g = fixed.INSIGHT, fixed.RISK_TAGS
    calm = "(error_severity = 'none' AND queue_status = 'balanced')"
    shaky = f"(stability = 'unstable' AND NOT ({calm} AND mem_status = 'healthy'))"
    hidden = f"(traffic_level = 'low' AND {calm})"
    say = [_when("mem_status = 'critical'", t["mem"]), _when("queue_status <> 'balanced'", t["queue"]), _when("cpu_status = 'high'", t["cpu"]),
           _when("error_severity IN ('medium', 'high')", t["errors"]), _when("trend = 'increasing'", t["traffic_up"]),
           _when("mem_trend = 'decreasing'", t["mem_down"]), _when("cpu_trend = 'increasing'", t["cpu_up"]),
           _when("short_trend = 'increasing_fast'", t["burst_up"]), _when("short_trend = 'decreasing_fast' AND points / 10.0 > 0.6", t["burst_down"]),
           _when(f"{shaky} AND NOT {hidden}", t["unstable"]), _when("heap_status = 'critical'", t["heap_out"]),
           _when("heap_status = 'warning'", t["heap_low"]), _when("heap_frag > 0.5", t["heap_frag"])]
    cte(f"{prefix}_ins", f"""SELECT *, CASE WHEN said = '' AND NOT {shaky} THEN '{t['normal']}' ELSE said END AS insight
  FROM (SELECT *, concat_ws('|', {', '.join(say)}) AS said FROM {status}) i""")
    pt = lambda c, v, n: f"CASE WHEN {c} = '{v}' THEN {n} ELSE 0 END"
    cte(f"{prefix}_risk0", f"""SELECT *, {pt('mem_status', 'critical', 50)} + {pt('mem_status', 'warning', 20)} + {pt('mem_trend', 'decreasing', 30)} + least(d_nb * 10, 100) AS r_mem,
  {pt('cpu_status', 'high', 30)} + {pt('cpu_trend', 'increasing', 20)} AS r_cpu, {pt('queue_status', 'severe_skew', 20)} + {pt('queue_status', 'slight_skew', 10)} AS r_queue,
  {pt('trend', 'increasing', 10)} + {pt('traffic_level', 'high', 10)} AS r_traffic,
  {pt('heap_status', 'critical', 40)} + {pt('heap_status', 'warning', 15)} + CASE WHEN heap_frag > 0.5 THEN 10 ELSE 0 END AS r_heap, least(error_score, 100) AS r_err FROM {prefix}_ins""")
    cte(f"{prefix}_risk", f"""SELECT *, CAST(least(r_mem + r_cpu + r_queue + r_traffic + r_heap + r_err, 100) AS BIGINT) AS risk_score,
  {label('least(r_mem + r_cpu + r_queue + r_traffic + r_heap + r_err, 100)', fixed.RISK_STEPS)} AS risk_level FROM {prefix}_risk0""")
    tags = [_when("mem_status = 'critical' AND mem_trend = 'decreasing'", g["mem_imminent"]), _when("mem_status = 'warning' AND mem_trend = 'decreasing'", g["mem_risk"]),
            _when("cpu_status = 'high' AND cpu_trend = 'increasing'", g["cpu"]), _when("queue_status = 'severe_skew' AND trend = 'increasing'", g["queue"]),
            _when("d_nb > 0 AND mem_status <> 'healthy'", g["mbuf"]), _when("traffic_level = 'high' AND trend = 'increasing'", g["surge"]),
            _when("heap_status IN ('critical', 'warning')", g["heap"])]
    parts = [f"CASE WHEN {c} <> 0 THEN concat('{n}=', CAST(CAST({c} AS BIGINT) AS VARCHAR)) END" for n, c in
             zip(FE.RISK_PARTS, ("r_mem", "r_cpu", "r_queue", "r_traffic", "r_heap", "r_err"))]
    cte(f"{prefix}", f"SELECT *, concat_ws('|', {', '.join(tags)}) AS risk, concat_ws('|', {', '.join(parts)}) AS risk_breakdown FROM {prefix}_risk")


_labels_cte("ora_feat", "ora_status")


def breakdown_text(c="risk_breakdown"):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string"))), "|")


def features(spark, sf):
    return FE.log_features(I.records_1s(spark, sf), I.records_5s(spark, sf))


@query("insights", "SELECT client_id, pid, win, insight FROM ora_feat")
def insights(spark, sf):
    return tidy(features(spark, sf).select(*T.WINDOW, "insight"))


@query("risk_score", """SELECT client_id, pid, win, CAST(r_mem AS BIGINT) AS risk_mempool, CAST(r_cpu AS BIGINT) AS risk_cpu, CAST(r_queue AS BIGINT) AS risk_queue,
  CAST(r_traffic AS BIGINT) AS risk_traffic, CAST(r_heap AS BIGINT) AS risk_heap, CAST(r_err AS BIGINT) AS risk_errors, risk_score, risk_level FROM ora_feat""")
def risk_score(spark, sf):
    return tidy(features(spark, sf).select(*T.WINDOW, *[f"risk_{p}" for p in FE.RISK_PARTS], "risk_score", "risk_level"))


@query("risk_tags_breakdown", "SELECT client_id, pid, win, risk, risk_breakdown FROM ora_feat")
def risk_tags_breakdown(spark, sf):
    return tidy(features(spark, sf).select(*T.WINDOW, "risk", breakdown_text().alias("risk_breakdown")))


FEATURE_SQL = """client_id, pid, win, dt AS window_seconds, dt5 AS window_seconds_5s, TRUE AS is_alive, round(rx_pps, 6) AS rx_pps, round(tx_pps, 6) AS tx_pps,
  traffic_level, trend, short_trend, stability, packet_type, round(imbalance_ratio, 6) AS imbalance_ratio, queue_status, round(mempool_free, 6) AS mempool_free, mem_status,
  mem_trend, round(heap_free_ratio, 6) AS heap_free, round(heap_frag, 6) AS heap_frag, heap_status, round(cpu_avg, 6) AS cpu_avg, cpu_status, cpu_trend, hot_lcore,
  d_ie AS rx_errors, d_oe AS tx_errors, d_nb AS nombuf, rx_missed AS missed, error_severity, insight, risk, risk_score, risk_level, risk_breakdown"""


def feature_output(df):
    return tidy(df.select(*FE.FEATURE_COLUMNS).withColumn("risk_breakdown", breakdown_text()))


@query("log_features", f"SELECT {FEATURE_SQL} FROM ora_feat")
def log_features(spark, sf):
    return feature_output(features(spark, sf))


cte("ora_ref", f"""SELECT client_id, pid, win, {per_sec('d_ip')} AS rx_pps, {per_sec('d_op')} AS tx_pps, d_ie AS rx_errors, d_oe AS tx_errors, d_nb AS nombuf,
  coalesce(rx_missed, 0) AS missed, imbalance_ratio AS queue_imbalance, mempool_free, coalesce(heap_free_ratio, 1.0) AS heap_free, coalesce(heap_frag, 0.0) AS heap_frag,
  coalesce(cpu_avg, 0.0) AS cpu_avg, coalesce(cpu_max, 0.0) AS cpu_max, dt AS window_seconds, samples AS sample_count FROM ora_stat300""")
_REF_D = ["rx_pps", "tx_pps", "queue_imbalance", "mempool_free", "heap_free", "heap_frag", "cpu_avg", "cpu_max"]
_REF_I = ["rx_errors", "tx_errors", "nombuf", "missed", "window_seconds", "sample_count"]


def baseline(spark, sf):
    return FE.reference_features(I.records_1s(spark, sf), I.records_5s(spark, sf))


@query("reference_features", "SELECT client_id, pid, win, " + ", ".join(f"round({c}, 6) AS {c}" for c in _REF_D) + ", " + ", ".join(_REF_I) + " FROM ora_ref")
def reference_features(spark, sf):
    return tidy(baseline(spark, sf))


cte("ora_asof", "SELECT f.*, r.win AS ref_win, " + ", ".join(f"r.{c} AS ref_{c}" for c in _REF_D + _REF_I) + """ FROM ora_feat f LEFT JOIN ora_ref r
  ON f.client_id = r.client_id AND f.pid = r.pid AND r.win = (SELECT MAX(b.win) FROM ora_ref b WHERE b.client_id = f.client_id AND b.pid = f.pid
    AND b.win <= f.win AND b.win >= f.win - 300)""")


def features_with_baseline(spark, sf):
    return FE.baseline_asof(features(spark, sf), baseline(spark, sf))


@query("baseline_asof", "SELECT client_id, pid, win, ref_win, " + ", ".join(f"round(ref_{c}, 6) AS ref_{c}" for c in _REF_D)
       + ", " + ", ".join(f"ref_{c}" for c in _REF_I) + " FROM ora_asof")
def baseline_asof(spark, sf):
    return tidy(features_with_baseline(spark, sf).select(*T.WINDOW, "ref_win", *[f"ref_{c}" for c in _REF_D + _REF_I]))


@query("log_summary_tool", """SELECT a.client_id, a.pid, a.seconds, f.win, f.risk_score, f.risk_level, f.insight, CASE WHEN f.win IS NULL THEN 'unknown client or process' END AS message
  FROM (SELECT client_id, pid, pid % 250 AS seconds FROM fx_instances WHERE pid % 250 >= 1) a LEFT JOIN (SELECT *, MAX(win) OVER (PARTITION BY client_id, pid) AS newest FROM ora_feat) f
  ON f.client_id = a.client_id AND f.pid = a.pid AND f.win > f.newest - a.seconds
  UNION ALL SELECT client_id, pid, pid % 250, NULL, NULL, NULL, NULL, 'seconds must be within 1..' FROM fx_instances WHERE pid % 250 < 1""")
def log_summary_tool(spark, sf):
    """Requests: every instance with a span taken from its number; some are out of range, some unknown."""
    inst = I.view(spark, sf, "fx_instances")
    req = inst.select("client_id", "pid", (F.col("pid") % 250).alias("seconds"))
    out = FE.log_summary(I.records_1s(spark, sf), I.records_5s(spark, sf), req)
    return tidy(out.select("client_id", "pid", "seconds", "win", "risk_score", "risk_level", "insight", "message"))
