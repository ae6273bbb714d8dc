"""Registered queries: every streaming job run to the end of its input with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.operators import features as FE
from fleetscope.operators import rules as R
from fleetscope.plans import inputs as I
from fleetscope.plans.common import tidy
from fleetscope.plans.q_telemetry import baseline
from fleetscope.plans.q_rules import _cooldown_ctes
from fleetscope.plans.registry import cte, query
from fleetscope.session import scratch_dir
from fleetscope.streaming import jobs as J
from fleetscope.streaming import poll as P

HOUR = 3600


def events_stream(spark, sf):
    """The events file as a stream with the derived columns."""
    raw = J.file_stream(spark, sf, I.table(spark, sf, "events").schema, "events.parquet")
    text = I.E_COLS.replace("{EPOCH}", "unix_seconds(CAST(ts AS TIMESTAMP))").replace("{STR}", "STRING")
    return raw.selectExpr(*I._exprs(text))


def run(q):
    q.awaitTermination()


def run_and_close(spark, start, last):
    """Run a job over its input, which comes as one batch, with a clock that closes what is open behind it.

    ``last`` is a row with the seconds of the newest event. A tick in the batch of the events makes none of them late.
    """
    clock = scratch_dir(spark, "clock")
    P.tick(spark, clock, last.first()[0] + 1000 * HOUR)
    run(start(P.clock_stream(spark, clock)))


def last_second(spark, sf):
    return I.events(spark, sf).agg(F.expr("max(unix_seconds(cast(ts as timestamp)))"))


def last_record(spark, sf, scale=1):
    return I.flat_1s(spark, sf).agg(F.max("t") * scale)


def records_stream(spark, sf):
    """The stored 1 s record table as a stream; its clock is scaled to real seconds (one record second = one hour)."""
    t = I.records_1s(spark, sf)
    flat = I.flat_1s(spark, sf)
    path = I.stored_path(spark, sf, "records_1s")
    s = J.file_stream(spark, path, flat.schema)
    return I.nest_1s(s).selectExpr(*[c for c in t.columns if c != "t"], f"t * {HOUR} as t")


@query("st_ingest_latest", """SELECT client_id, pid, type, t, seq, v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id, pid, type, t ORDER BY seq DESC) AS rn FROM fx_raw WHERE type IN ('1s', '5s')) r WHERE rn = 1""")
def st_ingest_latest(spark, sf):
    out = scratch_dir(spark, "st1")
    e = events_stream(spark, sf)
    raw = e.select("client_id", "pid", F.explode(F.array(*[F.lit(x) for x in I.RAW_TYPES])).alias("type"), "t", F.col("event_id").alias("seq"), "v")
    run(J.ingest_latest(raw, out))
    return J.latest(spark, out)


_FAST = """SELECT client_id, pid, win * 3600 AS win, port, dt * 3600 AS window_seconds, samples, d_ip AS rx_packets, d_ie AS rx_errors,
  round(CASE WHEN dt > 0 THEN CAST(d_ip AS DOUBLE) / (dt * 3600) ELSE 0.0 END, 6) AS rx_pps, round(imbalance_ratio, 6) AS imbalance_ratio FROM ora_port10"""
# windows of 10 hours counted from the epoch
W10H = "10 hours"


@query("st_fast_features", _FAST)
def st_fast_features(spark, sf):
    out = scratch_dir(spark, "st2")
    run_and_close(spark, lambda clock: J.fast_features(records_stream(spark, sf), out, W10H, W10H, clock), last_record(spark, sf, HOUR))
    return tidy(J.read_output(spark, out).drop("epoch"))


@query("st_slow_features", _FAST + " WHERE win % 60 = 0")
def st_slow_features(spark, sf):
    out = scratch_dir(spark, "st3")
    run_and_close(spark, lambda clock: J.slow_features(records_stream(spark, sf), out, 60 * HOUR, W10H, W10H, clock), last_record(spark, sf, HOUR))
    return tidy(J.read_output(spark, out).drop("epoch"))


_NO_REF = ", ".join(f"'{r[0]}'" for r in fixed.ALERT_RULES if not r[3].startswith("ref"))
cte("ora_phits", f"SELECT client_id, rule_id, win AS t, pid AS event_id, cooldown_sec FROM ora_rulehits WHERE rule_id IN ({_NO_REF})")
cte("ora_phits60", "SELECT * FROM ora_phits WHERE t % 60 = 0")
_cooldown_ctes("ora_pfires", "ora_phits", "client_id, rule_id", "cooldown_sec")
_cooldown_ctes("ora_pfires60", "ora_phits60", "client_id, rule_id", "cooldown_sec")


def _poll(spark, sf, every=None):
    """Both record tables as streams, their windows, labels, rule hits and cooldowns in one query."""
    one, five, out = I.flat_1s(spark, sf), I.flat_5s(spark, sf), scratch_dir(spark, "poll")
    stream = lambda name, flat: J.file_stream(spark, I.stored_path(spark, sf, name), flat.schema)

    def start(clock):
        fires = P.poll(I.nest_1s(stream("records_1s", one)), I.nest_5s(stream("records_5s", five)), R.default_rules(spark), clock, every=every)
        return J.to_folder(fires, out)

    run_and_close(spark, start, last_record(spark, sf))
    return J.read_output(spark, out).selectExpr("client_id", "rule_id", "win as t", "pid as event_id")


@query("st_fast_poll", "SELECT client_id, rule_id, t, event_id FROM ora_pfires")
def st_fast_poll(spark, sf):
    return _poll(spark, sf)


@query("st_slow_poll", "SELECT client_id, rule_id, t, event_id FROM ora_pfires60")
def st_slow_poll(spark, sf):
    return _poll(spark, sf, 60)


@query("st_baseline", """SELECT f.client_id, f.pid, f.win, f.packets, r.win AS ref_win, round(r.rx_pps, 6) AS ref_rx_pps FROM (SELECT client_id, pid, win, MAX(t_end) AS packets FROM ora_port10 GROUP BY client_id, pid, win) f
  LEFT JOIN ora_ref r ON f.client_id = r.client_id AND f.pid = r.pid AND r.win = (SELECT MAX(b.win) FROM ora_ref b WHERE b.client_id = f.client_id AND b.pid = f.pid AND b.win <= f.win AND b.win >= f.win - 300)""")
def st_baseline(spark, sf):
    """Closed feature windows arrive as a stream and meet the stored baseline table."""
    src, out = scratch_dir(spark, "st4in"), scratch_dir(spark, "st4")
    w = I.flat_1s(spark, sf).selectExpr("client_id", "pid", "t", "cast((floor(t / 10.0D) + 1) * 10 as bigint) as win")
    w.groupBy("client_id", "pid", "win").agg(F.max("t").alias("packets")).write.parquet(src + "/w")
    stream = J.file_stream(spark, src + "/w", spark.read.parquet(src + "/w").schema)
    run(J.baseline_join(stream, baseline(spark, sf), out, FE.fixed.BASELINE_WINDOW, ["rx_pps"]))
    return tidy(J.read_output(spark, out).drop("epoch"))


@query("st_cooldown", "SELECT client_id, rule_id, t, event_id FROM ora_fires")
def st_cooldown(spark, sf):
    out = scratch_dir(spark, "st5")
    run_and_close(spark, lambda clock: J.to_folder(P.rule_cooldown(hits_stream(spark, sf), clock), out), last_record(spark, sf))
    return J.read_output(spark, out).select("client_id", "rule_id", "t", "event_id")


@query("st_severity_cooldown", "SELECT client_id, severity, t, event_id FROM ora_sfires")
def st_severity_cooldown(spark, sf):
    out = scratch_dir(spark, "st5s")
    run_and_close(spark, lambda clock: J.to_folder(P.severity_cooldown(hits_stream(spark, sf), clock), out), last_record(spark, sf))
    return J.read_output(spark, out).select("client_id", "severity", "t", "event_id")


def hits_stream(spark, sf):
    """Every event is a hit; the times of hits are those of the records."""
    return events_stream(spark, sf).selectExpr(
        "client_id", "event_type as rule_id", "case event_type when 'error' then 'critical' when 'purchase' then 'warning' else 'info' end as severity",
        "t", "event_id", "cast(case event_type when 'error' then 3 when 'purchase' then 6 else 12 end as bigint) as cooldown")


@query("st_ring_buffer", """SELECT client_id, pid, t, category, name, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id, pid, name ORDER BY t DESC) AS rn FROM (
  SELECT client_id, pid, t, 'traffic' AS category, 'packets' AS name, CAST(p0_ip AS DOUBLE) AS value FROM fx_1s) x) y WHERE rn <= 300""")
def st_ring_buffer(spark, sf):
    out = scratch_dir(spark, "st6")
    flat = I.flat_1s(spark, sf)
    s = J.file_stream(spark, I.stored_path(spark, sf, "records_1s"), flat.schema)
    run(J.ring_buffer(s.selectExpr("client_id", "pid", "t", "'traffic' as category", "'packets' as name", "cast(p0_ip as double) as value"), out))
    return J.read_ring(spark, out)


@query("st_counter_delta", """SELECT * FROM (SELECT client_id, pid, t, p0_ip - LAG(p0_ip) OVER w AS rx, p0_op - LAG(p0_op) OVER w AS tx, p0_ie - LAG(p0_ie) OVER w AS errors FROM fx_1s WINDOW w AS (PARTITION BY client_id, pid ORDER BY t)) d WHERE rx IS NOT NULL""")
def st_counter_delta(spark, sf):
    out = scratch_dir(spark, "st7")
    flat = I.flat_1s(spark, sf)
    s = J.file_stream(spark, I.stored_path(spark, sf, "records_1s"), flat.schema)
    run(J.counter_delta(s.selectExpr("client_id", "pid", "t", "p0_ip as rx", "p0_op as tx", "p0_ie as errors"), out))
    return J.read_output(spark, out).drop("epoch")


@query("st_liveness", """SELECT client_id, first_seen, dead_at, beats FROM (SELECT client_id, MIN(ts) AS first_seen, MAX(ts) + INTERVAL 30 HOUR AS dead_at, COUNT(*) AS beats FROM (
  SELECT *, SUM(brk) OVER (PARTITION BY client_id ORDER BY ts, event_id) AS sess FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY client_id ORDER BY ts, event_id) < INTERVAL 30 HOUR THEN 0 ELSE 1 END AS brk FROM fx_heartbeats) a) b
  GROUP BY client_id, sess) c""")
def st_liveness(spark, sf):
    out = scratch_dir(spark, "st8")
    h = events_stream(spark, sf).selectExpr("user_id as client_id", "ts", "event_id")
    run_and_close(spark, lambda clock: J.liveness(h, out, "30 hours", "30 hours", clock=clock), last_second(spark, sf))
    return J.read_output(spark, out).selectExpr("client_id", "cast(first_seen as timestamp_ntz) as first_seen", "cast(dead_at as timestamp_ntz) as dead_at", "beats")


@query("st_registry_sync", """SELECT client_id, pid, CASE WHEN status = 'running' THEN 'register' ELSE 'unregister' END AS action FROM fx_instances WHERE (status = 'running') <> registered""")
def st_registry_sync(spark, sf):
    """Two snapshots, each in several files and batches: first every process runs, then those with status running."""
    out, src = scratch_dir(spark, "st9"), scratch_dir(spark, "st9in")
    inst = I.view(spark, sf, "fx_instances")
    first, second = inst.selectExpr("1L as sync", "client_id", "pid"), inst.where("status = 'running'").selectExpr("2L as sync", "client_id", "pid")
    first.unionByName(second).repartition(6).write.parquet(src)
    run(J.registry_sync(J.file_stream(spark, src, "sync long, client_id string, pid long", files_per_batch=2), out))
    return J.read_registry_actions(spark, out, inst.where("registered"))


@query("st_crash_dedup", "SELECT filename, COUNT(*) AS n FROM (SELECT DISTINCT filename FROM fx_core_files) f GROUP BY filename")
def st_crash_dedup(spark, sf):
    """Every core file notice comes three times."""
    out = scratch_dir(spark, "st10")
    _, cols, _ = I._VIEWS["fx_core_files"]
    e = events_stream(spark, sf).selectExpr("ts", *I._exprs(cols.replace("{STR}", "STRING")))
    thrice = e.select("ts", "filename", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("copy")).drop("copy")
    run(J.crash_dedup(thrice, out))
    return J.read_output(spark, out).groupBy("filename").agg(F.count(F.lit(1)).alias("n"))


cte("ora_sink", "SELECT CASE WHEN escalate THEN 'escalations' ELSE 'alerts' END AS sink, event_id, client_id, rule_id FROM fx_hits")


@query("st_alert_sink", "SELECT * FROM ora_sink")
def st_alert_sink(spark, sf):
    out = scratch_dir(spark, "st11")
    hits = events_stream(spark, sf).selectExpr("event_id", "client_id", "event_type as rule_id", "event_type = 'error' and k < 30 as escalate")
    run(J.alert_sink(hits, out))
    return J.read_output(spark, out).select("sink", "event_id", "client_id", "rule_id")
