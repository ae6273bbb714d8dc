"""Registered queries: call graph, signatures, patterns, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.scalars import in_list
from fleetscope.operators import crash_graph as G
from fleetscope.operators import crash_rules as X
from fleetscope.operators import crash_text as C
from fleetscope.plans import inputs as I
from fleetscope.plans.common import tidy
from fleetscope.plans.q_crash_text import CRASH_TYPE_SQL, gdb, gdb_frames, idle
from fleetscope.plans.registry import ORACLES, cte, query

_ok = f"func NOT IN ({in_list(fixed.INVALID_FUNCS)})"
cte("ora_canon0", f"""SELECT *, ROW_NUMBER() OVER w - 1 AS exec_depth, LAG(func) OVER w AS caller FROM fx_frames WHERE {_ok} WINDOW w AS (PARTITION BY dump_id, tid ORDER BY gdb_idx DESC)""")
cte("ora_canon", "SELECT * FROM ora_canon0 WHERE caller IS NULL OR caller <> func")
cte("ora_main", "SELECT * FROM ora_canon WHERE tid = 0")
cte("ora_edges", "SELECT dump_id, tid, exec_depth, caller, func AS callee FROM ora_canon WHERE caller IS NOT NULL")
cte("ora_cf", "SELECT dump_id, arg_max(func, exec_depth) AS crash_function FROM ora_main GROUP BY dump_id")


def canon(spark, sf):
    """The ordered stacks as a stored table: every graph operator reads it instead of ordering the frames again."""
    return I.stored(spark, sf, "stacks", lambda: G.exec_order(I.frames(spark, sf).drop("k")))


@query("idle_filter", f"""SELECT dump_id, tid, gdb_idx, func, address FROM fx_frames f WHERE NOT EXISTS (SELECT 1 FROM fx_frames g WHERE g.dump_id = f.dump_id AND g.tid = f.tid AND {idle('g.func')})""")
def idle_filter(spark, sf):
    return G.idle_filter(I.frames(spark, sf).drop("k"), C.is_idle("func"))


@query("subsystems", "SELECT dump_id, concat_ws('|', " + ", ".join(f"CASE WHEN bool_or(regexp_matches(func, '{p}')) THEN '{n}' END" for n, p in fixed.SUBSYSTEMS.items())
       + ") AS subsystems FROM fx_frames GROUP BY dump_id")
def subsystems(spark, sf):
    return tidy(G.dump_subsystems(I.frames(spark, sf)))


@query("exec_order", "SELECT dump_id, tid, gdb_idx, func, address, exec_depth, caller FROM ora_canon")
def exec_order(spark, sf):
    return G.exec_order(I.frames(spark, sf).drop("k"))


@query("call_edges", "SELECT * FROM ora_edges")
def call_edges(spark, sf):
    return G.call_edges(canon(spark, sf))


cte("ora_graph", "SELECT *, COUNT(*) OVER (PARTITION BY dump_id, caller) AS callees FROM (SELECT DISTINCT dump_id, caller, callee FROM ora_edges) e")


@query("call_graph", "SELECT * FROM ora_graph")
def call_graph(spark, sf):
    return G.call_graph(canon(spark, sf))


@query("call_hotspots", "SELECT dump_id, caller, callees, callee FROM ora_graph WHERE callees >= 3")
def call_hotspots(spark, sf):
    return tidy(G.call_hotspots(canon(spark, sf)))


@query("reciprocal_edges", """SELECT * FROM ora_edges e WHERE EXISTS (SELECT 1 FROM ora_edges r WHERE r.dump_id = e.dump_id AND r.tid = e.tid AND r.caller = e.callee AND r.callee = e.caller AND r.exec_depth < e.exec_depth)""")
def reciprocal_edges(spark, sf):
    return G.reciprocal_edges(canon(spark, sf))


@query("crash_signature", f"""SELECT dump_id, tid, COUNT(*) AS frames, CAST(SUM(CAST('0x' || substr(md5(concat(CAST(r AS VARCHAR), ':', func)), 1, 12) AS BIGINT)) AS BIGINT) AS digest,
  string_agg(func, ' < ' ORDER BY exec_depth DESC) FILTER (WHERE r <= 20) AS signature FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dump_id, tid ORDER BY exec_depth DESC) AS r FROM ora_canon
  WHERE NOT regexp_matches(func, '{'|'.join(fixed.SIGNATURE_SKIPS)}')) x GROUP BY dump_id, tid""")
def crash_signature(spark, sf):
    return G.crash_signature(canon(spark, sf))


@query("common_frames", """SELECT f.dump_id, f.func FROM (SELECT dump_id, func, COUNT(DISTINCT tid) AS n FROM ora_canon GROUP BY dump_id, func) f
  JOIN (SELECT dump_id, COUNT(DISTINCT tid) AS t FROM ora_canon GROUP BY dump_id) d ON f.dump_id = d.dump_id WHERE n = t""")
def common_frames(spark, sf):
    return G.common_frames(canon(spark, sf))


cte("ora_seq", "SELECT dump_id, tid, COUNT(*) AS frames, string_agg(func, '>' ORDER BY exec_depth) AS seq FROM ora_canon GROUP BY dump_id, tid")


@query("distinct_stacks", """SELECT a.dump_id, a.tid, a.frames, coalesce(a.seq = m.seq, FALSE) AS same_as_main FROM ora_seq a LEFT JOIN ora_seq m ON m.dump_id = a.dump_id AND m.tid = 0""")
def distinct_stacks(spark, sf):
    return G.distinct_stacks(canon(spark, sf)).select("dump_id", "tid", "frames", "same_as_main")


def starts(c, prefixes):
    return "(" + " OR ".join(f"starts_with({c}, '{p}')" for p in prefixes) + ")"


def layer(c):
    return (f"CASE WHEN {c} IN ({in_list(fixed.NOISE_NAMES)}) THEN 'noise' WHEN {starts(c, fixed.LIBC_PREFIXES)} THEN 'libc' WHEN {starts(c, fixed.PMD_PREFIXES)} THEN 'dpdk_pmd' "
            f"WHEN {starts(c, fixed.EAL_PREFIXES)} OR {c} IN ({in_list(fixed.EAL_NAMES)}) THEN 'dpdk_eal' WHEN starts_with({c}, 'rte_') THEN 'dpdk_lib' ELSE 'user_app' END")


def gtype(c, crash):
    return f"CASE WHEN {c} = {crash} THEN 'crash' ELSE CASE {layer(c)} WHEN 'noise' THEN 'libc' WHEN 'libc' THEN 'libc' WHEN 'user_app' THEN 'user' ELSE 'dpdk' END END"


@query("frame_layer", f"""SELECT f.dump_id, f.tid, f.gdb_idx, f.func, {layer('f.func')} AS layer, {gtype('f.func', "coalesce(c.crash_function, '')")} AS type FROM fx_frames f LEFT JOIN ora_cf c ON f.dump_id = c.dump_id""")
def frame_layer(spark, sf):
    f = I.frames(spark, sf)
    x = f.join(G.crash_function(canon(spark, sf)), "dump_id", "left")
    return x.select("dump_id", "tid", "gdb_idx", "func", G.frame_layer("func").alias("layer"),
                    G.graph_type("func", F.coalesce("crash_function", F.lit(""))).alias("type"))


_META = """dump_id, CASE MAX(k) % 3 WHEN 0 THEN 'SIGSEGV' WHEN 1 THEN 'SIGABRT' ELSE 'SIGFPE' END AS signal_name, CASE MIN(k) % 2 WHEN 0 THEN 'anonymous' ELSE '/opt/bin/app' END AS region,
  concat('0x', {HEX(SUM(k) * 20)HEX}) AS fault_addr"""
cte("ora_meta", "SELECT " + _META.replace("{HEX(SUM(k) * 20)HEX}", "lower(to_hex(CAST(SUM(k) * 20 AS BIGINT)))") + " FROM fx_frames GROUP BY dump_id")


def dump_meta(spark, sf):
    return spark.sql("SELECT " + _META.replace("{HEX(SUM(k) * 20)HEX}", "lower(hex(SUM(k) * 20))") + " FROM {f} GROUP BY dump_id", f=I.frames(spark, sf))


def has(names):
    return f"bool_or(func IN ({in_list(names)}))"


@query("crash_pattern", f"""SELECT g.dump_id, crash_function, {layer('crash_function')} AS crash_layer, signal_name, CASE WHEN mem THEN 'mempool_exhaustion' WHEN signal_name = 'SIGSEGV' AND CAST(fault_addr AS BIGINT) < 4096 THEN 'mempool_exhaustion_null_deref'
  WHEN ring AND signal_name = 'SIGABRT' THEN 'ring_assert_failure' WHEN {layer('crash_function')} = 'dpdk_pmd' THEN 'pmd_driver_crash' WHEN signal_name = 'SIGSEGV' AND region = 'anonymous' THEN 'null_ptr_in_anonymous_region'
  WHEN panic AND signal_name = 'SIGABRT' THEN 'eal_panic_abort' END AS pattern FROM (SELECT dump_id, arg_max(func, exec_depth) AS crash_function, {has(fixed.MEMPOOL_FUNCS)} AS mem, {has(fixed.RING_FUNCS)} AS ring, {has(fixed.PANIC_FUNCS)} AS panic
  FROM ora_main GROUP BY dump_id) g JOIN ora_meta m ON g.dump_id = m.dump_id""")
def crash_pattern(spark, sf):
    return G.crash_pattern(canon(spark, sf), dump_meta(spark, sf))


cte("ora_runs", f"""SELECT *, MAX(st) OVER (PARTITION BY dump_id, tid ORDER BY rk) AS run FROM (SELECT *, CASE WHEN LAG(layer) OVER w IS DISTINCT FROM layer THEN rk END AS st FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY dump_id, tid ORDER BY exec_depth) - 1 AS rk FROM (SELECT dump_id, tid, exec_depth, func, {layer('func')} AS layer FROM ora_canon) a WHERE layer <> 'noise') b
  WINDOW w AS (PARTITION BY dump_id, tid ORDER BY rk)) c""")


@query("layered_path", """SELECT dump_id, tid, run, layer, COUNT(*) AS frames, CASE WHEN COUNT(*) > 3 THEN concat(arg_min(func, rk), ' → ', MAX(CASE WHEN rk = run + 1 THEN func END), ' → … → ', arg_max(func, rk))
  ELSE string_agg(func, ' → ' ORDER BY rk) END AS path FROM ora_runs GROUP BY dump_id, tid, run, layer""")
def layered_path(spark, sf):
    return G.layered_path(canon(spark, sf))


cte("ora_mseq", "SELECT dump_id, COUNT(*) AS n, list(func ORDER BY exec_depth) AS fs FROM ora_main GROUP BY dump_id")


@query("path_summary", """SELECT dump_id, n, CASE WHEN n > 12 THEN concat(array_to_string(fs[1:3], ' → '), '  …  ', array_to_string(fs[n - 4:n], ' → ')) ELSE array_to_string(fs, ' → ') END AS path,
  CASE WHEN n > 12 THEN concat('(full depth: ', CAST(n AS VARCHAR), ', ', CAST(n - 8 AS VARCHAR), ' frames omitted)') ELSE '' END AS note FROM ora_mseq""")
def path_summary(spark, sf):
    return G.path_summary(canon(spark, sf))


@query("crash_context", f"SELECT dump_id, gdb_idx, {layer('func')} AS layer, func FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dump_id ORDER BY exec_depth DESC) AS r FROM ora_main) m WHERE r <= 8")
def crash_context(spark, sf):
    return G.crash_context(canon(spark, sf))


@query("thread_overlap", """SELECT o.dump_id, o.tid, string_agg(o.func, '|' ORDER BY o.func) AS shared FROM (SELECT DISTINCT dump_id, tid, func FROM ora_canon WHERE tid <> 0) o JOIN (
  SELECT DISTINCT dump_id, func FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dump_id ORDER BY exec_depth DESC) AS r FROM ora_main) m WHERE r <= 5) n ON o.dump_id = n.dump_id AND o.func = n.func GROUP BY o.dump_id, o.tid""")
def thread_overlap(spark, sf):
    return tidy(G.thread_overlap(canon(spark, sf)))


_noise = starts("func", fixed.GRAPH_NOISE_PREFIXES)


@query("graph_nodes", f"""SELECT n.dump_id, n.tid, concat(CAST(n.tid AS VARCHAR), '_', n.func) AS node_id, n.func, n.depth, n.address, {gtype('n.func', "coalesce(c.crash_function, '')")} AS type, n.func = coalesce(c.crash_function, '') AS is_crash FROM (
  SELECT dump_id, tid, func, MIN(exec_depth) AS depth, arg_min(address, exec_depth) AS address FROM ora_canon WHERE NOT {_noise} GROUP BY dump_id, tid, func) n LEFT JOIN ora_cf c ON n.dump_id = c.dump_id""")
def graph_nodes(spark, sf):
    return G.graph_nodes(canon(spark, sf))


@query("graph_edges_alive", f"""SELECT dump_id, tid, exec_depth, concat(CAST(tid AS VARCHAR), '_', caller) AS source, concat(CAST(tid AS VARCHAR), '_', callee) AS target FROM ora_edges
  WHERE NOT {starts('caller', fixed.GRAPH_NOISE_PREFIXES)} AND NOT {starts('callee', fixed.GRAPH_NOISE_PREFIXES)}""")
def graph_edges_alive(spark, sf):
    return G.graph_edges_alive(canon(spark, sf))


@query("crash_timeline", f"""SELECT m.dump_id, m.tid, m.exec_depth AS "order", m.func, m.address, m.tid = 0 AS is_crash_thread, m.func = coalesce(c.crash_function, '') AS is_crash FROM ora_canon m LEFT JOIN ora_cf c ON m.dump_id = c.dump_id
  WHERE NOT {_noise.replace('func', 'm.func')}""")
def crash_timeline(spark, sf):
    return G.crash_timeline(canon(spark, sf))


# registers of every address row: rdi takes plain addresses, small ones and fill patterns
_REGS = """l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, concat('0x', {HEX(addr)HEX}) AS rip, CASE l_linenumber WHEN 1 THEN '0x0' WHEN 2 THEN concat('0x', {HEX(l_suppkey)HEX}) WHEN 3 THEN concat('0xde', lpad({HEX(addr)HEX}, 14, '0'))
  WHEN 4 THEN concat('0x12cdcdcd', CASE WHEN l_quantity > 25 THEN 'cd' ELSE '01' END) WHEN 5 THEN '0xcdcdcdcd' ELSE concat('0x', {HEX(addr)HEX}) END AS rdi, CASE WHEN l_returnflag = 'A' THEN '/opt/bin/app' END AS region"""
cte("ora_regs", "SELECT " + _REGS.replace("{HEX(", "lower(to_hex(").replace(")HEX}", "))") + " FROM (SELECT *, l_partkey * 4096 + CAST(l_quantity AS BIGINT) * 64 AS addr FROM lineitem) l")
_P = fixed.POISON_BYTES
_H = "lpad(substr(rdi, 3), 16, '0')"
_POISON = ("CASE " + " ".join(f"WHEN substr({_H}, 1, 2) = '{b}' THEN '{t}'" for b, t in _P.items()) + " "
           + " ".join(f"WHEN substr({_H}, 9, 6) = '{b * 3}' AND substr({_H}, 15, 2) = '{b}' THEN '{t}'" for b, t in _P.items()) + " END")


@query("register_notes", f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(0 AS BIGINT) AS pos, 'rip' AS name, rip AS value, region AS note FROM ora_regs UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, 1, 'rdi', rdi, CASE WHEN rdi = '0x0' THEN 'NULL 指针' WHEN length(rdi) <= 5 THEN concat('近空地址 (+', rdi, ')') ELSE {_POISON} END FROM ora_regs""")
def register_notes(spark, sf):
    text = _REGS.replace("{HEX(", "lower(hex(").replace(")HEX}", "))")
    x = I.table(spark, sf, "lineitem").selectExpr("*", "l_partkey * 4096 + cast(l_quantity as bigint) * 64 as addr").selectExpr(*I._exprs(text))
    return tidy(G.register_notes(x, keep=("l_orderkey", "l_linenumber", "l_partkey")))


@query("frame_layer_table", f"SELECT dump_id, tid, gdb_idx, func, {layer('func')} AS layer FROM fx_frames")
def frame_layer_table(spark, sf):
    """The layers by a rule table."""
    return X.with_layers(I.frames(spark, sf).drop("k"), X.default_layers(spark)).select("dump_id", "tid", "gdb_idx", "func", "layer")


@query("crash_pattern_table")
def crash_pattern_table(spark, sf):
    """The patterns by rule tables."""
    return X.crash_patterns(canon(spark, sf), dump_meta(spark, sf), X.default_layers(spark), X.default_patterns(spark))


ORACLES["crash_pattern_table"] = ORACLES["crash_pattern"]


@query("stack_annotate", """SELECT w.dump_id, w.base, w."offset", w.value, f.func || ' 返回地址' AS note FROM (SELECT dump_id, 'rsp' AS base, concat('+0x', lpad(lower(to_hex((i - 1) * 8)), 4, '0')) AS "offset", value FROM (
  SELECT dump_id, unnest(ws) AS value, generate_subscripts(ws, 1) AS i FROM (SELECT dump_id, regexp_extract_all(s_rsp, '0x[0-9a-f]+')[2:] AS ws FROM ora_sec) a) b) w
  LEFT JOIN (SELECT dump_id, address, arg_max(func, idx) AS func FROM ora_fp WHERE func NOT IN ('??') AND address IS NOT NULL GROUP BY dump_id, address) f ON w.dump_id = f.dump_id AND w.value = f.address""")
def stack_annotate(spark, sf):
    s = C.with_sections(gdb(spark, sf)).select("dump_id", F.lit("rsp").alias("base"), C.stack_words("s_rsp").alias("words"))
    f = C.frame_parse(gdb_frames(spark, sf)).select("dump_id", "address", "func", (-F.col("idx")).alias("depth"))
    return G.stack_annotate(s, f)


@query("diagnosis_mode", """SELECT r.dump_id, r.raw_frames, coalesce(c.kept, 0) AS kept, CASE WHEN r.raw_frames < 3 OR (coalesce(c.kept, 0) <= 1) THEN 'env_diagnostic' ELSE 'call_chain_diagnostic' END AS mode
  FROM (SELECT dump_id, COUNT(*) AS raw_frames FROM fx_frames WHERE tid = 0 GROUP BY dump_id) r LEFT JOIN (SELECT dump_id, COUNT(*) AS kept FROM ora_main GROUP BY dump_id) c ON r.dump_id = c.dump_id""")
def diagnosis_mode(spark, sf):
    raw = I.frames(spark, sf).withColumn("source", F.lit(None).cast("string"))
    return G.diagnosis_mode(canon(spark, sf), raw).select("dump_id", "raw_frames", "kept", "mode")


@query("crash_snapshot", f"""SELECT r.dump_id, r.signal_name AS signal, t.func AS crash_point, {layer('t.func')} AS layer, t.address, regexp_extract(t.source, ':(\\d+)$', 1) AS line, r.rip, r.rdi,
  coalesce(CAST(fault_addr AS BIGINT) < 4096, FALSE) AS near_null, CASE WHEN region_name = '' THEN 'anonymous' ELSE region_name END AS region, {CRASH_TYPE_SQL} AS crash_type, t.mem AS mempool_path, h.total, h.abnormal, t.n AS frame_count
  FROM ora_region r JOIN (SELECT dump_id, arg_min(func, idx) AS func, arg_min(address, idx) AS address, arg_min(source, idx) AS source, COUNT(*) AS n, bool_or(func IN ({in_list(fixed.MEMPOOL_FUNCS)})) AS mem FROM ora_fp WHERE {_ok} GROUP BY dump_id) t ON r.dump_id = t.dump_id
  JOIN (SELECT dump_id, COUNT(*) AS total, CAST(SUM(CASE WHEN NOT crashed AND NOT is_idle THEN 1 ELSE 0 END) AS BIGINT) AS abnormal FROM ora_role GROUP BY dump_id) h ON r.dump_id = h.dump_id""")
def crash_snapshot(spark, sf):
    frames = C.frame_parse(gdb_frames(spark, sf)).select("dump_id", "idx", "func", "address", "source")
    s = G.crash_snapshot(C.parsed(gdb(spark, sf)), frames)
    return s.selectExpr(
        "dump_id", "signal.name as signal", "crash_point.function as crash_point", "crash_point.layer", "crash_point.address", "crash_point.line",
        "registers.rip", "registers.rdi", "fault.near_null", "fault.region", "analysis.crash_type", "analysis.mempool_path",
        "cast(thread_context.total as bigint) as total", "cast(size(thread_context.abnormal) as bigint) as abnormal", "frame_count")


@query("report_view", f"""SELECT p.dump_id, p.n AS frames, p.fs[p.n] AS crash_function, m.signal_name, n.nodes, e.edges, t.events FROM ora_mseq p JOIN ora_meta m ON p.dump_id = m.dump_id
  LEFT JOIN (SELECT dump_id, COUNT(*) AS nodes FROM (SELECT DISTINCT dump_id, tid, func FROM ora_canon WHERE NOT {_noise}) x GROUP BY dump_id) n ON n.dump_id = p.dump_id
  LEFT JOIN (SELECT dump_id, COUNT(*) AS edges FROM ora_edges WHERE NOT {starts('caller', fixed.GRAPH_NOISE_PREFIXES)} AND NOT {starts('callee', fixed.GRAPH_NOISE_PREFIXES)} GROUP BY dump_id) e ON e.dump_id = p.dump_id
  LEFT JOIN (SELECT dump_id, COUNT(*) AS events FROM ora_canon WHERE NOT {_noise} GROUP BY dump_id) t ON t.dump_id = p.dump_id""")
def report_view(spark, sf):
    """One row per crash: record, path length, graph and timeline sizes."""
    c = canon(spark, sf)
    count = lambda df, n: df.groupBy("dump_id").agg(F.count(F.lit(1)).alias(n))
    p = G.crash_pattern(c, dump_meta(spark, sf)).join(G.path_summary(c), "dump_id")
    for df, n in ((G.graph_nodes(c), "nodes"), (G.graph_edges_alive(c), "edges"), (G.crash_timeline(c), "events")):
        p = p.join(count(df, n), "dump_id", "left")
    return p.select("dump_id", F.col("n").alias("frames"), "crash_function", "signal_name", "nodes", "edges", "events")
