"""Registered queries: debugger text, stack tool text, logs and devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.operators import crash_text as C
from fleetscope.plans import inputs as I
from fleetscope.plans.common import tidy
from fleetscope.plans.registry import cte, query

_SIG = "CASE {n} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SIGNALS.items()) + " END"


def sig(n: str) -> str:
    return _SIG.replace("{n}", n)


def gdb(spark, sf):
    return I.view(spark, sf, "fx_gdb")


def sect(n: str) -> str:
    n = n.upper()
    return f"trim(regexp_extract(gdb_text, '(?s)=== {n}_BEGIN ===\\s*(.*?)\\s*=== {n}_END ===', 1), concat(' ', chr(10)))"


cte("ora_sec", "SELECT *, " + ", ".join(f"{sect(n)} AS s_{n}" for n in fixed.SECTIONS) + " FROM fx_gdb")


@query("core_filename", f"""SELECT event_id, split_part(filename, '.', 2) AS exe_name, CAST(split_part(filename, '.', 3) AS BIGINT) AS pid, CAST(split_part(filename, '.', 4) AS BIGINT) AS tid,
  CAST(split_part(filename, '.', 5) AS BIGINT) AS signal, coalesce({sig("split_part(filename, '.', 5)")}, 'UNKNOWN') AS signal_name,
  CAST(split_part(filename, '.', 6) AS BIGINT) AS timestamp, replace(split_part(filename, '.', 7), '!', '/') AS exe_path FROM fx_core_files""")
def core_filename(spark, sf):
    c = C.core_filename(I.view(spark, sf, "fx_core_files").select("event_id", "filename"))
    return tidy(c.drop("filename", "valid"))


@query("sections", "SELECT dump_id, " + ", ".join(f"s_{n}" for n in fixed.SECTIONS) + " FROM ora_sec")
def sections(spark, sf):
    return C.with_sections(gdb(spark, sf)).select("dump_id", *[f"s_{n}" for n in fixed.SECTIONS])


_SIGPAT = "Program (?:received|terminated with) signal (\\w+|SIG\\w+|\\d+)[,.]?\\s*(.*)?"
cte("ora_sig", f"""SELECT *, CASE WHEN regexp_matches(raw_sig, '^\\d+$') THEN coalesce({sig('raw_sig')}, concat('SIG_', raw_sig)) ELSE raw_sig END AS signal_name,
  trim(regexp_extract(gdb_text, '{_SIGPAT}', 2)) AS signal_desc FROM (SELECT *, regexp_extract(gdb_text, '{_SIGPAT}', 1) AS raw_sig FROM ora_sec) s""")


@query("signal_info", "SELECT dump_id, signal_name, signal_desc FROM ora_sig")
def signal_info(spark, sf):
    return C.signal_info(gdb(spark, sf)).select("dump_id", "signal_name", "signal_desc")


_CF = "(?m)#0\\s+(?:0x[0-9a-f]+\\s+in\\s+)?(.+?)(?:\\s+at\\s+(.+):(\\d+))?$"


@query("crash_frame", f"""SELECT dump_id, regexp_extract(s_bt_full, '{_CF}', 1) AS crash_func, regexp_extract(s_bt_full, '{_CF}', 2) AS crash_file,
  regexp_extract(s_bt_full, '{_CF}', 3) AS crash_line, TRUE AS has_debuginfo FROM ora_sec""")
def crash_frame(spark, sf):
    return C.crash_frame(C.with_sections(gdb(spark, sf))).select("dump_id", "crash_func", "crash_file", "crash_line", "has_debuginfo")


cte("ora_btl", """SELECT dump_id, ln, line, CAST(regexp_extract(line, '^\\s*#(\\d+)\\s+(.*)$', 1) AS BIGINT) AS frame_no, trim(regexp_extract(line, '^\\s*#(\\d+)\\s+(.*)$', 2)) AS frame FROM (
  SELECT dump_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT dump_id, string_split(s_bt_full, chr(10)) AS ls FROM ora_sec) a) b WHERE regexp_matches(line, '^\\s*#(\\d+)\\s+(.*)$')""")
cte("ora_bt", """SELECT dump_id, frame_no, frame, CAST(ROW_NUMBER() OVER (PARTITION BY dump_id ORDER BY ln) - 1 AS BIGINT) AS pos FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY dump_id, frame_no ORDER BY ln) AS rn FROM ora_btl) x WHERE rn = 1""")


@query("backtrace_frames", "SELECT * FROM ora_bt")
def backtrace_frames(spark, sf):
    return tidy(C.backtrace_frames(C.with_sections(gdb(spark, sf))))


def norm(c):
    return f"regexp_replace(lower({c}), '[\\s_()]+', '', 'g')"


def idle(c):
    return f"regexp_matches({norm(c)}, '{'|'.join(fixed.IDLE_TOKENS)}')"


_TH = "^\\s*(\\*?)\\s*(\\d+)\\s+Thread\\s+(0x[0-9a-f]+)\\s+\\(LWP\\s+(\\d+)\\)\\s+(.+?)$"
cte("ora_thr", f"""SELECT dump_id, regexp_extract(line, '{_TH}', 1) = '*' AS crashed, regexp_extract(line, '{_TH}', 2) AS id, regexp_extract(line, '{_TH}', 4) AS lwp, trim(regexp_extract(line, '{_TH}', 5)) AS bt_top
  FROM (SELECT dump_id, unnest(string_split(s_info_threads, chr(10))) AS line FROM ora_sec) a WHERE regexp_matches(line, '{_TH}')""")
cte("ora_role", f"""SELECT *, {idle('bt_top')} AS is_idle, CASE WHEN crashed THEN 'crashed' """
    + " ".join(f"WHEN regexp_matches({norm('bt_top')}, '{'|'.join(toks)}') THEN '{role}'" for role, toks in fixed.THREAD_ROLES)
    + f" WHEN {idle('bt_top')} THEN 'lcore_worker' ELSE 'unknown' END AS role FROM ora_thr")


def threads(spark, sf):
    return C.with_threads(C.with_sections(gdb(spark, sf)))


@query("thread_table", "SELECT dump_id, crashed, id, lwp, bt_top, role FROM ora_role")
def thread_table(spark, sf):
    return C.thread_table(threads(spark, sf))


@query("thread_summary", """SELECT dump_id, COUNT(*) AS total, MAX(CASE WHEN crashed THEN lwp END) AS crashed_lwp, CAST(SUM(CASE WHEN NOT crashed AND NOT is_idle THEN 1 ELSE 0 END) AS BIGINT) AS abnormal,
  CAST(COUNT(*) - SUM(CASE WHEN NOT crashed AND NOT is_idle THEN 1 ELSE 0 END) - MAX(CASE WHEN crashed THEN 1 ELSE 0 END) AS BIGINT) AS idle FROM ora_role GROUP BY dump_id""")
def thread_summary(spark, sf):
    return tidy(C.thread_summary(threads(spark, sf)))


@query("external_abnormal_threads", f"""SELECT dump_id, id, lwp, bt_top, role FROM ora_role WHERE NOT crashed AND NOT is_idle AND NOT regexp_matches(bt_top, '{'|'.join(fixed.INTERNAL_THREAD_FUNCS)}')""")
def external_abnormal_threads(spark, sf):
    return C.external_abnormal_threads(threads(spark, sf))


_TB_HEAD = "^\\s*Thread\\s+(\\d+)\\s+\\(Thread\\s+0x[0-9a-f]+\\s+\\(LWP\\s+(\\d+)\\)\\):?\\s*$"
cte("ora_tbl", f"""SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tid FROM (
  SELECT dump_id, ln, line, nullif(regexp_extract(line, '{_TB_HEAD}', 1), '') AS head FROM (SELECT dump_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT dump_id, string_split(s_thread_bt, chr(10)) AS ls FROM ora_sec) a) b) c""")
cte("ora_tbf", """SELECT dump_id, tid, ln, CAST(regexp_extract(line, '^\\s*#(\\d+)\\s+(.*)$', 1) AS BIGINT) AS frame_no, trim(regexp_extract(line, '^\\s*#(\\d+)\\s+(.*)$', 2)) AS frame FROM ora_tbl
  WHERE tid IS NOT NULL AND regexp_matches(line, '^\\s*#(\\d+)\\s+(.*)$')""")


@query("thread_backtraces", f"""SELECT dump_id, tid, CAST(ROW_NUMBER() OVER (PARTITION BY dump_id, tid ORDER BY ln) - 1 AS BIGINT) AS pos, frame_no, frame FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY dump_id, tid, frame_no ORDER BY ln) AS rn, bool_or({idle('frame')}) OVER (PARTITION BY dump_id, tid) AS has_idle FROM ora_tbf) x WHERE rn = 1 AND NOT has_idle""")
def thread_backtraces(spark, sf):
    return tidy(C.thread_backtraces(C.with_sections(gdb(spark, sf))))


cte("ora_reg", "SELECT *, " + ", ".join(f"nullif(regexp_extract(s_registers, '{r}\\s+(0x[0-9a-f]+)', 1), '') AS {r}" for r in fixed.KEY_REGISTERS)
    + """, CASE WHEN regexp_matches(s_siginfo, '\\$\\d+ = 0$') THEN '0x0' ELSE nullif(regexp_extract(s_siginfo, '0x[0-9a-f]+', 0), '') END AS fault_addr FROM ora_sig""")


@query("registers", "SELECT dump_id, " + ", ".join(fixed.KEY_REGISTERS) + " FROM ora_reg")
def registers(spark, sf):
    return C.with_registers(C.with_sections(gdb(spark, sf))).select("dump_id", *fixed.KEY_REGISTERS)


@query("fault_address", "SELECT dump_id, fault_addr FROM ora_reg")
def fault_address(spark, sf):
    return C.fault_address(C.with_sections(gdb(spark, sf))).select("dump_id", "fault_addr")


@query("locals_table", """SELECT dump_id, CAST(ROW_NUMBER() OVER (PARTITION BY dump_id ORDER BY ln) - 1 AS BIGINT) AS pos0, name, v AS value FROM (
  SELECT dump_id, ln, regexp_extract(line, '^(\\w+)\\s*=\\s*(.+)$', 1) AS name, trim(regexp_extract(line, '^(\\w+)\\s*=\\s*(.+)$', 2)) AS v FROM (
    SELECT dump_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT dump_id, string_split(s_locals, chr(10)) AS ls FROM ora_sec) a) b WHERE regexp_matches(line, '^(\\w+)\\s*=\\s*(.+)$')) c
  WHERE name NOT IN ('frame', 'Stack', 'Locals', 'Arguments', 'leak')""".replace("CAST(ROW_NUMBER() OVER (PARTITION BY dump_id ORDER BY ln) - 1 AS BIGINT) AS pos0, ", ""))
def locals_table(spark, sf):
    return C.locals_table(C.with_sections(gdb(spark, sf))).select("dump_id", "name", "value")


def region_sql(n):
    return (f"CASE WHEN {n} = '' THEN 'anonymous' WHEN starts_with({n}, '[stack') THEN 'stack' WHEN starts_with({n}, '[heap') THEN 'heap' WHEN {n} LIKE '%/dev/hugepages%' THEN 'hugepage' "
            f"WHEN contains({n}, 'librte_') OR {n} LIKE '%.so' OR contains({n}, '.so.') THEN 'shared_lib' ELSE 'executable' END")


@query("address_region", f"""SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, a.addr, CASE WHEN m.name = '' THEN 'anonymous' ELSE m.name END AS region, CASE WHEN m.addr IS NOT NULL THEN {region_sql('m.name')} END AS region_type
  FROM fx_addr a LEFT JOIN (SELECT x.addr, arg_min(m.name, m.map_id) AS name FROM (SELECT DISTINCT addr FROM fx_addr) x JOIN fx_map m ON x.addr >= m.start_addr AND x.addr < m.end_addr GROUP BY x.addr) m ON a.addr = m.addr""")
def address_region(spark, sf):
    return C.address_region(I.view(spark, sf, "fx_addr"), I.view(spark, sf, "fx_map"))


_MAPL = "(0x[0-9a-f]+)\\s+(0x[0-9a-f]+)\\s+0x[0-9a-f]+\\s+0x[0-9a-f]+\\s*(.*?)$"
cte("ora_region", f"""SELECT r.*, h.name AS region_name, h.ln AS region_ln FROM ora_reg r LEFT JOIN (SELECT dump_id, arg_min(name, ln) AS name, MIN(ln) AS ln FROM (
  SELECT dump_id, ln, rip, CAST(regexp_extract(line, '{_MAPL}', 1) AS BIGINT) AS a, CAST(regexp_extract(line, '{_MAPL}', 2) AS BIGINT) AS b, trim(regexp_extract(line, '{_MAPL}', 3)) AS name FROM (
    SELECT dump_id, rip, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT dump_id, rip, string_split(s_mappings, chr(10)) AS ls FROM ora_reg) q) w WHERE regexp_matches(line, '{_MAPL}')) e
  WHERE CAST(rip AS BIGINT) >= a AND CAST(rip AS BIGINT) < b GROUP BY dump_id) h ON r.dump_id = h.dump_id""")


@query("crash_region", f"""SELECT dump_id, rip, CASE WHEN region_name = '' THEN 'anonymous' ELSE region_name END AS region, CASE WHEN region_ln IS NOT NULL THEN {region_sql('region_name')} END AS region_type FROM ora_region""")
def crash_region(spark, sf):
    return C.crash_region(C.with_registers(C.with_sections(gdb(spark, sf)))).select("dump_id", "rip", "region", "region_type")


@query("stack_words", """SELECT dump_id, array_to_string(regexp_extract_all(s_rsp, '0x[0-9a-f]+')[2:], '|') AS rsp, array_to_string(regexp_extract_all(s_rbp, '0x[0-9a-f]+')[2:], '|') AS rbp FROM ora_sec""")
def stack_words(spark, sf):
    g = C.with_sections(gdb(spark, sf))
    return tidy(g.select("dump_id", C.stack_words("s_rsp").alias("rsp"), C.stack_words("s_rbp").alias("rbp")))


def libs_sql(yes):
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {'' if yes else 'NOT '}contains(s_shared, '{x}') THEN '{x}' END" for x in fixed.REQUIRED_LIBS) + ")"


@query("lib_status", f"SELECT dump_id, {libs_sql(True)} AS found_libs, {libs_sql(False)} AS missing_libs FROM ora_sec")
def lib_status(spark, sf):
    return tidy(C.lib_status(C.with_sections(gdb(spark, sf))).select("dump_id", "found_libs", "missing_libs"))


_FA = "CAST(fault_addr AS BIGINT)"
CRASH_TYPE_SQL = (f"CASE WHEN signal_name IS NULL OR signal_name = '' THEN 'unknown' WHEN signal_name = 'SIGSEGV' THEN CASE WHEN {_FA} = 0 THEN 'null_ptr_deref' WHEN {_FA} < 4096 THEN 'near_null_deref' "
                  "WHEN rdi = '0x0' THEN 'null_pointer_deref' WHEN rip = '0x0' THEN 'null_function_call' ELSE 'invalid_memory_access' END "
                  + " ".join(f"WHEN signal_name = '{k}' THEN '{v}'" for k, v in fixed.CRASH_BY_SIGNAL.items()) + " ELSE signal_name END")


@query("crash_type", f"SELECT dump_id, signal_name, fault_addr, {CRASH_TYPE_SQL} AS crash_type FROM ora_reg")
def crash_type(spark, sf):
    return C.parsed(gdb(spark, sf)).select("dump_id", "signal_name", "fault_addr", "crash_type")


@query("parse_warnings", f"""SELECT dump_id, concat('DPDK shared libs missing: ', replace({libs_sql(False)}, '|', ', ')) AS warnings, FALSE AS truncated FROM ora_sec""")
def parse_warnings(spark, sf):
    return tidy(C.parse_warnings(C.parsed(gdb(spark, sf))).select("dump_id", "warnings", "truncated"))


_FP = "(?s)^#(\\d+)\\s+(0x[0-9a-fA-F]+)?\\s*(?:in\\s+)?([^\\s(]+)(?:\\s*\\(.*?\\))?(?:\\s+at\\s+(\\S+:\\d+))?"
cte("ora_fp", f"""SELECT dump_id, frame_no AS idx, regexp_replace(regexp_extract(f, '{_FP}', 3), '<[^<>]*>', '', 'g') AS func, nullif(regexp_extract(f, '{_FP}', 2), '') AS address,
  nullif(regexp_extract(f, '{_FP}', 4), '') AS source FROM (SELECT dump_id, frame_no, concat('#', CAST(frame_no AS VARCHAR), ' ', frame) AS f FROM ora_bt) x""")


@query("frame_parse", "SELECT * FROM ora_fp WHERE func NOT IN ('??', 'unknown', '', '_start', '__libc_start_main')")
def frame_parse(spark, sf):
    return C.frame_parse(gdb_frames(spark, sf)).select("dump_id", "idx", "func", "address", "source")


def gdb_frames(spark, sf):
    b = C.backtrace_frames(C.with_sections(gdb(spark, sf)))
    return b.withColumn("frame", F.concat(F.lit("#"), F.col("frame_no").cast("string"), F.lit(" "), F.col("frame")))


# ---- stack tool, merged sources, quality --------------------------------------------------------------------------

cte("ora_stl", """SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tid,
  SUM(CASE WHEN line LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY dump_id ORDER BY ln) AS fr FROM (SELECT dump_id, ln, line, nullif(regexp_extract(line, '^TID\\s+(\\d+):', 1), '') AS head FROM (
  SELECT dump_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT dump_id, string_split(stack_text, chr(10)) AS ls FROM fx_stack) a) b) c""")
cte("ora_stf", """SELECT dump_id, tid, ln, fr, CAST(regexp_extract(line, '^#(\\d+)', 1) AS BIGINT) AS frame_no, regexp_extract(line, '(0x[0-9a-f]+)', 1) AS address,
  trim(regexp_extract(line, '^#\\d+\\s+0x[0-9a-f]+\\s*(.*)$', 1)) AS rest FROM ora_stl WHERE line LIKE '#%'""")
cte("ora_sts", """SELECT dump_id, fr, regexp_extract(line, '^\\s{4,}(\\S+:\\d+)', 1) AS source FROM ora_stl WHERE regexp_matches(line, '^\\s{4,}\\S+:\\d+')""")


@query("stack_tool_frames", """SELECT f.dump_id, f.tid, CAST(ROW_NUMBER() OVER (PARTITION BY f.dump_id, f.tid ORDER BY f.ln) - 1 AS BIGINT) AS pos, f.frame_no, f.address,
  CASE WHEN starts_with(rest, '- ') THEN '??' WHEN contains(rest, ' - ') THEN trim(split_part(rest, ' - ', 1)) ELSE rest END AS func,
  CASE WHEN starts_with(rest, '- ') THEN trim(substr(rest, 3)) WHEN contains(rest, ' - ') THEN trim(split_part(rest, ' - ', 2)) END AS module, s.source FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY dump_id, tid, address ORDER BY ln) AS rn FROM ora_stf) f LEFT JOIN ora_sts s ON f.dump_id = s.dump_id AND f.fr = s.fr WHERE rn = 1""")
def stack_tool_frames(spark, sf):
    return tidy(C.stack_tool_frames(I.view(spark, sf, "fx_stack")))


_NOTES = """event_id + CASE WHEN k % 7 = 3 THEN 1000000000 ELSE 0 END AS dump_id, CAST(CASE k % 4 WHEN 0 THEN 11 WHEN 1 THEN 6 WHEN 2 THEN 31 END AS {INT}) AS signal, concat('0x', {HEX(v)HEX}) AS rip, CASE WHEN k % 2 = 0 THEN '0x0' ELSE '0x9' END AS rdi,
  CASE WHEN k % 5 = 0 THEN NULL ELSE concat('0x', {HEX(k * 100)HEX}) END AS fault_addr"""
cte("ora_notes", "SELECT " + _NOTES.replace("{INT}", "INTEGER").replace("{HEX(", "lower(to_hex(").replace(")HEX}", "))") + " FROM fx_e")
_CORE_ID = "event_id + CASE WHEN process_time < 20 THEN 2000000000 ELSE 0 END"
cte("ora_cfs", f"SELECT {_CORE_ID} AS dump_id, {sig('split_part(filename, ' + chr(39) + '.' + chr(39) + ', 5)')} AS f_signal FROM fx_core_files")
cte("ora_merge", f"""SELECT coalesce(d.dump_id, n.dump_id, f.dump_id) AS dump_id, coalesce(f_signal, CASE n.signal WHEN 11 THEN 'SIGSEGV' WHEN 6 THEN 'SIGABRT' WHEN 31 THEN 'SIG_31' END, d.signal_name) AS signal_name,
  coalesce(n.rip, d.rip) AS m_rip, coalesce(n.rdi, d.rdi) AS m_rdi, coalesce(n.fault_addr, d.fault_addr) AS m_fault, n.dump_id IS NOT NULL AS has_notes, n.rip AS rip, n.rdi AS rdi, n.fault_addr AS fault_addr, d.ct
  FROM (SELECT *, {CRASH_TYPE_SQL} AS ct FROM ora_reg) d FULL JOIN ora_notes n ON d.dump_id = n.dump_id FULL JOIN ora_cfs f ON coalesce(d.dump_id, n.dump_id) = f.dump_id""")


@query("merge_crash_sources", f"""SELECT dump_id, signal_name, m_rip AS rip, m_rdi AS rdi, m_fault AS fault_addr, CASE WHEN has_notes THEN {CRASH_TYPE_SQL} ELSE coalesce(ct, 'unknown') END AS crash_type FROM ora_merge""")
def merge_crash_sources(spark, sf):
    text = _NOTES.replace("{INT}", "INT").replace("{HEX(", "lower(hex(").replace(")HEX}", "))")
    notes = I.events(spark, sf).selectExpr(*I._exprs(text))
    files = C.core_filename(I.view(spark, sf, "fx_core_files").selectExpr("*", f"{_CORE_ID} as dump_id"))
    return C.merge_crash_sources(C.parsed(gdb(spark, sf)), notes, files)


def _rule_sql(r):
    _, key, sev, parts, pat = r
    tests = [f"contains(e, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts] + ([f"regexp_matches(e, '{pat}')"] if pat else [])
    return " AND ".join(tests)


_hits = ", ".join(f"CASE WHEN {_rule_sql(r)} THEN '{r[1]}' END" for r in fixed.SYMBOL_RULES)
_fatal = " OR ".join(f"({_rule_sql(r)})" for r in fixed.SYMBOL_RULES if r[2] == "fatal")


@query("symbol_quality", f"""SELECT dump_id, CASE WHEN {_fatal} THEN 'invalid' WHEN len(h) > 0 THEN 'degraded' WHEN returncode <> 0 THEN 'degraded' ELSE 'valid' END AS quality,
  CASE WHEN len(h) > 0 THEN array_to_string(h, '|') WHEN returncode <> 0 THEN concat('gdb_returncode_', CAST(returncode AS VARCHAR)) ELSE '' END AS quality_notes FROM (
  SELECT *, list_filter([{_hits}], lambda x: x IS NOT NULL) AS h FROM (SELECT dump_id, returncode, trim(lower(stderr)) AS e FROM fx_gdb) a) b""")
def symbol_quality(spark, sf):
    return tidy(C.symbol_quality(gdb(spark, sf)).select("dump_id", "quality", "quality_notes"))


# ---- logs and devices ------------------------------------------------------------------------------------------------

_LOGF = ", ".join(f"nullif(trim(regexp_extract(app_log, '{p.replace(chr(39), chr(39) * 2)}', 1)), '') AS {n}" for n, p in fixed.APP_LOG_FIELDS.items())
_PROBE = "EAL:\\s*Probe PCI driver:\\s*(\\S+).*?device:\\s*([0-9a-fA-F:.]+)"
cte("ora_log", f"""SELECT *, {_LOGF}, contains(app_log, 'EAL: Detected shared linkage of DPDK') AS shared_linkage, array_to_string(regexp_extract_all(app_log, '{_PROBE}', 1), '|') AS probe_drivers,
  array_to_string(regexp_extract_all(app_log, '{_PROBE}', 2), '|') AS probe_devices, nullif(regexp_extract(app_log, '(?m)^([A-Za-z_][A-Za-z0-9_]*)\\(\\):\\s*(Failed to init PCI device.*)$', 1), '') AS driver_error_source,
  nullif(regexp_extract(app_log, '(?m)^([A-Za-z_][A-Za-z0-9_]*)\\(\\):\\s*(Failed to init PCI device.*)$', 2), '') AS driver_error_message,
  nullif(regexp_extract(app_log, '(?m)^(.*Failed to init PCI device.*)$', 1), '') AS driver_init_error FROM fx_log""")
_LOGC = [*fixed.APP_LOG_FIELDS, "shared_linkage", "probe_drivers", "probe_devices", "driver_error_source", "driver_error_message", "driver_init_error"]


@query("app_log_fields", "SELECT log_id, " + ", ".join(_LOGC) + " FROM ora_log")
def app_log_fields(spark, sf):
    return tidy(C.app_log_fields(I.view(spark, sf, "fx_log")).select("log_id", *_LOGC))


@query("log_tail_fatal", """SELECT log_id, CAST(len(string_split(app_log, chr(10))) AS BIGINT) AS tail_lines, CASE WHEN k % 3 = 0 THEN 'Segmentation fault (core dumped)' END AS fatal_signal FROM fx_log""")
def log_tail_fatal(spark, sf):
    return tidy(C.log_tail_fatal(I.view(spark, sf, "fx_log")).select("log_id", "tail_lines", "fatal_signal"))


cte("ora_nic", """SELECT log_id, 'network' AS section, concat('0000:0', CAST(k % 10 AS VARCHAR), ':00.0') AS pci, 'Some NIC' AS "desc", 'eth0' AS iface, CASE WHEN k % 3 = 0 THEN 'vfio-pci' ELSE 'ice' END AS drv,
  'vfio-pci' AS unused, TRUE AS active, k FROM fx_log UNION ALL SELECT log_id, 'crypto', concat('0000:0', CAST(k % 10 AS VARCHAR), ':01.0'), 'QAT', '', 'vfio-pci', '', FALSE, k FROM fx_log""")


@query("nic_table", 'SELECT log_id, section, pci, "desc", iface, drv, unused, active FROM ora_nic')
def nic_table(spark, sf):
    return C.nic_table(I.view(spark, sf, "fx_log"))


@query("device_issues", "SELECT n.log_id, n.pci AS slot, n.drv AS driver FROM ora_nic n JOIN ora_log l ON n.log_id = l.log_id WHERE n.section = 'network' AND n.drv = 'ice' AND contains(l.probe_devices, n.pci)")
def device_issues(spark, sf):
    return C.device_issues(C.app_log_fields(I.view(spark, sf, "fx_log")))


_DEV = """p_partkey AS slot, CASE p_size % 5 WHEN 0 THEN '0200' WHEN 1 THEN '0b40' WHEN 2 THEN '0880' WHEN 3 THEN '1000' ELSE '0c03' END AS class_code,
  CASE p_partkey % 3 WHEN 0 THEN '8086' WHEN 1 THEN '177d' ELSE '15b3' END AS vendor, CASE p_partkey % 4 WHEN 0 THEN '2710' WHEN 1 THEN 'a081' WHEN 2 THEN '1592' ELSE 'a0f9' END AS device,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'vfio-pci' WHEN 2 THEN 'igb_uio' ELSE 'ice' END AS driver"""
_CLS = [("network", "02", None, None), ("crypto", "10", None, None), ("crypto", "0b", "8086", None), ("dma", "08", "177d", "a081"), ("eventdev", "08", "177d", "a0f9"), ("eventdev", "0b", "8086", "2710")]


def _lit(x):
    return "NULL" if x is None else f"'{x}'"


@query("device_binding", f"""SELECT DISTINCT c.category, d.slot, d.driver, CASE WHEN d.driver = '' THEN 'no_driver' WHEN d.driver IN ('vfio-pci', 'uio_pci_generic', 'igb_uio') THEN 'dpdk_bound' ELSE 'kernel_bound' END AS binding,
  CASE WHEN c.category = 'network' AND d.driver = 'ice' THEN 'Network card has switched back to kernel driver' WHEN c.category = 'network' AND d.driver = '' THEN 'Network card has no driver bound' END AS alert
  FROM (SELECT {_DEV} FROM part) d JOIN (VALUES {', '.join('(' + ', '.join(_lit(x) for x in r) + ')' for r in _CLS)}) c(category, class2, vendor, device)
  ON substr(d.class_code, 1, 2) = c.class2 AND (c.vendor IS NULL OR c.vendor = d.vendor) AND (c.device IS NULL OR c.device = d.device)""")
def device_binding(spark, sf):
    dev = I.table(spark, sf, "part").selectExpr(*I._exprs(_DEV))
    cls = spark.createDataFrame(_CLS, "category string, class2 string, vendor string, device string")
    return C.device_binding(dev, cls)


@query("hugepage_usage", """SELECT event_id, CASE WHEN k % 10 = 9 THEN '未知' ELSE concat('2M hugepages: ', CAST(v - least(k * 50, v) AS VARCHAR), '/', CAST(v AS VARCHAR), ' used',
  CASE WHEN v <> 0 AND least(k * 50, v) < v * 0.1 THEN ' ⚠ 接近耗尽' ELSE ' (充足)' END) END AS usage, CASE WHEN k % 10 < 9 THEN round(v * 2048 / 1024.0, 6) END AS total_mb FROM fx_e""")
def hugepage_usage(spark, sf):
    e = I.events(spark, sf).selectExpr("event_id", "case when k % 10 = 9 then 'n/a' else cast(v as string) end as total", "cast(least(k * 50, v) as string) as free", "2048 as size_kb")
    return tidy(C.hugepage_usage(e).select("event_id", "usage", "total_mb"))


@query("cpu_layout", """SELECT host, socket, core, string_agg(CAST(cpu AS VARCHAR), ',' ORDER BY cpu) AS cpus FROM (SELECT CAST(floor(c_custkey / 64.0) AS BIGINT) AS host, CAST(floor((c_custkey % 64) / 32.0) AS BIGINT) AS socket,
  c_custkey % 16 AS core, c_custkey % 64 AS cpu FROM customer) c GROUP BY host, socket, core""")
def cpu_layout(spark, sf):
    c = I.table(spark, sf, "customer").selectExpr("cast(floor(c_custkey / 64.0) as bigint) as host", "cast(floor((c_custkey % 64) / 32.0) as bigint) as socket", "c_custkey % 16 as core", "c_custkey % 64 as cpu")
    return C.cpu_layout(c).withColumn("cpus", F.array_join(F.col("cpus").cast("array<string>"), ","))


cte("ora_bundle", """SELECT user_id AS bundle, filename, FALSE AS x FROM fx_core_files UNION ALL SELECT user_id, concat('/var/log/app', CAST(k AS VARCHAR), '.LOG'), FALSE FROM fx_e WHERE event_type = 'click'
  UNION ALL SELECT user_id, concat('/opt/bin/app', CAST(k AS VARCHAR)), k < 90 FROM fx_e WHERE event_type = 'view'""")


@query("bundle_manifest", """SELECT bundle, cores, logs, exes, others, core_path, log_path, exe_path, CASE WHEN cores <> 1 THEN 'need exactly one core file' WHEN logs > 1 THEN 'more than one log file' WHEN exes > 1 THEN 'more than one program' WHEN others > 0 THEN 'unknown file' END AS error FROM (
  SELECT bundle, CAST(SUM(CASE WHEN kind = 'core' THEN 1 ELSE 0 END) AS BIGINT) AS cores, CAST(SUM(CASE WHEN kind = 'log' THEN 1 ELSE 0 END) AS BIGINT) AS logs, CAST(SUM(CASE WHEN kind = 'exe' THEN 1 ELSE 0 END) AS BIGINT) AS exes,
  CAST(SUM(CASE WHEN kind = 'unknown' THEN 1 ELSE 0 END) AS BIGINT) AS others, MIN(CASE WHEN kind = 'core' THEN filename END) AS core_path, MIN(CASE WHEN kind = 'log' THEN filename END) AS log_path, MIN(CASE WHEN kind = 'exe' THEN filename END) AS exe_path
  FROM (SELECT *, CASE WHEN starts_with(regexp_extract(filename, '([^/]+)$', 1), 'core.') THEN 'core' WHEN lower(filename) LIKE '%.log' THEN 'log' WHEN x THEN 'exe' ELSE 'unknown' END AS kind FROM ora_bundle) b GROUP BY bundle) c""")
def bundle_manifest(spark, sf):
    e = I.events(spark, sf)
    cores = I.view(spark, sf, "fx_core_files").selectExpr("user_id as bundle", "filename", "false as is_executable")
    logs = e.where("event_type = 'click'").selectExpr("user_id as bundle", "concat('/var/log/app', cast(k as string), '.LOG') as filename", "false as is_executable")
    exes = e.where("event_type = 'view'").selectExpr("user_id as bundle", "concat('/opt/bin/app', cast(k as string)) as filename", "k < 90 as is_executable")
    return tidy(C.bundle_manifest(cores.unionByName(logs).unionByName(exes)))
