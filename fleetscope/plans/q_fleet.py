"""Registered queries: record tables, documents, fleet and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.operators import crash_text as C
from fleetscope.operators import fleet as D
from fleetscope.operators import telemetry as T
from fleetscope.plans import inputs as I
from fleetscope.plans.common import tidy
from fleetscope.plans.q_crash_text import sig
from fleetscope.plans.q_telemetry import features
from fleetscope.plans.registry import cte, query
from fleetscope.session import scratch_dir
from fleetscope.sources import documents as DOC
from fleetscope.sources import records as S
from fleetscope.sources.pages import page_directory, read_page

AS_OF = 474_000  # a clock inside the month of events, in record seconds


def rec(spark, sf):
    return I.flat_1s(spark, sf).selectExpr("client_id", "pid", "'1s' as type", "t", "seq", "p0_ip as packets").unionByName(
        I.flat_5s(spark, sf).selectExpr("client_id", "pid", "'5s' as type", "t", "seq", "x_good as packets"))


cte("ora_rec", "SELECT client_id, pid, '1s' AS type, t, seq, p0_ip AS packets FROM fx_1s UNION ALL SELECT client_id, pid, '5s', t, seq, x_good FROM fx_5s")


@query("scan_window", f"SELECT * FROM ora_rec WHERE type = '1s' AND t BETWEEN {AS_OF - 300} AND {AS_OF}")
def scan_window(spark, sf):
    return S.scan_window(rec(spark, sf), "1s", AS_OF, 300)


@query("scan_both_cadences", f"SELECT * FROM ora_rec WHERE t BETWEEN {AS_OF - 300} AND {AS_OF}")
def scan_both_cadences(spark, sf):
    return S.scan_both_cadences(rec(spark, sf), AS_OF, 300)


_RAWJ = "CASE event_type WHEN 'view' THEN substr(props, 1, length(props) - 1) ELSE props END"


@query("decode_json_records", """SELECT event_type, COUNT(CASE WHEN event_type <> 'view' THEN 1 END) AS decoded, COUNT(CASE WHEN event_type = 'view' THEN 1 END) AS malformed,
  CAST(SUM(CASE WHEN event_type <> 'view' THEN k END) AS BIGINT) AS total FROM fx_e GROUP BY event_type""")
def decode_json_records(spark, sf):
    e = I.table(spark, sf, "events").selectExpr("event_type", f"{_RAWJ} as body")
    d = S.decode_json_records(e, "body", "k bigint")
    return d.groupBy("event_type").agg(F.count(F.when(~F.col("malformed"), 1)).alias("decoded"), F.count(F.when(F.col("malformed"), 1)).alias("malformed"),
                                       F.sum("record.k").alias("total"))


@query("scan_key_prefix", "SELECT concat(client_id, ':info:', CAST(pid AS VARCHAR)) AS key, status FROM fx_instances WHERE client_id = 'c1' AND (status = 'running' OR start_time > 4000)")
def scan_key_prefix(spark, sf):
    e = I.view(spark, sf, "fx_instances").selectExpr("concat(client_id, ':info:', cast(pid as string)) as key", "status", "case when status = 'running' then null else start_time end as expires_at")
    return S.scan_key_prefix(e, "c1:info:", 4000).drop("expires_at")


@query("lookup_keys", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def lookup_keys(spark, sf):
    keys = I.table(spark, sf, "lineitem").where("l_quantity > 49").selectExpr("l_orderkey as o_orderkey")
    return S.lookup_keys(I.table(spark, sf, "orders"), keys, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("flush_latest_wins", """SELECT client_id, pid, type, t, seq, v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id, pid, type, t ORDER BY seq DESC) AS rn FROM fx_raw WHERE type IN ('1s', '5s')) r WHERE rn = 1""")
def flush_latest_wins(spark, sf):
    return S.flush_latest_wins(I.raw_records(spark, sf))


@query("ttl_expire", f"SELECT client_id, pid, t, packets FROM ora_rec WHERE t > {AS_OF} - 300")
def ttl_expire(spark, sf):
    return S.ttl_expire(rec(spark, sf), AS_OF).select("client_id", "pid", "t", "packets")


@query("table_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def table_filter(spark, sf):
    return S.table_filter(I.table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="5-LOW").select("o_orderkey", "o_custkey")


@query("page_with_total", """SELECT o_orderkey, o_totalprice, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F') AS total, CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size FROM orders
  WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def page_with_total(spark, sf):
    o = I.table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return read_page(o, page_directory(o, "o_totalprice"), ["o_orderkey"], 3, 20, descending=True).select(
        "o_orderkey", "o_totalprice", "total", F.col("page").cast("bigint").alias("page"), F.col("page_size").cast("bigint").alias("page_size"))


_NEW = "SELECT CASE WHEN c_acctbal > 5000 THEN c_custkey ELSE c_custkey + 100000000 END AS c_custkey, upper(c_name) AS c_name, c_mktsegment FROM customer WHERE c_nationkey < 10"
cte("ora_new", _NEW)


@query("upsert_rows", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ora_new) UNION ALL SELECT * FROM ora_new")
def upsert_rows(spark, sf):
    c = I.table(spark, sf, "customer")
    new = spark.sql(_NEW.replace("FROM customer", "FROM {c}"), c=c)
    return S.upsert_rows(c.select("c_custkey", "c_name", "c_mktsegment"), new, "c_custkey")


@query("partial_update", """SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'patched' ELSE c_name END AS c_name, CASE WHEN c_nationkey IN (3, 4) THEN concat('seg-', c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def partial_update(spark, sf):
    c = I.table(spark, sf, "customer")
    patch = c.where("c_nationkey in (3, 4)").selectExpr("c_custkey", "case when c_nationkey = 3 then 'patched' end as c_name", "concat('seg-', c_mktsegment) as c_mktsegment")
    return S.partial_update(c.select("c_custkey", "c_name", "c_mktsegment"), patch, "c_custkey")


@query("delete_by_source", "SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN (SELECT concat('src', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_regionkey = 1)")
def delete_by_source(spark, sf):
    n = I.table(spark, sf, "nation").where("n_regionkey = 1").selectExpr("concat('src', cast(n_nationkey as string)) as source")
    return S.delete_by_source(I.table(spark, sf, "documents"), n, "source").select("doc_id", "source", "n_chars")


@query("explode_storage_events", """SELECT d.doc_id, 'kb' AS bucket, concat('knowledge/2024-01-01/abcd1234_doc', CAST(d.doc_id AS VARCHAR), '.txt') AS key, n_chars * 1000 AS size, md5(text) AS etag, 'txt' AS filetype,
  concat('doc', CAST(d.doc_id AS VARCHAR)) AS filename, round(n_chars * 1000 / 1024.0 / 1024.0, 2) AS size_mb FROM documents d WHERE lang <> 'es'""")
def explode_storage_events(spark, sf):
    return S.explode_storage_events(I.view(spark, sf, "fx_storage_events"))


@query("ingest_new_only", """SELECT md5(text) AS etag, MIN(doc_id) AS doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en') GROUP BY md5(text)""")
def ingest_new_only(spark, sf):
    d = I.table(spark, sf, "documents").selectExpr("doc_id", "md5(text) as etag", "lang")
    return S.ingest_new_only(d.select("doc_id", "etag"), d.where("lang = 'en'"))


@query("load_documents", """SELECT 'txt' AS filetype, md5(line) AS line, COUNT(*) AS n, NULL AS error FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) l WHERE line <> '' GROUP BY line
  UNION ALL SELECT DISTINCT 'orc', NULL, 0, 'no parser for .orc' FROM documents""")
def load_documents(spark, sf):
    """Documents written as files of two types, one of which has no parser, and read back: every line of their contents."""
    path = scratch_dir(spark, "docs")
    d = I.table(spark, sf, "documents")
    d.select("text").write.option("maxRecordsPerFile", 50).text(path + "/txt")
    d.select("doc_id").write.orc(path + "/orc")
    out = DOC.load_documents(spark, path, "part-*")
    lines = out.select("filetype", "error", F.explode_outer(F.split("text", "\n")).alias("line")).where("error is not null or line <> ''")
    return lines.groupBy("filetype", "error", F.md5("line").alias("line")).agg(F.count("line").alias("n"))


@query("html_to_text", """SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(x, '[\\r\\n]+'), lambda s: regexp_replace(s, '^[\\s ]+|[\\s ]+$', '', 'g')), lambda s: s <> ''), concat(chr(10), chr(10))) AS text FROM (
  SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'),
    '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS x FROM pages) p""")
def html_to_text(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", DOC.html_to_text("html").alias("text"))


@query("load_cases", """SELECT CASE WHEN signal_name = 'es' THEN 'new' ELSE CAST(case_id AS VARCHAR) END AS case_id, signal_name, crash_type, crash_function, md5(description) AS description, root_cause,
  concat(source, '|', lang) AS anomaly_flags, CAST(n_chars AS VARCHAR) AS repair_steps FROM fx_cases c JOIN documents d ON c.case_id = d.doc_id""")
def load_cases(spark, sf):
    """Cases written as JSON and read back, all fields; those without an id get one of their own."""
    path = scratch_dir(spark, "cases") + "/json"
    d = I.table(spark, sf, "documents").selectExpr("doc_id as case_id", "array(source, lang) as anomaly_flags", "array(cast(n_chars as string)) as repair_steps")
    c = I.view(spark, sf, "fx_cases").join(d, "case_id").withColumn("case_id", F.expr("case when signal_name <> 'es' then cast(case_id as string) end"))
    c.write.json(path)
    out = DOC.load_cases(spark, path, multiline=False)
    own = F.when(F.col("signal_name") != "es", F.col("case_id")).when(F.length("case_id") == 36, "new").alias("case_id")
    return out.select(own, "signal_name", "crash_type", "crash_function", F.md5("description").alias("description"), "root_cause",
                      F.array_join("anomaly_flags", "|").alias("anomaly_flags"), F.array_join("repair_steps", "|").alias("repair_steps"))


@query("crash_file_scan", f"""SELECT f.event_id, f.filename, CASE WHEN i.pid IS NULL THEN 'unknown process' WHEN i.exe_path <> replace(split_part(f.filename, '.', 7), '!', '/') THEN 'path mismatch' ELSE 'process' END AS decision,
  coalesce({sig("split_part(f.filename, '.', 5)")}, 'UNKNOWN') AS signal_name FROM fx_core_files f LEFT JOIN fx_instances i ON i.pid = f.user_id""")
def crash_file_scan(spark, sf):
    f = C.core_filename(I.view(spark, sf, "fx_core_files").select("event_id", "filename"))
    return S.crash_file_scan(f, I.view(spark, sf, "fx_instances")).select("event_id", "filename", "decision", "signal_name")


@query("safe_name", "SELECT doc_id, concat('vs_', regexp_replace(concat(source, '-', lang, '.', CAST(doc_id AS VARCHAR)), '[^a-zA-Z0-9]', '_', 'g')) AS name FROM documents")
def safe_name(spark, sf):
    d = I.table(spark, sf, "documents")
    return d.select("doc_id", S.safe_name(F.concat_ws("", "source", F.lit("-"), "lang", F.lit("."), F.col("doc_id").cast("string"))).alias("name"))


# ---- fleet ---------------------------------------------------------------------------------------------------

NOW = 474_071  # last hour of the month


@query("client_alive", f"""SELECT u.client_id, MAX(h.t) AS last_seen, coalesce({NOW} - MAX(h.t) < 30, FALSE) AS alive FROM (SELECT DISTINCT c_custkey AS client_id FROM customer) u
  LEFT JOIN fx_heartbeats h ON h.client_id = u.client_id GROUP BY u.client_id""")
def client_alive(spark, sf):
    c = I.table(spark, sf, "customer").selectExpr("c_custkey as client_id")
    return D.client_alive(c, I.view(spark, sf, "fx_heartbeats"), NOW)


@query("running_instances", "SELECT client_id, pid, exe_name, start_time FROM fx_instances WHERE status = 'running'")
def running_instances(spark, sf):
    return D.running_instances(I.view(spark, sf, "fx_instances")).select("client_id", "pid", "exe_name", "start_time")


@query("registry_diff", """SELECT client_id, pid, CASE WHEN status = 'running' THEN 'register' ELSE 'unregister' END AS action FROM fx_instances WHERE (status = 'running') <> registered""")
def registry_diff(spark, sf):
    i = I.view(spark, sf, "fx_instances")
    return D.registry_diff(i.where("status = 'running'"), i.where("registered"))


@query("status_transition", """SELECT pid, nullif(f, 'none') AS status FROM (SELECT pid, list_reduce(list_prepend('none', list(status ORDER BY seq)), lambda s, x: CASE WHEN s = 'crashed' THEN s WHEN x = 'running' THEN x WHEN s = 'running' THEN x ELSE s END) AS f
  FROM fx_status GROUP BY pid) x""")
def status_transition(spark, sf):
    return D.status_transition(I.view(spark, sf, "fx_status")).select("pid", "status")


cte("ora_alive", f"SELECT concat('c', CAST(client_id AS VARCHAR)) AS client_id, {NOW} - MAX(t) < 30 AS alive FROM fx_heartbeats GROUP BY client_id")


@query("client_list", """SELECT c.client_id, c.pids, coalesce(r.n, 0) AS running, coalesce(a.alive, FALSE) AS alive FROM (SELECT client_id, COUNT(*) AS pids FROM fx_instances GROUP BY client_id) c
  LEFT JOIN (SELECT client_id, COUNT(*) AS n FROM fx_instances WHERE status = 'running' GROUP BY client_id) r ON r.client_id = c.client_id LEFT JOIN ora_alive a ON a.client_id = c.client_id""")
def client_list(spark, sf):
    i = I.view(spark, sf, "fx_instances")
    clients = i.groupBy("client_id").agg(F.count(F.lit(1)).alias("pids"))
    hb = I.view(spark, sf, "fx_heartbeats").withColumn("client_id", F.concat(F.lit("c"), F.col("client_id").cast("string")))
    alive = D.client_alive(hb, hb, NOW).drop("last_seen")
    return D.client_list(clients, i, alive)


@query("fleet_counts", """SELECT (SELECT COUNT(DISTINCT client_id) FROM fx_instances) AS clients, (SELECT COUNT(*) FROM fx_instances WHERE status = 'running') AS running,
  (SELECT COUNT(*) FROM fx_core_files) AS crashes, (SELECT COUNT(*) FROM documents) AS cases""")
def fleet_counts(spark, sf):
    return D.fleet_counts(I.view(spark, sf, "fx_instances"), I.view(spark, sf, "fx_core_files"), I.table(spark, sf, "documents"))


@query("report_page", """SELECT o.id, o.c_custkey, c.c_name, o.total, strftime(o.created, '%Y-%m-%d %H:%M:%S') AS create_time FROM (SELECT o_orderkey AS id, o_custkey AS c_custkey, o_orderdate AS created, (SELECT COUNT(*) FROM orders) AS total
  FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 25) o JOIN customer c ON c.c_custkey = o.c_custkey""")
def report_page(spark, sf):
    o = I.table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_custkey as c_custkey", "o_orderdate as created")
    return D.report_page(o, I.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 2, 25).select("id", "c_custkey", "c_name", "total", "create_time")


@query("nested_get", """SELECT event_id, coalesce(json_extract_string(j, '$.meta.k'), 'N/A') AS k, coalesce(json_extract_string(j, '$.meta.missing.deep'), 'N/A') AS deep FROM (SELECT event_id, concat('{"meta": ', props, '}') AS j FROM events) x""")
def nested_get(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", F.concat(F.lit('{"meta": '), "props", F.lit("}")).alias("j"))
    return e.select("event_id", D.nested_get("j", "$.meta.k", "N/A").alias("k"), D.nested_get("j", "$.meta.missing.deep", "N/A").alias("deep"))


@query("format_times", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 'O' THEN strftime(o_orderdate + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') ELSE concat('on ', o_orderpriority) END AS formatted FROM orders""")
def format_times(spark, sf):
    o = I.table(spark, sf, "orders").selectExpr("o_orderkey", """case o_orderstatus when 'F' then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss")
        when 'O' then cast(unix_seconds(cast(o_orderdate as timestamp)) + 90 as string) else concat('on ', o_orderpriority) end as raw""")
    return o.select("o_orderkey", D.format_time("raw").alias("formatted"))


@query("total_time", "SELECT event_id, filename, round(process_time + analyse_time, 6) AS total_time FROM fx_core_files")
def total_time(spark, sf):
    return tidy(D.total_time(I.view(spark, sf, "fx_core_files")).select("event_id", "filename", "total_time"))


@query("report_markdown", """SELECT client_id, pid, win, concat('# DPDK 故障分析报告', chr(10), chr(10), '> Run ID: `', CAST(win AS VARCHAR), '`', chr(10), chr(10), '## 摘要', chr(10), chr(10), '| 字段 | 值 |', chr(10), '|------|----|', chr(10),
  '| 客户端 | ', client_id, ' |', chr(10), '| 诊断置信度 | ', risk_level, ' |', chr(10), '| 崩溃时间 | ', ct, ' |', chr(10), chr(10),
  CASE WHEN risk <> '' THEN concat('## 根因', chr(10), chr(10), risk, chr(10), chr(10)) ELSE '' END, '## 指标特征', chr(10), chr(10), '- ', replace(insight, '|', concat(chr(10), '- '))) AS report
  FROM (SELECT *, repeat(CAST(win AS VARCHAR), CAST(samples AS INTEGER)) AS ct FROM ora_feat) f""")
def report_markdown(spark, sf):
    f = features(spark, sf).selectExpr(*T.WINDOW, "win as run_id", "risk_level as confidence", "repeat(cast(win as string), cast(samples as int)) as crash_time",
                                       "array_join(risk, '|') as root_cause", "insight")
    return D.report_markdown(f).select(*T.WINDOW, "report")


@query("diagnosis_inputs", f"""SELECT r.client_id, r.pid, r.crash_t, i.exe_name, coalesce(l.n, 0) AS log_rows, CASE WHEN c.client_id IS NULL THEN 'client not found' WHEN i.pid IS NULL THEN 'instance not found' WHEN k.pid IS NULL THEN 'crash record not found' ELSE '' END AS error
  FROM (SELECT DISTINCT client_id, pid, t AS crash_t FROM fx_e) r LEFT JOIN (SELECT DISTINCT client_id FROM fx_instances) c ON c.client_id = r.client_id
  LEFT JOIN fx_instances i ON i.client_id = r.client_id AND i.pid = r.pid LEFT JOIN (SELECT DISTINCT pid, t FROM fx_e WHERE event_type = 'error') k ON k.pid = r.pid AND k.t = r.crash_t
  LEFT JOIN (SELECT client_id, pid, COUNT(*) AS n FROM ora_rec WHERE t BETWEEN {AS_OF - 20} AND {AS_OF} GROUP BY client_id, pid) l ON l.client_id = r.client_id AND l.pid = r.pid""")
def diagnosis_inputs(spark, sf):
    e = I.events(spark, sf)
    req = e.selectExpr("client_id", "pid", "t as crash_t").distinct()
    inst = I.view(spark, sf, "fx_instances")
    crashes = e.where("event_type = 'error'").selectExpr("pid", "t as crash_t").distinct()
    logs = S.scan_both_cadences(rec(spark, sf), AS_OF, 20).groupBy("client_id", "pid").agg(F.count(F.lit(1)).alias("log_rows"))
    return D.diagnosis_inputs(req, inst, inst, crashes, logs)


@query("diagnosis_route", """SELECT case_id, CASE WHEN esc THEN 'fetch_data_escalation' ELSE 'fetch_data' END AS entry, CASE WHEN err <> '' THEN 'handle_error' WHEN NOT esc THEN 'root_cause_reasoning' ELSE 'root_cause_reasoning_escalation' END AS analysis,
  CASE WHEN err <> '' THEN 'handle_error' WHEN conf = 'LOW' OR steps = 0 THEN 'repair_suggestion' ELSE 'generate_report' END AS after FROM (
  SELECT case_id, crash_type IS NULL AS esc, CASE WHEN description = '' THEN 'empty' ELSE '' END AS err, CASE signal_name WHEN 'en' THEN 'high' WHEN 'fr' THEN 'LOW' ELSE 'medium' END AS conf, length(trim(root_cause)) AS steps FROM fx_cases) x""")
def diagnosis_route(spark, sf):
    c = I.view(spark, sf, "fx_cases").selectExpr("case_id", "crash_type is null as escalated", "crash_type is not null as has_core", "case when description = '' then 'empty' else '' end as error",
                                                 "case signal_name when 'en' then 'high' when 'fr' then 'LOW' else 'medium' end as confidence", "length(trim(root_cause)) as steps")
    return D.diagnosis_route(c).select("case_id", "entry", "analysis", "after")


@query("cleanup_crashed", """SELECT 'instance' AS kind, CAST(pid AS VARCHAR) AS name FROM fx_instances WHERE status <> 'crashed' UNION ALL
  SELECT 'file', filename FROM fx_core_files WHERE user_id IN (SELECT pid FROM fx_instances WHERE status = 'crashed')""")
def cleanup_crashed(spark, sf):
    files = C.core_filename(I.view(spark, sf, "fx_core_files").select("filename"))
    keep, drop = D.cleanup_crashed(I.view(spark, sf, "fx_instances"), files)
    return keep.select(F.lit("instance").alias("kind"), F.col("pid").cast("string").alias("name")).unionByName(
        drop.select(F.lit("file").alias("kind"), F.col("filename").alias("name")))


@query("register_clients", """SELECT s.client_id, CASE WHEN i.client_id IS NULL THEN 'added' ELSE 'already exists' END AS outcome FROM (SELECT concat('c', CAST(s_suppkey AS VARCHAR)) AS client_id FROM supplier) s
  LEFT JOIN (SELECT DISTINCT client_id FROM fx_instances) i ON i.client_id = s.client_id""")
def register_clients(spark, sf):
    new = I.table(spark, sf, "supplier").selectExpr("concat('c', cast(s_suppkey as string)) as client_id")
    add, dup = D.register_clients(I.view(spark, sf, "fx_instances"), new)
    return add.withColumn("outcome", F.lit("added")).unionByName(dup.withColumn("outcome", F.lit("already exists")))
