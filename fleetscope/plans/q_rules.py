"""Registered queries: rules, cooldowns, routing, alert texts and recipients."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.operators import alerts as A
from fleetscope.operators import rules as R
from fleetscope.operators import telemetry as T
from fleetscope.plans import inputs as I
from fleetscope.plans.common import tidy
from fleetscope.plans.q_telemetry import _REF_D, _REF_I, features_with_baseline, features
from fleetscope.plans.registry import cte, query
from fleetscope.session import scratch_dir

_SRC = {"rx_pps": "rx_pps", "tx_pps": "tx_pps", "rx_errors": "d_ie", "tx_errors": "d_oe", "nombuf": "d_nb", "missed": "rx_missed",
        "queue_imbalance": "imbalance_ratio", "mempool_free": "mempool_free", "heap_free": "heap_free_ratio", "heap_frag": "heap_frag",
        "cpu_avg": "cpu_avg", "risk_score": "risk_score"}
_HAS_REF = set(_REF_D + _REF_I)
cte("ora_metrics", " UNION ALL ".join(
    f"SELECT client_id, pid, win, '{m}' AS metric, CAST({c} AS DOUBLE) AS value, "
    + (f"CAST(ref_{m} AS DOUBLE)" if m in _HAS_REF else "CAST(NULL AS DOUBLE)") + " AS ref FROM ora_asof" for m, c in _SRC.items()))
cte("ora_rules", "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, '{i}', '{s}', '{m}', '{c}', CAST({t} AS DOUBLE), {cd}, {'TRUE' if e else 'FALSE'})" for n, (i, s, m, c, t, cd, e) in enumerate(fixed.ALERT_RULES))
    + ") r(rule_no, rule_id, severity, metric, condition, threshold, cooldown_sec, escalate)")
cte("ora_rulehits", """SELECT m.client_id, m.pid, m.win, r.rule_id, r.severity, r.metric, m.value, m.ref, r.escalate, r.rule_no, r.cooldown_sec FROM ora_metrics m JOIN ora_rules r ON m.metric = r.metric
  WHERE CASE r.condition WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold WHEN 'gte' THEN value >= threshold WHEN 'lte' THEN value <= threshold
    WHEN 'eq' THEN value = threshold WHEN 'ref_ratio' THEN ref IS NOT NULL AND ref <> 0 AND value / ref > threshold
    WHEN 'ref_ratio_lt' THEN ref IS NOT NULL AND ref <> 0 AND value / ref < threshold
    WHEN 'ref_delta' THEN ref IS NOT NULL AND value - ref > threshold ELSE FALSE END""")


@query("unpivot_features", "SELECT client_id, pid, win, metric, round(value, 6) AS value FROM ora_metrics")
def unpivot_features(spark, sf):
    return tidy(R.unpivot_features(features(spark, sf)))


def rule_hits(spark, sf):
    return R.rule_eval(features_with_baseline(spark, sf), R.default_rules(spark))


@query("rule_eval", """SELECT client_id, pid, win, rule_id, severity, metric, round(value, 6) AS value, round(ref, 6) AS ref, escalate FROM ora_rulehits""")
def rule_eval(spark, sf):
    return tidy(rule_hits(spark, sf).select(*T.WINDOW, "rule_id", "severity", "metric", "value", "ref", "escalate"))


@query("load_rules", """SELECT CAST(s_suppkey AS VARCHAR) AS rule_id, CASE WHEN s_nationkey < 10 THEN '' ELSE s_name END AS name,
  CASE WHEN s_acctbal < 0 THEN 'info' WHEN s_acctbal < 5000 THEN 'warning' ELSE 'critical' END AS severity, 'rx_pps' AS metric, 'gt' AS condition, s_acctbal AS threshold,
  CAST(CASE WHEN s_nationkey >= 20 THEN 60 ELSE s_nationkey END AS BIGINT) AS cooldown_sec, s_nationkey = 3 AS escalate, s_nationkey <> 5 AS enabled FROM supplier""")
def load_rules(spark, sf):
    """Rule documents written as YAML-style maps per supplier; absent keys take the defaults."""
    from fleetscope.sources.rules import typed_rules
    s = I.table(spark, sf, "supplier")
    raw = s.selectExpr(
        "cast(s_suppkey as string) as id", "case when s_nationkey >= 10 then s_name end as name",
        "case when s_acctbal >= 0 then case when s_acctbal < 5000 then 'warning' else 'critical' end end as severity", "'rx_pps' as metric",
        "'gt' as condition", "cast(s_acctbal as string) as threshold", "case when s_nationkey < 20 then cast(s_nationkey as string) end as cooldown_sec",
        "case when s_nationkey = 3 then 'true' end as escalate_to_fault", "case when s_nationkey = 5 then 'false' end as enabled")
    return tidy(typed_rules(raw))


# ---- cooldown -----------------------------------------------------------------------------------------------

def _cooldown_ctes(name: str, source: str, keys: str, cool: str) -> None:
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"a.{x} = b.{x}" for x in k)
    cte(f"{name}_cand", f"SELECT {keys}, t, MIN(event_id) AS event_id, MAX({cool}) AS cool FROM {source} GROUP BY {keys}, t")
    cte(f"{name}_next", f"""SELECT a.*, b.t AS nt FROM {name}_cand a ASOF LEFT JOIN (SELECT {keys}, t FROM {name}_cand) b ON {on} AND a.t + a.cool <= b.t""")
    cte(name, f"""/*recursive*/ SELECT n.* FROM {name}_next n JOIN (SELECT {keys}, MIN(t) AS t FROM {name}_cand GROUP BY {keys}) b ON {on.replace('a.', 'n.')} AND n.t = b.t
  UNION ALL SELECT b.* FROM {name} a JOIN {name}_next b ON {on} AND b.t = a.nt""")


_cooldown_ctes("ora_fires", "fx_hits", "client_id, rule_id", "cooldown")
_cooldown_ctes("ora_sfires", "fx_hits", "client_id, severity", "60")


@query("rule_cooldown", "SELECT client_id, rule_id, t, event_id FROM ora_fires")
def rule_cooldown(spark, sf):
    return R.rule_cooldown(I.view(spark, sf, "fx_hits"), span=360)


@query("severity_cooldown", "SELECT client_id, severity, t, event_id FROM ora_sfires")
def severity_cooldown(spark, sf):
    return R.severity_cooldown(I.view(spark, sf, "fx_hits"), span=168)


# One evaluation = one client and second. Its rule flags are the event types seen, its semantic flags depend on the value.
_SEM = "CASE WHEN v > 20000 THEN 'traffic_spike' WHEN v > 15000 THEN event_type END"
cte("ora_flags", f"""SELECT client_id, t, flag, MIN(src) AS src, arg_min(ord, src * 1000000000 + ord) AS ord FROM (
  SELECT client_id, t, event_type AS flag, 0 AS src, event_id AS ord FROM fx_e UNION ALL SELECT client_id, t, {_SEM}, 1, event_id FROM fx_e WHERE {_SEM} IS NOT NULL) u
  GROUP BY client_id, t, flag""")
cte("ora_frules", "SELECT * FROM (VALUES ('error', 'critical', TRUE), ('purchase', 'warning', FALSE), ('click', 'info', FALSE), ('view', 'info', FALSE)) r(flag, severity, escalate)")
cte("ora_eval", """SELECT f.client_id, f.t, CASE MAX(CASE r.severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END AS severity,
  bool_or(coalesce(r.escalate, FALSE)) AS escalate, CAST(COUNT(*) AS BIGINT) AS n_flags FROM ora_flags f LEFT JOIN ora_frules r ON f.flag = r.flag GROUP BY f.client_id, f.t""")


def _flag_inputs(spark, sf):
    e = I.events(spark, sf)
    rule = e.select("client_id", "t", F.col("event_type").alias("flag"), F.col("event_id").alias("ord"))
    sem = e.select("client_id", "t", F.expr(_SEM).alias("flag"), F.col("event_id").alias("ord")).where("flag is not null")
    return rule, sem


def _flag_rules(spark):
    return spark.createDataFrame([("error", "critical", True), ("purchase", "warning", False), ("click", "info", False), ("view", "info", False)],
                                 "rule_id string, severity string, escalate boolean")


def _flags_long(spark, sf):
    rule, sem = _flag_inputs(spark, sf)
    return rule.unionByName(sem).select("client_id", "t", "flag").distinct()


@query("merge_flags", "SELECT client_id, t, string_agg(flag, '|' ORDER BY src, ord) AS flags FROM ora_flags GROUP BY client_id, t")
def merge_flags(spark, sf):
    rule, sem = _flag_inputs(spark, sf)
    return tidy(R.merge_flags(rule, sem, ["client_id", "t"]))


@query("max_severity", "SELECT client_id, t, severity FROM ora_eval")
def max_severity(spark, sf):
    return R.max_severity(_flags_long(spark, sf), _flag_rules(spark), ["client_id", "t"])


@query("needs_escalation", "SELECT client_id, t, escalate FROM ora_eval")
def needs_escalation(spark, sf):
    return R.needs_escalation(_flags_long(spark, sf), _flag_rules(spark), ["client_id", "t"])


cte("ora_evalhits", "SELECT client_id, severity, t, t AS event_id FROM ora_eval")
_cooldown_ctes("ora_efires", "ora_evalhits", "client_id, severity", "60")


@query("route_decision", """SELECT e.client_id, e.t, e.severity, e.escalate, f.t IS NOT NULL AS should_alert,
  CASE WHEN e.t % 97 = 0 THEN 'handle_error' WHEN e.escalate THEN 'escalate_to_fault' WHEN f.t IS NOT NULL THEN 'alert_generation' ELSE 'end' END AS route
  FROM ora_eval e LEFT JOIN ora_efires f ON e.client_id = f.client_id AND e.severity = f.severity AND e.t = f.t""")
def route_decision(spark, sf):
    flags, rules, keys = _flags_long(spark, sf), _flag_rules(spark), ["client_id", "t"]
    evals = R.max_severity(flags, rules, keys).join(R.needs_escalation(flags, rules, keys), keys)
    cooled = R.cooldown(
        evals.selectExpr("client_id", "severity", "t", "t as event_id", "60L as cooldown"), ["client_id", "severity"], span=168)
    # an evaluation in every 97th hour counts as failed
    state = evals.selectExpr("*", "true as has_flags", "t % 97 = 0 as error")
    return R.route_decision(state, cooled).select("client_id", "t", "severity", "escalate", "should_alert", "route")


@query("semantic_gate", """SELECT DISTINCT client_id, pid, win FROM ora_stat s WHERE win % 60 = 0
  AND NOT EXISTS (SELECT 1 FROM ora_rulehits h WHERE h.client_id = s.client_id AND h.pid = s.pid AND h.win = s.win AND h.severity = 'critical')""")
def semantic_gate(spark, sf):
    f = features_with_baseline(spark, sf)
    hits = R.rule_eval(f, R.default_rules(spark).where("severity = 'critical'"))
    return R.semantic_gate(f.select(*T.WINDOW), hits)


# ---- texts ---------------------------------------------------------------------------------------------------

_RAW = """concat(CASE k % 4 WHEN 0 THEN 'Anomalies:  NONE' WHEN 1 THEN concat('checked. ANOMALIES: ', event_type, ' , cpu_', CAST(k AS {S}), ', ')
  WHEN 2 THEN 'nothing to report' ELSE 'anomalies: heap' END, chr(10), CASE WHEN k % 3 = 0 THEN 'escalate:  YES' ELSE 'ESCALATE: no' END)"""
cte("ora_raw", f"SELECT event_id, k, event_type, {_RAW.replace('{S}', 'VARCHAR')} AS raw FROM fx_e")


@query("parse_semantic_output", """SELECT event_id, CASE k % 4 WHEN 1 THEN concat(event_type, '|cpu_', CAST(k AS VARCHAR)) WHEN 3 THEN 'heap' ELSE '' END AS flags,
  regexp_matches(raw, '(?i)ESCALATE:\\s*yes') AS escalate FROM ora_raw""")
def parse_semantic_output(spark, sf):
    e = I.events(spark, sf).select("event_id", F.expr(_RAW.replace("{S}", "STRING")).alias("raw"))
    return tidy(A.parse_semantic_output(e).select("event_id", "flags", "escalate"))


_ALERT_RAW = """CASE k % 3 WHEN 0 THEN concat('Title: ', event_type, ' alarm', chr(10), 'Description:  value ', CAST(v AS {S}), chr(10), 'second line ', chr(10))
  WHEN 1 THEN concat('TITLE:  only ', CAST(k AS {S})) ELSE concat('free text of event ', CAST(event_id AS {S}), repeat(' word', 20)) END"""
cte("ora_alertraw", f"SELECT event_id, {_ALERT_RAW.replace('{S}', 'VARCHAR')} AS raw FROM fx_e")


@query("parse_alert_text", """SELECT event_id, coalesce(nullif(trim(regexp_extract(raw, '(?i)TITLE:\\s*(.+)', 1)), ''), raw) AS title,
  coalesce(nullif(regexp_replace(regexp_extract(raw, '(?is)DESCRIPTION:\\s*(.+)', 1), '^\\s+|\\s+$', '', 'g'), ''), raw) AS description FROM ora_alertraw""")
def parse_alert_text(spark, sf):
    e = I.events(spark, sf).select("event_id", F.expr(_ALERT_RAW.replace("{S}", "STRING")).alias("raw"))
    return A.parse_alert_text(e).select("event_id", "title", "description")


@query("fallback_alert_text", """SELECT client_id, pid, win, concat('[', upper(risk_level), '] DPDK 异常 — ', client_id) AS title,
  concat('触发规则: ', replace(risk, '|', ', '), chr(10), '流量: RX ', printf('%.1f', rx_pps), ' pps / TX ', printf('%.1f', tx_pps), ' pps', chr(10),
  '错误: RX错误=', CAST(d_ie AS VARCHAR), ' MBUF不足=', CAST(d_nb AS VARCHAR), ' 丢包=', CAST(rx_missed AS VARCHAR), chr(10),
  '内存池空闲: ', printf('%.1f', mempool_free * 100), '% | 堆内存空闲: ', printf('%.1f', heap_free_ratio * 100), '%', chr(10), 'CPU均值: ', printf('%.1f', cpu_avg * 100), '%') AS description FROM ora_feat""")
def fallback_alert_text(spark, sf):
    f = features(spark, sf).withColumn("flags", F.col("risk")).withColumn("severity", F.col("risk_level"))
    return A.fallback_alert_text(f).select(*T.WINDOW, "title", "description")


_J = """concat('{{"root_cause": "cause ', event_type, '", "call_chain": ["a", "b', CAST(k AS {S}), '"], "confidence": "', CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'sure' END, '", "repair_steps": ["s1", "s2"]}}')"""
_J = _J.replace("{{", "{").replace("}}", "}")
_JRAW = f"""CASE k % 5 WHEN 0 THEN concat('Answer:', chr(10), '```json', chr(10), {_J}, chr(10), '```', chr(10), 'done') WHEN 1 THEN concat('text ', {_J}, ' tail')
  WHEN 2 THEN {_J} WHEN 3 THEN '  no json here  ' ELSE concat('x {{broken ', CAST(k AS {{S}}), '}} y') END""".replace("{{", "{").replace("}}", "}")
cte("ora_jraw", f"SELECT event_id, k, event_type, {_JRAW.replace('{S}', 'VARCHAR')} AS raw, {_J.replace('{S}', 'VARCHAR')} AS body FROM fx_e")


@query("extract_json_block", """SELECT event_id, CASE k % 5 WHEN 3 THEN 'no json here' WHEN 4 THEN concat('{broken ', CAST(k AS VARCHAR), '}') ELSE body END AS json_text,
  k % 5 < 3 AND k % 4 < 3 AS valid, CASE WHEN k % 5 < 3 AND k % 4 < 3 THEN json_extract_string(body, '$.root_cause') END AS root_cause,
  CASE WHEN k % 5 < 3 AND k % 4 < 3 THEN json_extract_string(body, '$.confidence') END AS confidence,
  CASE WHEN k % 5 < 3 AND k % 4 < 3 THEN concat('a|b', CAST(k AS VARCHAR)) END AS call_chain, CASE WHEN k % 5 < 3 AND k % 4 < 3 THEN 's1|s2' END AS repair_steps FROM ora_jraw""")
def extract_json_block(spark, sf):
    e = I.events(spark, sf).select("event_id", F.expr(_JRAW.replace("{S}", "STRING")).alias("raw"))
    return tidy(A.extract_json_block(e).drop("raw"))


# ---- recipients -------------------------------------------------------------------------------------------------

_RULE_SQL = """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE WHEN n_nationkey % 6 = 1 THEN 'crash_event' ELSE 'callback_event' END AS alert_type,
  CASE n_nationkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN '' WHEN 2 THEN 'warning' ELSE 'Info' END AS severity,
  CAST(CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE n_regionkey END AS BIGINT) AS template_id, n_nationkey % 8 <> 7 AS enabled, n_nationkey % 11 = 5 AS deleted FROM nation"""
_MAIL_SQL = """SELECT CAST(s_nationkey AS BIGINT) AS rule_id, CASE WHEN s_acctbal < 0 THEN '' ELSE concat(lower(replace(s_name, '#', '')), '@ops.example') END AS email FROM supplier"""
_TPL_SQL = "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, r_regionkey <> 2 AS enabled FROM region"
cte("ora_mrules", _RULE_SQL)
cte("ora_mails", _MAIL_SQL)
cte("ora_tpl", _TPL_SQL)


def mail_tables(spark, sf):
    run = lambda sql, t: spark.sql(sql.replace(f"FROM {t}", "FROM {src}"), src=I.table(spark, sf, t))
    return run(_RULE_SQL, "nation"), run(_MAIL_SQL, "supplier"), run(_TPL_SQL, "region")


@query("rules_with_recipients", """SELECT r.id, r.name, r.alert_type, r.severity, m.email, r.template_id,
  CASE WHEN r.alert_type = 'crash_event' THEN 'crash_fixed_template' ELSE t.name END AS template_name, r.enabled FROM ora_mrules r
  LEFT JOIN ora_mails m ON m.rule_id = r.id AND m.email <> '' LEFT JOIN ora_tpl t ON t.id = r.template_id WHERE NOT r.deleted""")
def rules_with_recipients(spark, sf):
    return A.rules_with_recipients(*mail_tables(spark, sf))


@query("route_alerts", """SELECT a.alert_id, a.severity, x.sent_count, x.skipped_count, 'callback notification sent' AS message FROM fx_alerts a JOIN (
  SELECT s.severity, CAST(SUM(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS sent_count, CAST(SUM(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS skipped_count FROM (
    SELECT s.severity, r.id, coalesce(m.n, 0) AS n, (r.severity = '' OR lower(r.severity) = s.severity) AND coalesce(m.n, 0) > 0 AND coalesce(t.enabled, FALSE) AS ok
    FROM (SELECT DISTINCT severity FROM fx_alerts) s JOIN ora_mrules r ON r.enabled AND NOT r.deleted AND r.alert_type = 'callback_event'
    LEFT JOIN (SELECT rule_id, COUNT(*) AS n FROM ora_mails WHERE email <> '' GROUP BY rule_id) m ON m.rule_id = r.id LEFT JOIN ora_tpl t ON t.id = r.template_id) s GROUP BY s.severity) x
  ON a.severity = x.severity""")
def route_alerts(spark, sf):
    return A.route_alerts(I.view(spark, sf, "fx_alerts"), *mail_tables(spark, sf)).select("alert_id", "severity", "sent_count", "skipped_count", "message")


@query("crash_notice_targets", """SELECT a.alert_id, a.client_id, c.n > 0 AS ok, CASE WHEN c.n > 0 THEN 'crash notification sent' ELSE 'no recipients configured' END AS message, c.n AS recipients
  FROM fx_alerts a, (SELECT COUNT(*) AS n FROM ora_mails WHERE rule_id = 1 AND email <> '') c""")
def crash_notice_targets(spark, sf):
    rules, mails, _ = mail_tables(spark, sf)
    crashes = I.view(spark, sf, "fx_alerts").select("alert_id", "client_id")
    return A.crash_notice_targets(crashes, rules, mails)


@query("render_subject", """SELECT alert_id, CASE WHEN status = 'failed' THEN concat('【', severity, '】', title) ELSE concat('[', client_id, '] ', title, ' / ', severity, ' {{unknown}}') END AS subject FROM fx_alerts""")
def render_subject(spark, sf):
    a = I.view(spark, sf, "fx_alerts").withColumn(
        "template", F.expr("case when status = 'failed' then '' else '[{{client_id}}] {{ title }} / {{ severity }} {{unknown}}' end"))
    return a.select("alert_id", A.render_subject(a).alias("subject"))


@query("severity_to_level", "SELECT alert_id, CASE severity WHEN 'critical' THEN 'P1' WHEN 'warning' THEN 'P2' ELSE 'P3' END AS level FROM fx_alerts")
def severity_to_level(spark, sf):
    return I.view(spark, sf, "fx_alerts").select("alert_id", A.severity_to_level().alias("level"))


@query("normalize_lists", """SELECT s_suppkey, CASE WHEN s_nationkey = 4 THEN concat(s_name, '@x.example|', s_name) ELSE concat(s_name, '@x.example') END AS emails,
  CASE WHEN s_nationkey = 4 THEN concat('invalid address: ', s_name) END AS email_error, CASE WHEN s_nationkey = 9 THEN '' WHEN s_nationkey = 8 THEN 'title|body' ELSE 'title|severity' END AS fields,
  CASE WHEN s_nationkey = 9 THEN 'no field given' WHEN s_nationkey = 8 THEN 'unknown field: body' END AS field_error FROM supplier""")
def normalize_lists(spark, sf):
    s = I.table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "array(concat(' ', s_name, '@x.example '), '', concat(s_name, '@x.example'), case when s_nationkey = 4 then s_name else '  ' end) as emails",
        "case when s_nationkey = 9 then array('', ' ') when s_nationkey = 8 then array(' title', 'body') else array('title ', 'severity', 'title', '') end as fields")
    a = A.normalize_emails(s).withColumnsRenamed({"clean": "e", "error": "email_error"})
    b = A.normalize_fields(a).withColumnsRenamed({"clean": "f", "error": "field_error"})
    return tidy(b.select("s_suppkey", F.col("e").alias("emails"), "email_error", F.col("f").alias("fields"), "field_error"))


_LOG_ROWS = ["triggered_at as sent_at", "concat(' ', client_id, ' ') as sender", "'ops@x.example' as receivers", "title as subject",
             "case severity when 'critical' then 'P1' when 'warning' then '' end as alert_level", "case when status = 'failed' then null else status end as status",
             "cast(null as string) as error_message"]


@query("mail_log_append", """SELECT triggered_at AS sent_at, client_id AS sender, 'ops@x.example' AS receivers, title AS subject, CASE severity WHEN 'critical' THEN 'P1' ELSE 'P3' END AS alert_level,
  status, '' AS error_message FROM fx_alerts""")
def mail_log_append(spark, sf):
    """Failed mails, then the others, appended to one log and read back."""
    path, rows = scratch_dir(spark, "mail-log"), I.view(spark, sf, "fx_alerts")
    for part in ("status = 'failed'", "status <> 'failed'"):
        A.mail_log_append(rows.where(part).selectExpr(*_LOG_ROWS), path)
    return spark.read.parquet(path)


@query("mail_log_search", """SELECT alert_id AS id, triggered_at AS sent_at, client_id, title FROM fx_alerts WHERE status = 'failed' AND triggered_at >= TIMESTAMP '2024-01-05 00:00:00' AND triggered_at <= TIMESTAMP '2024-01-20 12:00:00'""")
def mail_log_search(spark, sf):
    log = I.view(spark, sf, "fx_alerts").selectExpr("alert_id as id", "triggered_at as sent_at", "client_id", "title", "status")
    return A.mail_log_search(log, "2024-01-05 00:00:00", "2024-01-20 12:00:00", "failed").drop("status")


@query("prompt_context_rows", """SELECT client_id, pid, win, prompt, substr(sha256(prompt), 1, 16) AS content_hash, CAST(floor(length(prompt) / 4.0) AS BIGINT) AS token_estimate, n_pts AS few_shot_count FROM (
  SELECT client_id, pid, win, CAST(points AS BIGINT) AS n_pts, concat('## insight', chr(10), insight, chr(10), chr(10), '## risk', chr(10), risk_level, chr(10), chr(10), '## baseline missed', chr(10), CAST(ref_missed AS VARCHAR)) AS prompt FROM ora_asof WHERE ref_missed IS NOT NULL
  UNION ALL SELECT client_id, pid, win, CAST(points AS BIGINT), concat('## insight', chr(10), insight, chr(10), chr(10), '## risk', chr(10), risk_level) FROM ora_asof WHERE ref_missed IS NULL) p""")
def prompt_context_rows(spark, sf):
    f = features_with_baseline(spark, sf).withColumn("insight", F.array_join("insight", "|"))
    p = A.prompt_context_rows(f, {"insight": "insight", "risk": "risk_level", "baseline missed": "ref_missed"}, shots="points")
    return p.select(*T.WINDOW, "prompt", "content_hash", "token_estimate", "few_shot_count")


@query("chat_messages", """SELECT conv_id, turn AS pos, role, text AS content FROM conversations WHERE role = 'user' OR (role = 'assistant' AND coalesce(text, '') <> '')
  UNION ALL SELECT conv_id, MAX(turn) + 1, 'user', concat('follow-up on ', CAST(conv_id AS VARCHAR)) FROM conversations GROUP BY conv_id""")
def chat_messages(spark, sf):
    c = I.table(spark, sf, "conversations")
    ask = c.select("conv_id").distinct().withColumn("query", F.concat(F.lit("follow-up on "), F.col("conv_id").cast("string")))
    return A.chat_messages(c, ask)
