"""Text in and out of the semantic stage, alert routing to recipients, delivery log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.scalars import col, nonblank


def parse_semantic_output(df: DataFrame, raw: str = "raw") -> DataFrame:
    """ANOMALIES list (NONE means empty) and the ESCALATE switch, in any letter case."""
    body = F.trim(F.regexp_extract(raw, r"(?i)ANOMALIES:\s*(.+)", 1))
    items = F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<string>")
    return df.withColumns({
        "flags": F.when((body == "") | (F.upper(body) == "NONE"), none).otherwise(items),
        "escalate": F.col(raw).rlike(r"(?i)ESCALATE:\s*yes"),
    })


def parse_alert_text(df: DataFrame, raw: str = "raw", title_chars: int | None = None) -> DataFrame:
    """TITLE line and DESCRIPTION rest; without them the whole text; ``title_chars`` cuts the title that stands in."""
    title = F.trim(F.regexp_extract(raw, r"(?i)TITLE:\s*(.+)", 1))
    desc = F.regexp_replace(F.regexp_extract(raw, r"(?is)DESCRIPTION:\s*(.+)", 1), r"^\s+|\s+$", "")
    return df.withColumns({
        "title": F.when(title != "", title).otherwise(F.substring(raw, 1, title_chars) if title_chars else F.col(raw)),
        "description": F.when(desc != "", desc).otherwise(F.col(raw)),
    })


def _one_digit(c) -> Column:
    """One decimal, exact ties to even."""
    return F.format_string("%.1f", F.bround(col(c), 1))


def fallback_alert_text(features: DataFrame, flags: str = "flags", severity: str = "severity") -> DataFrame:
    """Title and multi-line description from the key numbers of a feature row."""
    pct = lambda c: F.concat(_one_digit(F.col(c) * 100), F.lit("%"))
    num = lambda c: F.col(c).cast("string")
    t = {k: F.lit(v) for k, v in fixed.FALLBACK_LINES.items()}
    desc = F.concat_ws(
        "\n",
        F.concat(t["rules"], F.array_join(flags, ", ")),
        F.concat(t["rx"], _one_digit("rx_pps"), t["tx"], _one_digit("tx_pps"), t["pps"]),
        F.concat(t["rx_errors"], num("rx_errors"), t["nombuf"], num("nombuf"), t["missed"], num("missed")),
        F.concat(t["mempool"], pct("mempool_free"), t["heap"], pct("heap_free")),
        F.concat(t["cpu"], pct("cpu_avg")),
    )
    return features.withColumns({
        "title": F.concat(F.lit("["), F.upper(severity), F.lit(f"] {fixed.FALLBACK_TITLE} — "), "client_id"), "description": desc,
    })


FAULT_SCHEMA = "root_cause string, call_chain array<string>, confidence string, repair_steps array<string>"


def extract_json_block(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Fenced block when it starts like JSON, else the outermost braces, else the text; parsed against the schema.

    ``valid`` is false for text that is not JSON, a missing root cause or confidence, or an unknown confidence.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    fenced = trim(F.regexp_extract(raw, r"(?is)```(?:json)?\s*\n?(.*?)\n?```", 1))
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    text = F.when(fenced.startswith("{") | fenced.startswith("["), fenced).when(braces != "", braces).otherwise(trim(F.col(raw)))
    x = df.withColumn("json_text", text).withColumn("_p", F.from_json("json_text", FAULT_SCHEMA))
    ok = F.col("_p").isNotNull() & F.col("_p.root_cause").isNotNull() & F.coalesce(
        F.col("_p.confidence").isin("high", "medium", "low"), F.lit(False))
    none = F.array().cast("array<string>")
    return x.withColumns({
        "valid": ok, "root_cause": F.when(ok, F.col("_p.root_cause")), "confidence": F.when(ok, F.col("_p.confidence")),
        "call_chain": F.when(ok, F.coalesce("_p.call_chain", none)), "repair_steps": F.when(ok, F.coalesce("_p.repair_steps", none)),
    }).drop("_p")


# ---- rules, recipients, templates --------------------------------------------------------------------------

def rules_with_recipients(rules: DataFrame, recipients: DataFrame, templates: DataFrame) -> DataFrame:
    """Live rules with template name, one row per recipient (a rule without any keeps one row with NULL).

    Long form on purpose: the recipient list of a rule is not bounded, so it is never collected into one row.
    """
    live = rules.where("not deleted")
    mails = recipients.where("coalesce(email, '') <> ''").select(F.col("rule_id").alias("id"), "email")
    names = templates.select(F.col("id").alias("template_id"), F.col("name").alias("_tn"))
    name = F.when(F.col("alert_type") == fixed.CRASH_TYPE, F.lit(fixed.CRASH_TEMPLATE)).otherwise(F.col("_tn"))
    return live.join(mails, "id", "left").join(names, "template_id", "left").select(
        "id", "name", "alert_type", "severity", "email", "template_id", name.alias("template_name"), "enabled")


def route_alerts(alerts: DataFrame, rules: DataFrame, recipients: DataFrame, templates: DataFrame) -> DataFrame:
    """Alert → mails sent and rules skipped.

    The outcome depends on the alert only through its severity, so rules and recipients are first reduced to one
    row per severity; alerts then meet that tiny table. Rules with a blank severity count for every alert.
    """
    counts = recipients.where("coalesce(email, '') <> ''").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_mail"))
    tpl = templates.select(F.col("id").alias("template_id"), F.col("enabled").alias("t_on"))
    active = rules.where(f"not deleted and enabled and alert_type = '{fixed.CALLBACK_TYPE}'")
    r = (
        active.join(counts, active.id == counts.rule_id, "left").join(tpl, "template_id", "left")
        .selectExpr("lower(coalesce(severity, '')) as sev",
                    "case when coalesce(n_mail, 0) > 0 and coalesce(t_on, false) then n_mail else 0 end as mails")
    )
    per = r.groupBy("sev").agg(F.sum("mails").alias("mails"), F.sum(F.expr("case when mails = 0 then 1 else 0 end")).alias("dead"),
                               F.count(F.lit(1)).alias("rules"))
    total = per.agg(F.expr("""struct(coalesce(sum(rules), 0) as all_rules, coalesce(sum(case when sev = '' then mails end), 0) as any_mails,
        coalesce(sum(case when sev = '' then dead end), 0) as any_dead, coalesce(sum(case when sev = '' then rules end), 0) as any_rules) as t"""))
    named = per.where("sev <> ''").withColumnRenamed("sev", "_sev")
    j = alerts.join(named, F.lower("severity") == F.col("_sev"), "left").withColumn("_t", total.scalar()).select("*", "_t.*")
    return j.selectExpr(
        *alerts.columns, "coalesce(mails, 0) + any_mails as sent_count",
        "coalesce(dead, 0) + any_dead + all_rules - coalesce(rules, 0) - any_rules as skipped_count",
        "case when all_rules = 0 then 'no callback alert rule configured' else 'callback notification sent' end as message")


def crash_notice_targets(crashes: DataFrame, rules: DataFrame, recipients: DataFrame, rule_id: int = fixed.CRASH_RULE_ID) -> DataFrame:
    """Crash → number of recipients of the built-in rule, or the reason why nobody is told."""
    rule = rules.where(F.col("id") == rule_id).where("not deleted").agg(F.struct(F.count(F.lit(1)).alias("n_rule"), F.bool_or("enabled").alias("on")))
    mails = recipients.where((F.col("rule_id") == rule_id) & F.expr("coalesce(email, '') <> ''")).agg(F.count(F.lit(1)))
    x = crashes.withColumns({"_r": rule.scalar(), "n_mail": mails.scalar()}).select(*crashes.columns, "n_mail", "_r.*")
    return x.selectExpr(
        *crashes.columns, "n_rule > 0 and not (coalesce(on, false) and n_mail = 0) as ok",
        """case when n_rule = 0 then 'alert rule not found' when not on then 'alert rule disabled'
            when n_mail = 0 then 'no recipients configured' else 'crash notification sent' end as message""",
        "case when n_rule > 0 and on then n_mail else 0 end as recipients")


def render_subject(df: DataFrame, template: str = "template", keys=fixed.ALERT_FIELDS) -> Column:
    """Fill {{key}} and {{ key }} with the columns of the row; a blank template gives the default one."""
    out = F.coalesce(nonblank(template), F.lit(fixed.SUBJECT_TEMPLATE))
    for k in keys:
        if k in df.columns:
            v = F.coalesce(F.col(k).cast("string"), F.lit("None"))
            out = F.replace(F.replace(out, F.lit("{{" + k + "}}"), v), F.lit("{{ " + k + " }}"), v)
    return out


def severity_to_level(severity: str = "severity") -> Column:
    return F.expr(f"case {severity} when 'critical' then 'P1' when 'warning' then 'P2' else 'P3' end")


def normalize_emails(df: DataFrame, raw: str = "emails") -> DataFrame:
    """Trimmed addresses in first-seen order without blanks and repeats; an address without @ or an empty list is an error."""
    clean = F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""))
    bad = F.filter(clean, lambda x: ~x.contains("@"))
    return df.withColumn("clean", clean).withColumn(
        "error", F.when(F.size(bad) > 0, F.concat(F.lit("invalid address: "), F.element_at(bad, 1)))
        .when(F.size("clean") == 0, F.lit("no address given")))


def normalize_fields(df: DataFrame, raw: str = "fields", allowed=fixed.ALERT_FIELDS) -> DataFrame:
    """Same for the field order of a template; unknown fields are an error."""
    clean = F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""))
    bad = F.filter(clean, lambda x: ~x.isin(*allowed))
    return df.withColumn("clean", clean).withColumn(
        "error", F.when(F.size(bad) > 0, F.concat(F.lit("unknown field: "), F.element_at(bad, 1)))
        .when(F.size("clean") == 0, F.lit("no field given")))


# ---- delivery log, prompts, chat -----------------------------------------------------------------------------

def mail_log_rows(alerts: DataFrame) -> DataFrame:
    """Normalised delivery records: trimmed texts, level P3 and status failed where nothing is given."""
    t = lambda c: f"trim(coalesce({c}, '')) as {c}"
    return alerts.selectExpr("sent_at", t("sender"), t("receivers"), t("subject"),
                             "coalesce(nullif(alert_level, ''), 'P3') as alert_level",
                             "coalesce(nullif(status, ''), 'failed') as status", "coalesce(error_message, '') as error_message")


def mail_log_append(rows: DataFrame, path: str) -> None:
    mail_log_rows(rows).write.mode("append").parquet(path)


def mail_log_search(log: DataFrame, start: str | None = None, end: str | None = None, status: str | None = None) -> DataFrame:
    """Filter by status and closed time range, newest first. The filters reach the scan."""
    if status:
        log = log.where(F.col("status") == status)
    if start:
        log = log.where(F.col("sent_at") >= F.lit(start))
    if end:
        log = log.where(F.col("sent_at") <= F.lit(end))
    return log.orderBy(F.col("sent_at").desc(), F.col("id").desc())


def prompt_context_rows(df: DataFrame, sections: dict[str, str], shots: str | None = None, most_shots: int | None = None) -> DataFrame:
    """One prompt text per row from labelled columns, with content hash, token estimate and example count."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {label}\n"), F.col(c).cast("string"))) for label, c in sections.items()]
    x = df.withColumn("prompt", F.trim(F.concat_ws("\n\n", *parts)))
    n = F.coalesce(F.col(shots), F.lit(0)) if shots else F.lit(0)
    n = n if most_shots is None else F.least(n, F.lit(most_shots))
    return x.withColumns({
        "content_hash": F.substring(F.sha2("prompt", 256), 1, 16),
        "token_estimate": F.floor(F.char_length("prompt") / 4).cast("bigint"), "few_shot_count": n.cast("bigint"),
    })


def chat_messages(turns: DataFrame, queries: DataFrame) -> DataFrame:
    """User turns and non-empty assistant turns in order, then the new question; one row per message.

    Order is the turn number itself and the question comes one past the last turn, so no conversation is collected.
    """
    kept = turns.where("role = 'user' or (role = 'assistant' and coalesce(text, '') <> '')").select(
        "conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ask = queries.join(last, "conv_id", "left").select(
        "conv_id", (F.coalesce("last", F.lit(-1)) + 1).alias("pos"), F.lit("user").alias("role"), F.col("query").alias("content"))
    return kept.unionByName(ask)


