"""Clients, instances, crash reports: liveness, registry, pages, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.blocked import previous_row
from fleetscope.functions.scalars import col
from fleetscope.sources.pages import PageDirectory, page_directory, read_page


def client_alive(clients: DataFrame, heartbeats: DataFrame, now: int, timeout: int = fixed.LIVENESS_TIMEOUT) -> DataFrame:
    """Last heartbeat younger than the timeout; a client that never reported is dead."""
    last = heartbeats.groupBy("client_id").agg(F.max("t").alias("last_seen"))
    return clients.select("client_id").distinct().join(last, "client_id", "left").withColumn(
        "alive", F.coalesce(F.lit(now) - F.col("last_seen") < timeout, F.lit(False)))


def running_instances(instances: DataFrame, status: str | None = "running") -> DataFrame:
    x = instances if status is None else instances.where(F.col("status") == status)
    return x.orderBy("start_time", "client_id", "pid")


def registry_diff(running: DataFrame, registered: DataFrame, key=("client_id", "pid")) -> DataFrame:
    """Instances to add to and to remove from the registry."""
    k = list(key)
    a, b = running.select(*k).distinct(), registered.select(*k).distinct()
    return a.join(b, k, "left_anti").withColumn("action", F.lit("register")).unionByName(
        b.join(a, k, "left_anti").withColumn("action", F.lit("unregister")))


def status_transition(requests: DataFrame, key: str = "pid", order: str = "seq", span: int = 1_000_000) -> DataFrame:
    """Final status per process after ordered requests.

    ``running`` announces a process (ignored once it crashed); ``stop`` and ``crashed`` only apply to a running one;
    crashed is final. A crash request therefore takes effect exactly when the request right before it announced the
    process (repeated crash requests after an ineffective one stay ineffective), so neighbours and plain aggregates
    decide and no history is collected.
    """
    x = previous_row(requests.select(key, order, "status"), [key], order, ["status"], span=span)
    g = x.groupBy(key).agg(
        F.min(F.when((F.col("status") == "crashed") & (F.col("prev.status") == "running"), F.col(order))).alias("crash_seq"),
        F.min(F.when(F.col("status") == "running", F.col(order))).alias("first_run"),
        F.max_by("status", F.when(F.col("status") != "crashed", F.col(order))).alias("last_other"))
    final = F.when(F.col("crash_seq").isNotNull(), "crashed").when(F.col("first_run").isNull(), F.lit(None)).otherwise(F.col("last_other"))
    return g.select(key, final.alias("status"), "crash_seq")


def client_list(clients: DataFrame, instances: DataFrame, alive: DataFrame) -> DataFrame:
    n = instances.where("status = 'running'").groupBy("client_id").agg(F.count(F.lit(1)).alias("running"))
    return clients.join(n, "client_id", "left").join(alive, "client_id", "left").select(
        *clients.columns, F.coalesce("running", F.lit(0)).alias("running"), F.coalesce("alive", F.lit(False)).alias("alive"))


def fleet_counts(instances: DataFrame, crashes: DataFrame, cases: DataFrame) -> DataFrame:
    """Clients, running processes, crashes and cases in one row."""
    i = instances.agg(F.countDistinct("client_id").alias("clients"),
                      F.count(F.when(F.col("status") == "running", 1)).alias("running"))
    n = F.count(F.lit(1)).alias("n")
    return i.withColumns({"crashes": crashes.agg(n).scalar(), "cases": cases.agg(n).scalar()})


def format_time(c) -> Column:
    """Timestamp or epoch text or ISO text to yyyy-MM-dd HH:mm:ss; anything else stays as it is."""
    s = col(c).cast("string")
    epoch = F.when(s.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(s.try_cast("double")))
    ts = F.coalesce(epoch, F.try_to_timestamp(s))
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), s)


def report_page(reports: DataFrame, crashes: DataFrame, on: str, page: int, page_size: int, directory: PageDirectory | None = None) -> DataFrame:
    """One page of crash reports, newest first, with their crash record. The page is cut before the join.

    ``directory`` of ``created`` saves counting the ranges again for every page.
    """
    p = read_page(reports, directory or page_directory(reports, "created"), [F.col("id").desc()], page, page_size, descending=True)
    return p.join(crashes, on).withColumn("create_time", format_time("created"))


def nested_get(doc, path: str, default) -> Column:
    return F.coalesce(F.get_json_object(col(doc), path), F.lit(default))


def total_time(crashes: DataFrame) -> DataFrame:
    return crashes.withColumn("total_time", F.col("process_time") + F.col("analyse_time"))


def report_markdown(df: DataFrame) -> DataFrame:
    """One Markdown report per row from joined columns; sections without data are left out."""
    cell = lambda c: F.coalesce(c, F.lit("N/A"))
    row = lambda c, name: F.concat(F.lit(f"| {name} | "), cell(F.col(c).cast("string")), F.lit(" |"))
    head = F.concat(F.lit(f"{fixed.REPORT_TITLE}\n\n> Run ID: `"), F.col("run_id").cast("string"), F.lit("`"))
    summary = F.concat_ws("\n", F.lit(fixed.REPORT_SUMMARY), *[row(c, name) for c, name in fixed.REPORT_FIELDS.items()])
    cause = F.when(F.coalesce("root_cause", F.lit("")) != "", F.concat(F.lit(f"{fixed.REPORT_CAUSE}\n\n"), F.col("root_cause")))
    signs = F.when(F.size("insight") > 0, F.concat(F.lit(f"{fixed.REPORT_SIGNS}\n\n- "), F.array_join("insight", "\n- ")))
    return df.withColumn("report", F.concat_ws("\n\n", head, summary, cause, signs))


def diagnosis_inputs(requests: DataFrame, clients: DataFrame, instances: DataFrame, crashes: DataFrame, log_counts: DataFrame) -> DataFrame:
    """Client, instance, crash and log rows of each request; the first thing that is missing becomes the error."""
    c = clients.select("client_id").distinct().withColumn("_c", F.lit(True))
    i = instances.select("client_id", "pid", "exe_name", F.lit(True).alias("_i"))
    k = crashes.select("pid", "crash_t", F.lit(True).alias("_k"))
    x = requests.join(c, "client_id", "left").join(i, ["client_id", "pid"], "left").join(k, ["pid", "crash_t"], "left").join(
        log_counts, ["client_id", "pid"], "left")
    return x.select(*requests.columns, "exe_name", F.coalesce("log_rows", F.lit(0)).alias("log_rows"), F.expr(
        """case when _c is null then 'client not found' when _i is null then 'instance not found'
            when _k is null then 'crash record not found' else '' end""").alias("error"))


def diagnosis_route(states: DataFrame) -> DataFrame:
    """Path of a fault diagnosis: entry, analysis stage and what follows it."""
    return states.selectExpr(
        "*", "case when escalated then 'fetch_data_escalation' else 'fetch_data' end as entry",
        "case when error <> '' then 'handle_error' when has_core then 'root_cause_reasoning' else 'root_cause_reasoning_escalation' end as analysis",
        """case when error <> '' then 'handle_error' when lower(coalesce(confidence, '')) in ('low', '低') or steps = 0
            then 'repair_suggestion' else 'generate_report' end as after""")


def cleanup_crashed(instances: DataFrame, files: DataFrame, status: str = "crashed") -> tuple[DataFrame, DataFrame]:
    """Instances that stay, and the core files (parsed names) of the removed ones."""
    gone = instances.where(F.col("status") == status)
    return instances.where(F.col("status") != status), files.join(gone.select("pid").distinct(), "pid", "left_semi")


def register_clients(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clients to add and rejected ones that exist already."""
    known = existing.select("client_id").distinct()
    return incoming.join(known, "client_id", "left_anti"), incoming.join(known, "client_id", "left_semi")
