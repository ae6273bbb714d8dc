"""Streaming jobs.

Every job takes a streaming DataFrame and an output folder and returns the started query. Sinks are folders: each
micro-batch writes its own ``epoch=N`` folder with overwrite, so a batch that is repeated after a failure replaces its
own output and nothing is written twice. Tables with keys are append-only logs read through ``latest``.
Event times come without a zone, so they are cast before the watermark is set. Delays and widths are parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetscope.functions import fixed
from fleetscope.functions.blocked import last_n_per_key
from fleetscope.operators import telemetry as T
from fleetscope.operators.features import asof_latest
from fleetscope.operators.fleet import registry_diff
from fleetscope.session import ROCKSDB
from fleetscope.sources.records import flush_latest_wins
from fleetscope.streaming.log import compact, read_log
from fleetscope.streaming.poll import with_clock


def file_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def event_time(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _start(df: DataFrame, out: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return (df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{out}/_checkpoint")
            .trigger(availableNow=True).start())


def _write_epoch(df: DataFrame, out: str, epoch: int, name: str = "data") -> None:
    df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")


def to_folder(df: DataFrame, out: str) -> StreamingQuery:
    return _start(df, out, lambda b, e: _write_epoch(b, out, e))


def read_output(spark: SparkSession, out: str, name: str = "data") -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


# ---- ingest ------------------------------------------------------------------------------------------------

def ingest_latest(raw: DataFrame, out: str) -> StreamingQuery:
    """Flush with last-write-wins: every batch appends its own winners, ``latest`` settles them across batches."""
    return _start(raw, out, lambda b, e: _write_epoch(flush_latest_wins(b), out, e))


def latest(spark: SparkSession, out: str) -> DataFrame:
    return flush_latest_wins(read_log(spark, out))


def compact_latest(spark: SparkSession, out: str) -> bool:
    """Fold the settled epochs of ``ingest_latest`` into one generation of winners."""
    return compact(spark, out, flush_latest_wins)


def crash_dedup(files: DataFrame, out: str, delay: str = "1 hour") -> StreamingQuery:
    """Each core file is handed on once; names are remembered for the watermark delay."""
    return to_folder(event_time(files, delay=delay).dropDuplicatesWithinWatermark(["filename"]), out)


# ---- windows ------------------------------------------------------------------------------------------------

def _port_stream(records: DataFrame, width: str, delay: str, clock: DataFrame | None = None) -> DataFrame:
    """First and last counters per (window, port); plain scalars, so state per window is one small row."""
    counters = list(fixed.PORT_COUNTERS)
    rows = T._port_rows(records.drop("win"), 1).drop("win")
    rows = with_clock(rows.withColumn("ts", F.timestamp_seconds(F.col("t"))), clock, delay)
    agg = ["min(t) as t0", "max(t) as t1", "sum(case when coalesce(pos, 0) = 0 then 1 else 0 end) as n"]
    agg += [f"min_by({c}, t) as first_{c}" for c in counters] + [f"max_by({c}, t) as last_{c}" for c in counters]
    agg += [f"max_by({c}, t) as {c}" for c in T._PORT_LAST]
    g = rows.groupBy(F.window("ts", width), *T.INSTANCE, "port").agg(*[F.expr(x) for x in agg])
    return g.withColumn("win", F.unix_seconds(F.col("window.end"))).drop("window")


def _finish(batch: DataFrame) -> DataFrame:
    x = T._windowed_deltas(batch, list(fixed.PORT_COUNTERS))
    return x.selectExpr(*T.WINDOW, "port", "window_seconds", "samples", "d_ipackets as rx_packets", "d_ierrors as rx_errors",
                        f"{T.rate_sql('d_ipackets', 'window_seconds')} as rx_pps", "imbalance_ratio")


def fast_features(records: DataFrame, out: str, width: str = "10 seconds", delay: str = "10 seconds", clock: DataFrame | None = None) -> StreamingQuery:
    """Tumbling windows of the fast poll. All ports of a window close in the same batch, so deltas are finished there."""
    return _start(_port_stream(records, width, delay, clock), out, lambda b, e: _write_epoch(_finish(b), out, e))


def slow_features(records: DataFrame, out: str, every: int, width: str = "10 seconds", delay: str = "10 seconds", clock: DataFrame | None = None) -> StreamingQuery:
    """The slow poll looks at the last short window of every ``every`` seconds: tumbling windows, most of them skipped."""
    g = _port_stream(records, width, delay, clock).where(F.col("win") % every == 0)
    return _start(g, out, lambda b, e: _write_epoch(_finish(b), out, e))


def baseline_join(features: DataFrame, baseline: DataFrame, out: str, ttl: int, metrics: Sequence[str]) -> StreamingQuery:
    """Closed windows meet the newest baseline that is at most ``ttl`` seconds old (static table, re-read per batch)."""
    ref = baseline.select(*T.INSTANCE, F.col("win").alias("ref_win"), *[F.col(m).alias(f"ref_{m}") for m in metrics])

    def each(b: DataFrame, e: int) -> None:
        _write_epoch(asof_latest(b, ref, T.INSTANCE, "win", "ref_win", ttl, [f"ref_{m}" for m in metrics]), out, e)

    return _start(features, out, each)


def liveness(heartbeats: DataFrame, out: str, timeout: str = "30 seconds", delay: str = "30 seconds", key: str = "client_id", clock: DataFrame | None = None) -> StreamingQuery:
    """Heartbeat sessions; a session ends one timeout after its last heartbeat, which is when the client counts as dead."""
    h = with_clock(heartbeats, clock, delay, key)
    s = h.groupBy(F.session_window("ts", timeout), key).agg(F.count(F.lit(1)).alias("beats"))
    return to_folder(s.select(key, F.col("session_window.start").alias("first_seen"), F.col("session_window.end").alias("dead_at"), "beats"), out)


# ---- keyed state -----------------------------------------------------------------------------------------------

class Cooldown(StatefulProcessor):
    """Per key: time of the last fire. A hit fires when the cooldown has passed since."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
        last = self._last.get()[0] if self._last.exists() else None
        fires = []
        for t, c, i in zip(pdf["t"], pdf["cooldown"], pdf["event_id"]):
            if last is None or t >= last + c:
                last = int(t)
                fires.append((*key, last, int(i)))
        if last is not None:
            self._last.update((last,))
        yield pd.DataFrame(fires, columns=["client_id", "rule_id", "t", "event_id"])

    def close(self) -> None:
        pass


def cooldown(hits: DataFrame, out: str) -> StreamingQuery:
    """Fires of (client, rule) hits that come in order, or in any order within a batch; see ``poll.rule_cooldown`` for late ones."""
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fires = hits.groupBy("client_id", "rule_id").transformWithStateInPandas(
        statefulProcessor=Cooldown(), outputStructType="client_id string, rule_id string, t bigint, event_id bigint",
        outputMode="Append", timeMode="None")
    return to_folder(fires, out)


class CounterDelta(StatefulProcessor):
    """Per instance: the previous tick's counters; emits the change. The first tick yields nothing."""

    COUNTERS = ("rx", "tx", "errors")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._prev = handle.getValueState("prev", "rx bigint, tx bigint, errors bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = list(self.COUNTERS)
        pdf = pd.concat(list(rows)).sort_values("t")
        before = pdf[names].shift(1)
        if self._prev.exists():
            before.iloc[0] = list(self._prev.get())
        out = pdf[["client_id", "pid", "t"]].copy()
        for n in names:
            out[n] = pdf[n] - before[n]
        self._prev.update(tuple(int(x) for x in pdf[names].iloc[-1]))
        yield out.dropna().astype({n: "int64" for n in names})

    def close(self) -> None:
        pass


def counter_delta(ticks: DataFrame, out: str) -> StreamingQuery:
    """ticks: client_id, pid, t, rx, tx, errors (cumulative)."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    d = ticks.groupBy("client_id", "pid").transformWithStateInPandas(
        statefulProcessor=CounterDelta(), outputStructType="client_id string, pid bigint, t bigint, rx bigint, tx bigint, errors bigint",
        outputMode="Append", timeMode="None")
    return to_folder(d, out)


# ---- batches ---------------------------------------------------------------------------------------------------

def ring_buffer(series: DataFrame, out: str, n: int = fixed.RING_1S) -> StreamingQuery:
    """Each batch stores only its own newest n points per series; ``read_ring`` cuts across batches."""
    keys = [*T.INSTANCE, "category", "name"]
    return _start(series, out, lambda b, e: _write_epoch(last_n_per_key(b, keys, "t", n), out, e))


def read_ring(spark: SparkSession, out: str, n: int = fixed.RING_1S) -> DataFrame:
    return last_n_per_key(read_log(spark, out), [*T.INSTANCE, "category", "name"], "t", n)


def compact_ring(spark: SparkSession, out: str, n: int = fixed.RING_1S) -> bool:
    """Fold the settled epochs of ``ring_buffer`` into the newest n points of each series."""
    return compact(spark, out, lambda rows: last_n_per_key(rows, [*T.INSTANCE, "category", "name"], "t", n))


def registry_sync(running: DataFrame, out: str) -> StreamingQuery:
    """Log of the running processes: sync (time of the snapshot), client_id, pid. A snapshot may span many batches."""
    last = lambda b: b.groupBy(*T.INSTANCE).agg(F.max("sync").alias("sync"))
    return _start(running, out, lambda b, e: _write_epoch(last(b), out, e))


def read_registry_actions(spark: SparkSession, out: str, registered: DataFrame, sync: int | None = None) -> DataFrame:
    """Register and unregister actions of one complete snapshot, by default the newest, against the registry table.

    The log holds the newest sync that saw each process, whatever batch or file it came in, so a process counts as
    running if that is the snapshot asked for (or a later one).
    """
    seen = read_output(spark, out).groupBy(*T.INSTANCE).agg(F.max("sync").alias("sync"))
    at = seen.agg(F.max("sync").alias("_at")) if sync is None else spark.range(1).select(F.lit(sync).alias("_at"))
    alive = seen.join(F.broadcast(at), F.col("sync") >= F.col("_at")).select(*T.INSTANCE)  # one row
    return registry_diff(alive, registered)


def alert_sink(results: DataFrame, out: str) -> StreamingQuery:
    """One write per batch, partitioned by sink: escalations and alerts."""
    def each(b: DataFrame, e: int) -> None:
        named = b.withColumn("sink", F.when(F.col("escalate"), "escalations").otherwise("alerts"))
        named.write.mode("overwrite").partitionBy("sink").parquet(f"{out}/data/epoch={e}")

    return _start(results, out, each)
