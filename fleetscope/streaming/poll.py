"""The polling loop as one streaming query: window aggregate, labels and rules, cooldown, sink.

Both cadences form one stream. A window of an instance is one state row with its first and last record of each
cadence and the points of its rate series, at most as many as the window has seconds. When the watermark passes a window it
becomes a feature row with the same labels as in batch, meets the rule table, and its hits go, in order of time, to the
cooldown, whose state is one number per key and is given up by a timer once the cooldown is over.

A clock, a stream of bare times, drives the watermark where a source falls silent; its last tick closes what is still open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetscope.functions import fixed
from fleetscope.functions.scalars import once, ratio, ratio_sql
from fleetscope.operators import telemetry as T
from fleetscope.operators.features import label_windows
from fleetscope.operators.rules import rule_eval
from fleetscope.session import ROCKSDB

CLOCK = "ts timestamp"


# ---- clock -----------------------------------------------------------------------------------------------------

def clock_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The clock as a stream of times; the folder is made where it is missing."""
    spark.createDataFrame([], CLOCK).write.mode("append").parquet(folder)
    return spark.readStream.schema(CLOCK).parquet(folder)


def tick(spark: SparkSession, folder: str, seconds: float) -> None:
    """Let the clock show a time, in seconds since 1970."""
    spark.range(1).select(F.timestamp_seconds(F.lit(seconds)).alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def with_clock(events: DataFrame, clock: DataFrame | None, delay: str, key: str = "client_id") -> DataFrame:
    """Events (with ``ts`` and a ``key`` that is not NULL) under a watermark that the ticks of the clock advance too."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if clock is None:
        return events.withWatermark("ts", delay)
    # Ticks end behind the watermark; the test names the event time, else it would be moved below the watermark.
    return events.unionByName(clock, allowMissingColumns=True).withWatermark("ts", delay).where(f"if({key} is null, ts is null, true)")


def run_and_close(spark: SparkSession, start: Callable[[DataFrame], StreamingQuery], folder: str, seconds: float) -> StreamingQuery:
    """Run a job to the end of its input, then on with two ticks: the first closes every window, the second ends what those began."""
    start(clock_stream(spark, folder)).awaitTermination()
    for later in (0, 1):
        tick(spark, folder, seconds + later)
        q = start(spark.readStream.schema(CLOCK).parquet(folder))
        q.awaitTermination()
    return q


# ---- window aggregate --------------------------------------------------------------------------------------------

_FIELDS_1S = ("is_alive", "ethdev_stats", "ethdev_link", "mempool_stats")
_FIELDS_5S = ("ethdev_xstats", "heap_stats", "active_lcores", "avg_usage", "max_usage", "hottest_lcore")


def both_cadences(rec_1s: DataFrame, rec_5s: DataFrame) -> DataFrame:
    """One stream of ts, client_id, pid, t and the record of either cadence as ``one`` or ``five``."""
    pack = lambda df, names, out: df.select(*T.INSTANCE, "t", F.timestamp_seconds("t").alias("ts"), F.struct(*names).alias(out))
    return pack(rec_1s, _FIELDS_1S, "one").unionByName(pack(T.with_lcore_summary(rec_5s), _FIELDS_5S, "five"), allowMissingColumns=True)


def window_rows(events: DataFrame, width: int) -> DataFrame:
    """Closed windows: first and last record of each cadence, their times, numbers of records, and the rate points."""
    side = lambda c: [
        f"min_by({c}, t) filter (where {c} is not null) as first_{c}", f"max_by({c}, t) filter (where {c} is not null) as last_{c}",
        f"min(t) filter (where {c} is not null) as start_{c}", f"max(t) filter (where {c} is not null) as end_{c}", f"count({c}) as n_{c}",
    ]
    points = "collect_list(struct(t, transform_values(one.ethdev_stats, (k, s) -> s.ipackets) as by_port)) filter (where one is not null) as points"
    g = events.groupBy(F.window("ts", f"{width} seconds"), *T.INSTANCE).agg(*[F.expr(x) for x in [*side("one"), *side("five"), points]])
    return g.where("n_one > 0 and n_five > 0").withColumns({"win": F.unix_seconds(F.col("window.end")), "closed": F.window_time("window")}).drop("window")


def _deltas(side: str, stats: str, names: dict[str, str], get: str) -> list[str]:
    """Counters of the first port of the last record against the first record; a port that is new counts in full."""
    value = lambda which, n: f"coalesce({get.format(m=f'{which}_{side}.{stats}', n=n)}, 0)"
    return [f"{value('last', n)} - {value('first', n)} as {out}" for out, n in names.items()]


def window_statistic(windows: DataFrame) -> DataFrame:
    """The columns of the batch statistic that labels and rules need, from one state row each."""
    x = windows.selectExpr("*", "map_keys(last_one.ethdev_stats)[0] as p1", "map_keys(last_five.ethdev_xstats)[0] as p5").where("p1 is not null and p5 is not null")
    d1 = {f"d_{n}": n for n in fixed.PORT_COUNTERS}
    x = x.selectExpr(
        *T.WINDOW, "closed", "points", "last_one", "last_five", "cast(end_one - start_one as double) as window_seconds", "cast(end_five - start_five as double) as window_seconds_5s",
        "n_one as samples", "last_one.is_alive as is_alive", "coalesce(last_one.ethdev_stats[p1].q_ipackets, array()) as q",
        "try_element_at(map_values(last_one.mempool_stats), 1) as pool", "try_element_at(map_values(last_five.heap_stats), 1) as heap",
        *_deltas("one", "ethdev_stats", d1, "try_element_at({m}, p1).{n}"),
        *_deltas("five", "ethdev_xstats", {f"x_{n}": full for n, full in fixed.XSTAT_NAMES.items()}, "try_element_at(try_element_at({m}, p5), '{n}')"),
    )
    x = x.withColumns(T.queue_balance("q"))
    rate = lambda d: T.rate_sql(d, "window_seconds")
    return x.selectExpr(
        *T.WINDOW, "closed", "points", "window_seconds", "window_seconds_5s", "samples", "is_alive", f"{rate('d_ipackets')} as rx_pps", f"{rate('d_opackets')} as tx_pps",
        f"{ratio_sql('d_ibytes', 'd_ipackets')} as rx_avg_size", "d_ierrors as rx_errors", "d_oerrors as tx_errors", "d_rx_nombuf as rx_nombuf", "imbalance_ratio",
        f"case when size(last_one.mempool_stats) > 0 then {ratio_sql('pool.common_pool_count', 'pool.size')} end as mempool_free", "x_rx_good as rx_good", "x_rx_missed as rx_missed",
        f"case when size(last_five.heap_stats) > 0 then {ratio_sql('heap.Free_size', 'heap.Heap_size')} end as heap_free_ratio",
        f"case when size(last_five.heap_stats) > 0 then case when heap.Free_size <> 0 then 1.0D - {ratio_sql('heap.Greatest_free_size', 'heap.Free_size')} else 0.0D end end as heap_frag",
        "last_five.active_lcores as active_lcores", "last_five.avg_usage as avg_usage", "last_five.max_usage as max_usage", "last_five.hottest_lcore as hottest_lcore",
    )


def series_summary(points: Column) -> Column:
    """(points, peak, jitter, short_trend) of the smoothed receive rate of the busiest port, from the points of one window."""
    def pair(p: Column, before: Column) -> Column:
        top = F.array_max(F.transform(F.map_entries(p["by_port"]), lambda e, i: F.struct(e["value"].alias("ip"), (-i).alias("o"), e["key"].alias("port"))))
        dt = (p["t"] - before["t"]).cast("double")
        pps = once(top, lambda x: F.try_divide(F.greatest(x["ip"] - F.try_element_at(before["by_port"], x["port"]), F.lit(0)).cast("double"), dt))
        return once(pps, lambda v: F.when((dt > fixed.MIN_PAIR_GAP) & (dt <= fixed.MAX_PAIR_GAP) & v.between(0, fixed.MAX_PPS), v))

    def smooth(values: Column) -> Column:
        a, empty = fixed.EMA_ALPHA, F.array().cast("array<double>")
        return F.aggregate(values, empty, lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(F.lit(a) * v + F.lit(1 - a) * F.element_at(acc, -1)))))

    rates = lambda ps: F.filter(F.transform(F.slice(ps, 2, 1 << 30), lambda p, i: pair(p, F.get(ps, i))), lambda v: v.isNotNull())
    done = lambda e: F.when(F.size(e) > 0, F.struct(
        F.size(e).alias("points"), F.array_max(e).alias("peak"), T.jitter_of(e).alias("jitter"), T.short_trend_of(e).alias("short_trend")))
    # Sorted by time alone: points of one window have different times.
    by_time = F.array_sort(points, lambda a, b: F.when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).otherwise(0))
    return once(by_time, lambda ps: once(smooth(rates(ps)), done))


def poll_features(rec_1s: DataFrame, rec_5s: DataFrame, clock: DataFrame | None = None, width: int = fixed.FEATURE_WINDOW, delay: str = "10 seconds", every: int | None = None) -> DataFrame:
    """Feature rows, as of ``features.log_features``, of the windows that close; of the slow poll with ``every`` only those that end at its beat."""
    rows = window_rows(with_clock(both_cadences(rec_1s, rec_5s), clock, delay), width)
    if every:
        rows = rows.where(F.col("win") % every == 0)
    stats = window_statistic(rows).withColumn("_s", series_summary(F.col("points"))).drop("points")
    return label_windows(stats.select("*", "_s.*").drop("_s"))


# ---- cooldown ------------------------------------------------------------------------------------------------------

class OrderedCooldown(StatefulProcessor):
    """Per key: the time from which it may fire again, forgotten by a timer when it comes. Rows reach it in order of time from batch to batch.

    Within a batch rows are reduced piece by piece to one row a second, so a key holds no more than the seconds of a batch.
    """

    PIECE = 200_000

    def __init__(self, t: str, cool: str, tie: str) -> None:
        self.t, self.cool, self.tie = t, cool, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._free = handle.getValueState("free_at", "t bigint")

    def _reduced(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True).sort_values([self.t, self.tie], kind="stable").drop_duplicates(self.t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for pdf in rows:
            parts.append(pdf)
            held += len(pdf)
            if held > self.PIECE:
                parts = [self._reduced(parts)]
                held = 0
        pdf = self._reduced(parts)
        ts, cool = pdf[self.t].to_numpy(np.int64), pdf[self.cool].to_numpy(np.int64)
        free = self._free.get()[0] if self._free.exists() else None
        fired, i = [], 0 if free is None else int(np.searchsorted(ts, free))
        while i < len(ts):
            fired.append(i)
            free = int(ts[i] + cool[i])
            i = max(i + 1, int(np.searchsorted(ts, free)))
        if fired:
            self._free.update((free,))
            self._handle.registerTimer(free * 1000)
        yield pdf.iloc[fired]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._free.exists() and self._free.get()[0] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self._free.clear()
        return iter([])

    def close(self) -> None:
        pass


def in_order(hits: DataFrame, keys: Sequence[str], clock: DataFrame | None, delay: str, t: str = "t", cool: str = "cooldown", tie: str = "event_id") -> DataFrame:
    """Hits merged to one row a key and second (the smallest ``tie`` stands for it), handed on when the watermark passes the second.

    This is the buffer that puts late hits in order; hits later than ``delay`` are left out by the watermark.
    """
    x = with_clock(hits.select(F.timestamp_seconds(F.col(t)).alias("ts"), *keys, t, cool, tie), clock, delay)
    g = x.groupBy(F.window("ts", "1 second"), *keys, t).agg(F.min(tie).alias(tie), F.max(F.col(cool).cast("bigint")).alias(cool))
    return g.select(*keys, F.col(t).cast("bigint").alias(t), tie, cool, F.window_time("window").alias("closed"))


def cooled(hits: DataFrame, keys: Sequence[str], t: str = "t", cool: str = "cooldown", tie: str = "event_id") -> DataFrame:
    """Hits that fire: none while the key's last fire is less than its cooldown ago. ``hits`` come in order from batch to batch."""
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return hits.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=OrderedCooldown(t, cool, tie), outputStructType=hits.schema, outputMode="Append", timeMode="EventTime")


def rule_cooldown(hits: DataFrame, clock: DataFrame | None = None, delay: str = "10 seconds", keys: Sequence[str] = ("client_id", "rule_id")) -> DataFrame:
    return cooled(in_order(hits, keys, clock, delay), keys)


def severity_cooldown(hits: DataFrame, clock: DataFrame | None = None, delay: str = "10 seconds", seconds: int = fixed.SEVERITY_COOLDOWN) -> DataFrame:
    keys = ("client_id", "severity")
    return cooled(in_order(hits.withColumn("cooldown", F.lit(seconds)), keys, clock, delay), keys)


def poll(rec_1s: DataFrame, rec_5s: DataFrame, rules: DataFrame, clock: DataFrame | None = None, width: int = fixed.FEATURE_WINDOW, delay: str = "10 seconds", every: int | None = None) -> DataFrame:
    """Rules that fire, from raw records to the alert, in one query; ``every`` makes it the slow poll.

    Of several processes of a client that meet a rule in one window, the smallest pid stands for them.
    """
    features = poll_features(rec_1s, rec_5s, clock, width, delay, every)
    hits = rule_eval(features, rules, ["closed"]).selectExpr("*", "cast(cooldown_sec as bigint) as cooldown")
    return cooled(hits, ("client_id", "rule_id"), "win", "cooldown", "pid").drop("cooldown", "closed")
