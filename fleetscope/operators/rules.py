"""Rule evaluation, greedy cooldowns and the routing decision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.groups import map_sorted_groups
from fleetscope.functions.small import small_side
from fleetscope.operators.telemetry import WINDOW

RULE_SCHEMA = ("rule_id string, name string, severity string, metric string, condition string, threshold double, "
               "cooldown_sec int, escalate boolean, enabled boolean, rule_no int")

_METRIC_SOURCE = {"queue_imbalance": "imbalance_ratio"}


def default_rules(spark: SparkSession) -> DataFrame:
    """The shipped rule table."""
    rows = [(i, i.replace("_", " ").lower(), s, m, c, float(t), cd, esc, True, n)
            for n, (i, s, m, c, t, cd, esc) in enumerate(fixed.ALERT_RULES)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def unpivot_features(features: DataFrame, with_ref: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Wide feature row to (metric, value[, ref]); values that are not numbers are dropped. ``keep`` names further columns to carry."""
    src = {m: _METRIC_SOURCE.get(m, m) for m in fixed.RULE_METRICS}
    have = set(features.columns)
    items = []
    for m, c in src.items():
        ref = f"cast(ref_{m} as double)" if with_ref and f"ref_{m}" in have else "cast(null as double)"
        items.append(f"named_struct('metric', '{m}', 'value', try_cast({c} as double), 'ref', {ref})")
    out = features.selectExpr(*WINDOW, *keep, f"inline(array({', '.join(items)}))").where("value is not null")
    return out if with_ref else out.drop("ref")


CONDITION_SQL = """case condition
    when 'gt' then value > threshold when 'lt' then value < threshold
    when 'gte' then value >= threshold when 'lte' then value <= threshold when 'eq' then value = threshold
    when 'ref_ratio' then case when ref is null or ref = 0 then false else value / ref > threshold end
    when 'ref_ratio_lt' then case when ref is null or ref = 0 then false else value / ref < threshold end
    when 'ref_delta' then case when ref is null then false else value - ref > threshold end
    else false end"""


def rule_eval(features: DataFrame, rules: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Enabled rules that hold, one row per window and rule.

    A rule table within the row bound of ``small_side`` goes to the features; nothing is shuffled by the few metrics.
    """
    return (
        unpivot_features(features, True, keep).join(small_side(rules.where("enabled")), "metric").where(CONDITION_SQL)
        .select(*WINDOW, *keep, "rule_id", "severity", "metric", "value", "ref", "threshold", "cooldown_sec", "escalate", "rule_no")
    )


# ---- greedy cooldown ---------------------------------------------------------------------------------------

def _jumps(ts: np.ndarray, cool: int) -> np.ndarray:
    """For each candidate the next one that may fire after it; len(ts) stands for none in this block."""
    return np.searchsorted(ts, ts + cool, side="left")


def _block_exits(ts: np.ndarray, cool: int) -> np.ndarray:
    """Last fire time of the block for every candidate taken as its first fire (pointer doubling)."""
    n = len(ts)
    nxt = np.append(_jumps(ts, cool), n)
    last = np.append(np.arange(n), n)
    step = nxt.copy()
    while True:
        ahead = last[step]
        grown = np.where(ahead < n, ahead, last)
        if np.array_equal(grown, last) and (step >= n).all():
            break
        last, step = grown, step[step]
        if (step >= n).all():
            break
    # doubling keeps the furthest reachable candidate
    return ts[last[:n]]


def _block_fires(ts: np.ndarray, cool: int, free_at: int) -> np.ndarray:
    """Mask of the candidates that fire when the key is free from ``free_at`` on (pointer doubling)."""
    n = len(ts)
    mark = np.zeros(n + 1, dtype=bool)
    first = int(np.searchsorted(ts, free_at, side="left"))
    if first >= n:
        return mark[:n]
    mark[first] = True
    step = np.append(_jumps(ts, cool), n)
    while not (step >= n).all():
        mark[step[np.flatnonzero(mark)]] = True
        step = step[step]
    hit = step[np.flatnonzero(mark)]
    mark[hit] = True
    return mark[:n]


def cooldown(hits: DataFrame, keys: Sequence[str], t: str = "t", cool: str = "cooldown", order: str = "event_id",
             span: int = 86_400) -> DataFrame:
    """Greedy suppression: a fire silences its key until ``t >= fire + cool``; silenced hits do not extend it.

    Each key's timeline is cut into blocks of ``span`` seconds (at least the cooldown). Pass 1 solves every block for
    every first fire that is possible in it (those within one cooldown of its start, plus the next one); pass 2 chains
    these small answers along the blocks of a key; pass 3 marks the fires inside each block from its known start.
    A single key therefore never has to be walked by one task, whatever its share of the data.
    Hits of the same second are merged first (the smallest ``order`` stands for them). The cooldown is constant per key.
    """
    keys = list(keys)
    blk = f"cast(floor({t} / cast(greatest({span}, _c) as double)) as bigint)"
    cand = (
        hits.groupBy(*keys, t).agg(F.min(order).alias(order), F.max(F.col(cool).cast("bigint")).alias("_c"))
        .selectExpr(*keys, f"cast({t} as bigint) as {t}", f"{order}", "_c", f"{blk} as _blk")
    )
    types = {f.name: f.dataType.simpleString() for f in cand.schema.fields}
    kcols = ", ".join(f"{k} {types[k]}" for k in keys)

    def solve(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        head = rows.iloc[starts][[*keys, "_blk", "_c"]].reset_index(drop=True)
        ts, first, ends = rows[t].to_numpy(), [], []
        for a, b, blk_no, c in zip(starts, [*starts[1:], len(rows)], head["_blk"], head["_c"]):
            part = ts[a:b]
            n = min(b - a, int(np.searchsorted(part, blk_no * max(span, c) + c, side="left")) + 1)
            first.append(part[:n].tolist())
            ends.append(_block_exits(part, c)[:n].tolist())
        return head.assign(starts=first, exits=ends)

    solved = map_sorted_groups(cand, [*keys, "_blk"], [t], solve,
                               f"{kcols}, _blk bigint, _c bigint, starts array<bigint>, exits array<bigint>")

    def chain(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        new_key = np.zeros(len(rows), dtype=bool)
        new_key[starts] = True
        free, out = 0, []
        for new, first, ends, c in zip(new_key, rows["starts"], rows["exits"], rows["_c"]):
            if new:
                free = -(2**62)
            out.append(free)
            i = int(np.searchsorted(first, free, side="left"))
            if i < len(first):
                free = int(ends[i]) + c
        return rows[[*keys, "_blk"]].assign(free_at=out)

    entry = map_sorted_groups(solved, keys, ["_blk"], chain, f"{kcols}, _blk bigint, free_at bigint")

    def mark(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ts, cs, free = rows[t].to_numpy(), rows["_c"].to_numpy(), rows["free_at"].to_numpy()
        keep = [_block_fires(ts[a:b], cs[a], free[a]) for a, b in zip(starts, [*starts[1:], len(rows)])]
        return rows.loc[np.concatenate(keep), [*keys, t, order]]

    return map_sorted_groups(cand.join(entry, [*keys, "_blk"]), [*keys, "_blk"], [t], mark,
                             f"{kcols}, {t} bigint, {order} {types[order]}")


def rule_cooldown(hits: DataFrame, keys: Sequence[str] = ("client_id", "rule_id"), **kw) -> DataFrame:
    return cooldown(hits, keys, **kw)


def severity_cooldown(hits: DataFrame, seconds: int = fixed.SEVERITY_COOLDOWN, **kw) -> DataFrame:
    return cooldown(hits.withColumn("_sc", F.lit(seconds)), ["client_id", "severity"], cool="_sc", **kw)


# ---- flags of one evaluation ---------------------------------------------------------------------------------

def merge_flags(rule_flags: DataFrame, semantic_flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rule flags, then semantic flags, each once, in first-seen order. Inputs: keys, flag, ord.

    Repeats are removed before anything is collected, so a list is never longer than the set of flag names.
    """
    keys = list(keys)
    tagged = rule_flags.select(*keys, "flag", F.lit(0).alias("src"), "ord").unionByName(
        semantic_flags.select(*keys, "flag", F.lit(1).alias("src"), "ord"))
    once = tagged.groupBy(*keys, "flag").agg(F.min(F.struct("src", "ord")).alias("first"))
    lists = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "flag"))).alias("l"))
    return lists.select(*keys, F.transform("l", lambda x: x["flag"]).alias("flags"))


def max_severity(flags: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest severity of the rules behind the flags; flags without a rule count as info."""
    rank = "case severity when 'critical' then 3 when 'warning' then 2 else 1 end"
    j = flags.join(small_side(rules.select(F.col("rule_id").alias("flag"), "severity")), "flag", "left")
    top = j.groupBy(*keys).agg(F.max(F.expr(rank)).alias("r"))
    return top.select(*keys, F.expr("case r when 3 then 'critical' when 2 then 'warning' else 'info' end").alias("severity"))


def needs_escalation(flags: DataFrame, rules: DataFrame, keys: Sequence[str], semantic: str | None = None) -> DataFrame:
    """True when the rule of any flag escalates or the semantic stage asked for it."""
    j = flags.join(small_side(rules.select(F.col("rule_id").alias("flag"), F.col("escalate").alias("_e"))), "flag", "left")
    asked = F.coalesce(F.col("_e"), F.lit(False))
    if semantic:
        asked = asked | F.coalesce(F.col(semantic), F.lit(False))
    return j.groupBy(*keys).agg(F.bool_or(asked).alias("escalate"))


def route_decision(evals: DataFrame, cooled: DataFrame) -> DataFrame:
    """evals: client_id, t, severity, escalate, has_flags, error → route.

    ``cooled`` holds the (client_id, severity, t) that passed the severity cooldown. Escalation wins over the alert and
    does not ask the cooldown; a passing evaluation uses the cooldown up either way.
    """
    passed = cooled.select("client_id", "severity", "t").withColumn("passed", F.lit(True))
    return evals.join(passed, ["client_id", "severity", "t"], "left").selectExpr(
        *evals.columns, "coalesce(passed, false) as should_alert",
        """case when error then 'handle_error' when not has_flags then 'end' when escalate then 'escalate_to_fault'
            when coalesce(passed, false) then 'alert_generation' else 'end' end as route""")


def semantic_gate(windows: DataFrame, hits: DataFrame, every: int = 60) -> DataFrame:
    """Windows of the slow poll (every ``every`` seconds) that no rule hit; only these go to the semantic stage."""
    return windows.where(f"win % {int(every)} = 0").join(hits.select(*WINDOW).distinct(), WINDOW, "left_anti")
