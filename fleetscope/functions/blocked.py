"""Ordered computations over long keys, cut into blocks.

A window over ``partitionBy(key)`` puts a whole key into one task. When one key can own a third of the
data that task never ends. The helpers here cut every key's timeline into blocks, do the row work per
(key, block), and carry only one small row per block across the cut. The results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400


def _block(order: str, block: Column | None, span: int) -> Column:
    return block if block is not None else F.floor(F.col(order) / F.lit(float(span))).cast("bigint")


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
    span: int = DAY, block: Column | None = None,
) -> DataFrame:
    """Replace each column by its running total along ``order`` per key."""
    keys = list(keys)
    b = df.withColumn("_blk", _block(order, block, span))
    key = ", ".join(keys)
    totals = b.groupBy(*keys, "_blk").agg(*[F.expr(f"sum({c}) as _s_{c}") for c in cols])
    before = f"over (partition by {key} order by _blk rows between unbounded preceding and 1 preceding)"
    base = totals.selectExpr(*keys, "_blk", *[f"coalesce(sum(_s_{c}) {before}, 0) as _b_{c}" for c in cols])
    inside = f"over (partition by {key}, _blk order by {order} rows between unbounded preceding and current row)"
    rest = [c for c in df.columns if c not in cols]
    return b.join(base, [*keys, "_blk"]).selectExpr(*rest, *[f"cast(sum({c}) {inside} + _b_{c} as bigint) as {c}" for c in cols])


def previous_row(
    df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
    span: int = DAY, block: Column | None = None,
) -> DataFrame:
    """Add struct column ``prev`` = ``cols`` of the preceding row of the same key (NULL on the first row)."""
    keys = list(keys)
    b = df.withColumn("_blk", _block(order, block, span))
    inside = W.partitionBy(*keys, "_blk").orderBy(order)
    packed = F.struct(*cols)
    tails = b.groupBy(*keys, "_blk").agg(F.max_by(packed, F.col(order)).alias("_tail"))
    carried = tails.select(
        *keys, "_blk", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_blk")).alias("_carry")
    )
    return (
        b.withColumn("_in", F.lag(packed).over(inside))
        .join(carried, [*keys, "_blk"], "left")
        .withColumn("prev", F.coalesce("_in", "_carry"))
        .drop("_in", "_carry", "_blk")
    )


def last_n_per_key(df: DataFrame, keys: Sequence[str], order: str, n: int, tie: str | None = None,
                   span: int = DAY) -> DataFrame:
    """Newest ``n`` rows per key.

    Each block of time keeps its own newest n first, and the blocks are then cut to n together.
    """
    keys = list(keys)
    desc = [F.col(order).desc()] + ([F.col(tie).desc()] if tie else [])
    b = df.withColumn("_blk", _block(order, None, span))
    b = b.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_blk").orderBy(*desc))).where(F.col("_rn") <= n)
    # of the surviving blocks only the newest ones that together hold n rows can matter
    held = b.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    newer = W.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(W.unboundedPreceding, -1)
    base = held.select(*keys, "_blk", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_newer"))
    return (
        b.join(base, [*keys, "_blk"]).where(F.col("_rn") + F.col("_newer") <= n).drop("_rn", "_newer", "_blk")
    )


def running_max(df: DataFrame, keys: Sequence[str], order: str, col: str, out: str, span: int = 4096) -> DataFrame:
    """Add ``out`` = largest ``col`` seen so far along ``order`` per key (NULLs are passed over)."""
    keys = list(keys)
    key = ", ".join(keys)
    b = df.selectExpr("*", f"cast(floor({order} / cast({span} as double)) as bigint) as _blk")
    tops = b.groupBy(*keys, "_blk").agg(F.expr(f"max({col}) as _top"))
    carried = tops.selectExpr(*keys, "_blk", f"max(_top) over (partition by {key} order by _blk rows between unbounded preceding and 1 preceding) as _before")
    inside = f"over (partition by {key}, _blk order by {order} rows between unbounded preceding and current row)"
    x = b.selectExpr("*", f"max({col}) {inside} as _in").join(carried, [*keys, "_blk"])
    return x.selectExpr(*df.columns, f"greatest(_in, _before) as {out}")


def rank_and_previous(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], span: int = 4096) -> DataFrame:
    """Add ``rank`` (0-based position along ``order``) and ``prev`` (struct of ``cols`` of the row before) per key."""
    keys = list(keys)
    key = ", ".join(keys)
    pack = f"struct({', '.join(cols)})"
    b = df.selectExpr("*", f"cast(floor({order} / cast({span} as double)) as bigint) as _blk")
    tails = b.groupBy(*keys, "_blk").agg(F.expr(f"max_by({pack}, {order}) as _tail"), F.expr("count(1) as _n"))
    along = f"over (partition by {key} order by _blk"
    carried = tails.selectExpr(
        *keys, "_blk", f"lag(_tail) {along}) as _carry",
        f"coalesce(sum(_n) {along} rows between unbounded preceding and 1 preceding), 0) as _before")
    inside = f"over (partition by {key}, _blk order by {order})"
    x = b.selectExpr("*", f"lag({pack}) {inside} as _in", f"row_number() {inside} as _rn").join(carried, [*keys, "_blk"])
    return x.selectExpr(*df.columns, "cast(_rn - 1 + _before as bigint) as rank", "coalesce(_in, _carry) as prev")
