"""Column builders shared by all operators. Everything stays a built-in expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """num / den as double, 0.0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def rate(delta, seconds) -> Column:
    """delta per second, 0.0 for an empty or negative time span."""
    dt = col(seconds).cast("double")
    return F.when(dt > 0, col(delta).cast("double") / dt).otherwise(F.lit(0.0))


def delta(first, last) -> Column:
    """last - first as double; a value that is not a number gives 0.0."""
    a = col(first).cast("string").try_cast("double")
    b = col(last).cast("string").try_cast("double")
    return F.coalesce(b - a, F.lit(0.0))


def level(v, low: float, high: float) -> Column:
    v = col(v)
    return F.when(v < low, "low").when(v < high, "medium").otherwise("high")


def threshold_label(v, steps: Sequence[tuple[float, str]]) -> Column:
    """First label whose bound lies above the value; the last label above all bounds."""
    v = col(v)
    out = None
    for bound, label in steps:
        test = v < F.lit(float(bound))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(steps[-1][1])


def tumbling_end(t, width: int) -> Column:
    """Exclusive end of the tumbling window of ``width`` seconds holding ``t`` (numeric seconds)."""
    return ((F.floor(col(t) / F.lit(float(width))) + 1) * width).cast("bigint")


def hex_to_number(h) -> Column:
    """0x… text to an exact unsigned 64-bit number (decimal(20,0)); NULL when it is not hex."""
    h = col(h)
    digits = F.regexp_extract(F.lower(h), r"^(?:0x)?([0-9a-f]{1,16})$", 1)  # '' becomes NULL
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def nonblank(c) -> Column:
    c = col(c)
    return F.when(F.trim(c) != "", c)


def regex_or_null(c, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL when the pattern does not match (or the group is empty)."""
    x = F.regexp_extract(col(c), pattern, group)
    return F.when(x != "", x)


def once(value, fn) -> Column:
    """``fn(value)`` with the value evaluated a single time, however often ``fn`` uses it.

    A lambda binds it; plain column references would be replaced by copies of the whole expression.
    """
    return F.get(F.transform(F.array(col(value)), fn), F.lit(0))


def compact(items: Sequence[Column]) -> Column:
    """Array of the non-null items in the given order."""
    return F.array_compact(F.array(*items))


def rows_of(df, keep: Sequence[str], items, name: str = "x", pos: str | None = None):
    """One row per array element, rows with an empty array dropped.

    The outer form keeps the optimizer from adding a size filter, which would copy the array expression (and all text
    parsing in it) below the projection and evaluate it several times.
    """
    gen = F.posexplode_outer(items).alias(pos, name) if pos else F.explode_outer(items).alias(name)
    return df.select(*keep, gen).where(F.col(name).isNotNull())


def sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- the same helpers as SQL text, for wide select lists ---------------------------------------------------

def ratio_sql(num: str, den: str) -> str:
    return f"coalesce(try_divide(cast({num} as double), cast({den} as double)), 0.0D)"


def rate_sql(change: str, seconds: str) -> str:
    return f"(case when {seconds} > 0 then cast({change} as double) / {seconds} else 0.0D end)"


def label_sql(v: str, steps: Sequence[tuple[float, str]]) -> str:
    body = " ".join(f"when {v} < {b} then '{n}'" for b, n in steps if b != float("inf"))
    return f"(case {body} else '{steps[-1][1]}' end)"


def window_end_sql(width: int, t: str = "t") -> str:
    return f"cast((floor({t} / cast({width} as double)) + 1) * {width} as bigint)"


def in_list(names: Sequence[str]) -> str:
    return ", ".join(sql_quote(n) for n in names)
