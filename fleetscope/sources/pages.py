"""Deep pages of a sorted table by a page directory.

The directory has a row for each range of the first sort key: its bounds and its number of rows, so it tells in which
ranges a page lies and how many rows come before. A page reads those ranges only, as a filter that reaches the scan,
and sorts nothing else: page 1,000,000 costs what page 1 does. The directory serves all pages until the table changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PageDirectory:
    key: str
    #: (low, high, rows) in rising order; low is inclusive, high exclusive, None is open.
    ranges: tuple[tuple[object, object, int], ...]
    #: Rows without a key.
    nulls: int

    @property
    def total(self) -> int:
        return self.nulls + sum(n for _, _, n in self.ranges)


def _literal(v) -> str:
    if isinstance(v, datetime):
        return f"timestamp_ntz'{v}'" if v.tzinfo is None else f"timestamp'{v}'"
    return f"date'{v}'" if isinstance(v, date) else repr(v)


def page_directory(table: DataFrame, key: str, parts: int = 256) -> PageDirectory:
    """Directory of at most ``parts`` ranges of a number, date or time, cut where the rows are; two passes over one column.

    A value that many rows share is a range of its own kind: its rows are not divided, only what is read for a page grows.
    """
    kind = dict(table.dtypes)[key]
    at = F.col(f"`{key}`")
    shares = [i / parts for i in range(1, parts)]
    number = at.cast("timestamp") if kind == "timestamp_ntz" else at  # approximate quantiles know no time without a zone
    found = table.agg(F.percentile_approx(number, shares, 100 * parts).cast(f"array<{kind}>").alias("b")).first()["b"] or []
    bounds = sorted(set(found))
    which = F.lit(None).cast("int") if not bounds else F.expr(
        f"if(`{key}` is null, null, aggregate(array({', '.join(f'cast({_literal(b)} as {kind})' for b in bounds)}), 0, (n, b) -> n + if(b <= `{key}`, 1, 0)))")
    which = which if bounds else F.when(at.isNotNull(), 0)
    counts = {r["which"]: r["count"] for r in table.groupBy(which.alias("which")).count().collect()}  # a row for each range
    edges = [None, *bounds, None]
    return PageDirectory(key, tuple((edges[i], edges[i + 1], counts.get(i, 0)) for i in range(len(bounds) + 1)), counts.get(None, 0))


def read_page(
    table: DataFrame, directory: PageDirectory, then: Sequence[str | Column] = (), page: int = 1, page_size: int = 10, descending: bool = False,
) -> DataFrame:
    """A page by the key of the directory, then by ``then``, with page, size and total as of ``records.page_with_total``.

    Rows without a key come first, or last where the order is descending. Beyond the last page there are no rows.
    """
    at, kind = F.col(f"`{directory.key}`"), dict(table.dtypes)[directory.key]
    start, stop = (page - 1) * page_size, page * page_size
    steps: list = [(None, directory.nulls), *[((low, high), n) for low, high, n in directory.ranges]]
    seen, wanted, before = 0, [], 0
    for where, n in reversed(steps) if descending else steps:
        if n and seen < stop and seen + n > start:
            before = before if wanted else seen
            wanted.append(where)
        seen += n
    has_null, spans = None in wanted, [w for w in wanted if w is not None]
    test = F.lit(False)
    if spans:
        spans.sort(key=lambda s: (s[0] is not None, s[0]))
        low, high = spans[0][0], spans[-1][1]
        inside = at.isNotNull()
        for bound, fits in ((low, lambda b: at >= b), (high, lambda b: at < b)):
            if bound is not None:
                inside = inside & fits(F.expr(f"cast({_literal(bound)} as {kind})"))
        test = inside | at.isNull() if has_null else inside
    elif has_null:
        test = at.isNull()
    order = [at.desc() if descending else at.asc(), *then]
    rows = table.where(test).orderBy(*order).offset(start - before).limit(page_size) if wanted else table.limit(0)
    return rows.withColumns({"total": F.lit(directory.total).cast("long"), "page": F.lit(page), "page_size": F.lit(page_size)})
