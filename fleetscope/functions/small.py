"""Joins with tables that people write: rules, classes, recipients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side counts as small; a rule or class row is well under a kilobyte.
MOST_ROWS = 20_000


def small_side(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, counted up to the bound; else ``df`` as it is.

    A table made from a list has no size in the planner's eyes, which would shuffle the large side by a few key values.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
