"""Output conventions of registered queries: plain columns, rounded doubles, lists joined to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        n = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            n = f"round({n}, {digits}) as {n}"
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            n = f"array_join({n}, '|') as {n}"
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)):
            n = f"cast({n} as bigint) as {n}"
        out.append(n)
    return df.selectExpr(*out)


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
