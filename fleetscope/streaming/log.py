"""Logs of epochs and their compaction.

A stream writes a folder per epoch. Compaction folds the epochs before the newest (which a restarted stream may write again)
and the last generation into a new generation, and then writes a manifest of one row that names it. A manifest is there
as a whole or not at all, so a reader sees one generation and the epochs after it, each row once. What is replaced stays
until ``clean_up``, for readers that began before; reading costs one generation and the epochs since, however many there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = "_SUCCESS"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _numbered(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Complete folders ``prefix=N`` below ``path``."""
    fs, at = _fs(spark, path)
    found = {}
    for s in fs.listStatus(at) if fs.exists(at) else ():
        name = s.getPath().getName()
        if name.startswith(f"{prefix}=") and fs.exists(_fs(spark, f"{path}/{name}/{DONE}")[1]):
            found[int(name.split("=")[1])] = f"{path}/{name}"
    return found


def _generation(spark: SparkSession, out: str) -> tuple[int, int]:
    """(generation, last epoch in it) of the newest manifest, (-1, -1) without one."""
    found = _numbered(spark, f"{out}/manifest", "generation")
    if not found:
        return -1, -1
    newest = max(found)
    return newest, spark.read.parquet(found[newest]).first()["upto"]


def paths(spark: SparkSession, out: str) -> list[str]:
    """Folders that make up the log now."""
    g, upto = _generation(spark, out)
    later = [p for e, p in sorted(_numbered(spark, f"{out}/data", "epoch").items()) if e > upto]
    return [f"{out}/merged/generation={g}", *later] if g >= 0 else later


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """All rows of the log; every row lies in the newest generation or in an epoch behind it."""
    return spark.read.parquet(*paths(spark, out))


def compact(spark: SparkSession, out: str, fold: Callable[[DataFrame], DataFrame]) -> bool:
    """Fold what is settled into a new generation; False if there is nothing new. ``fold`` of a fold and new rows must equal that of all rows."""
    g, upto = _generation(spark, out)
    settled = [e for e in sorted(_numbered(spark, f"{out}/data", "epoch"))[:-1] if e > upto]
    if not settled:
        return False
    epochs = [f"{out}/data/epoch={e}" for e in settled]
    rows = spark.read.parquet(*([f"{out}/merged/generation={g}"] if g >= 0 else []), *epochs)
    fold(rows).write.mode("overwrite").parquet(f"{out}/merged/generation={g + 1}")  # what a lost attempt left is replaced
    spark.range(1).select(F.lit(settled[-1]).cast("long").alias("upto")).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/generation={g + 1}")
    return True


def clean_up(spark: SparkSession, out: str, keep: int = 2) -> None:
    """Remove generations but the newest ``keep``, and the epochs that the oldest kept one already holds."""
    found = sorted(_numbered(spark, f"{out}/manifest", "generation"))
    if len(found) < keep:
        return
    oldest = found[-keep]
    upto = spark.read.parquet(f"{out}/manifest/generation={oldest}").first()["upto"]
    gone = [f"{out}/{part}/generation={g}" for g in found if g < oldest for part in ("manifest", "merged")]
    gone += [p for e, p in _numbered(spark, f"{out}/data", "epoch").items() if e <= upto]
    for path in gone:
        fs, at = _fs(spark, path)
        fs.delete(at, True)
