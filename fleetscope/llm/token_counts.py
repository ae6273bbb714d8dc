"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (insert, delete, revise) is reduced to additive deltas and written once; it counts from the moment
a commit row names it. A batch id commits once: a replay, or a second writer of the same id, changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, d_docs long, d_tokens long, attempt string"
COMMITS = "batch_id string, attempt string"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Deltas of ``changes`` (op, source, lang, tokenizer, old_tokens, new_tokens), summed before the shuffle.

    Null counts are 0; null keys are keys of their own; an unknown or null op raises, because guessing would corrupt totals.
    """
    sign = F.expr("case op when 'insert' then 1L when 'delete' then -1L when 'revise' then 0L else cast(raise_error(concat('unknown op: ', coalesce(op, 'null'))) as long) end")
    tokens = F.expr("if(op = 'delete', 0L, coalesce(new_tokens, 0L)) - if(op = 'insert', 0L, coalesce(old_tokens, 0L))")
    return changes.select(*KEYS, sign.alias("_n"), tokens.alias("_t")).groupBy(*KEYS).agg(F.sum("_n").alias("d_docs"), F.sum("_t").alias("d_tokens"))


def _commits(spark: SparkSession, state: str) -> DataFrame:
    return _read(spark, f"{state}/commits", COMMITS)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(hadoop) else spark.createDataFrame([], schema)


def commit_batch(spark: SparkSession, state: str, batch_id: str, changes: DataFrame) -> bool:
    """Apply a batch; False if it was applied before. A run that dies before the commit row leaves no trace in totals."""
    if not _commits(spark, state).where(F.col("batch_id") == batch_id).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    signed_deltas(changes).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{state}/deltas")
    spark.createDataFrame([(batch_id, attempt)], COMMITS).coalesce(1).write.mode("append").parquet(f"{state}/commits")
    return True


def totals(spark: SparkSession, state: str) -> DataFrame:
    """Current totals of keys with documents or tokens. Of two racing attempts at one batch the smaller one counts."""
    valid = _commits(spark, state).groupBy("batch_id").agg(F.min("attempt").alias("attempt"))
    return (
        _read(spark, f"{state}/deltas", DELTAS)
        .join(valid.select("attempt"), "attempt")
        .groupBy(*KEYS)
        .agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        .where("n_docs <> 0 or n_tokens <> 0")
    )


def compact(spark: SparkSession, state: str, to: str) -> None:
    """Fold all committed batches into one delta in a new state folder; their ids stay committed there."""
    folded = totals(spark, state).withColumnsRenamed({"n_docs": "d_docs", "n_tokens": "d_tokens"})
    attempt = uuid.uuid4().hex
    folded.withColumn("attempt", F.lit(attempt)).write.parquet(f"{to}/deltas")
    ids = _commits(spark, state).select("batch_id").distinct().withColumn("attempt", F.lit("folded"))
    ids.union(spark.createDataFrame([(f"compact-{attempt}", attempt)], COMMITS)).coalesce(1).write.parquet(f"{to}/commits")
