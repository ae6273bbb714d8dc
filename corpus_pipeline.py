"""A corpus pipeline of the training-data operators: toxicity, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm import stages
from fleetscope.llm.common import stage, table

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("minhash_dedup", stages.drop_near_duplicates),
    ("secret_scan", stages.redact_secrets),
    ("mixing", stages.mix),
    ("packing", stages.pack),
]

#: Trained scores and hash-drawn samples have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
