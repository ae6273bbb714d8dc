"""Stages of the corpus pipeline: (spark, docs, sf_dir) to documents, the last one to batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import mixing, near_dup, packing, secrets, toxicity
from fleetscope.llm.common import fold, small_batches, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, max_rows: int = 4_000) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of the training folds.

    A null or empty text scores by the bias alone, a very long one by all its n-grams; repeated rows and equal scores fare
    alike; an empty table gives an empty result. Extra columns pass through, whatever their names.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.labelled(docs.select("doc_id", "text"), labels, max_rows, fold(F.col("doc_id")) != 0))
    return docs.where(toxicity.score_toxicity(docs, model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows that share an id are one document.

    Null, empty and wordless texts and rows without an id stay. Of a group the smallest id stays, so ties are settled. An
    empty table gives an empty result; texts are compared whole; extra columns pass through, whatever their names.
    """
    small_batches(spark)
    found = near_dup.near_duplicates(docs)
    gone = stage(found.where("not kept").select("doc_id").distinct(), "dup-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret in a text is replaced by a mark, and n_chars counts the new text.

    Null and empty texts pass unchanged, as do texts without a secret, n_chars included; repeated rows are each scanned; an
    empty table gives an empty result. Extra columns pass through, whatever their names, but for one named ``found``.
    """
    scanned = secrets.scan(docs)
    clean = scanned.withColumn("text", secrets.redact("text", "found"))
    changed = F.expr("if(size(found) = 0, n_chars, cast(length(text) as bigint))")
    return clean.withColumn("n_chars", changed).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target and its key say.

    Null and empty texts weigh nothing and come with complete epochs alone or where they fall before the cut; null sources are
    one source; rows that share an id are taken together. An empty table gives an empty result. Extra columns pass
    through, whatever their names, but for those named like the columns of ``mix_sources``.
    """
    return mixing.take_mixed(mixing.mix_sources(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches over what the mix takes; copies of a document are rows of their own.

    Null and empty texts have no tokens; a text longer than the budget is a batch of its own; an empty table gives an empty
    result; extra columns are left out.
    """
    return packing.pack(docs)
