"""Blocked computations equal the plain window, also when one key holds most rows."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.functions import blocked as B


def skewed(spark, n=3000):
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}"), t, rng.randrange(100)) for t in rng.sample(range(100_000), n)]
    return spark.createDataFrame(rows, "k string, t bigint, v bigint")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_running_totals(spark):
    d = skewed(spark)
    w = W.partitionBy("k").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    same(B.running_totals(d, ["k"], "t", ["v"], span=500).select("k", "t", "v"), d.select("k", "t", F.sum("v").over(w)))


def test_previous_row(spark):
    d = skewed(spark)
    got = B.previous_row(d, ["k"], "t", ["t", "v"], span=500).select("k", "t", F.col("prev.t").alias("pt"), F.col("prev.v").alias("pv"))
    w = W.partitionBy("k").orderBy("t")
    same(got, d.select("k", "t", F.lag("t").over(w), F.lag("v").over(w)))


def test_last_n(spark):
    d = skewed(spark)
    w = W.partitionBy("k").orderBy(F.col("t").desc())
    want = d.withColumn("r", F.row_number().over(w)).where("r <= 40").drop("r")
    same(B.last_n_per_key(d, ["k"], "t", 40, span=700).select("k", "t", "v"), want)


def test_rank_and_running_max(spark):
    d = skewed(spark)
    got = B.running_max(B.rank_and_previous(d, ["k"], "t", ["v"], span=900), ["k"], "rank", "v", "m", span=64)
    w = W.partitionBy("k").orderBy("t")
    want = d.select("k", "t", (F.row_number().over(w) - 1).cast("bigint"), F.lag("v").over(w),
                    F.max("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
    same(got.select("k", "t", "rank", "prev.v", "m"), want)


def test_last_n_beyond_the_group_limit(spark):
    d = skewed(spark)
    w = W.partitionBy("k").orderBy(F.col("t").desc())
    want = d.withColumn("r", F.row_number().over(w)).where("r <= 1500").drop("r")
    same(B.last_n_per_key(d, ["k"], "t", 1500, span=700).select("k", "t", "v"), want)
