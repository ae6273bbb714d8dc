"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams it has, present or not. From labelled texts each feature gets its
log-count ratio r (how much likelier it is in toxic texts); a logistic regression is trained on the features times r.
Training runs in rounds: every partition of the training features does one pass of gradient steps from the shared
weights, and the results are averaged. The point where the score is one half is set by cross-fitting: each half of the
training rows gets margins from the same training on the other half, and all these margins together give the cut of the
best F1. Scoring reads each text once, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import fold, stage

_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Sorted indices of the character n-grams of the lower-cased whole text, white space as one blank."""
    if not text:
        return np.zeros(0, np.int32)
    c = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    seen = np.zeros(1 << bits, bool)
    h = c
    for n in range(2, max(orders) + 1):
        if len(c) < n:
            break
        h = (h[:-1] * _ODD) ^ c[n - 1 :]
        if n in orders:
            seen[((h * _ODD) ^ (h >> np.uint64(29))) * _ODD >> np.uint64(64 - bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # regression weight times log-count ratio
    bias: float
    orders: tuple[int, ...]
    bits: int

    def score(self, text: str | None) -> float:
        x = features(text, self.orders, self.bits)
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weights[x].sum()), -30, 30))))


def best_cut(toxic: np.ndarray, z: np.ndarray) -> float:
    """The point between two neighbouring values that gives the best F1 for calling larger ones toxic."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(toxic[order])
    k = int((2 * hits / (np.arange(1, len(z) + 1) + toxic.sum())).argmax())
    return float(z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2


def step_size(rate: float, r: int) -> float:
    return rate / (1 + 0.3 * r)


def one_pass(rows, ratio: np.ndarray, w: np.ndarray, bias: float, step: float) -> tuple[np.ndarray, float, int]:
    """Change of the weights, bias and number of rows (toxic, x) after a gradient step for each row."""
    own, b, seen = w.copy(), bias, 0
    for y, x in rows:
        v = ratio[x]
        g = y - 1 / (1 + np.exp(-np.clip(b + float(own[x] @ v), -30, 30)))
        own[x] += np.float32(step * g) * v
        b += 0.1 * step * g
        seen += 1
    return own - w, b, seen


def averaged(w: np.ndarray, found: list[tuple[np.ndarray, float, int]]) -> tuple[np.ndarray, float]:
    total = sum(n for _, _, n in found)
    return w + sum(d * np.float32(n / total) for d, _, n in found), float(sum(b * n / total for _, b, n in found))


def ratios(p: np.ndarray, q: np.ndarray, n1: int, n0: int, smooth: float, scale: float) -> np.ndarray:
    """Scaled log-count ratios from the numbers of toxic and other texts with each feature."""
    return ((np.log((p + smooth) / (n1 + 2 * smooth)) - np.log((q + smooth) / (n0 + 2 * smooth))) / scale).astype(np.float32)


def train(
    texts: DataFrame, orders: tuple[int, ...] = (4, 5, 6), bits: int = 18, scale: float = 16.0,
    smooth: float = 1.0, rounds: int = 10, rate: float = 2.0, parts: int = 6, folds: int = 2,
) -> ToxicityModel:
    """Fit on ``texts`` (text, toxic 0 or 1), the caller's bounded sample of labelled rows.

    Null texts count as empty. Without rows of both labels the model scores every text by the share of label 1. The model of all
    rows and those of the cross-fitting, each without one fold, are trained side by side in the same rounds.
    """
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [features(t, orders, bits) for t in pdf["text"]]})

    made = texts.selectExpr("text", "cast(toxic as int) as toxic").repartition(parts).mapInPandas(extract, "toxic int, x array<int>")
    rows = stage(made.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int")).withColumn("fold", F.pmod(F.xxhash64("x", F.lit(1)), F.lit(folds)).cast("int")), "tox-train")
    n, positives = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (positives + 0.5) / (n + 1)
    if not 0 < positives < n:
        return ToxicityModel(np.zeros(1 << bits, np.float32), float(np.log(prior / (1 - prior))), orders, bits)
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for pdf in batches:
            for y, x, f in zip(pdf["toxic"], pdf["x"], pdf["fold"], strict=True):
                k, with_feature = seen.get((y, f), (0, np.zeros(1 << bits, np.int32)))
                with_feature[x] += 1
                seen[y, f] = (k + 1, with_feature)
        for (y, f), (k, with_feature) in seen.items():
            yield pd.DataFrame({"toxic": [y], "fold": [f], "n": [k], "c": [with_feature.tobytes()]})

    # Rows with each feature by label and fold: vectors of 4 * 2**bits bytes per task, packed where they are counted.
    size = np.zeros((2, folds), np.int64)
    count = np.zeros((2, folds, 1 << bits), np.int32)
    for found in rows.mapInPandas(tally, "toxic int, fold int, n long, c binary").toLocalIterator():
        size[found["toxic"], found["fold"]] += found["n"]
        count[found["toxic"], found["fold"]] += np.frombuffer(found["c"], np.int32)

    def starting(k: int | None) -> tuple[np.ndarray, np.ndarray, float]:
        """Ratios, weights and bias of the model without fold ``k``."""
        used = [f for f in range(folds) if f != k]
        (q, p), (n0, n1) = count[:, used].sum(axis=1), (int(v) for v in size[:, used].sum(axis=1))
        prior = (n1 + 0.5) / (n1 + n0 + 1)
        return ratios(p, q, n1, n0, smooth, scale), np.zeros(1 << bits, np.float32), float(np.log(prior / (1 - prior)))

    ratio, w, bias = (list(x) for x in zip(*(starting(k) for k in [None, *range(folds)]), strict=True))
    del count
    known = texts.sparkSession.sparkContext.broadcast(ratio)
    # Every round reads the same rows in the same order; kept by the executors, and dealt anew where one is lost.
    fit = rows.repartition(parts, "part").sortWithinPartitions(F.xxhash64("x", "toxic")).persist(StorageLevel.DISK_ONLY)
    for r in range(rounds):
        def epoch(batches: Iterator[pd.DataFrame], w=tuple(w), bias=tuple(bias), step=step_size(rate, r)) -> Iterator[pd.DataFrame]:
            own = [x for pdf in batches for x in zip(pdf["toxic"], pdf["x"], pdf["fold"], strict=True)]
            for m in range(folds + 1):
                change, b, seen = one_pass(((y, x) for y, x, f in own if f != m - 1), known.value[m], w[m], bias[m], step)
                if seen:
                    yield pd.DataFrame({"m": [m], "n": [seen], "b": [b], "w": [change.astype(np.float16).tobytes()]})

        # The change of each model's weights by each part: one row of 2 * 2**bits bytes, small enough to come with the task's status.
        found = sorted(fit.mapInPandas(epoch, "m int, n long, b double, w binary").collect(), key=lambda f: (f["m"], f["n"], f["b"]))
        for m in {f["m"] for f in found}:
            w[m], bias[m] = averaged(w[m], [(np.frombuffer(f["w"], np.float16).astype(np.float32), f["b"], f["n"]) for f in found if f["m"] == m])
    weights = [a * b for a, b in zip(w, ratio, strict=True)]

    def margins(batches: Iterator[pd.DataFrame], own=tuple(weights[1:])) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "z": [float(own[f][x].sum()) for x, f in zip(pdf["x"], pdf["fold"], strict=True)]})

    cross = fit.mapInPandas(margins, "toxic int, z double").orderBy("z", "toxic").toPandas()
    fit.unpersist()
    known.destroy()
    cut = best_cut(cross["toxic"].to_numpy(), cross["z"].to_numpy())
    return ToxicityModel(weights[0], -cut, orders, bits)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int, usable: Column) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents, chosen by a hash of the id.

    The chosen ids are bounded, so they go to the documents and no text is shuffled to find them. Where an id has
    several labels the toxic one counts; labels without a value, an id or a document are left out.
    """
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stage(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "tox-labels")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> Column:
    """Score column for ``docs.text``; empty and null texts get the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype="float64")

    return F.pandas_udf(score, "double")("text")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 4_000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Labels of fold 0 (see ``common.fold``) are never used. Repeated rows get equal scores; an empty table gives none.
    """
    model = train(labelled(docs, labels, max_rows, fold(F.col("doc_id")) != 0))
    return docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score_toxicity(docs, model).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )
