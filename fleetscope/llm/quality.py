"""Quality rules whose thresholds adapt to language and source.

Per document a few ratios are measured over the whole text. For every (language, source) a mergeable KLL quantile
sketch of each ratio is kept; small groups fall back to the merged sketch of the language, then to that of all
documents. The thresholds are fences set from the sketch's quantiles, joined back to the documents, and decide.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stage

SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\r\x0b\x0c"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Ratios that the rules look at; high values are bad.
RATIOS = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
}

#: Where the middle half of a group does not vary, the fence is this quantile: junk of symbols may be up to a seventh of
#: a group, repeats are judged by the last hundredth.
TAILS = {"symbol_ratio": 0.85, "dup_line_ratio": 0.99, "repeat_ratio": 0.99, "mean_word": 0.99}
#: Size of a KLL sketch: a group of up to so many documents is kept whole, larger ones err by about 0.005 in rank.
SKETCH_K = 800


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(ids) + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def text_metrics(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8")
    words = raw.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip(_WHITE):
            lines += 1
            dup += line in seen
            seen.add(line)
    white = len(raw) - len(raw.translate(None, _WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - white, symbols, dup, repeated_words(words), lines


def _measure(text: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in METRICS.split(", ")]
    return pd.DataFrame([text_metrics(x) for x in text], columns=names, dtype="int64")


def quality_metrics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the measures of each whole text; a null text measures as an empty one."""
    return docs.select(*keep, F.pandas_udf(_measure, METRICS)("text").alias("_m")).select(*keep, "_m.*")


def quantile_sketches(measured: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """One row per key: number of documents and one KLL sketch per ratio.

    A key that holds much of the data is cut into salts whose sketches are merged afterwards.
    """
    ratios = measured.selectExpr(*keys, "_salt", *[f"cast({e} as double) as {n}" for n, e in RATIOS.items()])
    part = ratios.groupBy(*keys, "_salt").agg(
        F.count(F.lit(1)).alias("_n"), *[F.kll_sketch_agg_double(n, SKETCH_K).alias(n) for n in RATIOS]
    )
    return merge_sketches(part, keys)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge rows of sketches that share the keys; the same fold serves salts, languages and all documents."""
    rows = sketches.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.collect_list(n).alias(n) for n in RATIOS])
    merged = [F.expr(f"aggregate(slice({n}, 2, size({n})), {n}[0], (a, b) -> kll_sketch_merge_double(a, b))").alias(n) for n in RATIOS]
    return rows.select(*keys, "_n", *merged)


def fences(sketches: DataFrame, keys: list[str], spread: float, slack: dict[str, float]) -> DataFrame:
    """Upper fence of each ratio plus a small slack.

    The fence is the third quartile plus ``spread`` times the middle range, or the quantile of ``TAILS`` if that range is 0.
    """
    q = lambda n, p: f"kll_sketch_get_quantile_double({n}, {p}D)"
    fence = lambda n: f"if({q(n, 0.75)} > {q(n, 0.25)}, {q(n, 0.75)} + {spread}D * ({q(n, 0.75)} - {q(n, 0.25)}), {q(n, TAILS[n])})"
    return sketches.selectExpr(*keys, "_n", *[f"{fence(n)} + {slack[n]}D as {n}_max" for n in RATIOS])


def adaptive_filter(
    docs: DataFrame, min_group: int = 200, spread: float = 3.0, slack: dict[str, float] | None = None, salts: int = 16
) -> DataFrame:
    """Measures, thresholds and verdict of every document.

    Returns ``doc_id``, the measures, ``base_failed`` (under 50 words, or over half of the words in repeated windows),
    the four thresholds and ``kept``. Null ``lang`` or ``source`` is a group of its own; a null text counts as empty and
    fails the base rule. Groups under ``min_group`` documents use the language's thresholds, languages under it those
    of all documents, so the rule is the same at every size. Repeated rows give repeated rows; an empty table gives none.
    """
    slack = slack or {"symbol_ratio": 0.02, "dup_line_ratio": 0.05, "repeat_ratio": 0.05, "mean_word": 0.5}
    base = docs.select("doc_id", "text", F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    measured = stage(
        quality_metrics(base, ["doc_id", "_lang", "_source"]).withColumn(
            "base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
        ),
        "quality-metrics",
    )
    salted = measured.where("not base_failed").withColumn("_salt", F.expr(f"pmod(xxhash64(doc_id), {salts})"))
    groups = stage(quantile_sketches(salted, ["_lang", "_source"], salts), "quality-sketches")
    langs = merge_sketches(groups, ["_lang"])
    everything = merge_sketches(langs.withColumn("_all", F.lit(1)), ["_all"])
    names = [f"{n}_max" for n in RATIOS]
    of = lambda df, keys, tag: fences(df, keys, spread, slack).select(
        *[F.col(k).alias(f"{tag}{k}") for k in keys], F.col("_n").alias(f"{tag}_n"), *[F.col(n).alias(f"{tag}{n}") for n in names]
    )
    rules = (
        of(groups, ["_lang", "_source"], "g")
        .join(of(langs, ["_lang"], "l"), F.col("g_lang").eqNullSafe(F.col("l_lang")))
        .join(of(everything, ["_all"], "a"), F.lit(True))
        .select(
            F.col("g_lang").alias("_rl"),
            F.col("g_source").alias("_rs"),
            *[F.expr(f"case when g_n >= {min_group} then g{n} when l_n >= {min_group} then l{n} else a{n} end").alias(n) for n in names],
        )
    )
    rules = stage(rules, "quality-rules")
    joined = measured.join(rules, F.col("_lang").eqNullSafe(F.col("_rl")) & F.col("_source").eqNullSafe(F.col("_rs")), "left")
    passed = reduce(lambda a, b: a & b, [F.expr(f"{e} <= {n}_max") for n, e in RATIOS.items()])
    kept = ~F.col("base_failed") & F.coalesce(passed, F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *names
    )
