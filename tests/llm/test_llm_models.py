"""Language, toxicity and quality: held-out accuracy, exact measures, defined results on odd rows."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.llm.common import fold
from fleetscope.llm.language_id import grams, identify_language, learn
from fleetscope.llm.quality import RATIOS, adaptive_filter, fences, merge_sketches, quantile_sketches, text_metrics
from fleetscope.llm.toxicity import best_cut, features, labelled, score_toxicity, toxicity, train

ODD = [(None, None, None, None), (1, "", "en", "a"), (2, "12 34 !", None, None), (3, "Der Hund", "de", "b"), (3, "Der Hund", "de", "b"), (4, "ab " * 200_000, "en", None)]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, kept int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(os.environ.get("TEST_MODEL_DIR", "/root/testdata/sf0.01") + "/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ODD], ODD_SCHEMA)


def test_fold(spark):
    rows = spark.createDataFrame([(5,), (None,), (-7,)], "doc_id long").select("doc_id", fold(F.col("doc_id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 for r in rows)


def test_language_held_out(docs):
    model = learn(docs.where(fold(F.col("doc_id")) != 0))
    rows = identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_filter_has_no_false_negatives(spark):
    df = spark.createDataFrame([("abc def ghi " * 3, "x"), ("abc xyz uvw " * 3, "y"), ("?", "x"), (None, "y"), ("abc", None)], "text string, lang string")
    model = learn(df, bits=12)
    assert model.languages == ["x", "y"] and set(model.table[:, 0]) <= {0, 1, 2, 3}
    assert model.predict("def ghi")[0] == "x" and model.predict("xyz uvw")[0] == "y"
    many = spark.createDataFrame([(f"{a}{b}{a}{b} " * 4, f"l{i:03d}") for i, (a, b) in enumerate((chr(0x4E00 + k), chr(0x5E00 + k)) for k in range(70))], "text string, lang string")
    wide = learn(many)
    assert wide.table.shape[1] == 2 and wide.predict(chr(0x4E00 + 69) + chr(0x5E00 + 69) + chr(0x4E00 + 69))[0] == "l069"


def test_language_of_many_grams_leaves_short_texts_of_others(spark):
    rng = np.random.default_rng(7)
    cjk = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 60_000))) for _ in range(20)]
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(400)]
    rows = [(t, "cjk") for t in cjk for _ in range(3)] + [(" ".join(words), "latin")] * 3
    model = learn(spark.createDataFrame(rows, "text string, lang string").repartition(8))
    assert model.false_rate.max() < 0.15
    assert all(model.predict(w)[0] == "latin" for w in words) and all(model.predict(t[:6])[0] == "cjk" for t in cjk)
    assert len(model.table) == 1 << 23


def test_grams():
    want = [" ab", "ab ", "b c", " cé", "cé "]
    assert [(g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF) for g in grams("Ab1-cÉ").tolist()] == [tuple(map(ord, w)) for w in want]
    assert grams("AB c").tolist() == grams("ab ç".replace("ç", "c")).tolist() and not len(grams("12 ?"))


def test_language_edges(odd):
    rows = identify_language(odd, learn(odd)).collect()
    assert len(rows) == 6 and Counter(r["lang_pred"] for r in rows) == {"und": 3, "de": 2, "en": 1}
    assert identify_language(odd, learn(odd.limit(0))).where("lang_pred <> 'und' or score <> 0").isEmpty()
    assert identify_language(odd.limit(0), learn(odd)).count() == 0


def test_toxicity_held_out(docs, spark):
    labels = spark.read.parquet(os.environ.get("TEST_MODEL_DIR", "/root/testdata/sf0.01") + "/labels.parquet")
    out = toxicity(docs, labels).join(labels, "doc_id").where("toxic is not null").toPandas()
    for part, least in ((out[out.held_out], 0.75), (out[~out.held_out], 0.95)):
        y, rank = (part.toxic == 1).to_numpy(), part.score.rank().to_numpy()
        auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
        assert auc > least, auc
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()
    again = toxicity(docs.repartition(3), labels).join(labels, "doc_id").toPandas()
    assert np.allclose(again.set_index("doc_id").score.sort_index(), out.set_index("doc_id").score.sort_index())


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (4, None), (77, 1)], "doc_id long, toxic int")
    texts = labelled(odd, labels, 100, F.lit(True))
    assert sorted((r["text"], r["toxic"]) for r in texts.collect()) == [("", 0), ("Der Hund", 1), ("Der Hund", 1)]
    model = train(texts)
    scores = odd.select("doc_id", score_toxicity(odd, model).alias("s")).collect()
    assert len(scores) == 6 and all(0 <= r["s"] <= 1 for r in scores)
    assert train(texts.limit(0)).score("x") == pytest.approx(0.5) and train(texts.where("toxic = 1")).score("x") > 0.5
    assert toxicity(odd.limit(0), labels).count() == 0 and toxicity(odd, labels.limit(0)).count() == 6


def test_features_and_cut():
    assert len(features("", (4,), 18)) == 0 and len(features(None, (4,), 18)) == 0
    assert features("You\n IDIOT", (4, 5), 18).tolist() == features(" you idiot", (4, 5), 18).tolist()
    assert set(features("an idiot", (5,), 18)) & set(features("idiotic", (5,), 18))
    assert 1 < best_cut(np.array([0, 0, 1, 1]), np.array([-1.0, 1.0, 2.0, 3.0])) < 2


def brute_metrics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


def test_quality_measures(docs):
    texts = [r["text"] for r in docs.collect()] + ["a a a a", "a b c a b c", "x\n\n \nx\nx ", "é# ü\x85\x0b|", "a b", ""]
    assert all(text_metrics(t) == brute_metrics(t) for t in texts) and text_metrics(None) == (0,) * 6


def test_quality_verdicts(docs, spark):
    labels = spark.read.parquet(os.environ.get("TEST_MODEL_DIR", "/root/testdata/sf0.01") + "/labels.parquet")
    out = adaptive_filter(docs).join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    good = out[(out.quality == 1) & ~out.base_failed]
    bad = out[out.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.2
    assert (out.base_failed == ((out.n_words < 50) | (100 * out.n_repeat_words > 50 * out.n_words))).all() and not (out.base_failed & out.kept).any()


def test_sketches_merge(spark):
    df = spark.range(4000).selectExpr("id", "'k' as k", "id as n_symbols", "1 as word_chars", "0 as n_dup_lines", "1 as n_lines", "0 as n_repeat_words", "1 as n_words", "pmod(id, 7) as _salt")
    one = quantile_sketches(df, ["k"])
    q = merge_sketches(one.union(one), ["k"]).selectExpr("_n", "kll_sketch_get_quantile_double(symbol_ratio, 0.25D) as q").first()
    assert q["_n"] == 8000 and abs(q["q"] - 1000) < 100
    f = fences(one, ["k"], 3.0, dict.fromkeys(RATIOS, 0.5)).first()
    assert abs(f["symbol_ratio_max"] - 9000) < 600 and f["dup_line_ratio_max"] == 0.5


def test_quality_thresholds_follow_the_source(spark):
    """Lists repeat up to 30% of their lines, prose none; tables carry symbols in a fifth of the texts, prose none."""

    def text(i, repeats, symbols):
        lines = [f"line{i}x{k} " + " ".join(f"w{i}x{k}x{j}" for j in range(8)) for k in range(10)]
        lines[10 - repeats :] = [lines[0]] * repeats
        return "\n".join(lines) + " #" * symbols

    rows = [(i, text(i, i % 4 if i % 30 < 4 else 0, 0), "en", "lists") for i in range(300)]
    rows += [(300 + i, text(300 + i, 0, 60 if i % 5 == 0 else 0), "en", "tables") for i in range(300)]
    rows += [(600 + i, text(600 + i, 0, 0), "en", "prose") for i in range(297)]
    rows += [(900, text(900, 3, 0), "en", "prose"), (901, text(901, 0, 60), "en", "prose")]
    out = {r["doc_id"]: r for r in adaptive_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    lists, tables, prose = out[3], out[300], out[600]
    assert lists["dup_line_ratio_max"] > prose["dup_line_ratio_max"] + 0.2 and lists["repeat_ratio_max"] > prose["repeat_ratio_max"] + 0.2
    assert tables["symbol_ratio_max"] > prose["symbol_ratio_max"] + 0.05
    assert lists["kept"] and tables["kept"] and prose["kept"]
    assert not out[900]["kept"] and not out[901]["kept"]


def test_quality_edges(odd):
    rows = adaptive_filter(odd).collect()
    assert len(rows) == 6 and sum(r["n_words"] for r in rows) == 3 + 2 + 2 + 200_000
    assert all(r["base_failed"] and not r["kept"] for r in rows)
    assert adaptive_filter(odd.limit(0)).count() == 0
