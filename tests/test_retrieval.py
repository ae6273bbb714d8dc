import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from fleetscope.functions import fixed
from fleetscope.operators import retrieval as K

TEXTS = ["", "   ", "short", "a" * 5000, ("word " * 700).strip(), "p1\n\n" * 300, "句子。" * 900 + "\n\n" + "x " * 1000,
         "\n".join(f"line {i}, with text. And more!" for i in range(400))]


@pytest.mark.parametrize("profile", list(fixed.SPLIT_PROFILES))
@pytest.mark.parametrize("n", range(len(TEXTS)))
def test_spans(profile, n):
    size, overlap, seps = fixed.SPLIT_PROFILES[profile]
    text = TEXTS[n]
    spans = K.split_spans(text, size, overlap, seps)
    covered = np.zeros(len(text), dtype=bool)
    last = -1
    for a, b in spans:
        assert a < b and a >= last
        last = a
        covered[a:b] = True
        if seps[-1] == "":
            assert b - a <= size
    assert covered.all()
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert b - c <= overlap


def test_chunks_point_into_text(spark):
    docs = [(str(i), t, "txt") for i, t in enumerate(TEXTS)] + [("none", None, "txt")]
    df = spark.createDataFrame(docs, "source_key string, text string, filetype string")
    rows = K.chunk_documents(df).collect()
    text = {k: t for k, t, _ in docs}
    for r in rows:
        if r.error is None:
            assert text[r.source_key][r.char_start:r.char_end] == r.text and r.text.strip() == r.text
    assert [r.source_key for r in rows if r.error] == ["none"]
    assert {r.source_key for r in rows if not r.error} == {str(i) for i in range(2, len(TEXTS))}


def vecs(spark, n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    m[: n // 3] = m[0] + rng.normal(size=(n // 3, d)) * 0.01  # a third of all vectors lies in one place
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vec array<double>")


def brute_top(q, m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ u.T, 9)
    return {(i, int(j)) for i in range(len(q)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_vector_topk_in_cells(spark):
    m, df = vecs(spark, 400)
    q = df.where("id < 60").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id) for r in K.vector_topk(q, df, 7, cell_rows=30, block_rows=8).collect()}
    assert got == brute_top(m[:60], m, 7)


def test_ivf_recall(spark):
    m, df = vecs(spark, 600)
    q = df.withColumnRenamed("id", "query_id")
    items, c = K.ivf_assign(df, lists=20)
    got = {(r.query_id, r.id) for r in K.vector_topk_ivf(q, items, c, 5, probes=10, cell_rows=40).collect()}
    want = brute_top(m, m, 5)
    assert len(got & want) / len(want) >= 0.9
    full = {(r.query_id, r.id) for r in K.vector_topk_ivf(q, items, c, 5, probes=len(c), cell_rows=40).collect()}
    assert full == want


def test_keyword_cells_do_not_change_the_result(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(["the"] + rng.choices(words, k=rng.randrange(5, 40)))) for i in range(300)], "doc_id bigint, description string")
    q = spark.createDataFrame([(i, " ".join(["The"] + rng.choices(words, k=4))) for i in range(20)], "query_id bigint, text string")
    p = K.build_postings(docs, ["description"])
    one = {(r.query_id, r.id, r.score) for r in K.keyword_topk(q, p, 5).collect()}
    many = {(r.query_id, r.id, r.score) for r in K.keyword_topk(q, p, 5, cell_docs=17, block_rows=3).collect()}
    assert one == many and len(one) == 100


def test_cjk_tokens(spark):
    assert spark.createDataFrame([("内存Pool_1 é!",)], "t string").select(K.tokens("t")).first()[0] == ["内", "存", "pool_1", "é"]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_is_exact(spark):
    rng = random.Random(9)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 11))) for _ in range(700)}
    ask = set(rng.sample(sorted(words), 60)) | {"zzz", "abababab"}
    v = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r.term, r.match, r.edits) for r in K.fuzzy_terms(spark.createDataFrame([(w,) for w in ask], "term string"), v).collect()}
    d = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    want = {(a, b, lev(a, b)) for a in ask for b in words if lev(a, b) <= d(a)}
    assert got == want


def test_rrf_by_hand(spark):
    s = "query_id bigint, id bigint, score double, rank int"
    a = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 0.5, 2)], s)
    b = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.8, 2)], s)
    got = {r.id: (round(r.fused_score, 9), r.first_list, r.score) for r in K.rrf_fusion([a, b]).collect()}
    f = lambda s, r: 0.7 * s + 0.3 / (60 + r)
    assert got == {10: (round(f(1, 1), 9), 0, 1.0), 11: (round(f(0.5, 2) + f(0.9, 1), 9), 0, 0.5), 12: (round(f(0.8, 2), 9), 1, 0.8)}


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_query_go_only_to_cells_that_hold_them(spark, monkeypatch):
    """the query side used to be copied to every cell, words that no document of the cell has included."""
    sent = []
    stream = K._cell_stream

    def counted(queries, items, cells, *rest):
        sent.append((queries.count(), cells))
        return stream(queries, items, cells, *rest)

    monkeypatch.setattr(K, "_cell_stream", counted)
    docs = spark.createDataFrame([(i, f"the word{i:03d}") for i in range(200)], "doc_id bigint, description string")
    q = spark.createDataFrame([(i, f"the wrod{i:03d}") for i in range(20)], "query_id bigint, text string")
    p = K.build_postings(docs, ["description"])
    got = K.keyword_topk(q, p, 1, cell_docs=10, fuzzy=True).collect()
    assert {(r.query_id, r.id) for r in got} == {(i, i) for i in range(20)}
    near = K.fuzzy_terms(q.select(F.explode(K.tokens("text")).alias("term")), p).where("term <> 'the'").count()
    assert near > 0 and sent == [(20 * 20 + near, 20)]  # the frequent word to all 20 cells, a rare one to its own


def test_keyword_adds_up_every_row_of_a_repeated_document(spark):
    """Rows of one id with texts of different length hold the same word twice."""
    p = spark.createDataFrame([(1, "description", "a", 1, 2), (1, "description", "a", 1, 4), (2, "description", "a", 1, 3)],
                              "doc_id bigint, field string, term string, tf bigint, field_len int")
    q = spark.createDataFrame([(7, "a")], "query_id bigint, text string")
    score = {r.id: r.score for r in K.keyword_topk(q, p, 5, boosts={"description": 1.0}).collect()}
    idf, norm = np.log(1 + (2 - 3 + 0.5) / (3 + 0.5)), lambda n: 1 + 1.2 * (0.25 + 0.75 * n / 3.5)
    want = {1: idf * 2.2 * (1 / norm(2) + 1 / norm(4)), 2: idf * 2.2 / norm(3)}
    assert {k: v for k, v in score.items()} == pytest.approx({k: v for k, v in want.items() if v > 0}, abs=1e-5)


def cell_rows(m):
    return pd.DataFrame({"id": np.arange(len(m))[::-1], "vec": list(m[::-1])})


@pytest.mark.parametrize("kind", ["spread", "copies", "near", "ties"])
def test_first_look_loses_nothing(kind):
    """The look in single precision gives the same items as a full sort, in groups of copies and near copies too."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(5000, 64)).astype(np.float32)
    if kind == "copies":
        m[500:4500] = m[7]
    if kind == "near":
        m[500:4500] = m[7] + rng.normal(size=(4000, 64)).astype(np.float32) * 1e-4
    if kind == "ties":
        m = rng.integers(-1, 2, size=(5000, 64)).astype(np.float32)
    q = m[::50]
    got = K._vector_best(pd.DataFrame({"id": np.arange(len(q)), "vec": list(q)}), K._vector_cell(cell_rows(m)), 5)
    u = lambda x: x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u(q) @ u(m).T, 9)
    assert got.groupby("query_id").size().eq(5).all()
    want = np.sort(-s, axis=1, kind="stable")[:, :5]
    have = -got.sort_values(["query_id", "score"], ascending=[True, False])["score"].to_numpy().reshape(-1, 5)
    assert np.allclose(have, want, atol=2e-9, rtol=0)
    if kind != "near":
        best = np.argsort(-s, axis=1, kind="stable")[:, :5]
        assert set(zip(got["query_id"], got["id"])) == {(i, int(j)) for i in range(len(q)) for j in best[i]}


def test_search_is_dealt_into_tasks(spark, monkeypatch):
    """One cell used to be one task for all queries; a large search is cut by queries too, with the same result."""
    monkeypatch.setattr(K, "TASK_PAIRS", 2_000)
    m, df = vecs(spark, 400)
    q = df.where("id < 60").withColumnRenamed("id", "query_id")
    found = K.vector_topk(q, df, 7, cell_rows=150, block_rows=8)
    assert {(r.query_id, r.id) for r in found.collect()} == brute_top(m[:60], m, 7)


def test_lists_are_searched_as_a_stream(spark):
    """the queries of a list came as one group into memory."""
    m, df = vecs(spark, 200)
    items, c = K.ivf_assign(df, lists=4)
    assert "CoGroup" not in plan(K.vector_topk_ivf(df.withColumnRenamed("id", "query_id"), items, c, 5, probes=4, cell_rows=40))


def test_chunks_are_handed_on_in_small_parts(spark, monkeypatch):
    """The chunks of a whole Arrow batch used to be held as one list."""
    docs = spark.createDataFrame([(str(i), "word " * 20_000, "txt") for i in range(60)], "source_key string, text string, filetype string").coalesce(1)
    seen = {}
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: seen.update(run=run, rows=self) or self)
    K.chunk_documents(docs)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in seen["rows"].collect()])
    parts = list(seen["run"](iter([batch])))
    assert len(parts) > 4 and max(p.nbytes for p in parts) < 2 * K.SEND_CHARS
    assert sum(p.num_rows for p in parts) == 60 * len(K.split_spans("word " * 20_000, *fixed.SPLIT_PROFILES["default"]))


def test_words_are_counted_without_a_shuffle(spark, tmp_path):
    """every word of every text crossed the network."""
    docs = spark.createDataFrame([(1, "b a B", "x"), (2, None, "Y 内b"), (None, "a", "")], "doc_id bigint, description string, root_cause string")
    p = K.build_postings(docs, ["description", "root_cause"])
    assert "Exchange" not in plan(p)
    rows = {(r.doc_id, r.field, r.term, r.tf, r.field_len) for r in p.collect()}
    assert rows == {(1, "description", "b", 2, 3), (1, "description", "a", 1, 3), (1, "root_cause", "x", 1, 1), (2, "root_cause", "y", 1, 3),
                    (2, "root_cause", "内", 1, 3), (2, "root_cause", "b", 1, 3), (None, "description", "a", 1, 1)}


def test_rows_of_one_id_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (1, "a"), (2, "a"), (None, "z"), (None, "z")], "doc_id bigint, description string")
    rows = sorted(((r.doc_id or 0, r.field_len, r.term, r.tf) for r in K.build_postings(docs, ["description"]).collect()))
    assert rows == [(0, 1, "z", 2), (1, 1, "a", 1), (1, 2, "a", 2), (1, 2, "b", 1), (1, 2, "c", 1), (2, 1, "a", 1)]


def test_plain_pattern_gives_the_same_words(spark):
    texts = ["Été 9ⅷ x_y-z İI", "日本 kana カナ・ー a", "한글abc", "œuvre ² ſ", "", "áb", "ﬁ ＡＢ 〇"]
    full = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]|[[\p{L}\p{N}_]&&[^\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]]+"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(K.tokens("t").alias("a"), F.regexp_extract_all(F.lower("t"), F.lit(full), 0).alias("b")).collect():
        assert r.a == r.b


def test_best_of_all_chunks_bound_the_candidates(monkeypatch):
    """each chunk of items had only its own k-th best as a bound, so most of what was scored exactly could not be among the k best."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(6 * K.CHUNK, 64))
    m[:: K.CHUNK] = np.eye(64)[0] * 20 + rng.normal(size=(6, 64))  # one near item in every chunk
    q = np.tile(np.eye(64)[0] * 20, (40, 1)) + rng.normal(size=(40, 64))
    scored, einsum = [], np.einsum
    monkeypatch.setattr(K.np, "einsum", lambda how, a, b: scored.append(len(a)) or einsum(how, a, b))
    got = K._vector_best(pd.DataFrame({"id": np.arange(40), "vec": list(q)}), K._vector_cell(cell_rows(m)), 5)
    assert set(zip(got["query_id"], got["id"])) == brute_top(q, m, 5)
    assert sum(scored) <= 2 * 5 * 40


def test_lists_of_a_cell_share_their_bound():
    """items of several lists lie in one cell; a query sees the lists that it names, and ties go to the smaller id across lists."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(3000, 16))
    m[1500:] = m[:1500]
    name = rng.integers(0, 7, size=3000)
    asked = [rng.choice(9, size=4, replace=False) for _ in range(50)]  # lists 7 and 8 are not in the cell
    cell = K._vector_cell(pd.DataFrame({"id": np.arange(3000), "vec": list(m), "lists": [[x] for x in name]}).sample(frac=1, random_state=1))
    got = K._vector_best(pd.DataFrame({"id": np.arange(50), "vec": list(m[:50]), "lists": asked}), cell, 6)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.where(np.isin(name[None, :], [7]), -9.0, np.round(u[:50] @ u.T, 9))
    for i, x in enumerate(asked):
        s[i, ~np.isin(name, x)] = -9.0
    assert set(zip(got["query_id"], got["id"])) == {(i, int(j)) for i in range(50) for j in np.argsort(-s[i], kind="stable")[:6]}


def test_a_query_goes_once_to_a_cell_of_lists(spark, monkeypatch):
    """a query used to be copied for every list that it looks into."""
    sent = []
    stream = K._cell_stream
    monkeypatch.setattr(K, "_cell_stream", lambda q, i, cells, *rest: sent.append((q.count(), cells)) or stream(q, i, cells, *rest))
    m, df = vecs(spark, 300)
    items, c = K.ivf_assign(df, lists=10)
    found = K.vector_topk_ivf(df.withColumnRenamed("id", "query_id"), items, c, 5, probes=10, cell_rows=1000)
    assert sent == [(300, 1)] and {(r.query_id, r.id) for r in found.collect()} == brute_top(m, m, 5)


def test_lists_fill_cells():
    assert K._list_cells({0: 30, 1: 250, 3: 60, 2: 40, 4: 1}, 100) == ({0: (0, 1), 1: (1, 3), 2: (4, 1), 3: (4, 1), 4: (5, 1)}, 6)


def test_lists_take_the_norm_of_a_vector_once(spark):
    """the norm was taken again inside the lambda for every number of the vector."""
    items, _ = K.ivf_assign(vecs(spark, 100)[1], lists=3)
    assert "aggregate(" not in plan(items) and "lambda" not in plan(items)
