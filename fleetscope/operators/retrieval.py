"""Chunking, vector search, keyword search, rank fusion and recall.

Exhaustive scoring is done cell by cell: documents are cut into cells by key hash; the queries pass the cells as a stream
and bring back their k best. No scored pair crosses the network but the k best, and the sizes of cell and block bound the
memory of a task whatever the data looks like.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fleetscope.functions import fixed
from fleetscope.functions.scalars import col, nonblank, rows_of
from fleetscope.functions.small import MOST_ROWS, small_side
from fleetscope.session import scratch_dir

# ---- chunking --------------------------------------------------------------------------------------------

Span = tuple[int, int]


def _pieces(text: str, a: int, b: int, sep: str) -> list[Span]:
    """Cut [a, b) before every occurrence of the separator; it stays with the piece that follows."""
    if a == b:
        return []
    if sep == "":
        return [(i, i + 1) for i in range(a, b)]
    cuts, i = [a], text.find(sep, a, b)
    while i != -1:
        if i > cuts[-1]:
            cuts.append(i)
        i = text.find(sep, i + len(sep), b)
    return list(zip(cuts, [*cuts[1:], b]))


def _pack(spans: list[Span], size: int, overlap: int) -> list[Span]:
    """Join neighbouring spans up to ``size`` characters; the next chunk takes back at most ``overlap`` characters."""
    out, lo, hi = [], 0, 0  # the open chunk is spans[lo:hi]
    for n, (a, b) in enumerate(spans):
        if hi > lo and spans[hi - 1][1] - spans[lo][0] + b - a > size:
            out.append((spans[lo][0], spans[hi - 1][1]))
            while lo < hi and (spans[hi - 1][1] - spans[lo][0] > overlap or spans[hi - 1][1] - spans[lo][0] + b - a > size):
                lo += 1
        if lo == hi:
            lo = n
        hi = n + 1
    return [*out, (spans[lo][0], spans[hi - 1][1])] if hi > lo else out


def split_spans(text: str, size: int, overlap: int, separators: Sequence[str], a: int = 0, b: int | None = None) -> list[Span]:
    """Chunk spans: cut at the coarsest separator present, cut long pieces again with the finer ones, pack the short ones."""
    b = len(text) if b is None else b
    at = next((i for i, s in enumerate(separators) if s == "" or text.find(s, a, b) != -1), len(separators) - 1)
    finer, out, short = separators[at + 1:], [], []
    for p, q in _pieces(text, a, b, separators[at]):
        if q - p < size:
            short.append((p, q))
            continue
        out += _pack(short, size, overlap)
        short = []
        out += split_spans(text, size, overlap, finer, p, q) if finer else [(p, q)]
    return out + _pack(short, size, overlap)


def _profile(filetype: str):
    return fixed.SPLIT_PROFILES[fixed.PROFILE_BY_EXTENSION.get((filetype or "").lower(), "default")]


CHUNK_SCHEMA = "source_key string, chunk_index int, text string, char_start int, char_end int, filetype string, error string"
_CHUNK_ARROW = pa.schema([("source_key", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("char_start", pa.int32()),
                          ("char_end", pa.int32()), ("filetype", pa.string()), ("error", pa.string())])
#: Documents read at a time from an Arrow batch, and characters of chunks after which rows are handed on.
READ_DOCS, SEND_CHARS = 32, 1 << 20


def chunk_documents(docs: DataFrame, key: str = "source_key", text: str = "text", filetype: str = "filetype") -> DataFrame:
    """One row per chunk with its index and place in the text. A document that fails gives one row with an error.

    Works document by document inside Arrow batches: no shuffle, and one bad document never stops the others. Chunks are
    handed on after about a megabyte, so a task holds the batch it reads and little more, however many documents follow.
    """
    def chunks(k, t, ft) -> Iterator[tuple]:
        try:
            if t is None:
                raise ValueError("document has no text")
            size, overlap, seps = _profile(ft)
            n = 0
            for a, b in split_spans(t, size, overlap, seps):
                raw = t[a:b]
                body = raw.strip()
                if body:
                    at = a + len(raw) - len(raw.lstrip())
                    yield k, n, body, at, at + len(body), ft, None
                    n += 1
        except Exception as e:  # noqa: BLE001
            yield k, None, None, None, None, ft, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        ready = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK_ARROW)], schema=_CHUNK_ARROW)
        for batch in batches:
            for lo in range(0, batch.num_rows, READ_DOCS):
                part = batch.slice(lo, READ_DOCS)
                for doc in zip(*[c.to_pylist() for c in part.columns]):
                    for row in chunks(*doc):
                        rows.append(row)
                        chars += len(row[2] or "") + 64
                        if chars >= SEND_CHARS:
                            yield ready()
                            rows, chars = [], 0
        if rows:
            yield ready()

    src = docs.select(col(key).cast("string").alias("k"), col(text).alias("t"), col(filetype).alias("f"))
    return src.mapInArrow(run, CHUNK_SCHEMA)


def embedding_inputs(docs: DataFrame, key: str, chunks: str, batch: int = fixed.EMBED_BATCH) -> DataFrame:
    """Non-blank chunks of each document with their original index and the batch they are sent in."""
    kept = F.filter(F.transform(chunks, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda s: F.trim(s["t"]) != "")
    x = rows_of(docs, [key], kept, "s", "pos")
    return x.select(key, F.col("s.i").alias("chunk_index"), F.col("s.t").alias("text"),
                    F.floor(F.col("pos") / batch).cast("bigint").alias("batch_no"), (F.col("pos") % batch).alias("slot"))


def case_text(cases: DataFrame, required=("case_id", "description")) -> DataFrame:
    """Labelled non-empty fields joined by blank lines; cases without a required field get an error instead."""
    def field(name: str, label: str) -> Column | None:
        if name not in cases.columns:
            return None
        c = F.col(name)
        if dict(cases.dtypes)[name].startswith("array"):
            c = F.when(F.size(c) > 0, F.array_join(c, ", "))
        return F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}："), c.cast("string")))

    parts = [p for p in (field(n, lb) for n, lb in fixed.CASE_LABELS) if p is not None]
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(r).cast("string"), F.lit("")) == "", F.lit(r)) for r in required]))
    x = cases.withColumn("_m", missing)
    return x.select("case_id", F.when(F.size("_m") == 0, F.concat_ws("\n\n", *parts)).alias("embedding_text"),
                    F.when(F.size("_m") > 0, F.concat(F.lit("missing: "), F.array_join("_m", ", "))).alias("error"))


# ---- cells ------------------------------------------------------------------------------------------------

def _blocks(n: int, per: int) -> int:
    return max(1, math.ceil(n / per))


def _best_per_query(parts: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Merge the k best of every cell; ties go to the smaller id."""
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cell_stream(queries: DataFrame, items: DataFrame, cells: int, prepare: Callable[[pd.DataFrame], tuple],
                 score: Callable[[pd.DataFrame, tuple], pd.DataFrame], q_rows: int) -> DataFrame:
    """``score(block of queries, prepare(items of a cell))`` for every cell, as (query_id, id, score).

    Both sides have the same columns, ``id`` among them, and say in ``_c``, from 0 to ``cells`` - 1, where their rows go; a
    cell is a partition. A task prepares its items once, then reads the queries as a stream, in blocks of at most ``q_rows``
    whole queries; so it holds one cell and one block, however many queries there are.
    """
    # sorted by one number alone, which needs no comparison of rows: NULL for items, which come first
    turn = lambda df, c: df.withColumn("_turn", c)
    both = turn(items, F.lit(None).cast("bigint")).unionByName(turn(queries, F.coalesce("id", F.lit(-1 << 63))))
    own = [c for c in items.columns if c != "_c"]
    dealt = both.repartitionById(cells, F.col("_c").cast("int")).sortWithinPartitions("_turn").select(F.col("_turn").isNotNull().alias("_asks"), *own)

    def blocks(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids = rows["id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        for lo in range(0, len(starts), q_rows):
            yield rows.iloc[starts[lo]:starts[lo + q_rows] if lo + q_rows < len(starts) else len(rows)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ready, rest = [], None, None
        for pdf in batches:
            asks = pdf["_asks"].to_numpy(dtype=bool)
            if not asks.all():
                held.append(pdf.loc[~asks, own])
            if not asks.any() or not (held or ready):
                continue
            if ready is None:
                ready, held = prepare(pd.concat(held, ignore_index=True)), []
            rows = pdf.loc[asks, own]
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            done = rows["id"] != rows["id"].iloc[-1]  # the last query may go on in the next batch
            rest = rows[~done]
            if done.any():
                yield from (score(b, ready) for b in blocks(rows[done]))
        if rest is not None:
            yield from (score(b, ready) for b in blocks(rest))

    return dealt.mapInPandas(run, "query_id bigint, id bigint, score double")


def _unit(rows: pd.Series) -> np.ndarray:
    vectors = rows.to_list()
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors of different length")
    m = np.concatenate(vectors).astype(np.float64).reshape(len(vectors), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties to the smaller column; NaN comes last."""
    if s.shape[1] <= k:
        return np.repeat(np.arange(len(s)), s.shape[1]), np.tile(np.arange(s.shape[1]), len(s))
    s = np.where(np.isnan(s), -np.inf, s)
    last = np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
    over, even = s > last, s == last
    return np.nonzero(over | (even & (np.cumsum(even, axis=1) <= k - over.sum(axis=1, keepdims=True))))


def _top_rows(scores: np.ndarray, qids: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """k best columns of each row, by score then smaller id; ``ids`` ascend."""
    r, c = _best_columns(scores, k)
    return pd.DataFrame({"query_id": qids[r], "id": ids[c], "score": scores[r, c]})


#: Items scored at a time, and the groups of them whose best scores bound the k-th best from below.
CHUNK, GROUPS = 2_048, 128
#: Rows of a chunk with more candidates than this, as in large groups of equal vectors, are searched in full.
MOST_CANDIDATES = 64


def _vector_cell(rows: pd.DataFrame) -> tuple:
    """Items of a cell by list and ascending id: ids, unit vectors, their columns in single precision for the first look,
    whether these are finite, and (list, begin, end) of every list. Items without lists are one list."""
    lists = np.concatenate(rows["lists"].to_list()) if "lists" in rows else np.zeros(len(rows), dtype=np.int32)
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    order = order[np.argsort(lists[order], kind="stable")]
    rows, lists = rows.iloc[order], lists[order]
    m = _unit(rows["vec"])
    coarse = np.ascontiguousarray(m.T.astype(np.float32))
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    spans = [(int(lists[lo]), int(lo), int(hi)) for lo, hi in zip(starts, [*starts[1:], len(lists)])]
    return rows["id"].to_numpy(), m, coarse, bool(np.isfinite(coarse).all()), spans


def _asked(queries: pd.DataFrame, spans: list[tuple]) -> Iterator[tuple]:
    """(rows of the queries that ask for a list, begin, end) of the lists of a cell; all rows if queries name no lists."""
    if "lists" not in queries:
        yield from ((np.arange(len(queries)), lo, hi) for _, lo, hi in spans)
        return
    wanted = queries["lists"].to_list()
    row, which = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted]), np.concatenate(wanted)
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    for name, lo, hi in spans:
        a, b = np.searchsorted(which, [name, name + 1])
        if a < b:
            yield row[a:b], lo, hi


def _vector_best(queries: pd.DataFrame, cell: tuple, k: int) -> pd.DataFrame:
    """Exact k best items of a cell for a block of queries, by cosine to nine digits, ties to the smaller id.

    Single precision finds the candidates: what lies below the k-th best known by more than its error cannot be among the
    k best. The k best of the groups' best scores so far give that bound, from list to list; a score below it is looked at
    once, as a member of its group. Only the candidates are scored in double precision.
    """
    ids, m, coarse, finite, spans = cell
    q, qids = _unit(queries["vec"]), queries["id"].to_numpy()
    plain = k > GROUPS or not (finite and np.isfinite(q).all())  # every row is searched in full
    q32 = q.astype(np.float32)
    slack = np.float32(2 * (q.shape[1] + 4) * 2.0 ** -24 + 1e-8)
    best = np.full((len(q), k), -np.inf, dtype=np.float32)  # the smallest of a row stands first
    room = np.empty(len(q) * CHUNK, dtype=np.float32)
    found = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.float32), np.zeros(0))]  # row, column, first score, exact score or NaN

    def searched(rows: np.ndarray, lo: int, hi: int, first: np.ndarray) -> None:
        exact = np.round(q[rows] @ m[lo:hi].T, 9)
        r, c = _best_columns(exact, k)
        found.append((rows[r], lo + c, first[r, c], exact[r, c]))

    for rows, begin, end in _asked(queries, spans):
        ask = q32 if len(rows) == len(q) else q32[rows]
        for lo in range(begin, end, CHUNK):
            hi = min(lo + CHUNK, end)
            w = hi - lo
            if plain:
                searched(rows, lo, hi, np.full((len(rows), w), np.inf, dtype=np.float32))
                continue
            s = np.matmul(ask, coarse[:, lo:hi], out=room[:len(rows) * w].reshape(len(rows), w))
            even = w // GROUPS * GROUPS  # behind them each column is a group
            grouped = s[:, :even].reshape(len(rows), -1, GROUPS)
            tops = s if even == 0 else grouped.max(axis=1) if even == w else np.hstack([grouped.max(axis=1), s[:, even:]])
            more = np.flatnonzero(tops.max(axis=1) > best[rows, 0])
            if len(more):
                known = np.hstack([best[rows[more]], tops[more]])
                best[rows[more]] = np.partition(known, known.shape[1] - k, axis=1)[:, -k:]
            least = best[rows, 0] - slack
            r, g = np.nonzero(tops >= least[:, None])
            c = np.where(g < GROUPS, g, g + even - GROUPS) if even else g
            if even:
                inside = g < GROUPS
                x, j = np.nonzero(grouped[r[inside], :, g[inside]] >= least[r[inside], None])
                r, c = np.r_[r[inside][x], r[~inside]], np.r_[j * GROUPS + g[inside][x], c[~inside]]
            full = np.bincount(r, minlength=len(rows)) > max(MOST_CANDIDATES, 4 * k)
            if full.any():
                searched(rows[full], lo, hi, s[full])
                r, c = r[~full[r]], c[~full[r]]
            found.append((rows[r], lo + c, s[r, c], np.full(len(r), np.nan)))
    r, c, first, exact = (np.concatenate(x) for x in zip(*found))
    keep = first >= best[r, 0] - slack
    r, c, exact = r[keep], c[keep], exact[keep]
    todo = np.flatnonzero(np.isnan(exact))
    for lo in range(0, len(todo), 50_000):
        x = todo[lo:lo + 50_000]
        exact[x] = np.round(np.einsum("ij,ij->i", q[r[x]], m[c[x]]), 9)
    order = np.lexsort((ids[c], -exact, r))
    r, c, exact = r[order], c[order], exact[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][:len(r)])
    kept = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)])) < k
    return pd.DataFrame({"query_id": qids[r[kept]], "id": ids[c[kept]], "score": exact[kept]})


#: Pairs of a query and an item that a task of a vector search compares, while the tasks are few and in large searches.
TASK_PAIRS, MOST_TASK_PAIRS, FEW_TASKS = 250_000_000, 4_000_000_000, 64


def _shards(pairs: int, cells: int) -> int:
    """Parts into which the queries of every cell are cut."""
    return _blocks(max(min(_blocks(pairs, TASK_PAIRS), FEW_TASKS), _blocks(pairs, MOST_TASK_PAIRS)), cells)


def _part(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(n)).cast("int")


def _dealt(queries: DataFrame, items: DataFrame, cells: int, shards: int, k: int, block_rows: int) -> DataFrame:
    """k best items per query; ``_i`` says the cell of a row. Every shard of queries passes its cells, a pair of both to a task."""
    q = queries.withColumn("_c", F.col("_i") * shards + _part("id", shards)).drop("_i")
    i = items.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_c", F.col("_i") * shards + F.col("_s")).drop("_i", "_s")
    return _best_per_query(_cell_stream(q, i, cells * shards, _vector_cell, lambda b, cell: _vector_best(b, cell, k), block_rows), k)


def vector_topk(queries: DataFrame, items: DataFrame, k: int = 5, cell_rows: int = 50_000, block_rows: int = 512) -> DataFrame:
    """Exact k nearest items per query by cosine; score = 1 - distance. Inputs: (query_id, vec), (id, vec).

    Items are cut into cells and queries into shards by a hash of their ids, and every shard passes every cell, a pair to a
    task; so a row crosses the network once per cell or shard. A query brings back its k best of every cell.
    """
    n_items, n_queries = items.count(), queries.count()
    cells = _blocks(n_items, cell_rows)
    q = queries.select(F.col("query_id").cast("bigint").alias("id"), "vec", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_i"))
    i = items.select(F.col("id").cast("bigint"), "vec", _part("id", cells).alias("_i"))
    return _dealt(q, i, cells, _shards(n_items * n_queries, cells), k, block_rows)


def ivf_assign(items: DataFrame, lists: int = 100, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """Inverted lists: ``lists`` k-means centroids on the unit vectors of all items, and each item's list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    f = items.select("id", "vec", array_to_vector("vec").alias("_v"))
    f = Normalizer(inputCol="_v", outputCol="features").transform(f)  # one pass over a vector; a lambda would take its norm again for each number
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(f.select("features"))
    out = model.transform(f).select("id", "vec", F.col("prediction").alias("list_id"))
    return out, np.vstack(model.clusterCenters())


def _list_cells(sizes: dict[int, int], cell_rows: int) -> tuple[dict[int, tuple[int, int]], int]:
    """(first cell, cells) of every list, and the number of cells. Small lists share a cell, a large one has several."""
    places, cells, free = {}, 0, 0
    for name, n in sorted(sizes.items()):
        if n > cell_rows:
            places[name] = (cells, _blocks(n, cell_rows))
            cells, free = cells + places[name][1], 0
            continue
        if n > free:
            cells, free = cells + 1, cell_rows
        places[name], free = (cells - 1, 1), free - n
    return places, max(1, cells)


def vector_topk_ivf(queries: DataFrame, assigned: DataFrame, centroids: np.ndarray, k: int = 5, probes: int = 10,
                    cell_rows: int = 50_000) -> DataFrame:
    """Approximate search: each query looks only into its nearest lists.

    A cell holds as many lists as fit, and a list that holds a third of all items is spread over many cells. A query goes
    once to a cell, with the names of its lists, and what it finds in one list bounds what the next has to offer.
    """
    c = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    probes = min(probes, len(c))
    rows = assigned.where("list_id is not null").groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per list
    places, cells = _list_cells({r.list_id: r.n for r in rows}, cell_rows)
    holds = np.zeros((len(c), cells), dtype=bool)
    for name, (first, n) in places.items():
        holds[name, first:first + n] = True

    @F.pandas_udf("struct<lists: array<int>, cells: array<int>>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        s = _unit(v) @ c.T
        near = np.argsort(-s, axis=1, kind="stable")[:, :probes].astype("int32")
        asked = np.zeros((len(near), cells), dtype=bool)
        for p in range(probes):
            asked |= holds[near[:, p]]
        row, cell = np.nonzero(asked)
        return pd.DataFrame({"lists": list(near), "cells": np.split(cell.astype("int32"), np.searchsorted(row, np.arange(1, len(near))))})

    spread = assigned.sparkSession.createDataFrame([(name, *place) for name, place in places.items()], "list_id int, _first int, _cells int")
    i = assigned.join(F.broadcast(spread), "list_id").select(
        F.col("id").cast("bigint"), "vec", F.array("list_id").alias("lists"), (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_cells")).cast("int")).alias("_i"))
    q = queries.select(F.col("query_id").cast("bigint").alias("id"), "vec", nearest("vec").alias("_n"))
    q = q.select("id", "vec", "_n.lists", F.explode("_n.cells").alias("_i"))
    pairs = sum(r.n for r in rows) * queries.count() * probes // max(1, len(c))
    return _dealt(q, i, cells, _shards(pairs, cells), k, 512)


# ---- keyword search ----------------------------------------------------------------------------------------

_CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"


def tokens(text) -> Column:
    """Lower-case words; Chinese, Japanese and Korean text is cut per character."""
    words = lambda pattern: F.regexp_extract_all(F.lower(col(text)), F.lit(pattern), 0)
    # texts without such characters, which no letter becomes in lower case, need only the plain pattern, at half the time
    return F.when(col(text).rlike(f"[{_CJK}]"), words(rf"[{_CJK}]|[[\p{{L}}\p{{N}}_]&&[^{_CJK}]]+")).otherwise(words(r"[\p{L}\p{N}_]+"))


#: Words that a task counts at a time.
COUNT_WORDS = 200_000


def _count_words(docs: DataFrame, fields: Sequence[str], doc_id: str) -> DataFrame:
    """Postings of every row by itself: its words are counted where it is read, without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("term", pa.string()), ("tf", pa.int64()), ("field_len", pa.int32())])

    def counted(ids: pa.Array, words: pa.ListArray, field: str) -> pa.RecordBatch:
        n = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        key = np.repeat(np.arange(len(words)), n) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        key, tf = np.unique(key, return_counts=True)
        row, term = np.divmod(key, max(1, len(coded.dictionary)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.repeat(field, len(row)), coded.dictionary.take(pa.array(term)),
                                           pa.array(tf), pa.array(n[row], pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for field, words in zip(fields, batch.columns[1:]):
                upto = words.offsets.to_numpy()
                lo = 0
                while lo < len(words):  # as many rows as have COUNT_WORDS words, one at least
                    hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + COUNT_WORDS, side="right")) - 1)
                    yield counted(ids.slice(lo, hi - lo), words.slice(lo, hi - lo), field)
                    lo = hi

    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                      *[tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"t{n}") for n, f in enumerate(fields)])
    return src.mapInArrow(run, "doc_id bigint, field string, term string, tf bigint, field_len int")


def build_postings(docs: DataFrame, fields: Sequence[str], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, field, term, tf, field_len) of all fields. Words are counted row by row; only rows whose id comes again,
    if there are any, are put together by a shuffle."""
    fields = list(fields)
    ids = docs.select(F.col(doc_id).cast("bigint").alias("_id"))
    again = ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    if again.isEmpty():
        return _count_words(docs, fields, doc_id)
    again = small_side(again)
    same = F.col(doc_id).cast("bigint").eqNullSafe(F.col("_id"))
    once, more = (_count_words(docs.join(again, same, how), fields, doc_id) for how in ("left_anti", "left_semi"))
    more = more.groupBy("doc_id", "field", "field_len", "term").agg(F.sum("tf").alias("tf"))
    return once.unionByName(more)


def posting_stats(postings: DataFrame, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Document frequency per (field, term), of the postings ``used`` if given; document count and mean length per field."""
    df = (postings if used is None else used).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    per_doc = postings.groupBy("doc_id", "field").agg(F.max("field_len").alias("len"))
    return df, per_doc.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


#: Pairs of a word of a query and a posting that a task adds up at a time.
MOST_PAIRS = 2_000_000


def _staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, with a true size for the planner."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyword_topk(queries: DataFrame, postings: DataFrame, k: int = 5, boosts: dict[str, float] = fixed.FIELD_BOOSTS,
                 k1: float = 1.2, b: float = 0.75, cell_docs: int = 1_000, block_rows: int = 256, fuzzy: bool = False) -> DataFrame:
    """Any-word search over several fields: BM25 per field times its boost, the best field counts. queries: query_id, text.

    Postings meet the queries cell by cell; a frequent word is then a run of sums inside a cell and never a list of pairs in
    a shuffle. A word of a query goes to the cells that hold the word, so rare words, of which a fuzzy search has many, do
    not travel to every cell.
    """
    qt = rows_of(queries, [F.col("query_id").cast("bigint")], tokens("text"), "term").groupBy("query_id", "term").agg(
        F.count(F.lit(1)).cast("double").alias("qtf"))
    if fuzzy:  # a word of the index counts by its best likeness to a word of the query
        near = fuzzy_terms(qt.select("term"), postings.select("term"))
        qt = qt.join(near, "term").groupBy("query_id", F.col("match").alias("term")).agg(F.max(F.col("qtf") * F.col("weight")).alias("qtf"))
        qt = _staged(qt, "near_terms")
    terms = qt.select("term").distinct()
    used = postings
    if terms.limit(MOST_ROWS + 1).count() <= MOST_ROWS:  # else nearly every posting is asked for, and a filter by the words would send them all round
        used = postings.join(F.broadcast(terms), "term", "left_semi")
    df, avg = posting_stats(postings, used)
    boost = F.create_map(*[x for f, v in boosts.items() for x in (F.lit(f), F.lit(float(v)))])
    avg, cells = F.broadcast(avg), _blocks(postings.select("doc_id").distinct().count(), cell_docs)  # a row per field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("field_len") / F.col("avg_len"))
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("_c")
    word = F.concat("field", F.lit("\n"), "term").alias("word")
    w = used.join(avg, "field").select(F.col("doc_id").alias("id"), word, (F.col("tf") * (k1 + 1) / norm).alias("w"), cell)
    # a word of a query goes only to the cells that hold it
    asked = qt.join(df, "term").join(avg, "field").select(
        "query_id", word, (F.col("qtf") * F.element_at(boost, F.col("field")) * idf).alias("w"))
    q = asked.join(used.select(word, cell).distinct(), "word").select(F.col("query_id").alias("id"), "word", "w", "_c")

    def cell_of(rows: pd.DataFrame) -> tuple:
        """Postings by ascending number of their word, with the place where each number begins; words by field."""
        ids, doc = np.unique(rows["id"].to_numpy(), return_inverse=True)
        number, words = pd.factorize(rows["word"])
        order = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[order], np.arange(len(words) + 1))
        field, fields = pd.factorize(np.array([x[:x.index("\n")] for x in words], dtype=object))
        return ids, doc[order], rows["w"].to_numpy()[order], pd.Index(words), field, len(fields), starts

    def score(left: pd.DataFrame, held: tuple) -> pd.DataFrame:
        ids, doc, weight, words, field, n_fields, starts = held
        qids, qpos = np.unique(left["id"].to_numpy(), return_inverse=True)
        number, qw = words.get_indexer(left["word"]), left["w"].to_numpy()
        best = np.zeros(len(qids) * len(ids))
        for f in range(n_fields):
            rows = np.flatnonzero((number >= 0) & (field[number] == f))
            key = number[rows]
            n = starts[key + 1] - starts[key]
            acc, ends = np.zeros_like(best), np.cumsum(n)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, MOST_PAIRS):  # pairs of a word of a query and a posting
                pair = np.arange(lo, min(lo + MOST_PAIRS, int(ends[-1])))
                row = np.searchsorted(ends, pair, side="right")
                post = starts[key[row]] + pair - (ends[row] - n[row])
                acc += np.bincount(qpos[rows[row]] * len(ids) + doc[post], weights=qw[rows[row]] * weight[post], minlength=len(best))
            np.maximum(best, acc, out=best)
        out = _top_rows(np.round(best.reshape(len(qids), -1), 6), qids, ids, k)
        return out[out["score"] > 0]

    return _best_per_query(_cell_stream(q, w, cells, cell_of, score, block_rows), k)


def fuzzy_terms(query_terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vocabulary words within the automatic edit distance of a query word: up to 2 letters 0, 3 to 5 letters 1, else 2.

    Exact, by the pigeonhole rule: a word at distance d, cut into d + 1 pieces, has at least one piece that stands
    unchanged in the other word, at most d places off. Words meet on (distance, length, piece number, piece) and
    the candidates are then measured. Weight = 1 - edits / length.
    """
    edits = "case when length(term) <= 2 then 0 when length(term) <= 5 then 1 else 2 end"
    q = query_terms.select("term").distinct().selectExpr("term", "length(term) as len", f"{edits} as d")
    v = vocabulary.select(F.col("term").alias("match")).distinct().withColumn("vlen", F.length("match"))
    # piece p of n pieces starts at floor(len * p / n)
    v = v.selectExpr("match", "vlen", "explode(array(0, 1, 2)) as d").where("vlen > d")
    v = v.selectExpr("match", "vlen", "d", "explode(sequence(0, d)) as p")
    v = v.selectExpr("match", "vlen", "d", "p", "cast(floor(vlen * p / (d + 1)) as int) as a", "cast(floor(vlen * (p + 1) / (d + 1)) as int) as b")
    v = v.selectExpr("match", "vlen", "d", "p", "substring(match, a + 1, b - a) as piece")
    q = q.selectExpr("term", "len", "d", "explode(sequence(len - d, len + d)) as vlen").where("vlen > d")
    q = q.selectExpr("*", "explode(sequence(0, d)) as p")
    q = q.selectExpr("*", "cast(floor(vlen * p / (d + 1)) as int) as a", "cast(floor(vlen * (p + 1) / (d + 1)) as int) as b")
    q = q.selectExpr("*", "explode(sequence(greatest(a - d, 0), a + d)) as s").where("s + b - a <= len")
    q = q.selectExpr("term", "len", "d", "vlen", "p", "substring(term, s + 1, b - a) as piece").distinct()
    # measured before repeats are removed: few candidates survive, so little is shuffled
    pair = q.join(v, ["d", "vlen", "p", "piece"]).selectExpr(
        "term", "match", "len", "case d when 0 then 0 when 1 then levenshtein(term, match, 1) else levenshtein(term, match, 2) end as edits")
    near = pair.where("edits >= 0").distinct()
    return near.selectExpr("term", "match", "edits", "1.0D - cast(edits as double) / len as weight")


# ---- fusion, evaluation ----------------------------------------------------------------------------------------

def score_normalize(results: DataFrame) -> DataFrame:
    """Score over the best score of the query (results hold at most k rows per query); rank from 1."""
    w = W.partitionBy("query_id")
    top = F.max("score").over(w)
    rank = F.row_number().over(w.orderBy(F.col("score").desc(), F.col("id").asc()))
    return results.withColumns({"rank": rank, "score": F.when(top != 0, F.col("score") / top).otherwise(F.lit(0.0))})


def rrf_fusion(lists: Sequence[DataFrame], k: int = fixed.RRF_K, alpha: float = 0.7, beta: float = 0.3) -> DataFrame:
    """Sum over the lists of alpha * score + beta / (k + rank); the first list that has an id names its source."""
    both = None
    for n, df in enumerate(lists):
        part = df.select("query_id", "id", "score", "rank", F.lit(n).alias("list_no"))
        both = part if both is None else both.unionByName(part)
    s = alpha * F.col("score") + beta / (k + F.col("rank"))
    return both.groupBy("query_id", "id").agg(
        F.sum(F.when(F.col("list_no") == 0, s).otherwise(F.lit(0.0))).alias("_a"),
        F.sum(F.when(F.col("list_no") != 0, s).otherwise(F.lit(0.0))).alias("_b"),
        F.min_by("list_no", "list_no").alias("first_list"), F.min_by("score", "list_no").alias("score")).selectExpr(
        "query_id", "id", "score", "first_list", "_a + _b as fused_score")


def fused_rank(fused: DataFrame, digits: int = 9) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.round("fused_score", digits).desc(), F.col("id").asc())
    return fused.withColumn("fused_rank", F.row_number().over(w))


def hybrid_search(keyword: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    """Rank-only fusion of both result lists, cut to k."""
    return fused_rank(rrf_fusion([keyword, vector], fixed.RRF_K, 0.0, 1.0)).where(F.col("fused_rank") <= k)


def dedup_best(results: DataFrame, content: str = "root_cause", score: str = "score", row_id: str = "id") -> DataFrame:
    """Best row per trimmed content, blanks dropped; max_by keeps the work in a grouped aggregate."""
    x = results.withColumn("_c", F.trim(F.coalesce(content, F.lit("")))).where("_c <> ''")
    return x.groupBy("_c").agg(F.max_by(F.struct(row_id, score), F.struct(F.col(score), -F.col(row_id))).alias("m")).select(
        F.col("_c").alias(content), f"m.{row_id}", f"m.{score}")


def recall_eval(found: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Share of the truth ids each result list found, per query. truth: query_id, id (distinct)."""
    n = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    out = n
    for name, df in found.items():
        hit = df.select("query_id", "id").distinct().join(truth, ["query_id", "id"], "left_semi").groupBy("query_id").agg(
            F.count(F.lit(1)).alias(f"_{name}"))
        out = out.join(hit, "query_id", "left")
    return out.select("query_id", "n_truth", *[(F.coalesce(F.col(f"_{n}"), F.lit(0)) / F.col("n_truth")).alias(f"{n}_recall") for n in found])


def recall_grid(keyword: DataFrame, vector: DataFrame, truth: DataFrame, ks=(10, 30, 60), alphas=(0.0, 0.5, 0.7), betas=(0.3, 0.5, 1.0),
                tops=(1, 3, 5, 8, 10)) -> DataFrame:
    """Mean recall of fusion for every setting, beside both single lists; settings where fusion is not worse than either.

    The grid is a literal array, so every fused candidate is copied once per setting; candidates are at most 2k per query.
    """
    combos = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta")) for k in ks for a in alphas for b in betas])
    top_n = F.array(*[F.lit(t) for t in tops])
    both = keyword.select("query_id", "id", "score", "rank", F.lit(0).alias("l")).unionByName(
        vector.select("query_id", "id", "score", "rank", F.lit(1).alias("l")))
    wide = both.groupBy("query_id", "id").agg(*[F.max(F.when(F.col("l") == n, F.col(c))).alias(f"{c}{n}") for n in (0, 1) for c in ("score", "rank")])
    t = truth.select("query_id", "id", F.lit(1).alias("hit"))
    n_truth = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    x = wide.join(t, ["query_id", "id"], "left").select("*", F.inline(combos))
    part = lambda n: F.coalesce(F.col("alpha") * F.col(f"score{n}") + F.col("beta") / (F.col("k") + F.col(f"rank{n}")), F.lit(0.0))
    w = W.partitionBy("k", "alpha", "beta", "query_id").orderBy(F.round(part(0) + part(1), 9).desc(), F.col("id").asc())
    x = x.withColumn("fr", F.row_number().over(w)).select("*", F.explode(top_n).alias("top_k"))
    hit = lambda c: F.sum(F.when((F.col(c) <= F.col("top_k")) & (F.col("hit") == 1), 1).otherwise(0))
    g = x.groupBy("k", "alpha", "beta", "top_k", "query_id").agg(hit("fr").alias("f"), hit("rank0").alias("a"), hit("rank1").alias("b"))
    g = g.join(n_truth, "query_id").groupBy("k", "alpha", "beta", "top_k").agg(*[
        F.round(F.avg(F.col(c) / F.col("n_truth")), 9).alias(n) for c, n in (("f", "fused_recall"), ("a", "keyword_recall"), ("b", "vector_recall"))])
    return g.where("fused_recall >= keyword_recall and fused_recall >= vector_recall").orderBy(F.col("fused_recall").desc(), "k", "alpha", "beta", "top_k")


def case_admission(cases: DataFrame, best: DataFrame, threshold: float = fixed.ADMISSION_THRESHOLD) -> DataFrame:
    """A case joins the library when its confidence is high and nothing known is too similar. best: case_id, top_score."""
    j = cases.join(best, "case_id", "left")
    high = F.lower("confidence").isin("high", "高")
    return j.withColumn("admit", F.coalesce(high & (F.col("top_score").isNull() | (F.col("top_score") < threshold)), F.lit(False)))


def knowledge_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Nearest chunks with score to four digits and their source columns. chunks: id, vec, source_key, filetype."""
    top = vector_topk(queries, chunks.select("id", "vec"), k)
    return top.join(chunks.drop("vec"), "id").withColumn("score", F.round("score", 4))


def delete_everywhere(tables: dict[str, DataFrame], ids: DataFrame | None, key: str = "case_id") -> dict[str, DataFrame]:
    """Remove the given ids (all rows when None) from every store's table."""
    if ids is None:
        return {n: df.limit(0) for n, df in tables.items()}
    return {n: df.join(ids.select(key).distinct(), key, "left_anti") for n, df in tables.items()}


def retrieval_query_text(incidents: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """One search text per incident from its fields; absent ones read 未知, empty lists 无. No field at all, no search."""
    def show(name: str) -> Column:
        if dict(incidents.dtypes)[name].startswith("array"):
            return F.when(F.size(name) > 0, F.array_join(name, ", ")).otherwise(fixed.NONE)
        return F.coalesce(nonblank(name), F.lit(fixed.UNKNOWN))

    scalars = [n for n, _ in fields if not dict(incidents.dtypes)[n].startswith("array")]
    any_set = F.coalesce(*[nonblank(n) for n in scalars]).isNotNull()
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), show(n)) for n, label in fields])
    return incidents.withColumn("query_text", F.when(any_set, text))


def vector_store_rows(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Chunks with their vectors as store rows; a chunk or vector without its partner and a wrong dimension are errors."""
    j = chunks.join(vectors, ["source_key", "chunk_index"], "full")
    err = (F.when(F.col("text").isNull() | F.col("vec").isNull(), "chunk and vector count differ")
           .when(F.size("vec") != dim, "dimension mismatch"))
    return j.select(F.concat(F.col("source_key").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")).alias("id"),
                    "source_key", "chunk_index", F.col("text").alias("content"), "vec", err.alias("error"))
