"""Near-duplicate groups by b-bit MinHash over word shingles.

Every text becomes the set of its hashed shingles. Equal sets collapse to one class. Of each class 160 minima are taken
(32-bit multiply hashes): four minima at a time form the keys of 40 bands, and two bits of every minimum, mixed with a
seed of its own, are packed into five words, from which bit counts give the similarity, corrected for chance collisions.

Classes that share a band are candidates. A band of m classes hands on m - 1 pairs: each class with the band's hub, the
member whose signature is close to most others. Bands with the same members count once. Pairs whose corrected estimate
is far below the threshold are dropped unless a set is small, the rest confirmed on the full sets. Links between other members of a band
matter only where they join different components, so those pairs alone are compared afterwards, in blocks of finer
signatures (two bits of the minimum of each of 1,024 slices of the hash range) inside a task, and confirmed likewise; of
small sets only those are dropped whose signatures rule out the threshold. No
list of all pairs of a band is ever made, and at 0.75 a pair misses all 40 bands once in four million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stage

SHINGLE = 5
BANDS, ROWS = 40, 4
LOW_BITS = 2
WORDS = BANDS * ROWS * LOW_BITS // 64
#: Four standard deviations of the estimate below a similarity of 0.75, so that no link is lost to the estimate.
MARGIN = 0.165
#: Slices of the finer signature, and four standard deviations of its estimate.
SLICES, FINE_MARGIN = 1024, 0.07
BLOCK = 512
#: Pairs with a set of fewer shingles are not dropped by an estimate: it is too coarse for them.
SMALL = 64

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, 1), np.int64).astype(np.uint64)
_SEED = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.int64).astype(np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text; A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter((_HASHES[w] for w in words), np.uint64, n)
    if n < SHINGLE:
        return _mix(np.array([(h * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)]))
    s = h[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        s += h[k : n - SHINGLE + 1 + k] * _PLACE[k]
    return np.unique(_mix(s))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, ((x[i : i + 1024] ^ _XOR) * _MUL).min(axis=1), out=best)
    return best


def sketch(text: str | None) -> tuple:
    """Size of the set, its two fingerprints, the packed low bits and the band keys."""
    s = shingle_set(text)
    if not len(s):
        return 0, 0, 0, [0] * WORDS, [], fine(s)
    m = minima(s)
    # Low bits of a product depend on low bits alone, so two shingles would agree in all minima or in none.
    low = (_mix(m.astype(np.uint64) ^ _SEED) & np.uint64((1 << LOW_BITS) - 1)).reshape(WORDS, -1)
    shift = np.arange(low.shape[1], dtype=np.uint64) * np.uint64(LOW_BITS)
    packed = (low << shift).sum(axis=1, dtype=np.uint64)
    key = _BAND.copy().reshape(-1)
    for column in m.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = _mix(key ^ column)
    one, two = s.sum(dtype=np.uint64), _mix(s ^ _M1).sum(dtype=np.uint64)
    return len(s), int(one.view(np.int64)), int(two.view(np.int64)), packed.view(np.int64), key.view(np.int64), fine(s)


def fine(s: np.ndarray) -> bytes:
    """Two bit planes over the slices of the hash range: 0 for an empty slice, else 1 to 3 by the low bits of its minimum."""
    at = (s >> np.uint64(64 - 10)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(s) else np.zeros(0, np.int64)  # the set is sorted
    code = np.zeros(SLICES, np.uint8)
    code[at[first]] = (s[first] % np.uint64(3)).astype(np.uint8) + 1
    return np.packbits(np.stack([code & 1, code >> 1])).tobytes()


SKETCH = "n long, h1 long, h2 long, sig array<long>, bands array<long>, fine binary"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, h1, h2, sig, bands, fine) of every row, in one pass over the texts; ``row`` is unique once written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            out = pd.DataFrame([sketch(t) for t in pdf["text"]], columns=["n", "h1", "h2", "sig", "bands", "fine"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            out.insert(1, "row", np.arange(row, row + len(out)))
            row += len(out)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, row long, {SKETCH}")


def estimate(a: str, b: str) -> Column:
    """Similarity from the bit counts of two signatures, corrected for chance agreement of the low bits."""
    pairs = " + ".join(
        f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & 6148914691236517205L)" for i in range(WORDS)
    )
    chance = 1 / (1 << LOW_BITS)
    return F.expr(f"(1D - ({pairs}) / {BANDS * ROWS}D - {chance}D) / (1D - {chance}D)")


#: A node with more edges than this meets them by a broadcast; with very many edges the bound grows, so that at most about
#: 500,000 nodes are ever sent round.
HEAVY = 1_000


def with_least(edges: DataFrame, least: Column, n_edges: int) -> DataFrame:
    """(u, v, m): every edge (u, v) with ``least``, an aggregate over the edges of u.

    The centre of a large star has a great part of all edges. Such nodes, few because they need many edges each, go to
    the edges where they lie; all others meet theirs by a shuffle on u.
    """
    low = stage(edges.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n")), "cc-low")
    heavy, light = (low.where(f"{side} n > {max(HEAVY, n_edges // 500_000)}").drop("n") for side in ("", "not"))
    if heavy.isEmpty():
        return edges.join(light, "u")
    few = F.broadcast(heavy)
    return edges.join(few, "u").unionByName(edges.join(few.select("u"), "u", "left_anti").join(light, "u"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root the smallest reachable node, by alternating stars.

    Every round writes its edges to the shared folder; only their count and a checksum reach the driver.
    """
    e = stage(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), "cc")
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = e.union(e.select("v", "u"))
        large = with_least(both, F.least(F.min("v"), F.first("u")), 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "cc")
        small = with_least(large, F.min("v"), state[0]).selectExpr("explode(array(struct(u as u, m as v), struct(v as u, m as v))) as e").select("e.*")
        e = stage(small.where("u <> v").distinct(), "cc")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, ha, b, hb) whose full sets meet the threshold: 100 * intersection >= percent * union.

    A class with many partners is cut into groups; each group gets the text of ``b`` once, then those of its ``a``,
    and is read as a stream, so no group is held in memory.
    """
    counts = stage(pairs.groupBy("b").count().where(f"count > {BLOCK}"), "dup-hot")
    salted = pairs.join(counts, "b", "left").selectExpr("a", "ha", "b", "hb", f"coalesce(pmod(xxhash64(a), cast(ceil(count / {BLOCK}) as long)), 0L) as g")
    needs = salted.selectExpr("b", "hb", "g", "1 as side", "a as want", "ha as h").unionByName(
        salted.selectExpr("b", "hb", "g", "0 as side", "b as want", "hb as h").distinct()
    )
    # The wanted ids grow with the corpus, so both sides always meet by a shuffle; each text crosses the network once here.
    texts = stage(needs, "dup-needs").hint("merge").join(docs.selectExpr("doc_id as want", "text"), "want").select("b", "hb", "g", "side", "want", "h", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(n, "b", "hb", "g").sortWithinPartitions("b", "hb", "g", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, base = None, None
        for pdf in batches:
            links = []
            for b, hb, g, side, want, h, text in pdf.itertuples(index=False):
                s = shingle_set(text)
                if int(s.sum(dtype=np.uint64).view(np.int64)) != h:  # another row of a repeated id
                    continue
                if side == 0:
                    group, base = (b, hb, g), s
                elif group == (b, hb, g):
                    both = len(np.intersect1d(base, s, assume_unique=True))
                    if 100 * both >= percent * (len(base) + len(s) - both):
                        links.append((want, b))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(run, "a long, b long")


_CHANCE = 1 / (1 << LOW_BITS)
_ODD_BITS = np.uint64(0x5555555555555555)
_SIG = [f"s{i}" for i in range(WORDS)]


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of corrected estimates between two sets of packed signatures (rows of ``WORDS`` words)."""
    differ = np.zeros((len(a), len(b)), np.int32)
    for w in range(WORDS):
        x = a[:, w, None] ^ b[None, :, w]
        differ += np.bitwise_count((x | (x >> np.uint64(1))) & _ODD_BITS)
    return (1 - differ / (BANDS * ROWS) - _CHANCE) / (1 - _CHANCE)


def _slices(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of the slices that finer signatures (rows of two planes of words) hold in either, in both, and alike."""
    half = a.shape[1] // 2
    either, both, same = (np.zeros((len(a), len(b)), np.int32) for _ in range(3))
    for w in range(half):
        a0, a1, b0, b1 = a[:, w, None], a[:, half + w, None], b[None, :, w], b[None, :, half + w]
        has_a, has_b = a0 | a1, b0 | b1
        pair = has_a & has_b
        either += np.bitwise_count(has_a | has_b)
        both += np.bitwise_count(pair)
        same += np.bitwise_count(pair & ~((a0 ^ b0) | (a1 ^ b1)))
    return either, both, same


def _similar_fine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of estimates from finer signatures, corrected for one chance in three."""
    either, both, same = _slices(a, b)
    return (3 * same - both) / 2 / np.maximum(either, 1)


def _possible_fine(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of the pairs that finer signatures do not rule out, given the sizes of the sets; never misses a link.

    Of two unlike minima of a slice the smaller is in one set only, so a common shingle of that slice is not the minimum
    of one of the sets. So at most the slices alike and the shingles that are no minima are common.
    """
    most = _slices(a, b)[2].astype(np.int64)
    for s, n, shape in ((a, na, (-1, 1)), (b, nb, (1, -1))):
        half = s.shape[1] // 2
        most = most + (n - np.bitwise_count(s[:, :half] | s[:, half:]).sum(axis=1, dtype=np.int64)).reshape(shape)
    na, nb = na[:, None], nb[None, :]
    most = np.minimum(most, np.minimum(na, nb))
    return 100 * most >= percent * (na + nb - most)


def _signatures(rows: pd.DataFrame) -> np.ndarray:
    return rows[_SIG].to_numpy(np.int64).view(np.uint64)


def _by_group(batches: Iterator[pd.DataFrame], keys: list[str], one: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    """Results of ``one`` for each run of equal keys in sorted batches; holds one batch and one group at a time."""
    rest = None
    for pdf in batches:
        rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        cols = [rows[k].to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        starts = [0, *cuts.tolist()]
        found = [x for a, b in zip(starts, starts[1:], strict=False) if (x := one(rows.iloc[a:b])) is not None]
        rest = rows.iloc[starts[-1] :]
        if found:
            yield pd.concat(found, ignore_index=True)
    if rest is not None and len(rest) and (x := one(rest)) is not None:
        yield x


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def hubs(members: DataFrame, percent: int) -> DataFrame:
    """The hub (b, hb) of every band from its members (key, node, h1, size, s0..): the one close to most members.

    A band over ``BLOCK`` members is cut into blocks by a hash; each names the member that is close to most of its block,
    and the best of these is the hub.
    """
    close = percent / 100 - MARGIN / 4

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        s = _signatures(rows)
        near = (_similar(s, s) >= close).sum(axis=1)
        best = np.lexsort((rows["h1"].to_numpy(), rows["node"].to_numpy(), -near))[0]
        return pd.DataFrame({"key": rows["key"].iloc[:1].to_numpy(), "b": [rows["node"].iloc[best]], "hb": [rows["h1"].iloc[best]], "near": [int(near[best])]})

    cut = members.selectExpr("*", f"pmod(xxhash64(node), cast(ceil(size / {BLOCK}) as long)) as blk")
    found = _dealt(cut, "key", "blk").mapInPandas(lambda batches: _by_group(batches, ["key", "blk"], one), "key long, b long, hb long, near long")
    return found.groupBy("key").agg(F.min(F.struct((-F.col("near")).alias("near"), "b", "hb")).alias("c")).select("key", "c.b", "c.hb")


def compare_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (key, node, h1, n, comp, size, fine, bands) of a band in different components that may be similar.

    Bands over ``BLOCK`` members are cut into blocks by a hash; every pair of blocks is one group of at most two blocks'
    rows, whose signatures are compared as a matrix. Only pairs near or above the threshold leave the task, and each leaves
    it once: in the band with the smallest key that both members have. (Of bands with equal members the smallest key stands
    for all, so that band is never missing.)
    """
    floor = percent / 100 - FINE_MARGIN
    cut = members.selectExpr("*", f"cast(ceil(size / {BLOCK}) as int) as k").selectExpr("*", "cast(pmod(xxhash64(node), k) as int) as blk")
    grid = cut.selectExpr(
        "key", "node", "h1", "n", "comp", "blk", "fine", "bands", "explode(transform(sequence(0, k - 1), x -> struct(least(x, blk) as i, greatest(x, blk) as j))) as p"
    ).selectExpr("key", "p.i", "p.j", "blk", "node", "h1", "n", "comp", "fine", "bands")

    def one(rows: pd.DataFrame) -> pd.DataFrame | None:
        comp = rows["comp"].to_numpy()
        if (comp == comp[0]).all():
            return None
        i, j, blk = rows["i"].iloc[0], rows["j"].iloc[0], rows["blk"].to_numpy()
        left, right = rows[blk == i], rows[blk == j]
        words = lambda x: np.frombuffer(b"".join(x["fine"]), np.uint64).reshape(len(x), -1)
        near = _similar_fine(words(left), words(right)) >= floor
        na, nb = left["n"].to_numpy(), right["n"].to_numpy()
        if (tiny := np.minimum(na[:, None], nb[None, :]) < SMALL).any():
            near = np.where(tiny, _possible_fine(words(left), na, words(right), nb, percent), near)
        na, nb = na[:, None], nb[None, :]
        near &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
        near &= left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
        if i == j:
            near &= left["node"].to_numpy()[:, None] > right["node"].to_numpy()[None, :]
        x, y = np.nonzero(near)
        if len(x):
            ba, bb = np.stack(left["bands"].to_list()), np.stack(right["bands"].to_list())
            here = np.zeros(len(x), bool)
            for at in range(0, len(x), 20_000):
                a, b = ba[x[at : at + 20_000]], bb[y[at : at + 20_000]]
                here[at : at + 20_000] = np.where(a == b, a, np.iinfo(np.int64).max).min(axis=1) == rows["key"].iloc[0]
            x, y = x[here], y[here]
        if not len(x):
            return None
        return pd.DataFrame({"a": left["node"].to_numpy()[x], "ha": left["h1"].to_numpy()[x], "b": right["node"].to_numpy()[y], "hb": right["h1"].to_numpy()[y]})

    dealt = _dealt(grid, "key", "i", "j")
    return dealt.mapInPandas(lambda batches: _by_group(batches, ["key", "i", "j"], one), "a long, ha long, b long, hb long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Words are runs of code points other than ASCII white space, A-Z lower-cased; texts of fewer than five words are one
    shingle. A null text, or one without words, is linked with nothing; a row without an id cannot name a component: it
    is linked with nothing, has a null component_id and is kept. Rows that share an id are one document. An empty table
    gives an empty result. Long texts are read whole; a set of shingles is the largest thing a task holds.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = stage(sketches(docs), "dup-sketch")
    known = base.where("n > 0 and doc_id is not null")
    first = known.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row")).alias("f"), F.count(F.lit(1)).alias("copies"))
    classes = stage(first.selectExpr("h1", "h2", "f.doc_id as node", "f.row as row", "copies"), "dup-classes")
    reps = stage(known.join(classes.select("row"), "row").selectExpr("doc_id as node", "h1", "n", "sig", "bands", "fine"), "dup-reps")
    rows = reps.select(F.explode("bands").alias("key"), "node", "h1")
    band = rows.groupBy("key").agg(F.min(F.struct("node", "h1")).alias("c"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node", "h1")).alias("x"))
    bands = stage(band.where("size > 1").groupBy("size", "c", "x").agg(F.min("key").alias("key")), "dup-bands")
    shared = stage(rows.join(bands, "key").select("key", "node", "h1", "size", "c"), "dup-shared")
    marks = reps.selectExpr("node", "h1", "n", *[f"sig[{i}] as s{i}" for i in range(WORDS)])
    hub = stage(hubs(shared.where("size > 2").join(marks, ["node", "h1"]), percent), "dup-hubs")
    starred = shared.join(hub, "key", "left").selectExpr("node as a", "h1 as ha", "coalesce(b, c.node) as b", "coalesce(hb, c.h1) as hb")
    pairs = starred.where("a <> b or ha <> hb").distinct()
    side = lambda x: reps.selectExpr(f"node as {x}", f"h1 as h{x}", f"n as n{x}", f"sig as s{x}")
    sized = stage(pairs, "dup-pairs").join(side("a"), ["a", "ha"]).join(side("b"), ["b", "hb"]).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    likely = stage(sized.where((F.least("na", "nb") < SMALL) | (estimate("sa", "sb") >= percent / 100 - MARGIN)).select("a", "ha", "b", "hb"), "dup-likely")
    links = stage(confirm(likely, docs, percent), "dup-links")
    roots = stage(connected(links), "dup-roots")

    # Other members of a band: only pairs that would join different components.
    placed = stage(shared.where("size > 2").join(roots, "node", "left").selectExpr("key", "node", "h1", "size", "coalesce(root, node) as comp"), "dup-placed")
    torn = stage(placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"), "dup-torn")
    members = placed.join(torn, "key").join(reps.select("node", "h1", "n", "fine", "bands"), ["node", "h1"])
    ends = "struct(a as i, ha as h), struct(b as i, hb as h)"
    ordered = lambda df: df.selectExpr(f"greatest({ends}) as x", f"least({ends}) as y").selectExpr("x.i as a", "x.h as ha", "y.i as b", "y.h as hb")
    more = ordered(compare_blocks(members, percent)).distinct()
    more = stage(more.join(ordered(likely), ["a", "ha", "b", "hb"], "left_anti"), "dup-more")
    if not more.isEmpty():
        links = links.unionByName(confirm(more, docs, percent))
        roots = stage(connected(stage(links, "dup-links")), "dup-roots")

    # One label per class that is not alone; salted, because one class can hold a large share of the rows.
    label = classes.join(roots, "node", "left").where("copies > 1 or root is not null")
    salts = 16
    label = stage(label.selectExpr("h1", "h2", "coalesce(root, node) as root", f"explode(sequence(0, {salts - 1})) as salt"), "dup-labels")
    slim = base.selectExpr("doc_id", "n as n_shingles", "if(n > 0 and doc_id is not null, h1, null) as h1", "h2", f"cast(pmod(xxhash64(doc_id), {salts}) as int) as salt")
    return (
        slim.join(label, ["h1", "h2", "salt"], "left")
        .selectExpr("doc_id", "n_shingles", "coalesce(root, doc_id) as component_id")
        .withColumn("kept", F.expr("doc_id <=> component_id"))
    )
