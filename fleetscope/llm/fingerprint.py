"""Document fingerprints by homomorphic multiset hashing, with DataFrame functions only.

A text is a multiset of paragraphs (lines). Each paragraph hashes to a wide vector, and the fingerprint is the sum of
the vectors modulo powers of two, so it does not depend on the order of paragraphs, and a paragraph is inserted or
deleted by adding or subtracting its vector. The vector has two parts: eight lanes modulo 2**32 hashed from the whole
paragraph, which settle equality, and 128 lanes modulo 2**32, the sum of +1/-1 vectors hashed from its pieces (runs of
words cut after certain letters, so that an edit moves few of them). The cosine of the second part of two fingerprints
estimates the share of pieces the texts have in common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stage

EQUAL, LIKE = 8, 128
PIECE = r"(?<=[dnrst.,;:!?])[\x20\x09\x0B-\x0D]+|\n"  # no piece depends on the line before
_BOTH = (1 << 32) + 1  # the lowest bit of either half


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lanes(text: str) -> str:
    """SQL for the fingerprint of a text column as array<int>: the equality lanes, then the likeness lanes."""
    seeds = ", ".join(f"xxhash64({s}, p)" for s in range(EQUAL // 2))
    hashed = f"transform(split({text}, '\\n', -1), p -> array({seeds}))"
    equal = [f"aggregate(x.h, 0L, (a, h) -> (a + (h[{s}] & 4294967295L)) & 4294967295L)" for s in range(EQUAL // 2)]
    equal += [f"aggregate(x.h, 0L, (a, h) -> (a + shiftrightunsigned(h[{s}], 32)) & 4294967295L)" for s in range(EQUAL // 2)]
    ones = [f"aggregate(x.p{w}, 0L, (a, h) -> a + (shiftrightunsigned(h, {j}) & {_BOTH}L))" for w in range(LIKE // 64) for j in range(32)]
    pieces = f"filter(split({text}, {_lit(PIECE)}, -1), p -> p <> '')"
    words = ", ".join(f"'p{w}', transform(y, p -> xxhash64({100 + w}, p))" for w in range(LIKE // 64))
    # Each sum holds two counts of set bits; twice the count less the number of pieces is the sum of +1 and -1.
    wrap = lambda c: f"(({c}) + 2147483648L & 4294967295L) - 2147483648L"
    split = f"flatten(transform(z.ones, c -> array({wrap('2 * (c & 4294967295L) - z.n')}, {wrap('2 * shiftrightunsigned(c, 32) - z.n')})))"
    return (
        f"transform(transform(transform(array({pieces}), y -> named_struct('h', {hashed}, 'n', size(y), {words})), "
        f"x -> named_struct('n', cast(x.n as bigint), 'equal', array({', '.join(equal)}), 'ones', array({', '.join(ones)}))), "
        f"z -> transform(concat(z.equal, {split}), v -> cast(v as bigint)))[0]"
    )


def combine(a: str, b: str, sign: int = 1) -> str:
    """SQL for the fingerprint of both multisets together (or of ``a`` without ``b``): lanes added modulo their powers."""
    return (
        f"transform(zip_with({a}, {b}, (x, y) -> x + {sign} * y), (v, i) -> if(i < {EQUAL}, v & 4294967295L, (v + 2147483648L & 4294967295L) - 2147483648L))"
    )


def as_hex(fp: str) -> str:
    return f"array_join(transform({fp}, v -> lpad(hex(v & 4294967295L), 8, '0')), '')"


def likeness(a: str, b: str) -> str:
    """SQL for the cosine of the likeness lanes within 0 and 1; equal fingerprints give 1, one without pieces 0."""
    part = lambda x: f"slice({x}, {EQUAL + 1}, {LIKE})"
    dot = lambda x, y: f"aggregate(zip_with({part(x)}, {part(y)}, (x, y) -> cast(x as double) * y), 0D, (s, v) -> s + v)"
    norm = f"sqrt({dot(a, a)}) * sqrt({dot(b, b)})"
    return f"if({a} = {b}, 1D, transform(array({norm}), n -> if(n > 0, least(1D, greatest(0D, {dot(a, b)} / n)), 0D))[0])"


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``fp``; a null text counts as an empty one. Every other column passes through; no shuffle."""
    return docs.withColumn("fp", F.expr(lanes(f"coalesce(`{text}`, '')")))


def id_bounds(docs: DataFrame, per_block: int, most_blocks: int, oversample: int = 8) -> list[int]:
    """Ids that cut the documents into blocks of about ``per_block``, taken from a hashed sample of the distinct ids.

    At most about ``2 * oversample * most_blocks`` ids reach the driver.
    """
    n = docs.count()
    blocks = min(most_blocks, n // per_block)
    if blocks < 2:
        return []
    every = max(1, n // (blocks * oversample))
    picked = docs.where(f"doc_id is not null and pmod(xxhash64(doc_id), {every}) = 0").select("doc_id").distinct()
    found = sorted(r[0] for r in picked.limit(2 * oversample * blocks + 1000).collect())
    return sorted({found[i * len(found) // blocks] for i in range(1, blocks)}) if found else []


def block_of(bounds: list[int]) -> str:
    """SQL for the number of bounds not above doc_id, by bisection; null ids come behind all others."""
    if not bounds:
        return "if(doc_id is null, 1L, 0L)"
    n = len(bounds)
    steps = ", ".join(str(1 << i) for i in range(n.bit_length() - 1, -1, -1))
    table = f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)"
    found = f"aggregate(array({steps}), 0, (at, s) -> if(at + s <= {n} and get({table}, at + s - 1) <= doc_id, at + s, at))"
    return f"if(doc_id is null, {n + 1}L, cast({found} as bigint))"


def with_next(docs: DataFrame, per_block: int = 1024, most_blocks: int = 100_000) -> DataFrame:
    """``docs`` (doc_id, text, fp) plus ``next_text`` and ``next_fp`` of the following id; the last is followed by the first.

    Null ids come last; rows that share an id follow each other by text, and lie in one block. Ids are cut where the data
    are, into blocks of about ``per_block`` documents (more where that would give over ``most_blocks`` of them), however
    far apart ids lie. A block is ordered in one task; its last row takes the first row of the next block, of which there
    is one per block. Texts are shuffled once.
    """
    block = F.expr(block_of(id_bounds(docs, per_block, most_blocks)))
    cut = docs.select("doc_id", "text", block.alias("block"))
    heads = stage(cut.groupBy("block").agg(F.min("doc_id").alias("head")), "fp-heads")  # at most about most_blocks rows
    follow = heads.selectExpr(
        "block as _of", "coalesce(lead(block) over (order by block), first(block) over (order by block)) as block"
    )
    first = cut.join(F.broadcast(heads), ["block"]).where("doc_id <=> head").groupBy("block").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("h"))
    first = fingerprints(first.selectExpr("block", "h.text as text")).join(F.broadcast(follow), "block")
    heir = stage(first.selectExpr("_of as block", "struct(text, fp) as _head"), "fp-first")
    order = "over (partition by block order by doc_id nulls last, text)"
    dealt = docs.withColumn("block", block).repartition("block")
    seen = dealt.selectExpr("*", f"lead(struct(coalesce(text, '') as text, fp)) {order} as _lead")
    return seen.join(heir, "block", "left").selectExpr(
        *[f"`{c}`" for c in docs.columns], "coalesce(_lead, _head).text as next_text", "coalesce(_lead, _head).fp as next_fp"
    )


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edit replaces the last quarter (rounded down) of the code points by as many from the start of the next text, or
    all of it. A single document follows itself. Null texts count as empty; an empty table gives an empty result.
    """
    own = fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    edited = with_next(own).selectExpr(
        "doc_id", "fp", "next_fp", "length(coalesce(text, '')) as n_chars",
        "concat(substring(coalesce(text, ''), 1, length(coalesce(text, '')) - length(coalesce(text, '')) div 4), substring(next_text, 1, cast(length(coalesce(text, '')) div 4 as int))) as edited",
    )
    return fingerprints(edited.withColumnRenamed("fp", "own_fp"), "edited").selectExpr(
        "doc_id", "cast(n_chars as bigint) as n_chars", "sha2(edited, 256) as edited_sha256", f"{as_hex('own_fp')} as fingerprint", f"{as_hex('fp')} as edited_fingerprint",
        f"{likeness('own_fp', 'fp')} as near_edited", f"{likeness('own_fp', 'next_fp')} as near_next",
    )
