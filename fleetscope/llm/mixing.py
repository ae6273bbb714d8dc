"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A document draws ``u`` from its id; its key is ``u ** (1 / quality)``, the exponential key of its quality weight in
another scale. Within a source documents are ordered by falling key and taken while the running sum of sizes stays
near the budget. A target above the size of its source is met by complete epochs first, the rest is selected.

No source is sorted whole: keys fall into bins, sizes are summed per (source, bin), and only the bin in which the
budget ends is ordered. What remains per source is one row (epochs, bin, last key), which decides every document where
it lies, so texts are never shuffled by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stage, uniform, word_count

SYMBOLS = "#*$%&|<>"


def text_quality(text: Column) -> Column:
    """Weight in [0.1, 1]: falls with the share of mark-up symbols; an empty or null text weighs 1."""
    n = F.length(text)
    share = (n - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * share), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` (one row per ``_src`` with ``source_size``) plus ``target``.

    Weights repeat over the sources in code-point order, null last. A target stops at ``cap`` times the size; the
    excess goes to the others by weight. That fixed point is a water level: sources sorted by cap over weight are
    capped as long as the level of those before them reaches theirs. The windows run over one row per source.
    """
    cycle = "array(" + ",".join(map(str, weights)) + ")"
    ranked = sizes.selectExpr(
        "*", f"element_at({cycle}, cast(pmod(row_number() over (order by _src asc nulls last) - 1, {len(weights)}) + 1 as int)) as _w"
    )
    before = "over (order by {cap} * source_size / _w, _src rows between unbounded preceding and 1 preceding)".replace("{cap}", f"{cap}D")
    level = ranked.selectExpr(
        "*",
        f"{share}D * sum(source_size) over () as _all",
        "sum(_w) over () as _weights",
        f"coalesce(sum({cap}D * source_size) {before}, 0D) as _caps",
        f"coalesce(sum(_w) {before}, 0) as _used",
    ).selectExpr("*", f"(_all - _caps) / (_weights - _used) >= {cap}D * source_size / _w as _full")
    return level.selectExpr(
        "*",
        f"coalesce(sum(if(_full, {cap}D * source_size, 0D)) over (), 0D) as _fixed",
        "sum(if(_full, 0, _w)) over () as _free",
    ).selectExpr("_src", "source_size", f"if(_full, {cap}D * source_size, (_all - _fixed) * _w / _free) as target")


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, bins: int = 4096) -> DataFrame:
    """One row per source: size, target, epochs and the key at which selection ends. ``docs`` needs _id, _src, _size, _r, _bin."""
    per_bin = docs.groupBy("_src", "_bin").agg(F.sum("_size").alias("_s"))
    sums = stage(
        per_bin.selectExpr(
            "*", "sum(_s) over (partition by _src) as source_size", "sum(_s) over (partition by _src order by _bin) as _upto"
        ),
        "mix-bins",
    )
    targets = stage(
        source_targets(sums.groupBy("_src").agg(F.max("source_size").alias("source_size")), weights, share, cap).selectExpr(
            "*", "cast(if(source_size > 0, floor(target / source_size), 0) as long) as _epochs"
        ).selectExpr("*", "target - _epochs * source_size as _rest"),
        "mix-targets",
    ).alias("t")
    # The bin in which the budget ends: the first whose running sum passes it.
    edge = (
        sums.alias("s")
        .join(targets, F.expr("s._src <=> t._src"))
        .where("s._upto > t._rest and s._upto - s._s <= t._rest")
        .groupBy("s._src")
        .agg(F.min("s._bin").alias("_edge"), F.min_by(F.expr("s._upto - s._s"), F.col("s._bin")).alias("_before"))
    )
    edge = stage(targets.join(edge.alias("e"), F.expr("t._src <=> e._src"), "left").selectExpr("t.*", f"coalesce(_edge, {bins}) as _edge", "coalesce(_before, 0) as _before"), "mix-edge")
    inside = docs.alias("d").join(
        edge.select(F.col("_src").alias("_e"), "_edge", "_before", "_rest"), F.expr("d._src <=> _e and d._bin = _edge")
    )
    peers = "over (partition by _src order by _r desc, _id range between unbounded preceding and current row)"
    taken = inside.selectExpr(
        "_src", "_id", "_r", "_rest", f"_before + sum(_size) {peers} as _upto", "sum(_size) over (partition by _src, _r, _id) as _own"
    ).where("_upto <= _rest or (_upto - _own < _rest and _upto - _rest < _rest - (_upto - _own))")
    cut = taken.groupBy("_src").agg(F.max(F.struct((-F.col("_r")).alias("_r"), "_id")).alias("_c"))
    return edge.alias("p").join(cut.alias("c"), F.expr("p._src <=> c._src"), "left").selectExpr(
        "p._src as _src", "source_size", "target", "_epochs", "_edge", "coalesce(-_c._r, 2D) as _cut_r", "coalesce(_c._id, 0L) as _cut_id"
    )


def keyed(docs: DataFrame, size: Column, quality: Column, bins: int, seed: int) -> DataFrame:
    """``docs`` plus _id, _src, _size, _r (the sampling key) and _bin, in this order after the own columns."""
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    u = uniform(ident, seed=seed)
    return (
        docs.withColumns({"_id": ident, "_src": F.col("source"), "_size": F.coalesce(size.cast("long"), F.lit(0)), "_r": F.pow(u, F.lit(1.0) / quality)})
        .withColumn("_bin", F.least(F.floor((F.lit(1.0) - F.col("_r")) * F.lit(bins)), F.lit(bins - 1)).cast("int"))
    )


def mix_sources(
    docs: DataFrame, size: Column | None = None, quality: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, bins: int = 4096, salts: int = 32, seed: int = 17,
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, the number of times the mix takes it.

    A null text has size 0; null sources form one source, ranked last; a null id is an id of its own. Rows that share
    an id share a key and are taken or left together. Sources without words have target 0 and no copies beyond
    complete epochs. An empty table gives an empty result. Columns named like the results are replaced; all others pass
    through, whatever their names.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    size = size if size is not None else word_count(F.col("text"))
    quality = quality if quality is not None else text_quality(F.col("text"))
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")  # no name can clash inside it
    base = keyed(docs.select(row, "doc_id", "source", size.alias("_words"), quality.alias("_quality")), F.col("_words"), F.col("_quality"), bins, seed)
    slim = stage(base.select("_id", "_src", "_size", "_r", "_bin"), "mix-keys")
    plan = stage(mixing_plan(slim, weights, share, cap, bins), "mix-plan")
    spread = plan.select(F.explode(F.expr(f"sequence(0, {salts - 1})")).alias("_ps"), *[F.col(c).alias(f"_p{c}") for c in plan.columns])
    picked = F.expr("_bin < _p_edge or (_bin = _p_edge and (_r > _p_cut_r or (_r = _p_cut_r and _id <= _p_cut_id)))")
    return (
        base.withColumn("_salt", F.expr(f"cast(pmod(xxhash64(_id), {salts}) as int)"))
        .join(spread, F.expr("_src <=> _p_src and _salt = _ps"))
        .select(
            *[F.col("_row")[c].alias(c) for c in own], F.col("_size").alias("size"), F.col("_psource_size").alias("source_size"), F.col("_ptarget").alias("target"),
            (F.col("_p_epochs") + F.when(picked & (F.col("_ptarget") > F.col("_p_epochs") * F.col("_psource_size")), 1).otherwise(0)).cast("long").alias("copies"),
        )
    )


def take_mixed(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the mix: each document as often as it is taken."""
    row = mixed.where("copies > 0").select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return row.select(*[F.col("row")[c].alias(c) for c in columns])
