"""Layers and crash patterns from tables that users write.

A layer rule is an exact name or a prefix. Function names are looked up, once each, by themselves and by their prefixes of
the lengths that rules have, so a table of ten thousand rules costs a handful of hash lookups a name and no long
expression; of the rules that hold the one with the smallest number wins.

A pattern names conditions on a dump; null means any. It is looked up by the first condition it has (a function on the
main thread, the layer of the crash function, a signal, a region), so dumps never meet patterns that share nothing with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.scalars import hex_to_number
from fleetscope.functions.small import small_side

LAYER_RULES = "rule_no int, match string, text string, layer string"
PATTERN_RULES = "pattern_no int, pattern string, funcs array<string>, layer string, signals array<string>, near_null boolean, regions array<string>"
OTHER = "user_app"


def default_layers(spark: SparkSession) -> DataFrame:
    """The shipped layers as a table."""
    parts = [("exact", fixed.NOISE_NAMES, "noise"), ("prefix", fixed.LIBC_PREFIXES, "libc"), ("prefix", fixed.PMD_PREFIXES, "dpdk_pmd"),
             ("prefix", fixed.EAL_PREFIXES, "dpdk_eal"), ("exact", fixed.EAL_NAMES, "dpdk_eal"), ("prefix", ("rte_",), "dpdk_lib")]
    rows = [(match, text, layer) for match, texts, layer in parts for text in texts]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LAYER_RULES)


def default_patterns(spark: SparkSession) -> DataFrame:
    """The shipped crash patterns as a table."""
    segv, abrt = ["SIGSEGV", "11"], ["SIGABRT", "6"]
    rows = [
        ("mempool_exhaustion", list(fixed.MEMPOOL_FUNCS), None, None, None, None), ("mempool_exhaustion_null_deref", None, None, segv, True, None),
        ("ring_assert_failure", list(fixed.RING_FUNCS), None, abrt, None, None), ("pmd_driver_crash", None, "dpdk_pmd", None, None, None),
        ("null_ptr_in_anonymous_region", None, None, segv, None, ["anonymous", fixed.UNKNOWN, ""]), ("eal_panic_abort", list(fixed.PANIC_FUNCS), None, abrt, None, None),
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PATTERN_RULES)


def name_layers(names: DataFrame, rules: DataFrame, func: str = "func", other: str = OTHER) -> DataFrame:
    """(func, layer) of every distinct, non-null name. A rule without a text, or of an unknown kind, matches nothing."""
    lengths = rules.where("match = 'prefix' and text is not null").agg(F.array_sort(F.collect_set(F.length("text"))).alias("lengths"))  # one row, a number for each length
    one = names.where(F.col(func).isNotNull()).select(F.col(func).alias("func")).distinct()
    probes = one.join(F.broadcast(lengths), F.lit(True)).selectExpr(
        "func", "explode(concat(array(struct('exact' as match, func as text)), transform(filter(lengths, n -> n <= length(func)), n -> struct('prefix' as match, substring(func, 1, n) as text)))) as p"
    ).select("func", "p.match", "p.text")
    first = rules.groupBy("match", "text").agg(F.min(F.struct("rule_no", "layer")).alias("r"))
    hit = probes.join(small_side(first), ["match", "text"]).groupBy("func").agg(F.min("r").alias("r"))
    return one.join(hit, "func", "left").select("func", F.coalesce("r.layer", F.lit(other)).alias("layer"))


def with_layers(frames: DataFrame, rules: DataFrame, func: str = "func", layer: str = "layer", other: str = OTHER) -> DataFrame:
    """``frames`` plus the layer of each function; a null function is of the layer ``other``.

    Frequent functions lie in many frames, so the names, far fewer than frames, go to the frames: by broadcast where the
    planner finds them small, else salted.
    """
    salts = 16
    named = name_layers(frames, rules, func, other).select(F.col("func").alias("_name"), F.col("layer").alias("_layer"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    keys = [c for c in frames.columns if c not in (layer, func)]
    own = frames.drop(layer).withColumn("_of", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int") if keys else F.lit(0))
    j = own.join(named, (F.col(func) == F.col("_name")) & (F.col("_of") == F.col("_salt")), "left")
    return j.withColumn(layer, F.coalesce("_layer", F.lit(other))).drop("_name", "_layer", "_salt", "_of")


def crash_patterns(canonical: DataFrame, meta: DataFrame, layers: DataFrame, patterns: DataFrame, main: int = 0, other: str = OTHER) -> DataFrame:
    """dump_id, crash_function, crash_layer, signal_name and the first pattern of the table that fits, NULL if none does.

    canonical: frames of ``crash_graph.exec_order``; meta: dump_id, signal_name, region, fault_addr. A dump without meta has no
    signal, an unnamed region and no fault address. A pattern without any condition fits every dump.
    """
    m = canonical.where(F.col("tid") == main)
    top = m.groupBy("dump_id").agg(F.max_by("func", "exec_depth").alias("crash_function")).join(meta, "dump_id", "left")
    dumps = with_layers(top, layers, "crash_function", "crash_layer", other).selectExpr(
        "dump_id", "crash_function", "crash_layer", "signal_name", "coalesce(region, '') as _region", "fault_addr")
    dumps = dumps.withColumn("_near", F.coalesce(hex_to_number("fault_addr") < fixed.NEAR_NULL, F.lit(False))).drop("fault_addr")

    # Patterns by their first condition; functions of the main thread meet only the patterns that name them.
    keyed = patterns.selectExpr("*", """explode(case when funcs is not null then transform(funcs, x -> struct('func' as kind, x as key))
        when layer is not null then array(struct('layer' as kind, layer as key)) when signals is not null then transform(signals, x -> struct('signal' as kind, x as key))
        when regions is not null then transform(regions, x -> struct('region' as kind, x as key)) else array(struct('any' as kind, '' as key)) end) as k""")
    keyed = small_side(keyed.selectExpr("k.kind", "k.key", "pattern_no", "pattern", "layer", "signals", "near_null", "regions"))
    facts = dumps.selectExpr("dump_id", "stack(4, 'layer', crash_layer, 'signal', signal_name, 'region', _region, 'any', '') as (kind, key)")
    met = facts.unionByName(m.selectExpr("dump_id", "'func' as kind", "func as key").distinct()).join(keyed, ["kind", "key"]).drop("kind", "key").dropDuplicates(["dump_id", "pattern_no"])
    fits = met.join(dumps, "dump_id").where("""(layer is null or layer = crash_layer) and (signals is null or array_contains(signals, signal_name))
        and (near_null is null or near_null = _near) and (regions is null or array_contains(regions, _region))""")
    best = fits.groupBy("dump_id").agg(F.min(F.struct("pattern_no", "pattern")).alias("b"))
    return dumps.join(best, "dump_id", "left").select("dump_id", "crash_function", "crash_layer", "signal_name", F.col("b.pattern").alias("pattern"))
