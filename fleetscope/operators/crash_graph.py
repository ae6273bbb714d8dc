"""Frames to call graph, signatures and known patterns.

Input frames: dump_id, tid, gdb_idx (0 = innermost), func, address. ``canonical`` orders every stack from the root to
the crash once; all other operators work on its rows with grouped aggregates and equi-joins. Lists are only built
from rows already cut to a fixed number per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.blocked import rank_and_previous, running_max
from fleetscope.functions.scalars import col, hex_to_number, once, rows_of

CHAIN = ["dump_id", "tid"]
ARROW = " → "


def exec_order(frames: DataFrame) -> DataFrame:
    """Usable frames numbered from the root (exec_depth 0), with runs of the same function cut to their first frame.

    ``caller`` is the function above the kept frame. Depth numbers are those before the cut.
    """
    ok = frames.where(~F.col("func").isin(*fixed.INVALID_FUNCS)).withColumn("_o", -F.col("gdb_idx"))
    r = rank_and_previous(ok, CHAIN, "_o", ["func"])
    kept = r.where("prev is null or prev.func <> func")
    return kept.selectExpr(*frames.columns, "rank as exec_depth", "prev.func as caller")


def call_edges(canonical: DataFrame) -> DataFrame:
    return canonical.where("caller is not null").selectExpr(*CHAIN, "exec_depth", "caller", "func as callee")


def call_graph(canonical: DataFrame) -> DataFrame:
    """Distinct callees per caller over all threads of a dump, as edges with the out-degree of the caller."""
    e = call_edges(canonical).select("dump_id", "caller", "callee").distinct()
    n = e.groupBy("dump_id", "caller").agg(F.count(F.lit(1)).alias("callees"))
    return e.join(n, ["dump_id", "caller"])


def call_hotspots(canonical: DataFrame, at_least: int = 3) -> DataFrame:
    """Callers with many distinct callees, one row per callee, so no list grows with the fan-out."""
    return call_graph(canonical).where(F.col("callees") >= at_least).select("dump_id", "caller", "callees", "callee")


def reciprocal_edges(canonical: DataFrame) -> DataFrame:
    """Edges whose reverse occurred earlier in the same chain: compared with the first reverse occurrence only."""
    e = call_edges(canonical)
    first = e.groupBy(*CHAIN, F.col("callee").alias("caller"), F.col("caller").alias("callee")).agg(F.min("exec_depth").alias("_first"))
    return e.join(first, [*CHAIN, "caller", "callee"]).where("_first < exec_depth").select(*CHAIN, "exec_depth", "caller", "callee")


def _top_list(df: DataFrame, keys: list[str], order: Column, n: int, value: Column, name: str) -> DataFrame:
    """First n values per key as a list: cut by rank before anything is collected."""
    x = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= n)
    g = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", value.alias("v")))).alias("_l"))
    return g.select(*keys, F.transform("_l", lambda s: s["v"]).alias(name))


def crash_signature(canonical: DataFrame, depth: int = 20) -> DataFrame:
    """Number and digest of all names without run-time start-up frames, and the innermost ``depth`` names joined with ``<``.

    The digest adds a hash of every name at its distance from the crash, so stacks that differ anywhere differ in it and no
    list of all names is collected.
    """
    useful = canonical.where(~F.col("func").rlike("|".join(fixed.SIGNATURE_SKIPS)))
    top = _top_list(useful, CHAIN, F.col("exec_depth").desc(), depth, F.col("func"), "l")
    placed = rank_and_previous(useful.drop("caller").withColumn("_up", -F.col("exec_depth")), CHAIN, "_up", ["func"])
    part = F.expr("cast(conv(substr(md5(concat(rank + 1, ':', func)), 1, 12), 16, 10) as bigint)")
    whole = placed.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("frames"), F.sum(part).alias("digest"))
    return top.join(whole, CHAIN).select(*CHAIN, "frames", "digest", F.array_join("l", " < ").alias("signature"))


def crash_function(canonical: DataFrame, main: int = 0) -> DataFrame:
    """Innermost function of the main thread of each dump."""
    return canonical.where(F.col("tid") == main).groupBy("dump_id").agg(F.max_by("func", "exec_depth").alias("crash_function"))


def common_frames(canonical: DataFrame) -> DataFrame:
    """Functions that occur in every thread of a dump."""
    once = canonical.select(*CHAIN, "func").distinct()
    n = canonical.select(*CHAIN).distinct().groupBy("dump_id").agg(F.count(F.lit(1)).alias("threads"))
    seen = once.groupBy("dump_id", "func").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(n, "dump_id").where("n = threads").select("dump_id", "func")


def distinct_stacks(canonical: DataFrame, main: int = 0) -> DataFrame:
    """Threads of a dump and whether their name sequence equals the main one.

    Position and name are matched row by row with an equi-join and the matches counted: exact, nothing collected.
    """
    pos = rank_and_previous(canonical.drop("caller"), CHAIN, "exec_depth", ["func"]).select(*CHAIN, "rank", "func")
    m = pos.where(F.col("tid") == main).select("dump_id", "rank", "func", F.lit(1).alias("_hit"))
    mn = m.groupBy("dump_id").agg(F.count(F.lit(1)).alias("main_frames"))
    g = pos.join(m, ["dump_id", "rank", "func"], "left").groupBy(*CHAIN).agg(
        F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("matched"))
    g = g.join(mn, "dump_id", "left")
    return g.withColumn("same_as_main", F.coalesce((F.col("frames") == F.col("main_frames")) & (F.col("matched") == F.col("frames")), F.lit(False)))


# ---- names ---------------------------------------------------------------------------------------------------

def frame_layer(func) -> Column:
    """noise, libc, driver, runtime, library or application, first matching rule."""
    f = col(func)
    starts = lambda prefixes: f.rlike("^(" + "|".join(prefixes) + ")")
    return (F.when(f.isin(*fixed.NOISE_NAMES), "noise").when(starts(fixed.LIBC_PREFIXES), "libc")
            .when(starts(fixed.PMD_PREFIXES), "dpdk_pmd").when(starts(fixed.EAL_PREFIXES) | f.isin(*fixed.EAL_NAMES), "dpdk_eal")
            .when(f.startswith("rte_"), "dpdk_lib").otherwise("user_app"))


def graph_type(func, crash) -> Column:
    """Four-way label for display; the crash function overrides."""
    layer = frame_layer(func)
    return (F.when(col(func) == col(crash), "crash").when(layer.isin("noise", "libc"), "libc")
            .when(layer.startswith("dpdk"), "dpdk").otherwise("user"))


def is_graph_noise(func) -> Column:
    return col(func).rlike("^(" + "|".join(fixed.GRAPH_NOISE_PREFIXES) + ")")


def crash_pattern(canonical: DataFrame, meta: DataFrame, main: int = 0) -> DataFrame:
    """First known pattern that fits the main thread. meta: dump_id, signal_name, region, fault_addr."""
    m = canonical.where(F.col("tid") == main)
    has = lambda names: F.bool_or(F.col("func").isin(*names))
    g = m.groupBy("dump_id").agg(F.max_by("func", "exec_depth").alias("crash_function"), has(fixed.MEMPOOL_FUNCS).alias("_mem"),
                                 has(fixed.RING_FUNCS).alias("_ring"), has(fixed.PANIC_FUNCS).alias("_panic"))
    x = g.join(meta, "dump_id", "left").withColumn("crash_layer", frame_layer("crash_function"))
    segv = F.col("signal_name").isin("SIGSEGV", "11")
    abrt = F.col("signal_name").isin("SIGABRT", "6")
    near = hex_to_number("fault_addr") < fixed.NEAR_NULL
    region = F.coalesce("region", F.lit("")).isin("anonymous", fixed.UNKNOWN, "")
    pattern = (F.when(F.col("_mem"), "mempool_exhaustion").when(segv & near, "mempool_exhaustion_null_deref")
               .when(F.col("_ring") & abrt, "ring_assert_failure").when(F.col("crash_layer") == "dpdk_pmd", "pmd_driver_crash")
               .when(segv & region, "null_ptr_in_anonymous_region").when(F.col("_panic") & abrt, "eal_panic_abort"))
    return x.select("dump_id", "crash_function", "crash_layer", "signal_name", pattern.alias("pattern"))


def layered_path(canonical: DataFrame) -> DataFrame:
    """Runs of one layer along the path, noise left out; a run of more than three names shows two, an ellipsis, the last.

    One row per run. Only the first three and the last name of a run are ever collected.
    """
    x = canonical.drop("caller").withColumn("layer", frame_layer("func")).where("layer <> 'noise'")
    x = rank_and_previous(x, CHAIN, "exec_depth", ["layer"]).withColumn("start", F.expr("case when prev is null or prev.layer <> layer then rank end"))
    run = running_max(x, CHAIN, "rank", "start", "run")
    g = run.groupBy(*CHAIN, "run", "layer").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("func", "rank").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("rank") - F.col("run") < 3, F.struct("rank", "func")))).alias("h"))
    names = F.transform("h", lambda s: s["func"])
    shown = F.when(F.col("n") > 3, F.concat(F.slice(names, 1, 2), F.array(F.lit("…"), F.col("last")))).otherwise(names)
    return g.select(*CHAIN, "run", "layer", F.col("n").alias("frames"), F.array_join(shown, ARROW).alias("path"))


def path_summary(canonical: DataFrame, main: int = 0) -> DataFrame:
    """Main path in one line: all names up to 12, else three, an ellipsis and the last five with the number left out."""
    m = rank_and_previous(canonical.where(F.col("tid") == main).drop("caller"), CHAIN, "exec_depth", ["func"])
    n = m.groupBy("dump_id").agg(F.count(F.lit(1)).alias("n"))
    x = m.join(n, "dump_id").where("n <= 12 or rank < 3 or rank >= n - 5")
    g = x.groupBy("dump_id", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "func"))).alias("l"))
    names = F.transform("l", lambda s: s["func"])
    long = F.concat(F.array_join(F.slice(names, 1, 3), ARROW), F.lit("  …  "), F.array_join(F.slice(names, 4, 5), ARROW))
    note = F.format_string("(full depth: %d, %d frames omitted)", F.col("n"), F.col("n") - 8)
    return g.select("dump_id", "n", F.when(F.col("n") > 12, long).otherwise(F.array_join(names, ARROW)).alias("path"),
                    F.when(F.col("n") > 12, note).otherwise("").alias("note"))


def crash_context(canonical: DataFrame, main: int = 0, last: int = 8) -> DataFrame:
    """The innermost frames of the main thread with their layer."""
    w = W.partitionBy("dump_id").orderBy(F.col("exec_depth").desc())
    m = canonical.where(F.col("tid") == main).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    return m.select("dump_id", "gdb_idx", frame_layer("func").alias("layer"), "func")


def thread_overlap(canonical: DataFrame, main: int = 0, last: int = 5) -> DataFrame:
    """Other threads that share a function with the last frames before the crash."""
    w = W.partitionBy("dump_id").orderBy(F.col("exec_depth").desc())
    near = canonical.where(F.col("tid") == main).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    near = near.select("dump_id", "func").distinct()
    other = canonical.where(F.col("tid") != main).select(*CHAIN, "func").distinct()
    return other.join(near, ["dump_id", "func"]).groupBy(*CHAIN).agg(F.array_sort(F.collect_list("func")).alias("shared"))


# ---- display tables ----------------------------------------------------------------------------------------------

def graph_nodes(canonical: DataFrame, main: int = 0) -> DataFrame:
    """One node per thread and function (its first frame), noise frames left out."""
    n = canonical.where(~is_graph_noise("func")).groupBy(*CHAIN, "func").agg(
        F.min("exec_depth").alias("depth"), F.min_by("address", "exec_depth").alias("address"))
    x = n.join(crash_function(canonical, main), "dump_id", "left")
    return x.select(*CHAIN, F.concat(F.col("tid").cast("string"), F.lit("_"), "func").alias("node_id"), "func", "depth", "address",
                    graph_type("func", F.coalesce("crash_function", F.lit(""))).alias("type"),
                    (F.col("func") == F.coalesce("crash_function", F.lit(""))).alias("is_crash"))


def graph_edges_alive(canonical: DataFrame) -> DataFrame:
    """Edges between functions that both survive the noise filter (a property of the two names)."""
    e = call_edges(canonical).where(~is_graph_noise("caller") & ~is_graph_noise("callee"))
    t = F.concat(F.col("tid").cast("string"), F.lit("_"))
    return e.select(*CHAIN, "exec_depth", F.concat(t, "caller").alias("source"), F.concat(t, "callee").alias("target"))


def crash_timeline(canonical: DataFrame, main: int = 0) -> DataFrame:
    x = canonical.where(~is_graph_noise("func")).join(crash_function(canonical, main), "dump_id", "left")
    return x.select(*CHAIN, F.col("exec_depth").alias("order"), "func", "address", (F.col("tid") == main).alias("is_crash_thread"),
                    (F.col("func") == F.coalesce("crash_function", F.lit(""))).alias("is_crash"))


def poison_note(value) -> Column:
    """Fill pattern of a 64-bit value: its high byte, or the same byte in the low 32 bits (lowest digit pair free)."""
    def note(h: Column) -> Column:
        high, low = F.substring(h, 1, 2), F.substring(h, 15, 2)
        out = None
        for b, text in fixed.POISON_BYTES.items():
            out = F.when(high == b, text) if out is None else out.when(high == b, text)
        for b, text in fixed.POISON_BYTES.items():
            out = out.when((low == b) & (F.substring(h, 9, 6) == b * 3), text)
        return out

    return once(F.lpad(F.regexp_replace(F.lower(col(value)), "^0x", ""), 16, "0"), note)


def register_notes(df: DataFrame, keep=("dump_id",), module: str = "region") -> DataFrame:
    """Registers in fixed order, one row each: the module at rip, NULL / near-NULL / fill pattern at rdi."""
    have = [r for r in fixed.REGISTER_ORDER if r in df.columns]
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(r).alias("name"), F.col(r).alias("value")) for i, r in enumerate(have)])
    x = df.select(*keep, module, F.inline(items)).where("value is not null")
    a = hex_to_number("value")
    rdi = (F.when(a == 0, fixed.NOTE_NULL).when(a < fixed.NEAR_NULL, F.concat(
        F.lit(f"{fixed.NOTE_NEAR_NULL} (+0x"), F.lower(F.hex(a.cast("bigint"))), F.lit(")"))).otherwise(poison_note("value")))
    note = F.when((F.col("name") == "rip") & (F.coalesce(module, F.lit("")) != ""), F.col(module)).when(F.col("name") == "rdi", rdi)
    return x.select(*keep, "pos", "name", "value", note.alias("note"))


def stack_annotate(words: DataFrame, frames: DataFrame, keep=("dump_id", "base")) -> DataFrame:
    """Stack words with their offset; a word that is a frame address is named as its return address.

    words: keep…, words array. frames: dump_id, address, func, depth; the outermost frame of an address names it.
    """
    w = rows_of(words, keep, "words", "value", "i")
    f = frames.where("address is not null").groupBy("dump_id", "address").agg(F.min_by("func", "depth").alias("_f"))
    j = w.join(f, (w.dump_id == f.dump_id) & (w.value == f.address), "left").drop(f.dump_id)
    off = F.concat(F.lit("+0x"), F.lpad(F.lower(F.hex(F.col("i") * 8)), 4, "0"))
    return j.select(*keep, off.alias("offset"), "value", F.when(F.col("_f").isNotNull(), F.concat("_f", F.lit(f" {fixed.NOTE_RETURN}"))).alias("note"))


def diagnosis_mode(canonical: DataFrame, raw: DataFrame, main: int = 0) -> DataFrame:
    """env_diagnostic when the main stack is too short (one frame without source, or fewer than three raw frames)."""
    c = canonical.where(F.col("tid") == main).groupBy("dump_id").agg(F.count(F.lit(1)).alias("kept"))
    r = raw.where(F.col("tid") == main).groupBy("dump_id").agg(
        F.count(F.lit(1)).alias("raw_frames"), F.bool_or(F.col("source").isNotNull()).alias("has_source"))
    x = r.join(c, "dump_id", "left").fillna(0, ["kept"])
    short = (F.col("raw_frames") < 3) | ((F.col("kept") <= 1) & ~F.col("has_source"))
    return x.withColumn("mode", F.when(short, "env_diagnostic").otherwise("call_chain_diagnostic"))


def idle_filter(frames: DataFrame, idle: Column) -> DataFrame:
    """Frames of the threads without any waiting call."""
    return frames.join(frames.where(idle).select(*CHAIN).distinct(), CHAIN, "left_anti")


def dump_subsystems(frames: DataFrame) -> DataFrame:
    """Which library parts occur in a dump: one flag aggregate per pattern, then the list of names."""
    g = frames.groupBy("dump_id").agg(*[F.bool_or(F.col("func").rlike(p)).alias(n) for n, p in fixed.SUBSYSTEMS.items()])
    return g.select("dump_id", F.array_compact(F.array(*[F.when(F.col(n), n) for n in fixed.SUBSYSTEMS])).alias("subsystems"))


def crash_snapshot(parsed: DataFrame, frames: DataFrame) -> DataFrame:
    """Signal, crash point, registers, stack, fault, analysis and thread context of each dump as nested columns.

    parsed: row of ``crash_text.parsed``; frames: dump_id, idx, func, address, source of the crashed thread (bounded list).
    """
    top = frames.groupBy("dump_id").agg(
        F.min_by(F.struct("func", "address", "source"), "idx").alias("top"), F.count(F.lit(1)).alias("frames"),
        F.bool_or(F.col("func").isin(*fixed.MEMPOOL_FUNCS)).alias("mem"), F.bool_or(F.col("func").isin(*fixed.RING_FUNCS)).alias("ring"))
    near = F.coalesce(hex_to_number("fault_addr") < fixed.NEAR_NULL, F.lit(False))
    s = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    c = F.col
    x = parsed.join(top, "dump_id", "left")
    abnormal = F.filter("threads", lambda t: ~t["crashed"] & ~t["idle"])
    return x.select(
        "dump_id", s(name=c("signal_name"), description=c("signal_desc")).alias("signal"),
        s(function=c("top.func"), file=c("crash_file"), line=c("crash_line"), address=c("top.address"), layer=frame_layer("top.func"),
          declared=c("crash_func")).alias("crash_point"),
        s(rip=c("rip"), rdi=c("rdi"), rdi_poison=poison_note("rdi")).alias("registers"),
        s(address=c("fault_addr"), near_null=near, region=c("region"), region_type=c("region_type")).alias("fault"),
        s(crash_type=c("crash_type"), mempool_path=c("mem"), ring_path=c("ring"), missing_libs=c("missing_libs")).alias("analysis"),
        s(total=F.size("threads"), abnormal=abnormal).alias("thread_context"), c("frames").alias("frame_count"))


