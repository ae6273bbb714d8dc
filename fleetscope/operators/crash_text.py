"""Debugger, stack-tool, start-up-log and device text to structured columns.

Everything works inside one row with built-in string and array functions: no shuffle, no Python, whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions import gdb_lines as G
from fleetscope.functions.scalars import col, hex_to_number, once, regex_or_null, rows_of
from fleetscope.functions.small import small_side


def _lines(c) -> Column:
    return F.split(col(c), "\r?\n")


def signal_name(number: Column) -> Column:
    """Signal number to name; NULL when it is not in the table."""
    out = None
    for n, name in fixed.SIGNALS.items():
        test = number.cast("string") == str(n)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


# ---- file names ----------------------------------------------------------------------------------------

def core_filename(df: DataFrame, name: str = "filename") -> DataFrame:
    """core.exe.pid.tid.signal.time.path with at most six cuts; ``!`` in the path stands for ``/``."""
    p = F.split(name, r"\.", 7)
    path = F.replace(F.get(p, F.lit(6)), F.lit("!"), F.lit("/"))
    return df.withColumns({
        "exe_name": F.get(p, F.lit(1)), "pid": F.get(p, F.lit(2)).try_cast("bigint"), "tid": F.get(p, F.lit(3)).try_cast("bigint"),
        "signal": F.get(p, F.lit(4)).try_cast("int"), "signal_name": F.coalesce(signal_name(F.get(p, F.lit(4))), F.lit("UNKNOWN")),
        "timestamp": F.get(p, F.lit(5)).try_cast("bigint"),
        "exe_path": F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "valid": F.size(p) == 7,
    })


def bundle_manifest(files: DataFrame, bundle: str = "bundle", name: str = "filename", executable: str = "is_executable") -> DataFrame:
    """Files of a crash bundle by kind: exactly one core, at most one log and one program, nothing else."""
    base = F.regexp_extract(name, r"([^/]+)$", 1)
    kind = (F.when(base.startswith("core."), "core").when(F.lower(base).endswith(".log"), "log")
            .when(F.col(executable), "exe").otherwise("unknown"))
    k = files.withColumn("kind", kind)
    n = lambda x: F.sum(F.when(F.col("kind") == x, 1).otherwise(0))
    first = lambda x: F.min(F.when(F.col("kind") == x, F.col(name)))
    g = k.groupBy(bundle).agg(n("core").alias("cores"), n("log").alias("logs"), n("exe").alias("exes"), n("unknown").alias("others"),
                              first("core").alias("core_path"), first("log").alias("log_path"), first("exe").alias("exe_path"))
    error = (F.when(F.col("cores") != 1, "need exactly one core file").when(F.col("logs") > 1, "more than one log file")
             .when(F.col("exes") > 1, "more than one program").when(F.col("others") > 0, "unknown file"))
    return g.withColumn("error", error)


# ---- debugger sections --------------------------------------------------------------------------------------

def section_list(text) -> Column:
    """(name, body) of every BEGIN/END block, in order; the text is split once, at its BEGIN marks.

    A block ends at its own END mark; one that has none before the next block has a NULL body.
    """
    def block(p: Column, name: Column) -> Column:
        end = F.instr(p, F.concat(F.lit("=== "), name, F.lit("_END ===")))
        start = F.length(name) + len("_BEGIN ===")
        body = once(end, lambda e: F.when(e > 0, G.strip(F.substring(p, start + 1, e - start - 1))))
        return F.struct(name.alias("name"), body.alias("body"))

    pieces = F.split(col(text), "=== (?=[A-Z0-9_]+_BEGIN ===)")
    return F.transform(G.rest(pieces), lambda p: once(F.substring_index(p, "_BEGIN ===", 1), lambda n: block(p, n)))


def with_sections(df: DataFrame, text: str = "gdb_text") -> DataFrame:
    """The named BEGIN/END blocks as columns ``s_<name>``, empty where a block is missing; of several the first counts."""
    def body(n: str) -> Column:
        own = F.filter("_blocks", lambda b: (b["name"] == n.upper()) & b["body"].isNotNull())
        return F.coalesce(F.try_element_at(own, F.lit(1))["body"], F.lit(""))

    return df.withColumn("_blocks", section_list(text)).withColumns({f"s_{n}": body(n) for n in fixed.SECTIONS}).drop("_blocks")


def signal_info(df: DataFrame, text: str = "gdb_text") -> DataFrame:
    """Signal and description of the line on which the debugger says how the program ended."""
    said = F.filter(_lines(text), lambda x: x.contains("Program received signal ") | x.contains("Program terminated with signal "))
    tail = G.after(F.try_element_at(said, F.lit(1)), " signal ")

    def one(t: Column, raw: Column) -> Column:
        name = F.when(raw.rlike(G.NUMBER), F.coalesce(signal_name(raw), F.concat(F.lit("SIG_"), raw))).when(raw != "", raw)
        desc = F.trim(F.regexp_replace(F.substring(t, F.length(raw) + 1, F.length(t)), r"^[,.]?\s*", ""))
        return F.struct(name.alias("name"), F.when(raw != "", desc).alias("desc"))

    both = once(tail, lambda t: once(F.get(F.split(t, "[^A-Za-z0-9_]", 2), F.lit(0)), lambda raw: one(t, raw)))
    return df.withColumn("_said", both).withColumns({"signal_name": F.col("_said.name"), "signal_desc": F.col("_said.desc")}).drop("_said")


def frame_rows(section) -> Column:
    """array<struct<no, text>> of the frame lines of a text."""
    parts = F.filter(F.transform(_lines(section), G.frame_parts), G.is_frame)
    return F.transform(parts, lambda p: F.struct(G.frame_number(p).alias("no"), G.frame_body(p).alias("text")))


def crash_frame(df: DataFrame, section: str = "s_bt_full") -> DataFrame:
    """Function, file and line of frame 0; all NULL when the function is unknown."""
    first = F.try_element_at(F.filter(frame_rows(section), lambda r: r["no"] == 0), F.lit(1))["text"]

    def one(text: Column, where: Column) -> Column:
        func = F.trim(G.before_place(text, where))
        return F.struct(func.alias("func"), where.alias("place"))

    x = df.withColumn("_at", once(G.body_parts(first)["text"], lambda t: once(G.place(t), lambda w: one(t, w))))
    func, where = F.col("_at.func"), F.col("_at.place")
    known = ~func.isin("??", "")
    return x.withColumns({
        "crash_func": F.when(known, func), "crash_file": F.when(known, G.place_file(where)),
        "crash_line": F.when(known, G.place_line(where)), "has_debuginfo": F.when(known, where.isNotNull()),
    }).drop("_at")


def with_frames(df: DataFrame, section, out: str = "frames", limit: int | None = None) -> DataFrame:
    """Add the frame lines of a text, first per frame number, as array<struct<no, text>>."""
    first = lambda rows: once(F.transform(rows, lambda r: r["no"]), lambda nos: F.filter(rows, lambda r, i: F.array_position(nos, r["no"]) == i + 1))
    kept = once(frame_rows(section), first)
    return df.withColumn(out, F.slice(kept, 1, limit) if limit else kept)


def backtrace_frames(df: DataFrame, section: str = "s_bt_full", limit: int | None = None, keep=("dump_id",)) -> DataFrame:
    """One row per frame line of the crashed thread; ``limit`` keeps the first ones of each dump."""
    x = with_frames(df.select(*keep, section), section, "f", limit)
    return rows_of(x, keep, "f", pos="pos").select(*keep, "pos", F.col("x.no").alias("frame_no"), F.col("x.text").alias("frame"))


def norm_text(c) -> Column:
    return F.regexp_replace(F.lower(col(c)), r"[\s_()]+", "")


def is_idle(c) -> Column:
    """The name, without blanks, underscores and parentheses, contains one of the waiting calls."""
    return norm_text(c).rlike("|".join(fixed.IDLE_TOKENS))


def thread_role(crashed: Column, norm: Column) -> Column:
    """Role of a thread by the normalized name of its top frame."""
    out = F.when(crashed, "crashed")
    for role, tokens in fixed.THREAD_ROLES:
        out = out.when(norm.rlike("|".join(tokens)), role)
    return out.when(norm.rlike("|".join(fixed.IDLE_TOKENS)), "lcore_worker").otherwise("unknown")


def with_threads(df: DataFrame, section: str = "s_info_threads") -> DataFrame:
    """Add ``threads``: array of crashed flag, id, lwp, top frame, role and idle flag."""
    def one(t: Column, top: Column, norm: Column) -> Column:
        w = t["w"]
        return F.struct(t["crashed"].alias("crashed"), w[0].alias("id"), F.regexp_replace(w[4], r"\)", "").alias("lwp"),
                        top.alias("bt_top"), thread_role(t["crashed"], norm).alias("role"), norm.rlike("|".join(fixed.IDLE_TOKENS)).alias("idle"))

    split = F.transform(_lines(section), lambda x: F.struct(F.ltrim(x).startswith("*").alias("crashed"), G.thread_words(x).alias("w")))
    threads = F.transform(F.filter(split, lambda t: G.is_thread(t["w"])), lambda t: once(F.trim(t["w"][5]), lambda top: once(norm_text(top), lambda n: one(t, top, n))))
    return df.withColumn("threads", threads)


def thread_table(df: DataFrame, keep=("dump_id",)) -> DataFrame:
    return rows_of(df, keep, "threads", "t").select(*keep, "t.crashed", "t.id", "t.lwp", "t.bt_top", "t.role")


def abnormal_threads(threads: Column) -> Column:
    return F.filter(threads, lambda t: ~t["crashed"] & ~t["idle"])


def thread_summary(df: DataFrame, keep=("dump_id",)) -> DataFrame:
    t = F.col("threads")
    crashed = F.filter(t, lambda x: x["crashed"])
    x = df.select(*keep, F.size(t).alias("total"), F.try_element_at(crashed, F.lit(-1))["lwp"].alias("crashed_lwp"),
                  F.size(abnormal_threads(t)).alias("abnormal"))
    return x.withColumn("idle", F.greatest(F.col("total") - F.col("abnormal") - F.when(F.col("crashed_lwp").isNotNull(), 1).otherwise(0), F.lit(0)))


def external_abnormal_threads(df: DataFrame, keep=("dump_id",)) -> DataFrame:
    """Threads that are neither crashed nor idle and whose top frame is not internal to the packet library."""
    inner = "|".join(fixed.INTERNAL_THREAD_FUNCS)
    a = F.filter(abnormal_threads(F.col("threads")), lambda t: ~t["bt_top"].rlike(inner))
    return rows_of(df, keep, a, "t").select(*keep, "t.id", "t.lwp", "t.bt_top", "t.role")


def thread_backtraces(df: DataFrame, section: str = "s_thread_bt", keep=("dump_id",)) -> DataFrame:
    """Frames per thread block; threads in a waiting call are left out."""
    blocks = F.filter(F.split(section, r"(?m)^(?=[ \t]*Thread [0-9]+ )"), lambda b: (G.word(b) == "Thread") & (G.word(b, 2) == "(Thread"))
    x = rows_of(df, keep, blocks, "b")
    x = with_frames(x.select(*keep, G.word(F.col("b"), 1).alias("tid"), "b"), "b", "f")
    awake = F.when(~F.exists("f", lambda r: is_idle(r["text"])), F.col("f"))
    return rows_of(x, [*keep, "tid"], awake, pos="pos").select(
        *keep, "tid", "pos", F.col("x.no").alias("frame_no"), F.col("x.text").alias("frame"))


def with_registers(df: DataFrame, section: str = "s_registers") -> DataFrame:
    """The six key registers as columns; the last value wins."""
    words = F.transform(_lines(section), lambda x: F.split(G.strip(x), G.BLANKS, 3))
    values = F.filter(words, lambda w: F.coalesce(F.get(w, F.lit(1)).startswith("0x"), F.lit(False)))
    x = df.withColumn("_p", F.transform(values, lambda w: F.struct(w[0].alias("k"), w[1].alias("v"))))

    def last(n: str) -> Column:
        return F.try_element_at(F.filter("_p", lambda z: z["k"] == n), F.lit(-1))["v"]

    return x.withColumns({n: last(n) for n in fixed.KEY_REGISTERS}).drop("_p")


def fault_address(df: DataFrame, section: str = "s_siginfo") -> DataFrame:
    """The value printed for the address, ``$N = [(type)] 0xADDR`` or plain 0."""
    said = F.filter(_lines(section), lambda x: F.ltrim(x).startswith("$") & x.contains("="))
    value = F.element_at(F.split(G.strip(G.after(F.try_element_at(said, F.lit(1)), "=")), G.BLANKS), -1)
    return df.withColumn("fault_addr", once(value, lambda v: F.when(v.startswith("0x"), v).when(v == "0", "0x0")))


def locals_table(df: DataFrame, section: str = "s_locals", keep=("dump_id",), limit: int | None = None) -> DataFrame:
    """name = value rows of the crash frame without headers and ``leak``; ``limit`` shortens long values for display."""
    x = rows_of(df, keep, F.transform(_lines(section), lambda x: F.split(x, "=", 2)), "l", "pos")
    x = x.where("size(l) = 2").select(*keep, "pos", F.rtrim(F.col("l")[0]).alias("name"), F.trim(F.col("l")[1]).alias("v"))
    x = x.where(F.col("name").rlike("^[A-Za-z0-9_]+$") & (F.col("v") != ""))
    x = x.where(~F.col("name").isin(*fixed.LOCAL_SKIP, "leak"))
    short = F.col("v") if limit is None else F.when(F.length("v") <= limit, F.col("v")).otherwise(F.concat(F.substring("v", 1, limit), F.lit("…")))
    return x.select(*keep, "pos", "name", short.alias("value"))


def region_type(name) -> Column:
    n = col(name)
    return (F.when(F.coalesce(n, F.lit("")) == "", "anonymous").when(n.startswith("[stack"), "stack").when(n.startswith("[heap"), "heap")
            .when(n.startswith("[anon_hugepage]") | n.contains("/dev/hugepages"), "hugepage")
            .when(n.contains("/var/run/dpdk"), "dpdk_shared_mem")
            .when(n.contains("librte_") | n.endswith(".so") | n.contains(".so."), "shared_lib").otherwise("executable"))


def crash_region(df: DataFrame, section: str = "s_mappings", address: str = "rip") -> DataFrame:
    """First mapping line of the same text whose [start, end) holds the address."""
    maps = F.transform(F.filter(F.transform(_lines(section), G.mapping_words), G.is_mapping), lambda w: F.struct(
        hex_to_number(w[0]).alias("a"), hex_to_number(w[1]).alias("b"), F.coalesce(F.get(w, F.lit(4)), F.lit("")).alias("name")))
    x = df.withColumns({"_m": maps, "_a": hex_to_number(address)})
    hit = F.try_element_at(F.filter("_m", lambda m: (F.col("_a") >= m["a"]) & (F.col("_a") < m["b"])), F.lit(1))
    x = x.withColumn("_h", hit)
    name = F.col("_h")["name"]
    return x.withColumns({"region": F.when(F.col("_h").isNotNull(), F.when(name == "", "anonymous").otherwise(name)),
                          "region_type": F.when(F.col("_h").isNotNull(), region_type(name))}).drop("_m", "_a", "_h")


def address_region(addresses: DataFrame, maps: DataFrame, addr: str = "addr") -> DataFrame:
    """Range join of addresses with mappings [start_addr, end_addr); the first mapping (smallest map_id) wins.

    A mapping lives on the level of its size (powers of two), where it touches at most two slots however long it is.
    An address is looked up once per level that occurs (at most 64). Only distinct addresses are looked up, so a hot
    address costs one probe; the join back is an ordinary equi-join.
    """
    lvl = "cast(ceil(log2(cast(greatest(end_addr - start_addr, 1) as double))) as int)"
    m = maps.where("end_addr > start_addr").selectExpr("map_id", "start_addr", "end_addr", "name", f"{lvl} as lvl")
    m = m.selectExpr("*", """explode(array_distinct(array(cast(floor(start_addr / pow(2, lvl)) as bigint),
        cast(floor((end_addr - 1) / pow(2, lvl)) as bigint)))) as slot""")
    levels = m.agg(F.collect_set("lvl").alias("lvls"))  # one row of at most 64 values
    probe = addresses.select(F.col(addr).alias("_a")).where("_a is not null").distinct().join(F.broadcast(levels), F.lit(True)).select("_a", F.explode("lvls").alias("lvl"))
    probe = probe.selectExpr("_a", "lvl", "cast(floor(_a / pow(2, lvl)) as bigint) as slot")
    hit = probe.join(m, ["lvl", "slot"]).where("_a >= start_addr and _a < end_addr").groupBy("_a").agg(
        F.min_by("name", "map_id").alias("_n"))
    out = addresses.join(hit, addresses[addr] == hit["_a"], "left")
    return out.withColumns({
        "region": F.when(F.col("_a").isNotNull(), F.when(F.col("_n") == "", "anonymous").otherwise(F.col("_n"))),
        "region_type": F.when(F.col("_a").isNotNull(), region_type("_n"))}).drop("_a", "_n")


def stack_words(section) -> Column:
    """Hex words of a memory dump without the first, which is the address itself."""
    return G.rest(F.regexp_extract_all(col(section), F.lit(r"0x[0-9a-f]+"), 0))


def lib_status(df: DataFrame, section: str = "s_shared") -> DataFrame:
    libs = F.array(*[F.lit(x) for x in fixed.REQUIRED_LIBS])
    text = F.col(section)
    return df.withColumns({"found_libs": F.filter(libs, lambda x: text.contains(x)),
                           "missing_libs": F.filter(libs, lambda x: ~text.contains(x))})


def subsystems(text) -> Column:
    return F.array_compact(F.array(*[F.when(col(text).rlike(p), F.lit(n)) for n, p in fixed.SUBSYSTEMS.items()]))


def crash_type(signal="signal_name", fault="fault_addr", rdi="rdi", rip="rip") -> Column:
    """Crash class: segmentation faults by faulting address, then registers; other signals by table, else their name."""
    s = col(signal)
    near = once(hex_to_number(fault), lambda a: F.when(a == 0, "null_ptr_deref").when(a < fixed.NEAR_NULL, "near_null_deref"))
    other = F.when(col(rdi) == "0x0", "null_pointer_deref").when(col(rip) == "0x0", "null_function_call").otherwise("invalid_memory_access")
    segv = F.coalesce(near, other)
    out = F.when(F.coalesce(s, F.lit("")) == "", "unknown").when(s == "SIGSEGV", segv)
    for k, v in fixed.CRASH_BY_SIGNAL.items():
        out = out.when(s == k, v)
    return out.otherwise(s)


def parsed(df: DataFrame) -> DataFrame:
    """All single-row fields of a debugger text in one projection chain."""
    x = with_registers(crash_frame(signal_info(with_sections(df))))
    x = lib_status(crash_region(fault_address(with_threads(x))))
    return x.withColumn("crash_type", crash_type())


def parse_warnings(df: DataFrame) -> DataFrame:
    """Data-quality texts of a parsed dump, plus the flag of a truncated backtrace without source."""
    regs = F.coalesce(*[F.col(r) for r in fixed.KEY_REGISTERS])
    x = with_frames(df, "s_bt_full", "_f").withColumn("_n", F.size("_f")).drop("_f")
    texts = [
        F.when(F.col("signal_name").isNull(), "signal section missing or unparseable"),
        F.when(regs.isNull(), "registers section missing"), F.when(F.col("_n") == 0, "backtrace is empty"),
        F.when(F.col("_n").between(1, 2), F.concat(F.lit("backtrace only has "), F.col("_n").cast("string"), F.lit(" frame(s), may be truncated"))),
        F.when(F.size("threads") == 0, "no threads parsed from info_threads section"),
        F.when(F.col("crash_func").isNull(), "crash frame (#0) not found in bt_full section"),
        F.when(F.size("missing_libs") > 0, F.concat(F.lit("DPDK shared libs missing: "), F.array_join("missing_libs", ", "))),
    ]
    return x.withColumns({"warnings": F.array_compact(F.array(*texts)),
                          "truncated": F.col("_n").between(1, 2) & ~F.coalesce("has_debuginfo", F.lit(False))}).drop("_n")


def frame_parse(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Frame text (with its ``#n``) to number, function, address and source; frames without a usable name are dropped.

    The parsed row goes through a generator of one element, below which no filter is pushed, so each line is read once.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("idx", "func", "address", "source")]
    x = df.select(*own, F.explode_outer(F.array(G.parsed_frame(col(frame)))).alias("_f"))
    ok = F.col("_f.idx").isNotNull() & ~F.col("_f.func").isin(*fixed.INVALID_FUNCS)
    return x.where(ok).select(*own, "_f.idx", "_f.func", "_f.address", "_f.source")


# ---- stack tool ------------------------------------------------------------------------------------------------

_TOOL_FRAME = r"^#(\d+)\s+(0x[0-9a-fA-F]+)[ \t]*(.*)"


def stack_tool_frames(df: DataFrame, text: str = "stack_text", keep=("dump_id",)) -> DataFrame:
    """The second text format to the same frames: thread blocks, frame lines, source line below a frame.

    Frames of one thread that repeat an address are inlined copies and only the first stays.
    """
    blocks = F.filter(F.split(text, r"(?m)^(?=TID\s+\d+:)"), lambda b: b.rlike(r"^TID\s+\d+:"))
    x = rows_of(df, keep, blocks, "b").select(
        *keep, F.regexp_extract("b", r"^TID\s+(\d+):", 1).alias("tid"),
        F.filter(F.split("b", r"(?m)^(?=#\d+\s)"), lambda c: c.rlike(_TOOL_FRAME)).alias("c"))

    def one(c: Column) -> Column:
        rest = F.trim(F.regexp_extract(c, _TOOL_FRAME, 3))
        func = F.when(rest.startswith("- "), "").when(rest.contains(" - "), F.trim(F.regexp_extract(rest, r"^(.*) - ", 1))).otherwise(rest)
        func = F.when(func.isin("", "??", "unknown"), "??").otherwise(func)
        module = F.when(rest.startswith("- "), F.trim(F.substr(rest, F.lit(3)))).otherwise(F.trim(F.regexp_extract(rest, r" - ([^\n]*?)$", 1)))
        src = r"(?m)^[ \t]{4,}(\S+):(\d+)(?::\d+)?"
        source = F.when(F.regexp_extract(c, src, 1) != "", F.concat(F.regexp_extract(c, src, 1), F.lit(":"), F.regexp_extract(c, src, 2)))
        return F.struct(F.regexp_extract(c, _TOOL_FRAME, 1).try_cast("bigint").alias("no"), F.regexp_extract(c, _TOOL_FRAME, 2).alias("address"),
                        func.alias("func"), module.alias("module"), source.alias("source"))

    x = x.select(*keep, "tid", F.transform("c", one).alias("f"))
    first = F.filter("f", lambda r, i: ~F.exists(F.slice(F.col("f"), F.lit(1), i), lambda q: q["address"] == r["address"]))
    x = rows_of(x, [*keep, "tid"], first, "r", "pos")
    return x.select(*keep, "tid", "pos", F.col("r.no").alias("frame_no"), "r.address", "r.func", F.nullif("r.module", F.lit("")).alias("module"), "r.source")


def merge_crash_sources(debugger: DataFrame, notes: DataFrame, files: DataFrame) -> DataFrame:
    """Debugger row, core notes and core file name of a dump side by side.

    Signal: file name, then notes, then debugger. Registers and fault address of the notes replace the debugger's.
    """
    d = debugger.selectExpr("dump_id", "signal_name as d_signal", "crash_type as d_type", "rip as d_rip", "rdi as d_rdi", "fault_addr as d_fault")
    n = notes.selectExpr("dump_id", "signal as n_no", "rip as n_rip", "rdi as n_rdi", "fault_addr as n_fault", "true as has_notes")
    f = files.selectExpr("dump_id", "nullif(signal_name, 'UNKNOWN') as f_signal")
    j = d.join(n, "dump_id", "full").join(f, "dump_id", "full")
    note_sig = F.when(F.col("n_no").isNotNull(), F.coalesce(signal_name(F.col("n_no")), F.concat(F.lit("SIG_"), F.col("n_no").cast("string"))))
    x = j.withColumns({"signal_name": F.coalesce("f_signal", note_sig, "d_signal"),
                       "rip": F.coalesce("n_rip", "d_rip"), "rdi": F.coalesce("n_rdi", "d_rdi"), "fault_addr": F.coalesce("n_fault", "d_fault")})
    fast = crash_type("signal_name", "n_fault", "n_rdi", "n_rip")
    return x.select("dump_id", "signal_name", "rip", "rdi", "fault_addr",
                    F.when(F.coalesce("has_notes", F.lit(False)), fast).otherwise(F.coalesce("d_type", F.lit("unknown"))).alias("crash_type"))


def symbol_quality(df: DataFrame, stderr: str = "stderr", code: str = "returncode", rules=fixed.SYMBOL_RULES) -> DataFrame:
    """Rules on the debugger's messages: invalid if a fatal one holds, degraded for any other or a bad exit code."""
    x = df.withColumn("_e", G.strip(F.lower(F.coalesce(stderr, F.lit("")))))
    hits = []
    for _, key, sev, parts, pattern in rules:
        test = F.lit(True)
        for p in parts:
            test = test & F.col("_e").contains(p)
        if pattern:
            test = test & F.col("_e").rlike(pattern)
        hits.append(F.when(test, F.struct(F.lit(key).alias("key"), F.lit(sev).alias("severity"))))
    x = x.withColumn("_h", F.array_compact(F.array(*hits)))
    keys = F.array_distinct(F.transform("_h", lambda h: h["key"]))
    rc = F.col(code)
    return x.withColumns({
        "quality": F.when(F.exists("_h", lambda h: h["severity"] == "fatal"), "invalid").when(F.size("_h") > 0, "degraded")
        .when(rc.isNull(), "unknown").when(rc != 0, "degraded").otherwise("valid"),
        "quality_notes": F.when(F.size("_h") > 0, keys).when(rc.isNull(), F.array(F.lit("gdb_returncode_unknown")))
        .when(rc != 0, F.array(F.concat(F.lit("gdb_returncode_"), rc.cast("string")))).otherwise(F.array().cast("array<string>")),
    }).drop("_e", "_h")


# ---- start-up log and devices ------------------------------------------------------------------------------------

def app_log_fields(df: DataFrame, text: str = "app_log", head: int | None = None) -> DataFrame:
    """First match of each start-up field, linkage flag, probed devices and driver error in the log, or its first ``head`` lines."""
    x = df.withColumn("_t", F.array_join(F.slice(_lines(text), 1, head) if head else _lines(text), "\n"))
    cols = {n: F.trim(regex_or_null("_t", p, 1)) for n, p in fixed.APP_LOG_FIELDS.items()}
    failed = F.filter(_lines("_t"), lambda s: s.contains("Failed to init PCI device"))
    named = F.try_element_at(F.filter(failed, lambda s: G.word(s).endswith("():")), F.lit(1))
    src, msg = (F.coalesce(c, F.lit("")) for c in (F.regexp_replace(G.word(named), r"\(\):$", ""), G.word(named, 1, 2)))
    loose = F.coalesce(F.trim(F.try_element_at(failed, F.lit(1))), F.lit(""))
    probed = F.filter(_lines("_t"), lambda s: s.contains("Probe PCI driver:") & s.contains("device:"))
    pick = lambda c: F.when(c != "", c)
    return x.withColumns({
        **cols, "shared_linkage": F.col("_t").rlike(r"EAL:\s*Detected shared linkage of DPDK"),
        "probe_drivers": F.transform(probed, lambda s: G.word(G.after(s, "driver:"))),
        "probe_devices": F.transform(probed, lambda s: G.word(G.after(s, "device:"))),
        "driver_error_source": pick(src), "driver_error_message": pick(F.trim(msg)),
        "driver_init_error": F.when(src != "", F.concat(src, F.lit("(): "), F.trim(msg))).otherwise(pick(loose)),
    }).drop("_t")


def log_tail_fatal(df: DataFrame, text: str = "app_log", tail: int | None = None) -> DataFrame:
    """First fatal line of the log, or of its last ``tail`` lines."""
    lines = _lines(text)
    last = F.slice(lines, F.greatest(F.size(lines) - tail + 1, F.lit(1)), F.lit(tail)) if tail else lines
    hit = F.filter(last, lambda x: x.rlike(r"^Segmentation fault(?:\s*\(core dumped\))?\s*$"))
    return df.withColumns({"tail_lines": F.size(last), "fatal_signal": F.trim(F.try_element_at(hit, F.lit(1)))})


def with_nics(df: DataFrame, text: str = "nic_text", out: str = "nics") -> DataFrame:
    """Add the device lines with the section they stand under, as array<struct>."""
    def section(x: Column) -> Column:
        for part, name in fixed.NIC_SECTIONS:
            out = F.when(x.contains(part), name) if part == fixed.NIC_SECTIONS[0][0] else out.when(x.contains(part), name)
        return out

    x = df.withColumn("_lines", F.transform(_lines(text), lambda s: F.trim(s)))
    x = x.withColumn("_heads", F.transform("_lines", lambda s: section(F.lower(s))))
    kv = lambda r, k: F.regexp_extract(r, rf"{k}=(\S+)", 1)

    def one(s: Column, i: Column) -> Column:
        current = F.try_element_at(F.filter(F.slice("_heads", F.lit(1), i + 1), lambda h: h.isNotNull()), F.lit(-1))
        parts = F.split(s, "'", 3)
        pci, rest = F.trim(parts[0]), F.get(parts, F.lit(2))
        device = F.get("_heads", i).isNull() & current.isNotNull() & (F.size(parts) == 3) & (F.size(F.split(pci, "[:.]")) == 4)
        return F.when(device, F.struct(
            current.alias("section"), pci.alias("pci"), parts[1].alias("desc"),
            kv(rest, "if").alias("iface"), kv(rest, "drv").alias("drv"), kv(rest, "unused").alias("unused"),
            rest.contains("*Active*").alias("active")))

    return x.withColumn(out, F.array_compact(F.transform("_lines", one))).drop("_lines", "_heads")


def nic_table(df: DataFrame, text: str = "nic_text", keep=("log_id",)) -> DataFrame:
    x = rows_of(with_nics(df.select(*keep, text), text, "_n"), keep, "_n", "n")
    return x.select(*keep, "n.section", "n.pci", "n.desc", "n.iface", "n.drv", "n.unused", "n.active")


def device_issues(df: DataFrame, keep=("log_id",)) -> DataFrame:
    """Probed network devices that sit on a kernel driver."""
    x = with_nics(df.select(*keep, "nic_text", "probe_devices"), "nic_text", "_n")
    bad = F.filter("_n", lambda d: (d["section"] == "network") & (d["drv"] != "") & ~d["drv"].isin(*fixed.USERSPACE_DRIVERS)
                   & F.array_contains(F.col("probe_devices"), d["pci"]))
    return rows_of(x, keep, bad, "d").select(*keep, F.col("d.pci").alias("slot"), F.col("d.drv").alias("driver"))


def device_binding(devices: DataFrame, classes: DataFrame, userspace=fixed.USERSPACE_DRIVERS) -> DataFrame:
    """Device inventory × class table → category and binding state, with the alert text for network devices.

    classes: category, class2, vendor, device; a NULL vendor or device matches any. Join key is the class prefix.
    """
    d = devices.withColumn("class2", F.substring("class_code", 1, 2))
    c = classes.withColumnsRenamed({"vendor": "c_vendor", "device": "c_device"})
    j = d.join(small_side(c), "class2").where("(c_vendor is null or c_vendor = vendor) and (c_device is null or c_device = device)")
    state = (F.when(F.coalesce("driver", F.lit("")) == "", "no_driver").when(F.col("driver").isin(*userspace), "dpdk_bound").otherwise("kernel_bound"))
    out = j.select("category", "slot", "driver", state.alias("binding")).distinct()
    net = F.col("category") == "network"
    text = fixed.BINDING_ALERTS
    return out.withColumn("alert", F.when(net & (F.col("binding") == "kernel_bound"), text["kernel_bound"])
                          .when(net & (F.col("binding") == "no_driver"), text["no_driver"]))


def hugepage_usage(df: DataFrame, total: str = "total", free: str = "free", size_kb: str = "size_kb") -> DataFrame:
    """Used/total text with a warning below 10 % free, and the total in MB."""
    x = df.withColumns({"_t": col(total).try_cast("bigint"), "_f": col(free).try_cast("bigint")})
    note = F.when((F.col("_t") != 0) & (F.col("_f") < F.col("_t") * 0.1), fixed.HUGEPAGE_NOTES["low"]).otherwise(fixed.HUGEPAGE_NOTES["enough"])
    text = F.concat(F.lit("2M hugepages: "), (F.col("_t") - F.col("_f")).cast("string"), F.lit("/"), F.col("_t").cast("string"), F.lit(" used"), note)
    return x.withColumns({"usage": F.coalesce(text, F.lit(fixed.UNKNOWN)), "total_mb": F.col("_t") * F.col(size_kb) / 1024.0}).drop("_t", "_f")


def cpu_layout(cpus: DataFrame, host: str = "host") -> DataFrame:
    """(host, socket, core) → its CPUs in order; a core has only a few hardware threads."""
    return cpus.groupBy(host, "socket", "core").agg(F.array_sort(F.collect_list("cpu")).alias("cpus"))
