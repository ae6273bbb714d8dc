import pytest
from pyspark.sql import functions as F

from fleetscope.operators import crash_graph as G
from fleetscope.operators import crash_text as C

TYPES = [
    (("SIGSEGV", "0x0", "0x5", "0x1"), "null_ptr_deref"), (("SIGSEGV", "0xfff", "0x5", "0x1"), "near_null_deref"),
    (("SIGSEGV", "0x1000", "0x0", "0x1"), "null_pointer_deref"), (("SIGSEGV", None, "0x5", "0x0"), "null_function_call"),
    (("SIGSEGV", None, "0x5", "0x1"), "invalid_memory_access"), (("SIGSEGV", "0xffffffffffffffff", "0x5", "0x1"), "invalid_memory_access"),
    (("SIGBUS", None, None, None), "bus_error_alignment"), (("SIGTERM", None, None, None), "terminated"),
    (("SIG_99", None, None, None), "SIG_99"), ((None, None, None, None), "unknown"),
]


def test_crash_types(spark):
    df = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(TYPES)], "i int, signal_name string, fault_addr string, rdi string, rip string")
    got = {r.i: r.x for r in df.select("i", C.crash_type().alias("x")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(TYPES)}


@pytest.mark.parametrize("name,layer", [
    ("??", "noise"), ("", "noise"), ("__libc_start_main", "noise"), ("__libc_foo", "libc"), ("clone3", "libc"), ("mlx5_rx", "dpdk_pmd"),
    ("rte_eal_init", "dpdk_eal"), ("rte_panic", "dpdk_eal"), ("mp_handle", "dpdk_eal"), ("rte_ring_x", "dpdk_lib"), ("main", "user_app")])
def test_layers(spark, name, layer):
    assert spark.createDataFrame([(name,)], "f string").select(G.frame_layer("f")).first()[0] == layer


@pytest.mark.parametrize("value,note", [
    ("0xde00000000000001", "释放后填充 (poisoned)"), ("0xcdcdcdcd", "未初始化堆内存"), ("0x12cdcdcdcd", "未初始化堆内存"),
    ("0xcdcdcd01", None), ("0xfe", None), ("0x1234", None)])
def test_poison(spark, value, note):
    assert spark.createDataFrame([(value,)], "v string").select(G.poison_note("v")).first()[0] == note


def frames(spark, rows):
    return spark.createDataFrame(rows, "dump_id bigint, tid bigint, gdb_idx bigint, func string, address string")


def test_order_edges_and_cycles(spark):
    names = ["crash", "b", "a", "a", "b", "a", "??", "main"]  # innermost first
    c = G.exec_order(frames(spark, [(1, 0, i, n, f"0x{i}") for i, n in enumerate(names)]))
    got = [(r.exec_depth, r.func, r.caller) for r in c.orderBy("exec_depth").collect()]
    assert got == [(0, "main", None), (1, "a", "main"), (2, "b", "a"), (3, "a", "b"), (5, "b", "a"), (6, "crash", "b")]
    assert {(r.caller, r.callee, r.exec_depth) for r in G.reciprocal_edges(c).collect()} == {("b", "a", 3), ("a", "b", 5)}
    assert G.crash_signature(c).first().signature == "crash < b < a < b < a < main"
    assert G.crash_signature(c, 2).first().signature == "crash < b"


def test_deep_stack_and_summary(spark):
    n = 9000
    c = G.exec_order(frames(spark, [(1, 0, i, f"f{n - i}", None) for i in range(n)]))
    s = G.path_summary(c).first()
    assert s.n == n and s.path.startswith("f1 → f2 → f3  …  ") and s.path.endswith(f"f{n}") and s.note == f"(full depth: {n}, {n - 8} frames omitted)"
    run = G.layered_path(c).collect()
    assert [(r.layer, r.frames, r.path) for r in run] == [("user_app", n, f"f1 → f2 → … → f{n}")]


def test_distinct_stacks(spark):
    rows = [(1, t, i, n, None) for t, st in {0: "abc", 1: "abc", 2: "abd", 3: "ab"}.items() for i, n in enumerate(reversed(st))]
    got = {r.tid: r.same_as_main for r in G.distinct_stacks(G.exec_order(frames(spark, rows))).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}


def test_patterns(spark):
    stacks = {1: ["rte_pktmbuf_alloc", "main"], 2: ["x", "main"], 3: ["rte_ring_enqueue", "main"], 4: ["mlx5_rx", "main"], 5: ["y", "main"],
              6: ["rte_panic", "main"], 7: ["z", "main"]}
    c = G.exec_order(frames(spark, [(d, 0, i, f, None) for d, fs in stacks.items() for i, f in enumerate(fs)]))
    meta = spark.createDataFrame([(1, "SIGFPE", "x", None), (2, "SIGSEGV", "x", "0x10"), (3, "SIGABRT", "x", None), (4, "SIGFPE", "x", None),
                                  (5, "11", None, "0x999999"), (6, "6", "x", None), (7, "SIGFPE", "x", "0x0")],
                                 "dump_id bigint, signal_name string, region string, fault_addr string")
    got = {r.dump_id: r.pattern for r in G.crash_pattern(c, meta).collect()}
    assert got == {1: "mempool_exhaustion", 2: "mempool_exhaustion_null_deref", 3: "ring_assert_failure", 4: "pmd_driver_crash",
                   5: "null_ptr_in_anonymous_region", 6: "eal_panic_abort", 7: None}


def test_address_region_nested_and_huge_mappings(spark):
    maps = [(1, 0, 2**40, "[heap]"), (2, 100, 200, ""), (3, 2**41, 2**41 + 1, "/lib/librte_x.so.1"), (4, 5, 5, "empty")]
    m = spark.createDataFrame(maps, "map_id bigint, start_addr bigint, end_addr bigint, name string")
    addrs = [0, 99, 100, 199, 200, 2**40 - 1, 2**40, 2**41, 2**41 + 1]
    a = spark.createDataFrame([(x,) for x in addrs], "addr bigint")
    want = {x: next((n or "anonymous" for i, s, e, n in maps if s <= x < e), None) for x in addrs}
    assert {r.addr: r.region for r in C.address_region(a, m).collect()} == want


def test_thread_blocks_and_tool_lines(spark):
    bt = "Thread 2 (Thread 0x1 (LWP 5)):\n#0 0x1 in epoll_wait ()\nThread 1 (Thread 0x2 (LWP 4)):\n#0 0x1 in a ()\n  n = 1\n#0 again ()\n#1 0x2 in b ()"
    df = spark.createDataFrame([(1, bt)], "dump_id int, s_thread_bt string")
    assert [(r.tid, r.frame_no, r.frame) for r in C.thread_backtraces(df).collect()] == [("1", 0, "0x1 in a ()"), ("1", 1, "0x2 in b ()")]
    st = "PID 9\nTID 7:\n#0  0xa f - /m\n    s.c:3:1\n    t.c:9\n#1  0xa g\n#2  0xb - /m"
    got = C.stack_tool_frames(spark.createDataFrame([(1, st)], "dump_id int, stack_text string")).collect()
    assert [(r.frame_no, r.func, r.source) for r in got] == [(0, "f", "s.c:3:1"), (2, "??", None)]


def test_symbol_quality_levels(spark):
    rows = [("", 0, "valid"), ("", None, "unknown"), ("", 3, "degraded"), ("No debugging symbols found", 0, "degraded"), ("ELF class mismatch", 0, "invalid")]
    df = spark.createDataFrame([(i, e, r) for i, (e, r, _) in enumerate(rows)], "i int, stderr string, returncode int")
    assert {r.i: r.quality for r in C.symbol_quality(df).collect()} == {i: w for i, (_, _, w) in enumerate(rows)}


def test_log_head_and_tail(spark):
    text = "\n".join(["x"] * 600 + ["EAL: Detected CPU lcores: 4"] + ["Segmentation fault"] + ["y"] * 199)
    df = spark.createDataFrame([(1, text)], "log_id int, app_log string")
    assert C.app_log_fields(df, head=500).first().detected_lcores is None
    assert C.app_log_fields(df).first().detected_lcores == "4"
    r = C.log_tail_fatal(df, tail=200).first()
    assert (r.tail_lines, r.fatal_signal) == (200, "Segmentation fault")
    assert C.log_tail_fatal(df, tail=199).first().fatal_signal is None
    assert C.log_tail_fatal(df.withColumn("app_log", F.lit("a"))).first().tail_lines == 1
