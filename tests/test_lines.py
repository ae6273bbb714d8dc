"""Readers of debugger, log, device and page text, one case per variant of the line layouts."""

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import gdb_lines as G
from fleetscope.operators import crash_text as C
from fleetscope.sources.documents import decode_entities, html_to_text, parse_files, plain_text

FRAMES = [
    ("#0  0x00007f in rte_pktmbuf_alloc (mp=0x0) at mbuf.c:12", 0, "rte_pktmbuf_alloc", "0x00007f", "mbuf.c:12"),
    ("#1 main () at /src/app main.c:7", 1, "main", None, "/src/app main.c:7"),
    ("#12  worker<int, std::pair<a, b>> (x=1) from /opt/lib/libworker.so", 12, "worker", None, None),
    ("  #3  0x1 in ns::call<T>::run(int) ()", 3, "ns::call::run", "0x1", None),
    ("#4  0x55 in poll (a=1) at x.c:oops", 4, "poll", "0x55", None),
]
DROPPED = ["#2  ?? ()", "#x main ()", "main () at a.c:1", "#7", ""]


def test_frames(spark):
    df = spark.createDataFrame([(t,) for t, *_ in FRAMES] + [(t,) for t in DROPPED], "frame string")
    got = sorted((r.frame, r.idx, r.func, r.address, r.source) for r in C.frame_parse(df).collect())
    assert got == sorted(FRAMES)


@pytest.mark.parametrize(("name", "want"), [("f<int>(a)", "f"), ("0x12 in g (x)", "g"), ("a<b<c>>::d", "a::d"), ("", "unknown"), ("<x>", "unknown"), (" h ", "h")])
def test_bare_name(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(G.bare_name(F.col("n")).alias("x")).first().x == want


def test_crash_frame_and_signal(spark):
    text = ("Program received signal SIGSEGV, Segmentation fault.\n=== BT_FULL_BEGIN ===\n#0  0x1 in f (a=2) at d/x.c:9\n#1  main ()\n=== BT_FULL_END ===\n"
            "=== SIGINFO_BEGIN ===\n$1 = (void *) 0xdead\n=== SIGINFO_END ===\n=== REGISTERS_BEGIN ===\nrip 0x5 0x5 <f+1>\nrip 0x6\neflags [ ZF ]\n=== REGISTERS_END ===\n"
            "=== INFO_THREADS_BEGIN ===\n* 1    Thread 0x7f01 (LWP 100) \"app\" f (a=2)\n  2    Thread 0x7f02 (LWP 101) epoll_wait ()\n  Id Target Frame\n=== INFO_THREADS_END ===\n"
            "=== MAPPINGS_BEGIN ===\nStart End Size Offset objfile\n0x0 0x5 0x5 0x0 /bin/a\n0x5 0x9 0x4 0x0\n=== MAPPINGS_END ===")
    r = C.parsed(spark.createDataFrame([(1, text), (2, "")], "dump_id long, gdb_text string")).orderBy("dump_id").collect()
    a, b = r
    assert (a.signal_name, a.signal_desc, a.crash_func, a.crash_file, a.crash_line, a.has_debuginfo) == ("SIGSEGV", "Segmentation fault.", "f (a=2)", "d/x.c", "9", True)
    assert (a.fault_addr, a.rip, a.region, [(t.crashed, t.id, t.lwp, t.bt_top) for t in a.threads]) == (
        "0xdead", "0x6", "anonymous", [(True, "1", "100", '"app" f (a=2)'), (False, "2", "101", "epoll_wait ()")])
    assert (b.signal_name, b.crash_func, b.fault_addr, b.rip, b.region, b.threads) == (None, None, None, None, None, [])


def test_whole_texts_are_read(spark):
    log = "\n".join(["noise"] * 900 + ["ice_dev_init(): Failed to init PCI device", "Segmentation fault"] + ["tail"] * 400)
    df = spark.createDataFrame([(1, log)], "log_id long, app_log string")
    assert C.app_log_fields(df).first().driver_error_source == "ice_dev_init"
    assert C.app_log_fields(df, head=500).first().driver_error_source is None
    assert C.log_tail_fatal(df).first().fatal_signal == "Segmentation fault" and C.log_tail_fatal(df, tail=200).first().fatal_signal is None
    bt = "\n".join(f"#{i} f{i} ()" for i in range(40))
    assert C.backtrace_frames(spark.createDataFrame([(1, bt)], "dump_id long, s_bt_full string")).count() == 40


def test_html(spark):
    page = "<p title=\"a > b\">x &eacute; &#233;&#xE9; &amp;lt; &nosuch; & y</p><script>s = '</style>'; t()</script><style>p{}</style>z"
    row = spark.createDataFrame([(page, "a &hearts b; c")], "h string, e string").select(html_to_text("h").alias("t"), decode_entities(F.col("e")).alias("e")).first()
    assert (row.t, row.e) == ("x é éé &lt; &nosuch; & y\n\nz", "a &hearts b; c")


def test_bytes_and_readers(spark):
    df = spark.createDataFrame([("/d.x/a.TXT", b"ok \xff\xef\xbf\xbd"), ("/b.pdf", b""), ("/noext", b"x")], "path string, content binary")
    out = {r.source_key: (r.text, r.error) for r in parse_files(df).collect()}
    assert out["/d.x/a.TXT"] == ("ok �", None) and out["/b.pdf"] == (None, "no parser for .pdf")
    assert parse_files(df, {"pdf": plain_text}).where("error is null").count() == 1
