"""Operator inputs derived from the given tables, once for Spark and once as SQL text.

One record second is one hour of ``events`` time (column ``t``), so a 10 s window is 10 hours of events.
An instance (``pid``) is a run of 15 users and a client a run of 30, so the number of instances grows with
the data and each keeps about the same density. Every event takes part in every view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions.blocked import running_totals
from fleetscope.plans.registry import cte
from fleetscope.session import scratch_dir

PORTS = (0, 1)
PORT_COUNTERS = {
    "ip": "v", "ib": "v * (64 + k)", "op": "v - v % 7", "ob": "(v - v % 7) * (64 + k)", "ie": "e",
    "oe": "CASE WHEN k % 10 < 3 THEN e ELSE 0 END", "nb": "CASE WHEN k % 20 < 2 THEN e ELSE 0 END",
    "q0": "CASE WHEN k % 4 = 0 THEN v ELSE 0 END", "q1": "CASE WHEN k % 4 = 1 THEN v ELSE 0 END",
    "q2": "CASE WHEN k % 4 = 2 THEN v ELSE 0 END", "q3": "CASE WHEN k % 4 = 3 THEN v ELSE 0 END",
}
X_COUNTERS = {
    "x_good": "v", "x_missed": "CASE WHEN k < 20 THEN e ELSE 0 END", "x_rxerr": "e",
    "x_txerr": "CASE WHEN k < 30 THEN e ELSE 0 END", "x_mbuf": "CASE WHEN k < 5 THEN e ELSE 0 END",
    "x_multi": "v % 11", "x_bcast": "v % 5", "x_under": "v % 3",
}
# port 0 carries the events with k < 60, port 1 the others
PORT_TEST = {0: "k < 60", 1: "k >= 60"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored_path(spark: SparkSession, sf: str, name: str) -> str:
    """Folder of a derived table that was built before in this application."""
    return _STORED[(spark.sparkContext.applicationId, sf, name)]


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Derived record tables are written once per application and then scanned like the collector's own tables.

    They go to the shared folder of ``spark.checkpoint.dir``, so a lost executor costs a re-read and not a re-derivation.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = scratch_dir(spark, name) + "/t"
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


E_COLS = """event_id, user_id, event_type, value, ts, props,
  CAST(floor(user_id / 15.0) AS BIGINT) AS pid,
  concat('c', CAST(CAST(floor(user_id / 30.0) AS BIGINT) AS {STR})) AS client_id,
  CAST(floor({EPOCH} / 3600.0) AS BIGINT) AS t,
  CAST(floor(value * 100) AS BIGINT) AS v,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS e"""


def _exprs(text: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, cur, quote = [], 0, "", False
    for ch in text:
        if ch == "'":
            quote = not quote
        if not quote:
            depth += ch == "("
            depth -= ch == ")"
            if ch == "," and depth == 0:
                out.append(cur.strip())
                cur = ""
                continue
        cur += ch
    return [*out, cur.strip()]


def events(spark: SparkSession, sf: str) -> DataFrame:
    text = E_COLS.replace("{EPOCH}", "unix_seconds(CAST(ts AS TIMESTAMP))").replace("{STR}", "STRING")
    return table(spark, sf, "events").selectExpr(*_exprs(text))


cte("fx_e", "SELECT " + E_COLS.replace("{EPOCH}", "epoch(ts)").replace("{STR}", "VARCHAR") + " FROM events")


def _port_sums() -> dict[str, str]:
    return {
        f"p{p}_{n}": f"CASE WHEN {PORT_TEST[p]} THEN {x} ELSE 0 END"
        for p in PORTS for n, x in PORT_COUNTERS.items()
    }


# ---- raw records -----------------------------------------------------------------------------------------

RAW_TYPES = ("1s", "5s", "heartbeat")


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every event reported in each record type; several records can share a second."""
    e = events(spark, sf)
    return e.select(
        "client_id", "pid", F.explode(F.array(*[F.lit(x) for x in RAW_TYPES])).alias("type"),
        "t", F.col("event_id").alias("seq"), "v",
    )


cte("fx_raw", "SELECT client_id, pid, unnest(['1s','5s','heartbeat']) AS type, t, event_id AS seq, v FROM fx_e")


# ---- one-second records -----------------------------------------------------------------------------------

def flat_1s(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative counters, one row per (client, pid, second): the last report of the second wins.

    Events are first summed per second (partial aggregation before the shuffle); only those sums are then
    turned into running totals.
    """
    return stored(spark, sf, "records_1s", lambda: _derive_1s(spark, sf))


def _derive_1s(spark: SparkSession, sf: str) -> DataFrame:
    sums = _port_sums()
    cells = events(spark, sf).groupBy("client_id", "pid", "t").agg(
        *[F.expr(f"sum({x}) as {c}") for c, x in sums.items()],
        F.expr("max(event_id) as seq"), F.expr("max_by(v, event_id) as _v"), F.expr("max_by(k, event_id) as _k"),
    )
    run = running_totals(cells, ["client_id", "pid"], "t", list(sums), span=720)
    return run.selectExpr(
        "client_id", "pid", "t", "seq", *sums, "8192L as mp_size",
        "cast(8192 - (_v * 3) % 8192 as bigint) as mp_common", "_k as mp_cache",
    )


cte("fx_1s", "SELECT client_id, pid, t, event_id AS seq, " + ", ".join(_port_sums())
    + ", CAST(8192 AS BIGINT) AS mp_size, CAST(8192 - (v * 3) % 8192 AS BIGINT) AS mp_common, k AS mp_cache FROM ("
    + "SELECT client_id, pid, t, event_id, v, k, "
    + ", ".join(f"CAST(SUM({x}) OVER w AS BIGINT) AS {c}" for c, x in _port_sums().items())
    + ", ROW_NUMBER() OVER (PARTITION BY client_id, pid, t ORDER BY event_id DESC) AS rn FROM fx_e"
    + " WINDOW w AS (PARTITION BY client_id, pid ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c WHERE rn = 1")

cte("fx_ports", " UNION ALL ".join(
    f"SELECT client_id, pid, t, seq, '{p}' AS port, " + ", ".join(f"p{p}_{n} AS {n}" for n in PORT_COUNTERS)
    + " FROM fx_1s" for p in PORTS))


def records_1s(spark: SparkSession, sf: str) -> DataFrame:
    """The nested record: client_id, pid, t, type, is_alive, ethdev_stats, ethdev_link, mempool_stats."""
    return nest_1s(flat_1s(spark, sf))


def nest_1s(f: DataFrame) -> DataFrame:
    names = {"ipackets": "ip", "opackets": "op", "ibytes": "ib", "obytes": "ob", "ierrors": "ie", "oerrors": "oe", "rx_nombuf": "nb"}

    def port(p: int) -> str:
        cols = ", ".join(f"'{n}', p{p}_{c}" for n, c in names.items())
        return f"'{p}', named_struct({cols}, 'q_ipackets', array({', '.join(f'p{p}_q{i}' for i in range(4))}))"

    link = "named_struct('status', 'up', 'speed', 10000L, 'duplex', 'full-duplex')"
    return f.selectExpr(
        "client_id", "pid", "t", "seq", "'1s' as type", "true as is_alive",
        f"map({port(0)}, {port(1)}) as ethdev_stats", f"map('0', {link}, '1', {link}) as ethdev_link",
        """map('mbuf_pool', named_struct('name', 'mbuf_pool', 'size', mp_size, 'populated_size', mp_size, 'cache_size', 256L,
            'elt_size', 2176L, 'common_pool_count', mp_common, 'total_cache_count', mp_cache)) as mempool_stats""",
    )


# ---- five-second records ----------------------------------------------------------------------------------

_5S_EXTRA = """CAST(1000000 AS BIGINT) AS heap_size, CAST(1000000 - (v * 37) % 1000000 AS BIGINT) AS heap_free,
  CAST(floor(((1000000 - (v * 37) % 1000000) * (k + 1)) / 101.0) AS BIGINT) AS heap_greatest,
  concat(CAST(k AS {STR}), '.25%') AS lc0, concat(CAST((k * 7) % 100 AS {STR}), '.50%') AS lc1, '0.00%' AS lc2,
  CAST(k * 1000 AS BIGINT) AS busy0, CAST(((k * 7) % 100) * 1000 AS BIGINT) AS busy1, CAST(0 AS BIGINT) AS busy2,
  CAST(100000 AS BIGINT) AS total0, CAST(100000 AS BIGINT) AS total1, CAST(0 AS BIGINT) AS total2"""
_5S_NAMES = ("heap_size heap_free heap_greatest lc0 lc1 lc2 busy0 busy1 busy2 total0 total1 total2").split()


def flat_5s(spark: SparkSession, sf: str) -> DataFrame:
    """The slower cadence: the last report of every 5-second slot, over the same events."""
    return stored(spark, sf, "records_5s", lambda: _derive_5s(spark, sf))


def _derive_5s(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("t5", F.expr("CAST(floor(t / 5.0) * 5 AS BIGINT)"))
    cells = e.groupBy("client_id", "pid", F.col("t5").alias("t")).agg(
        *[F.expr(f"sum({x}) as {c}") for c, x in X_COUNTERS.items()],
        F.expr("max(event_id) as seq"), F.expr("max_by(v, event_id) as v"), F.expr("max_by(k, event_id) as k"),
    )
    run = running_totals(cells, ["client_id", "pid"], "t", list(X_COUNTERS), span=3600)
    return run.selectExpr("client_id", "pid", "t", "seq", *X_COUNTERS, *_exprs(_5S_EXTRA.replace("{STR}", "STRING")))


cte("fx_5s", "SELECT client_id, pid, t5 AS t, event_id AS seq, " + ", ".join(X_COUNTERS) + ", "
    + _5S_EXTRA.replace("{STR}", "VARCHAR") + " FROM (SELECT client_id, pid, t5, event_id, v, k, "
    + ", ".join(f"CAST(SUM({x}) OVER w AS BIGINT) AS {c}" for c, x in X_COUNTERS.items())
    + ", ROW_NUMBER() OVER (PARTITION BY client_id, pid, t5 ORDER BY event_id DESC) AS rn"
    + " FROM (SELECT *, CAST(floor(t / 5.0) * 5 AS BIGINT) AS t5 FROM fx_e) b"
    + " WINDOW w AS (PARTITION BY client_id, pid ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c WHERE rn = 1")


def records_5s(spark: SparkSession, sf: str) -> DataFrame:
    """The nested record: ethdev_xstats, lcore_usage (parallel arrays), heap_stats."""
    return nest_5s(flat_5s(spark, sf))


def nest_5s(f: DataFrame) -> DataFrame:
    xs = {"rx_good_packets": "x_good", "rx_missed_errors": "x_missed", "rx_errors": "x_rxerr", "tx_errors": "x_txerr",
          "rx_mbuf_allocation_errors": "x_mbuf", "rx_q0_multicast_packets": "x_multi",
          "rx_q0_broadcast_packets": "x_bcast", "rx_q0_undersize_packets": "x_under"}
    return f.selectExpr(
        "client_id", "pid", "t", "seq", "'5s' as type", "true as is_alive",
        "map('0', map(" + ", ".join(f"'{n}', {c}" for n, c in xs.items()) + ")) as ethdev_xstats",
        """map('0', named_struct('lcore_ids', array(1, 2, 3), 'total_cycles', array(total0, total1, total2),
            'busy_cycles', array(busy0, busy1, busy2), 'usage_ratio', array(lc0, lc1, lc2))) as lcore_usage""",
        """map('0', named_struct('Name', 'socket_0', 'Heap_size', heap_size, 'Free_size', heap_free, 'Alloc_size', heap_size - heap_free,
            'Greatest_free_size', heap_greatest, 'Alloc_count', 10L, 'Free_count', 4L)) as heap_stats""",
    )


# ---- views that need only a select list --------------------------------------------------------------------

_VIEWS: dict[str, tuple[str, str, str]] = {}


def _view(name: str, source: str, cols: str, where: str = "") -> None:
    _VIEWS[name] = (source, cols, where)
    duck = (cols.replace("{STR}", "VARCHAR").replace("{HEX(", "lower(to_hex(").replace(")HEX}", "))")
            .replace("{SECONDS}", "epoch(ts)"))
    cte(name, f"SELECT {duck} FROM {source}" + (f" WHERE {where}" if where else ""))


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, cols, where = _VIEWS[name]
    base = events(spark, sf) if source == "fx_e" else (
        view(spark, sf, source) if source in _VIEWS else table(spark, sf, source))
    if where:
        base = base.where(where)
    text = (cols.replace("{STR}", "STRING").replace("{HEX(", "lower(hex(").replace(")HEX}", "))")
            .replace("{SECONDS}", "unix_seconds(CAST(ts AS TIMESTAMP))").replace("\\", "\\\\"))
    return base.selectExpr(*_exprs(text))


_view("fx_hits", "fx_e", """event_id, client_id, pid, t, event_type AS rule_id,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
  CAST(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 6 ELSE 12 END AS BIGINT) AS cooldown,
  event_type = 'error' AND k < 30 AS escalate""")

_view("fx_alerts", "fx_e", """event_id AS alert_id, client_id, ts AS triggered_at,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
  concat('alert ', event_type) AS title, concat('value=', CAST(v AS {STR})) AS description,
  CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'success' END AS status""")

_view("fx_status", "fx_e", """user_id AS pid, event_id AS seq, t,
  CASE event_type WHEN 'error' THEN 'crashed' WHEN 'signup' THEN 'stop' ELSE 'running' END AS status""")

_view("fx_heartbeats", "fx_e", "user_id AS client_id, t, ts, event_id")

_view("fx_instances", "customer", """concat('c', CAST(CAST(floor(c_custkey / 30.0) AS BIGINT) AS {STR})) AS client_id,
  c_custkey AS pid, c_name AS exe_name,
  CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'stop' ELSE 'crashed' END AS status,
  c_custkey * 100 AS start_time, c_acctbal > 4000 AS registered,
  concat('/opt/bin/app', CAST(c_custkey % 100 AS {STR})) AS exe_path""")

_view("fx_core_files", "fx_e", """event_id, user_id, concat('core.app', CAST(k AS {STR}), '.', CAST(user_id AS {STR}), '.',
  CAST(user_id + 1 AS {STR}), '.', CASE k % 8 WHEN 0 THEN '4' WHEN 1 THEN '6' WHEN 2 THEN '7' WHEN 3 THEN '8' WHEN 4 THEN '11'
  WHEN 5 THEN '13' WHEN 6 THEN '15' ELSE '9' END, '.', CAST(t AS {STR}), '.!opt!bin!app', CAST(k AS {STR})) AS filename,
  CAST(v AS DOUBLE) / 100 AS process_time, CAST(k AS DOUBLE) / 10 AS analyse_time, t""")

_FUNCS = ("main", "__libc_start_main", "rte_pktmbuf_alloc", "rte_mempool_get", "rte_ring_enqueue", "mlx5_rx_burst",
          "rte_eal_init", "eal_thread_loop", "pthread_cond_wait", "process_packet", "rte_panic", "epoll_wait",
          "handle_flow", "rte_eth_tx_burst", "??", "clone3")
FUNC_CASE = "CASE k % 16 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FUNCS[:-1])) + f" ELSE '{_FUNCS[-1]}' END"

# A dump is 24 hours of one user; its threads are event_id % 3. Every event is one frame, the number of frames of
# a thread is whatever falls into the day.
_FRAME_COLS = f"""dump_id, tid, CAST(rn - 1 AS BIGINT) AS gdb_idx, {FUNC_CASE} AS func,
  concat('0x', {{HEX(4198400 + event_id * 16)HEX}}) AS address, k"""
_FRAME_BASE = """SELECT user_id * 1000 + CAST(floor(t / 240.0) AS BIGINT) % 1000 AS dump_id, event_id % 3 AS tid, event_id, k,
  ROW_NUMBER() OVER (PARTITION BY user_id, CAST(floor(t / 240.0) AS BIGINT), event_id % 3 ORDER BY event_id) AS rn FROM {SRC}"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Debugger frames: dump_id, tid, gdb_idx (0 = innermost), func, address."""
    base = spark.sql(_FRAME_BASE.replace("{SRC}", "{src}"), src=events(spark, sf))
    return base.selectExpr(*_exprs(_FRAME_COLS.replace("{HEX(", "lower(hex(").replace(")HEX}", "))")))


cte("fx_frames", "SELECT " + _FRAME_COLS.replace("{HEX(", "lower(to_hex(").replace(")HEX}", "))")
    + " FROM (" + _FRAME_BASE.replace("{SRC}", "fx_e") + ") n")

_view("fx_addr", "lineitem", """l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_partkey * 4096 + CAST(l_quantity AS BIGINT) * 64 AS addr""")
_view("fx_map", "part", """p_partkey AS map_id, p_partkey * 4096 AS start_addr, p_partkey * 4096 + p_size * 64 AS end_addr,
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '[stack]' WHEN 2 THEN '[heap]' WHEN 3 THEN '/dev/hugepages/rte'
   WHEN 4 THEN '/usr/lib/librte_eal.so.24' ELSE '/opt/bin/app' END AS name""")

_view("fx_gdb", "fx_e", """event_id AS dump_id, concat('Program terminated with signal ',
  CASE k % 5 WHEN 0 THEN '11' WHEN 1 THEN 'SIGABRT' WHEN 2 THEN 'SIGSEGV' WHEN 3 THEN 'SIGFPE' ELSE '99' END, ', Some text.', chr(10),
  '=== BT_FULL_BEGIN ===', chr(10), '#0  0x', {HEX(4198400 + v)HEX}, ' in rte_pktmbuf_alloc (mp=0x0) at mbuf.c:', CAST(k + 1 AS {STR}), chr(10),
  '        n = 5', chr(10), '#1  0x', {HEX(4199400 + v)HEX}, ' in process_packet ()', chr(10), '#1  0x', {HEX(4199400 + v)HEX}, ' in process_packet ()', chr(10),
  CASE WHEN k % 9 = 0 THEN '#2  0x1 in worker<int> (x=1) from /opt/lib/libworker.so' ELSE '#2  ?? ()' END, chr(10),
  '#3  0x', {HEX(4299400 + v)HEX}, ' in main () at app.c:7', chr(10),
  '=== BT_FULL_END ===', chr(10), '=== REGISTERS_BEGIN ===', chr(10), 'rip            0x', {HEX(4198400 + v)HEX}, chr(10),
  'rdi            0x', {HEX(v % 3)HEX}, chr(10), 'r8             0x1', chr(10), '=== REGISTERS_END ===', chr(10),
  '=== MAPPINGS_BEGIN ===', chr(10), '0x400000 0x', {HEX(4198400 + k * 300)HEX}, ' 0x1000 0x0 /opt/bin/app', chr(10),
  '0x', {HEX(4198400 + k * 300)HEX}, ' 0x', {HEX(4198400 + k * 500)HEX}, ' 0x1000 0x0 ', CASE k % 4 WHEN 0 THEN '[heap]' WHEN 1 THEN '' WHEN 2 THEN '/usr/lib/librte_eal.so.24' ELSE '/dev/hugepages/x' END, chr(10), '=== MAPPINGS_END ===', chr(10),
  '=== SHARED_BEGIN ===', chr(10), '0x7f00 0x7f10 Yes /usr/lib/librte_eal.so.24', chr(10), CASE WHEN k % 2 = 0 THEN '0x7f20 0x7f30 Yes /usr/lib/librte_ring.so.24' ELSE '' END, chr(10), '=== SHARED_END ===', chr(10),
  '=== RSP_BEGIN ===', chr(10), '0x7ffe00: 0x', {HEX(4199400 + v)HEX}, ' 0x0', chr(10), '0x7ffe10: 0x', {HEX(k)HEX}, ' 0xdead', chr(10), '=== RSP_END ===', chr(10),
  '=== RBP_BEGIN ===', chr(10), '0x7fff00: 0x1', chr(10), '=== RBP_END ===', chr(10),
  '=== LOCALS_BEGIN ===', chr(10), '#0  rte_pktmbuf_alloc (mp=0x0) at mbuf.c', chr(10), 'm = 0x', {HEX(v)HEX}, chr(10), 'leak = {1, 2, 3}', chr(10), 'buf = "', repeat('ab', CAST(k AS INT)), '"', chr(10), 'frame = 0', chr(10), '=== LOCALS_END ===', chr(10),
  '=== SIGINFO_BEGIN ===', chr(10), CASE WHEN k % 10 = 0 THEN '$1 = 0' ELSE concat('$1 = (void *) 0x', {HEX(k * 200)HEX}) END, chr(10), '=== SIGINFO_END ===', chr(10),
  '=== INFO_THREADS_BEGIN ===', chr(10), '* 1    Thread 0x7f01 (LWP 100) rte_pktmbuf_alloc ()', chr(10),
  '  2    Thread 0x7f02 (LWP 101) ', CASE k % 3 WHEN 0 THEN 'epoll_wait ()' WHEN 1 THEN 'eal_thread_loop ()' ELSE 'mp_handle ()' END, chr(10), '  3    Thread 0x7f03 (LWP 102) ', CASE k % 2 WHEN 0 THEN 'handle_flow ()' ELSE 'rte_ctrl_thread_create ()' END, chr(10), '=== INFO_THREADS_END ===', chr(10),
  '=== THREAD_BT_BEGIN ===', chr(10), 'Thread 2 (Thread 0x7f02 (LWP 101)):', chr(10), '#0  0x1 in ', CASE k % 2 WHEN 0 THEN 'epoll_wait' ELSE 'poll_queue' END, ' ()', chr(10), '#1  0x2 in start ()', chr(10), '#1  0x2 in start ()', chr(10),
  'Thread 1 (Thread 0x7f01 (LWP 100)):', chr(10), '#0  0x3 in rte_pktmbuf_alloc ()', chr(10), '#1  0x4 in process_packet ()', chr(10), '=== THREAD_BT_END ===') AS gdb_text,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'warning: No symbol table is loaded' WHEN 2 THEN 'file is truncated core' WHEN 3 THEN 'CRC mismatch: checksum does not match' ELSE 'Python Exception <x>: gdb.Value; register rip unavailable' END AS stderr,
  CAST(k % 2 AS INT) AS returncode, k, v""")

_view("fx_stack", "fx_e", """event_id AS dump_id, concat('TID 1:', chr(10), '#0  0x', {HEX(4198400 + v)HEX}, ' rte_mempool_get - /usr/lib/librte_mempool.so', chr(10),
  '    mempool.c:', CAST(k AS {STR}), chr(10), '#1  0x', {HEX(4198400 + v)HEX}, ' rte_mempool_get - /usr/lib/librte_mempool.so', chr(10),
  '#2  0x', {HEX(4398400 + v)HEX}, ' - /opt/bin/app', chr(10), 'TID 2:', chr(10), '#0  0x', {HEX(5398400 + v)HEX}, ' epoll_wait - /lib/libc.so.6', chr(10),
  'TID 3:', chr(10), '#0  0x', {HEX(5398400 + v)HEX}, ' handle_flow') AS stack_text""")

_view("fx_log", "fx_e", """event_id AS log_id, concat('EAL: Detected CPU lcores: ', CAST(k AS {STR}), chr(10), 'EAL: Detected NUMA nodes: 2', chr(10),
  'EAL: Selected IOVA mode ''PA''', chr(10), CASE WHEN k % 4 = 0 THEN concat('EAL: Detected shared linkage of DPDK', chr(10)) ELSE '' END,
  'EAL: Probe PCI driver: net_', CASE WHEN k % 2 = 0 THEN 'ice' ELSE 'mlx5' END,
  ' (8086:1592) device: 0000:0', CAST(k % 10 AS {STR}), ':00.0 (socket 0)', chr(10),
  'EAL: Probe PCI driver: net_ena (1d0f:ec20) device: 0000:1', CAST(k % 10 AS {STR}), ':00.0 (socket 1)', chr(10),
  CASE WHEN k % 5 = 0 THEN concat('ice_dev_init(): Failed to init PCI device', chr(10)) WHEN k % 5 = 1 THEN concat('EAL: Failed to init PCI device 1', chr(10)) ELSE '' END,
  CASE WHEN k % 7 = 0 THEN concat('EAL: Not enough memory available on socket 1', chr(10)) ELSE '' END,
  CASE WHEN k % 3 = 0 THEN 'Segmentation fault (core dumped)' ELSE 'bye' END) AS app_log,
  concat('Network devices using kernel driver', chr(10), '===================================', chr(10),
  '0000:0', CAST(k % 10 AS {STR}), ':00.0 ''Some NIC'' if=eth0 drv=', CASE WHEN k % 3 = 0 THEN 'vfio-pci' ELSE 'ice' END, ' unused=vfio-pci *Active*', chr(10), chr(10),
  'No ''Baseband'' devices detected', chr(10), 'Crypto devices using DPDK-compatible driver', chr(10), '0000:0', CAST(k % 10 AS {STR}), ':01.0 ''QAT'' drv=vfio-pci unused=') AS nic_text, k, v""")

_view("fx_storage_events", "documents", """doc_id, concat('{"EventName":"s3:ObjectCreated:', CASE WHEN lang = 'es' THEN 'Copy' ELSE 'Put' END, '","Records":[{"s3":{"bucket":{"name":"kb"},"object":{"key":"knowledge%2F2024-01-01%2Fabcd1234_doc',
  CAST(doc_id AS {STR}), '.txt","size":', CAST(n_chars * 1000 AS {STR}), ',"contentType":"text/plain","eTag":"', md5(text), '"}}}]}') AS body""")

_view("fx_cases", "documents", """doc_id AS case_id, lang AS signal_name,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('type_', lang) END AS crash_type,
  source AS crash_function, text AS description,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(' cause of ', source, ' ') END AS root_cause""")
