"""Names, texts, bounds and tables that results must agree on. Data only, no logic."""

# ---- telemetry ------------------------------------------------------------------------------------------
PORT_COUNTERS = ("ipackets", "opackets", "ibytes", "obytes", "ierrors", "oerrors", "rx_nombuf")
XSTAT_NAMES = {  # output name -> extended counter name
    "rx_good": "rx_good_packets",
    "rx_missed": "rx_missed_errors",
    "rx_errors": "rx_errors",
    "tx_errors": "tx_errors",
    "mbuf_errors": "rx_mbuf_allocation_errors",
    "multicast": "rx_q0_multicast_packets",
    "broadcast": "rx_q0_broadcast_packets",
    "undersize": "rx_q0_undersize_packets",
}
EMA_ALPHA = 0.3
MAX_PAIR_GAP = 3.0
MIN_PAIR_GAP = 0.01
MAX_PPS = 1e7
LOW_TRAFFIC_PPS = 10.0
RING_1S = 300
RING_5S = 180
FEATURE_WINDOW = 10
BASELINE_WINDOW = 300
RECORD_TTL = 300
LIVENESS_TIMEOUT = 30

QUEUE_STEPS = [(0.2, "balanced"), (0.5, "slight_skew"), (1.0, "severe_skew")]
MEMPOOL_STEPS = [(0.1, "critical"), (0.3, "warning"), (1.0, "healthy")]
HEAP_STEPS = [(0.05, "critical"), (0.15, "warning"), (1.0, "healthy")]
CPU_STEPS = [(0.3, "idle"), (0.7, "normal"), (1.0, "high")]
ERROR_STEPS = [(1, "none"), (10, "low"), (50, "medium"), (float("inf"), "high")]
RISK_STEPS = [(20, "low"), (50, "medium"), (80, "high"), (101, "critical")]

INSIGHT = {
    "mem": "mempool nearly exhausted",
    "queue": "queue imbalance detected",
    "cpu": "cpu under high load",
    "errors": "packet errors observed",
    "traffic_up": "traffic increasing rapidly",
    "mem_down": "mempool decreasing rapidly",
    "cpu_up": "cpu load rising",
    "burst_up": "traffic increasing sharply in short term",
    "burst_down": "traffic dropping rapidly",
    "unstable": "traffic is highly unstable",
    "heap_out": "heap memory nearly exhausted",
    "heap_low": "heap memory low",
    "heap_frag": "heap memory heavily fragmented",
    "normal": "system operating normally",
}
RISK_TAGS = {
    "mem_imminent": "mempool_exhaustion_imminent",
    "mem_risk": "mempool_exhaustion_risk",
    "cpu": "cpu_overload_imminent",
    "queue": "queue_congestion_risk",
    "mbuf": "packet_loss_due_to_mempool",
    "surge": "traffic_surge",
    "heap": "heap_memory_pressure",
}

# ---- rules: id, severity, metric, condition, threshold, cooldown seconds, escalate ---------------------------
ALERT_RULES = [
    ("MEMPOOL_CRITICAL", "critical", "mempool_free", "lt", 0.1, 60, False),
    ("MEMPOOL_WARNING", "warning", "mempool_free", "lt", 0.3, 120, False),
    ("MEMPOOL_DROP_FAST", "warning", "mempool_free", "ref_ratio_lt", 0.5, 60, False),
    ("HEAP_CRITICAL", "critical", "heap_free", "lt", 0.05, 60, True),
    ("HEAP_WARNING", "warning", "heap_free", "lt", 0.15, 120, False),
    ("HEAP_FRAG_HIGH", "warning", "heap_frag", "gt", 0.5, 300, False),
    ("NOMBUF_ANY", "critical", "nombuf", "gt", 0.0, 15, True),
    ("MISSED_ANY", "warning", "missed", "gt", 0.0, 30, False),
    ("MISSED_SURGE", "critical", "missed", "ref_delta", 100.0, 30, False),
    ("RX_ERROR_ANY", "warning", "rx_errors", "gt", 0.0, 60, False),
    ("RX_ERROR_SURGE", "critical", "rx_errors", "ref_ratio", 3.0, 30, False),
    ("TX_ERROR_ANY", "warning", "tx_errors", "gt", 0.0, 60, False),
    ("CPU_HIGH", "warning", "cpu_avg", "gt", 0.9, 30, False),
    ("CPU_SURGE", "warning", "cpu_avg", "ref_ratio", 2.0, 60, False),
    ("QUEUE_SEVERE_SKEW", "warning", "queue_imbalance", "gt", 0.5, 60, False),
    ("TRAFFIC_SURGE", "warning", "rx_pps", "ref_ratio", 3.0, 60, False),
    ("RISK_SCORE_HIGH", "warning", "risk_score", "gt", 50.0, 60, False),
    ("RISK_SCORE_CRITICAL", "critical", "risk_score", "gt", 80.0, 30, True),
]
RULE_METRICS = ("rx_pps", "tx_pps", "rx_errors", "tx_errors", "nombuf", "missed", "queue_imbalance",
                "mempool_free", "heap_free", "heap_frag", "cpu_avg", "risk_score")
SEVERITY_COOLDOWN = 60

# ---- crash ----------------------------------------------------------------------------------------------
SIGNALS = {4: "SIGILL", 6: "SIGABRT", 7: "SIGBUS", 8: "SIGFPE", 11: "SIGSEGV", 13: "SIGPIPE", 15: "SIGTERM"}
SECTIONS = ("bt_full", "info_threads", "registers", "mappings", "shared", "thread_bt", "rsp", "rbp", "args",
            "siginfo", "locals", "frame_info")
KEY_REGISTERS = ("rip", "rsp", "rbp", "rdi", "rsi", "rdx")
REGISTER_ORDER = ("rip", "rdi", "rsi", "rdx", "rsp", "rbp", "rax", "rbx", "rcx", "r8", "r9", "r10", "r11",
                  "r12", "r13", "r14", "r15")
IDLE_TOKENS = ("read", "libcread", "epollwait", "pthreadcondwait", "pthreadcondtimedwait", "futexwait",
               "nanosleep", "clocknanosleep", "socketlistener", "mphandle", "libcaccept")
THREAD_ROLES = (  # role, name parts after removing blanks, underscores and parentheses
    ("lcore_worker", ("rteealremotelaunch", "ealthreadloop", "rtelcoremain", "lcoreconfig", "ealworkerthread")),
    ("interrupt_thread", ("ealintrhandleevents", "rteintrcallbackfn", "epollwait", "rtectrlthreadcreate",
                          "recvmsg", "recvmsgsyscall", "recvfrom", "recvfromsyscall")),
    ("control_thread", ("rtemp", "mphandle", "socketlistener", "pthreadcondwait")),
)
REQUIRED_LIBS = ("librte_eal", "librte_mbuf", "librte_ethdev", "librte_net", "librte_ring")
SUBSYSTEMS = {
    "mempool": "rte_mempool|rte_pktmbuf",
    "ring": "rte_ring",
    "eal": "rte_eal|eal_",
    "ethdev": "rte_eth|rte_dev",
    "mbuf": "rte_mbuf",
    "malloc": "rte_malloc|malloc_elem",
}
CRASH_BY_SIGNAL = {
    "SIGBUS": "bus_error_alignment", "SIGABRT": "abort", "SIGFPE": "floating_point_exception",
    "SIGILL": "illegal_instruction", "SIGPIPE": "broken_pipe", "SIGTERM": "terminated",
}
NEAR_NULL = 0x1000
INVALID_FUNCS = ("??", "unknown", "", "_start", "__libc_start_main")
PMD_PREFIXES = ("i40e_", "mlx5_", "ixgbe_", "ena_", "ice_", "nfp_", "hns3_", "virtio_", "vmxnet3_", "bnxt_",
                "axgbe_", "enic_", "fm10k_", "e1000_", "igb_", "igbvf_", "cnxk_", "octeontx_", "af_xdp_",
                "dpaa_", "dpaa2_", "mvpp2_", "mvneta_")
EAL_PREFIXES = ("rte_eal_", "eal_", "rte_mp_", "eal_thread")
EAL_NAMES = ("rte_panic", "rte_exit", "__rte_panic", "mp_handle", "eal_intr_handle_events", "rte_ctrl_thread_create")
LIBC_PREFIXES = ("__libc_", "__glibc_", "pthread_", "__pthread", "clone3")
NOISE_NAMES = ("??", "unknown", "_start", "__libc_start_main", "")
GRAPH_NOISE_PREFIXES = ("__libc_", "__recvmsg", "clone3", "start_thread")
MEMPOOL_FUNCS = ("rte_mempool_get", "rte_pktmbuf_alloc", "rte_mempool_generic_get", "rte_mempool_get_bulk",
                 "rte_pktmbuf_alloc_bulk")
RING_FUNCS = ("rte_ring_enqueue", "rte_ring_dequeue", "rte_ring_enqueue_bulk", "rte_ring_dequeue_bulk")
PANIC_FUNCS = ("rte_panic", "rte_exit", "__rte_panic")
SIGNATURE_SKIPS = ("__libc", "pthread_", "_start")
POISON_BYTES = {
    "de": "释放后填充 (poisoned)", "cd": "未初始化堆内存", "fd": "堆内存守卫", "ab": "未初始化栈内存",
    "ba": "已释放内存", "cc": "未初始化栈", "fe": "已释放内存", "dd": "已释放堆内存", "f0": "已释放内存",
    "be": "内存填充",
}
NOTE_NULL = "NULL 指针"
NOTE_NEAR_NULL = "近空地址"
NOTE_RETURN = "返回地址"
USERSPACE_DRIVERS = ("vfio-pci", "uio_pci_generic", "igb_uio")
INTERNAL_THREAD_FUNCS = ("mp_handle", "eal_intr_handle_events", "rte_ctrl_thread_create")
LOCAL_SKIP = ("frame", "Stack", "Locals", "Arguments")

# debugger message rules: order, key, severity, substrings that must all occur, pattern on lower-case text
SYMBOL_RULES = [
    (1, "binary_identity_mismatch", "fatal", ["build-id", "does not match core file"], ""),
    (2, "shared_library_identity_mismatch", "fatal", ["build-id"], r"(shared library|\.so).*does not match"),
    (3, "relocation_address_mismatch", "non_fatal", [], r"loaded at (0x[0-9a-f]+).*expected (0x[0-9a-f]+)"),
    (4, "address_space_randomization_issue", "non_fatal", [], r"(add-symbol-file|address.*relocation|kaslr|pie.*offset)"),
    (5, "binary_checksum_mismatch", "fatal", ["crc mismatch"], r"(checksum mismatch|checksum does not match|crc mismatch)"),
    (6, "shared_library_load_failure", "non_fatal", [], r"(cannot find|could not load|skipping).*shared librar"),
    (7, "shared_library_symbol_resolution_failure", "non_fatal", ["could not load shared library symbols"], ""),
    (8, "library_version_mismatch", "fatal", ["wrong library or version mismatch"], ""),
    (9, "symbol_version_mismatch", "fatal", [], r"(requires version|no symbol version)"),
    (10, "debug_info_missing", "non_fatal", [], r"(could not find|cannot find|no such file).*\.debug"),
    (11, "debug_info_missing", "non_fatal", [], r"(missing|not found).*(debuginfo|debug.info|debug.symbol)"),
    (12, "symbol_table_missing", "non_fatal", ["no debugging symbols found"], ""),
    (13, "symbol_table_missing", "non_fatal", ["no symbol table is loaded"], ""),
    (14, "architecture_mismatch", "fatal", [], r"(wrong architecture|elf class mismatch|not.*elf.*format)"),
    (15, "architecture_bitwidth_mismatch", "fatal", [], r"(32.bit.*64.bit|64.bit.*32.bit|elf32.*elf64|elf64.*elf32)"),
    (16, "abi_endianness_mismatch", "fatal", [], r"(abi mismatch|wrong endian|endianness mismatch)"),
    (17, "core_file_truncated", "fatal", [], r"(truncated|incomplete).*(core|coredump)"),
    (18, "core_file_invalid_format", "fatal", [], r"(not a core file|invalid core|unrecognized.*core)"),
    (19, "core_register_access_failure", "non_fatal", ["can't fetch registers from this type of core file"], ""),
    (20, "thread_state_unavailable", "non_fatal", [], r"(cannot find|unable to find|failed to read).*(thread|lwp)"),
    (21, "register_read_failure", "non_fatal", [], r"(register|pc|sp|fp).*(unavailable|not available|could not read)"),
    (22, "gdb_python_printer_exception", "non_fatal", [], r"python exception.*gdb\.(value|type|frame|block)"),
]

# start-up log fields: name -> pattern with one group
APP_LOG_FIELDS = {
    "detected_lcores": r"EAL:\s*Detected CPU lcores:\s*(\d+)",
    "detected_numa_nodes": r"EAL:\s*Detected NUMA nodes:\s*(\d+)",
    "multi_process_socket": r"EAL:\s*Multi-process socket\s+(\S+)",
    "iova_mode": r"EAL:\s*Selected IOVA mode\s+'([^']+)'",
    "rte_version": r"EAL:\s*RTE Version:\s+'([^']+)'",
    "requested_device_unusable": r"EAL:\s*Requested device\s+([0-9a-fA-F:.]+)\s+cannot be used",
    "telemetry_status": r"TELEMETRY:\s*(.+)",
    "vfio_error": r"EAL:\s*(Failed to open VFIO\S*|Cannot open /dev/vfio\S*)",
    "hugepage_error": r"EAL:\s*(Cannot get hugepage information|Not enough memory available)",
    "not_enough_memory_socket": r"EAL:\s*Not enough memory available on socket\s+(\d+)",
}
NIC_SECTIONS = (  # heading part on lower-case text -> section, first match wins
    ("network devices", "network"), ("baseband", "baseband"), ("crypto", "crypto"), ("dma", "dma"),
    ("eventdev", "eventdev"), ("mempool", "mempool"), ("compress", "compress"), ("misc", "misc"),
    ("regex", "regex"), ("ml", "ml"),
)

# ---- retrieval ------------------------------------------------------------------------------------------
FIELD_BOOSTS = {"crash_function": 5.0, "description": 3.0, "log_feature": 2.0, "root_cause": 1.0}
RRF_K = 60
EMBED_BATCH = 10
ADMISSION_THRESHOLD = 0.9
SPLIT_PROFILES = {  # profile -> size, overlap, separators from coarse to fine
    "default": (800, 100, ["\n\n", "\n", "。", "！", "？", ".", "!", "?", " ", ""]),
    "code": (1500, 200, ["\nclass ", "\ndef ", "\n\n", "\n", " ", ""]),
    "table": (500, 50, ["\n", ",", ""]),
    "html": (800, 100, ["\n## ", "\n\n", "\n", "。", ".", " "]),
}
PROFILE_BY_EXTENSION = {"py": "code", "js": "code", "ts": "code", "java": "code", "go": "code", "cpp": "code",
                        "csv": "table", "html": "html", "htm": "html"}
CASE_LABELS = (("signal_name", "信号名称"), ("crash_type", "崩溃类型"), ("anomaly_flags", "异常标志"),
               ("description", "描述"), ("root_cause", "根因"), ("repair_steps", "修复步骤"))

# ---- alerts ---------------------------------------------------------------------------------------------
SUBJECT_TEMPLATE = "【{{severity}}】{{title}}"
ALERT_FIELDS = ("alert_id", "client_id", "severity", "title", "description", "triggered_at")
CALLBACK_TYPE = "callback_event"
CRASH_TYPE = "crash_event"
CRASH_TEMPLATE = "crash_fixed_template"
CRASH_RULE_ID = 1

# ---- texts of alerts and reports ----------------------------------------------------------------------------
FALLBACK_TITLE = "DPDK 异常"
FALLBACK_LINES = {
    "rules": "触发规则: ", "rx": "流量: RX ", "tx": " pps / TX ", "pps": " pps", "rx_errors": "错误: RX错误=", "nombuf": " MBUF不足=",
    "missed": " 丢包=", "mempool": "内存池空闲: ", "heap": " | 堆内存空闲: ", "cpu": "CPU均值: ",
}
REPORT_TITLE = "# DPDK 故障分析报告"
REPORT_SUMMARY = "## 摘要\n\n| 字段 | 值 |\n|------|----|"
REPORT_FIELDS = {"client_id": "客户端", "confidence": "诊断置信度", "crash_time": "崩溃时间"}
REPORT_CAUSE = "## 根因"
REPORT_SIGNS = "## 指标特征"
UNKNOWN = "未知"
NONE = "无"
HUGEPAGE_NOTES = {"low": " ⚠ 接近耗尽", "enough": " (充足)"}
BINDING_ALERTS = {"kernel_bound": "Network card has switched back to kernel driver", "no_driver": "Network card has no driver bound"}
