"""Session factory used by tests and the bench; a cluster job brings its own session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str | int = "*", app: str = "fleetscope") -> SparkSession:
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.driver.memory", os.environ.get("FLEETSCOPE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def ensure_utc(spark: SparkSession) -> None:
    """Event times are stored without a zone; every op assumes UTC.

    Reusing the partitioning of a union's inputs clashes with adaptive re-partitioning in Spark 4.1 (sides of unequal
    partition counts are zipped), so it is switched off.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for stream checkpoints and working tables, below the shared folder named by ``spark.checkpoint.dir``.

    Without that setting only a local session may go on, in a temporary folder: on a cluster every executor would write
    to its own disk and later reads would miss rows, so any other master is refused.
    """
    name = f"{label}-{uuid.uuid4().hex}"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/fleetscope/{name}"
    return f"{_local_root(spark.sparkContext.master)}/{name}"


@lru_cache(maxsize=1)
def _local_root(master: str) -> str:
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share: the master is {master}")
    return tempfile.mkdtemp(prefix="fleetscope-")
