"""Session helpers: a local session for tests and bench, and shared scratch paths.

Library functions never build a session; they take DataFrames (or a session)
from the caller. Anything written between steps goes under the cluster's
``spark.checkpoint.dir``, which on a cluster is shared storage.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings for a large cluster (tens of TB of flows, ~1000 executors). The
# row work is projections and map-side partial aggregations, so shuffles carry
# small aggregated rows; the large data movement is the scan, the forest's
# per-level statistics and the cached training rows.
CLUSTER_CONF = {
    # adaptive execution: coalesce the many small post-aggregation partitions,
    # split skewed join partitions, and re-plan joins from real sizes
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # initial shuffle width: about 2-3 partitions per core; AQE coalesces down
    "spark.sql.shuffle.partitions": "20000",
    # scan splits of 256 MB of Parquet keep the task count near 400k for 100 TB
    "spark.sql.files.maxPartitionBytes": "256m",
    # joins Spark broadcasts on its own stay small; at run time AQE decides
    # from measured sizes. The library's own broadcasts are checked by rows.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict | None = None) -> None:
    """Set the runtime SQL settings above (and ``overrides``) on a session."""
    for key, value in {**CLUSTER_CONF, **(overrides or {})}.items():
        spark.conf.set(key, value)


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "flowdetect", extra_conf: dict | None = None
) -> SparkSession:
    """A local[N] session configured as the tests and bench expect."""
    builder = SparkSession.builder
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a local one only when unset.

    On a cluster the folder must be set (shared storage); a machine-local
    temporary folder is only acceptable in local mode.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; on a cluster it must name a shared folder"
            )
        configured = tempfile.mkdtemp(prefix="flowdetect-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder, removed when the session ends."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flowdetect-{spark.sparkContext.applicationId}"
    folder, files = _folder(spark, base)
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


OPEN_FILES_CONF = "spark.sql.maxConcurrentOutputFileWriters"
#: Files that a task writing by day keeps open: more than there are days. Rows of further folders are sorted, as Spark does by itself.
OPEN_FILES = 16
_open_files: dict[int, tuple[int, str]] = {}  # of each session: writes under way, its own setting
_open_files_lock = threading.Lock()


@contextmanager
def unsorted_folders(spark: SparkSession):
    """A table written by folder inside this block has a file open for each folder in every task.

    Spark would sort each task's rows by folder first, and so hold them all: memory that
    grows with the rows of a task. Writes may overlap (days are trained side by
    side); the session's own setting is back when the last one ends.
    """
    session = spark._jsparkSession.hashCode()
    with _open_files_lock:
        writes, own = _open_files.get(session, (0, spark.conf.get(OPEN_FILES_CONF)))
        _open_files[session] = writes + 1, own
        spark.conf.set(OPEN_FILES_CONF, str(max(int(own), OPEN_FILES)))
    try:
        yield
    finally:
        with _open_files_lock:
            writes, own = _open_files.pop(session)
            if writes > 1:
                _open_files[session] = writes - 1, own
            else:
                spark.conf.set(OPEN_FILES_CONF, own)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (used by tests that inspect written files)."""
    return path[5:] if path.startswith("file:") else path
