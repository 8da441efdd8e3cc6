"""Session construction and the shared checkpoint folder.

Library code never builds its own session; it takes the caller's.  The
helpers here are for scripts (bench, tests) that need one, and for jobs that
cut lineage: they read ``spark.checkpoint.dir`` from the session and only set
one when the cluster left it unset (local tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "panelspark") -> SparkSession:
    """Session for scripts and tests: AQE on, UI off, UTC, Arrow on."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def size_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Spill-aware sizing from the bytes a job reads, for scripts that own their session.

    Sets the initial shuffle partition count to one per ``target_bytes`` of
    input (at least twice the cluster's parallelism) and lets adaptive execution
    coalesce to ``target_bytes`` after projection and partial aggregation
    shrink the data; scan splits use the same size.  100 TB gives about
    420,000 initial partitions of <= 256 MB, which fit an executor's memory and
    spill gracefully; skewed partitions are split by the adaptive skew-join rule.
    """
    cores = spark.sparkContext.defaultParallelism
    n = int(max(cores * 2, -(-input_bytes // target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    A machine-local folder would be incomplete on a cluster, so an unset one
    raises there; a local session (one process) gets a temporary folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="panelspark-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/panelspark-{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far (call it when their results are
    no longer read); returns how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_scratch)
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
