"""Session construction and the shared scratch location.

Lineage is cut with ``DataFrame.checkpoint()`` or by writing a table under
the folder named by ``spark.checkpoint.dir``; that folder must be shared
storage on a cluster. We only invent a local one when the session runs in
local mode and nothing is configured (tests).
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # local mode runs everything in the driver JVM; on a cluster the
    # deployment sets executor memory instead
    "spark.driver.memory": "16g",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # parquet scans: 128 MiB splits keep a task's input inside executor memory
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_session(master: str | None = None, app: str = "sinter",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir``). Only a local-mode
    session with nothing configured gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        # the context appends a per-application uuid folder
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at shared storage")
        configured = tempfile.mkdtemp(prefix="sinter-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for an intermediate table."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def release_memory(spark: SparkSession) -> None:
    """Between the steps of a long flow: plans and tables that nothing refers
    to go (checkpoints with them), and the driver gives memory that it holds
    but doesn't use back to the system. Compiling hundreds of plans frees
    hundreds of MB that the allocator would keep. Does nothing where the
    session has no JVM of its own or the JVM no such command."""
    gc.collect()
    try:
        jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
        jvm.java.lang.System.gc()
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # by reflection on the public interface: the server's own class is closed to callers
        public = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
        invoke = next(m for m in public if m.getName() == "invoke")
        args = new(jvm.java.lang.Object, 4)
        args[0], args[1] = name, "systemTrimNativeHeap"
        invoke.invoke(beans, args)
    except (AttributeError, PySparkException, Py4JError):
        pass
