"""Session helpers: one place for configuration and for the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fieldwork") -> SparkSession:
    """Build (or reuse) a session with the settings the jobs rely on.

    AQE stays on: it coalesces small shuffle partitions, turns a join into a
    broadcast only after measuring the materialised side, and splits skewed
    join partitions.  The UI is off (no server is started).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               # small shuffles of long texts stay spread over the cores; large
               # shuffles are governed by the advisory partition size anyway
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
               .config("spark.sql.session.timeZone", "UTC")
               # streaming state (one row per key) lives in RocksDB, not on the JVM heap
               .config("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor; its heap is the
        # execution memory of every task (takes effect when the JVM starts)
        builder = builder.config("spark.driver.memory", os.environ.get("FIELDWORK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as it is.  Only when the
    session has none (a local test run) is a private folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fieldwork-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, for written tables.

    Written tables cut lineage the way ``checkpoint()`` does and survive the loss
    of an executor, unlike anything kept on one machine.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/fieldwork-scratch/{name}-{uuid.uuid4().hex[:12]}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so that Python file APIs can be used in tests."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``fieldwork`` importable in Python workers (once per context).

    The package is zipped on the driver and handed to ``addPyFile``, which
    distributes it to every executor, as ``--py-files`` would.
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="fieldwork-pyfiles-"), "fieldwork.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))
