"""Session helpers.

The library never creates a session on its own inside operators; callers pass
one in. ``get_session`` is for tests, benches and scripts.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "newslake", driver_memory: str = "8g",
                conf: dict[str, str] | None = None) -> SparkSession:
    """Local or cluster session with AQE on and the UI off.

    On a cluster (no ``master`` given) the master, memory and the number of
    shuffle partitions come from spark-submit / the cluster defaults (size
    them so a shuffle partition is a few hundred MB; AQE coalesces small
    ones). Local runs get 8 shuffle partitions and a large driver heap.
    """
    builder = SparkSession.builder.appName(app_name)
    local = bool(master) and master.startswith("local")
    if master:
        builder = builder.master(master)
    if local:
        # Local mode: the driver JVM is also the only executor.
        builder = builder.config("spark.driver.memory", driver_memory)
        shuffle_partitions = shuffle_partitions or 8
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (tests, a laptop) in local mode fall back to a fresh local folder. On a
    cluster without it this raises: executors would each write to their own disk."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no SparkContext on the client
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc is not None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="newslake-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def read_table(spark: SparkSession, base_dir: str, name: str):
    """One driver table: ``<base_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))
