"""Session construction and shared-folder resolution."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins with runtime sizes (so a side
# is broadcast only after its real size is known), splits skewed join partitions
# and coalesces small shuffle partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Post-shuffle partitions are coalesced towards this size; skewed join
    # partitions above 5x the median (and 256 MB) are split.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    # Streaming state (windows, dedup, joins) off the JVM heap, checkpointed
    # incrementally with the query.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Broadcast only sides that the planner or AQE measured below 32 MB.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(master: str | None = "local[*]", app: str = "storepulse",
                  shuffle_partitions: int | None = 8, driver_memory: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with ``BASE_CONF``. ``master=None`` leaves master, shuffle
    partitions and UI to spark-submit / the cluster's defaults."""
    builder = SparkSession.builder.appName(app)
    conf = dict(BASE_CONF)
    if master is not None:
        builder = builder.master(master)
        conf["spark.ui.enabled"] = "false"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster shares for checkpoints and written tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only a
    local-mode session (tests) without one gets a private folder; on a cluster a
    machine-local folder would not survive a lost executor, so it is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            d = tempfile.mkdtemp(prefix="storepulse-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for one written table."""
    return os.path.join(shared_dir(spark), "storepulse", f"{name}-{uuid.uuid4().hex}")
