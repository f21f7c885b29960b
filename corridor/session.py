"""Spark session helpers: local sessions for tests/bench, shared-folder lookup."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants. Cluster sessions keep their own
# values for anything already set; these only fill gaps.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corridor") -> SparkSession:
    """A local session for tests and benchmarks (UI off, small shuffle width)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for materialised tables and checkpoints.

    Taken from ``spark.checkpoint.dir`` as the cluster names it. Only a local
    session (tests, benchmarks) without one gets a folder of its own, registered
    so that ``DataFrame.checkpoint()`` and our written tables use the same
    place; on a cluster a machine-local folder would be wrong, so that is an
    error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    # local-cluster[...] runs executors of their own and counts as a cluster
    if not path and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if not path:
        path = os.environ.get("CORRIDOR_LOCAL_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="corridor-ckpt-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path.rstrip("/")
