"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def _local_conf(builder: SparkSession.Builder, cpus: int) -> SparkSession.Builder:
    return (
        builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )


def get_spark(app: str = "baitscope", cpus: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session is created by the launcher; only the settings this
    library relies on (UTC session time zone, AQE) are applied to it.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
        builder = _local_conf(SparkSession.builder.appName(app), cpus)
        spark = (
            builder.config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set a scratch one only
    when none is configured in a local session (tests).  A cluster session
    without the setting is an error: a machine-local folder would be lost."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="baitscope-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one driver table (parquet) from ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
