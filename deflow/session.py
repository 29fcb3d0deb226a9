"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "deflow", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    ``master`` and ``shuffle_partitions`` are left to the cluster's own settings
    unless given; tests pass ``local[...]`` and a handful of partitions.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.compress", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("DEFLOW_DRIVER_MEMORY", "12g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's ``spark.checkpoint.dir`` when it names one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="deflow-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so a lost executor replays from there.

    ``keep_layout`` is for hash-placed data: the plan's partitioning is only remembered by the
    materialised result when it is fixed before the run, so adaptive re-planning is off for that run
    and later joins on the same key find the rows already in place.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not keep_layout:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # A fresh Dataset, because the old one may have been planned already.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the cluster's shuffle partitions before per-row work that costs a hundred times the move.

    Splits of the input follow file sizes, and the work per byte of source text does not.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
