"""Session construction and the shared working folder.

On a cluster the session comes from the platform; ``get_session`` only fills in
settings that are unset. Lineage cuts and derived fixture files live under
``spark.checkpoint.dir`` (a shared folder every executor can reach); a
machine-local temporary folder is used only when that setting is absent, which
is the local-test case.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "episcope") -> SparkSession:
    """Return the active session, or build one with the library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        _ensure_conf(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("EPISCOPE_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _ensure_conf(spark)
    return spark


def _ensure_conf(spark: SparkSession) -> None:
    # The timezone matters for every date operator: pin it when a caller left it unset.
    if spark.conf.get("spark.sql.session.timeZone", None) in (None, ""):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); set one only if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        # Local tests only: on a cluster the platform names a shared folder.
        root = tempfile.mkdtemp(prefix="episcope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for derived files."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/episcope/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Reliable lineage cut: write ``df`` to the shared checkpoint folder and read it back.

    Used for small shared intermediates (the daily fact) that several branches of
    one plan read; unlike a cache, the files survive the loss of an executor.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
