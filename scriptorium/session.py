"""Spark session defaults and the shared working folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def session(app: str = "scriptorium", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the engine is tuned for.

    Cluster-wide values (master, memory, shuffle partitions) stay with the caller; only options that
    change plan shapes are set here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.bindAddress", "127.0.0.1").config(
                "spark.driver.host", "127.0.0.1"
            )
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A machine-local temporary folder is used only for a local master without that setting, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="scriptorium-")
        configured = _LOCAL_DIRS[app]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")
