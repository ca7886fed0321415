"""Spark session with the settings the library is tested under, and the folder where jobs keep intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """On a cluster the submitted configuration wins over the settings here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession, prefix: str = "quern") -> str:
    """A new folder below the one named by ``spark.checkpoint.dir``.

    Where none is named, a session in one JVM gets a temporary one. On a cluster that is an error: its executors could
    not share a folder of the driver's machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
