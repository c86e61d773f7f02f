"""Session for one machine; on a cluster the session comes from spark-submit."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str, cores: str = "8", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ready_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package as the driver did.

    A cluster gets the package through ``--py-files`` or its own installation.
    """
    environment = spark.sparkContext.environment
    known = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if (root := str(Path(__file__).resolve().parents[1])) not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
