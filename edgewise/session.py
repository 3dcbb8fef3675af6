"""A session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "edgewise", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session, or the running one. On a cluster, use the session the
    cluster gives; the operators only need ``spark.checkpoint.dir`` to name a
    folder that all executors share."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
