"""A session with the settings the engine is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """Local session: UTC, adaptive execution, shuffle partitions by cores. On a cluster use its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores if isinstance(cores, int) else 8),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
