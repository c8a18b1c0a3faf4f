"""Session builder with the settings every plan of this package assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", app: str = "millrace", **extra: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword arguments use `__` for dots in setting names."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
