"""Session factory: UTC, adaptive execution, Arrow transfer."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings every session of the engine wants; a cluster's own settings win where it has set them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tapeworks", cores: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the master and settings through spark-submit."""
    builder = SparkSession.builder.appName(app)
    if cores or "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores or '*'}]")
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
