"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "skein", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; settings of the cluster win where given to spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
