"""Spark session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps calendar fields stable; AQE re-plans joins and splits skewed partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "waymark", **conf: str) -> SparkSession:
    """A session with DEFAULTS, overridden by ``conf`` (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
