"""A session with the settings that the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "docketry", **conf: str) -> SparkSession:
    """UTC and AQE with skew joins; ANSI mode stays on."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
