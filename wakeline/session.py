"""A Spark session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "wakeline", **settings: str) -> SparkSession:
    """UTC times, ANSI errors, adaptive plans; ``settings`` use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
