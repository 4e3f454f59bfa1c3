"""Spark sessions with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "veridex", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution, ANSI mode. On a cluster leave master and shuffle_partitions to its configuration."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
