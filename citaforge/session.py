"""One place that builds a session; a cluster passes its own settings instead."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str, cores: int | str = "*", shuffle: int = 8, extra: dict[str, str] | None = None) -> SparkSession:
    """A local session with adaptive execution; `extra` overrides anything."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | (extra or {})
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
