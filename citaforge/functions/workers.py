"""Makes this package importable in local Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Local workers import this package from where the driver has it; a cluster ships it with --py-files."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, _ROOT])
