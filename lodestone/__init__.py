"""Spark-native retrieval, code-graph and corpus-processing engine."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reachable_by_workers(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package where it is not installed (a local session)."""
    root, held = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)
