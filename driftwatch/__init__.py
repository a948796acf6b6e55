"""Anomaly analytics over trades and quotes, and operators for training text, as Spark jobs."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it isn't installed."""
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
