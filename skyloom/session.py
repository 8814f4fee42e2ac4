"""Session helpers: get this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_skyloom_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="skyloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(path)
    sc._skyloom_shipped = True
    return spark


def shipped(query):
    """A query that ships the package before it runs."""
    return lambda spark, sf_dir: query(ship(spark), sf_dir)
