"""Python workers and this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

import mlframe


def let_workers_import(spark: SparkSession) -> None:
    """Adds the folder that holds this package to the workers' PYTHONPATH, whatever the driver's working folder is. Where executors do not see that folder, ship the package with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(mlframe.__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known + os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (*known, root) if p)
