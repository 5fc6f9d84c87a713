"""This package for Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_leafmill_shipped", False):
        return
    name = os.path.join(tempfile.mkdtemp(prefix="leafmill-"), "leafmill-src.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(name)
    sc._leafmill_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, which ships the package first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
