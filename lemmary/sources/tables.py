"""Table access: one Parquet file or folder per table."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import DataFrame, SparkSession

from lemmary.sources.files import required_table

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it.

    Parts computed side by side ask for it at the same time; a cluster refuses a second file of the same name.
    """
    with _SHIPPING:
        if not getattr(spark.sparkContext, "_lemmary_shipped", False):
            _send(spark)


def _send(spark: SparkSession) -> None:
    sc = spark.sparkContext
    target = os.path.join(tempfile.mkdtemp(prefix="lemmary"), "lemmary.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(target)
    sc._lemmary_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` (FileNotFoundError without it); columns are pruned and filters pushed by Catalyst."""
    ship(spark)
    return required_table(spark, f"{folder}/{name}.parquet")
