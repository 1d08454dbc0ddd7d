"""Sessions with the settings that the operators are written for, and shipping of the package to executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import SparkSession


def session(app: str = "skeinflow", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use double underscores for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def release() -> None:
    """Give freed memory back to the system, where the C library can: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_skeinflow_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="skeinflow-package-")  # of the driver, which serves the file as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "skeinflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._skeinflow_shipped = True
