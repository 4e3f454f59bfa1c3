"""The library's own code on executors that were not given it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the whole package to the executors once per application, so that no part of it hides another.

    A package that was itself loaded from an archive is on the executors already. Batches for Python are kept small for
    the rest of the session where their size has its default, which suits narrow rows but not texts and rasters.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    app = spark.sparkContext.applicationId
    here = os.path.dirname(os.path.abspath(__file__))
    if app in _shipped or not os.path.isdir(here):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith((".py", ".json")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("veridex", os.path.relpath(path, here)))
    path = os.path.join(tempfile.mkdtemp(prefix="veridex"), "veridex_code.zip")  # Spark serves it to the executors
    with open(path, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veridex-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
