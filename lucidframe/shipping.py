"""The package on the workers: executors import it from a zip that Spark itself hands out, not from a shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    _done.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lucidframe-")  # stays while the driver lives: executors that join later fetch it too
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "lucidframe_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in sorted(os.walk(here)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("lucidframe", os.path.relpath(full, here)))
    context.addPyFile(path)
