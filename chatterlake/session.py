"""The package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that Python functions find it wherever they run.

    The archive is made where the driver runs; Spark's file server takes it from there.
    """
    context = spark.sparkContext
    if getattr(context, "_chatterlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="chatterlake-")) / "chatterlake-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    context._chatterlake_shipped = True
