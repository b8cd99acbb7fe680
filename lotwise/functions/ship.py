"""The package itself for Python workers: nothing needs to be installed on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's modules to all workers, once for each Spark context.

    Functions that run in workers are found by their module's name there, so the modules travel as
    a zip file with the job's other files.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lotwise_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="lotwise-")) / "lotwise_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._lotwise_shipped = True
