"""Sends this package to the executors of a session, which need it to run its Python functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a Spark application: add the package as a zip that the driver serves."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = Path(__file__).parent
    target = Path(tempfile.mkdtemp(), "tessera.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
