"""Sessions, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What every plan of this library assumes.  ANSI stays on; sources that can be dirty use try_ functions.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def session(name: str = "colligo", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once in an application.  Python tasks import them there."""
    context = spark.sparkContext
    if getattr(context, "_colligo_shipped", False):
        return
    package = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="colligo-"), "colligo.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(path)
    context._colligo_shipped = True
