"""Sending the package to Python workers that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, unless workers get the folder from PYTHONPATH or start in it; Spark's own file server hands it out."""
    app = spark.sparkContext.applicationId
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _sent or ROOT in known or Path.cwd().resolve() == ROOT:
        return
    path = Path(tempfile.mkdtemp()) / "pagequarry.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "pagequarry").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
