"""Hand this package to Python workers that can't import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_quillveil_shipped", False):
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="quillveil-")).resolve() / "quillveil_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._quillveil_shipped = True
