"""Send this package to the executors, so that queries run from any folder and on any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a zip of its sources, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="folioforge-")) / "folioforge.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _sent.add(app)
    return spark
