"""Ships this package to the executors, once per application, so that functions that run there can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="spark-skein-")) / f"{root.name}.zip"
    with zipfile.ZipFile(place, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(place))
    _shipped.add(app)
