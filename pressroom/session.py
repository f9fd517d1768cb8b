"""Sessions and the shipping of this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once for each application.

    Python stages import their functions by name; Spark's file server gives every
    executor, also one that joins later, the archive added here.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, path.relative_to(top.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark
