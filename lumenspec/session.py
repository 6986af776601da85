"""The session that tests and the bench use, and the way the package's code reaches executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH_BYTES = "8m"  # of an Arrow batch


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lumenspec")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("LUMENSPEC_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package as a zip file, once an application; bound what a Python worker holds of its input."""
    app = spark.sparkContext.applicationId
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if app not in _shipped:
        package = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="lumenspec-code-"), "lumenspec.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
