"""Tables written between the steps of a query, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that spark.checkpoint.dir names; under a temporary one where it is unset and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lumenspec-"))
    return f"{found.rstrip('/')}/lumenspec/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back: what follows starts there, so plans of loops stay small and survive lost executors."""
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
