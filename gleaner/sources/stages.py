"""Folders for what a query writes on its way: below ``spark.checkpoint.dir``.

Where that is unset they are below the warehouse, if a cluster's executors share
it; only a local master, whose executors are the driver, gets a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(master: str, checkpoints: str | None, warehouse: str) -> str | None:
    """The folder that driver and executors share; None for a local master without one.  A warehouse on a machine's own disk is none."""
    if checkpoints:
        return checkpoints.rstrip("/")
    if master.split("[")[0] == "local":
        return None
    if warehouse.startswith("file:") or ":/" not in warehouse:
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; the warehouse is local: {warehouse}")
    return f"{warehouse.rstrip('/')}/_gleaner"


class Folder:
    def __init__(self, spark: SparkSession, name: str):
        base = shared_folder(spark.sparkContext.master, spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"))
        base = base or "file://" + tempfile.mkdtemp(prefix="gleaner-")
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, read back from a written table."""
        df.write.parquet(self.path(name))
        return df.sparkSession.read.schema(df.schema).parquet(self.path(name))
