"""Tables written between the steps of an operator.

They go below ``spark.checkpoint.dir``, the folder that driver and executors
share, so a lost executor costs a reread and never a recomputation of the
whole lineage.  Where that setting is unset, tables go below the session's
warehouse, if it is shared; only a local master (tests, a laptop), whose
executors are the driver, uses a temporary folder of this machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..shipping import ship
from ..sources.stages import shared_folder


def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="gleaner-")


class Workspace:
    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        base = shared_folder(spark.sparkContext.master, spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"))
        if not base:
            base = spark._gleaner_checkpoint_dir = getattr(spark, "_gleaner_checkpoint_dir", None) or _local()
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.made: dict[int, str] = {}
        # Held, so that no other frame gets the id of a table's frame.
        self.kept: list[DataFrame] = []
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, read back from a written table."""
        where = self.path(name)
        df.write.parquet(where)
        back = self.spark.read.schema(df.schema).parquet(where)
        self.made[id(back)] = where
        self.kept.append(back)
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            where = self.made.pop(id(df), None)
            if where:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(where)
                p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def drop_all(self, but: DataFrame) -> None:
        """Delete all tables but one, which no longer needs them."""
        self.drop(*[df for df in self.kept if df is not but])


def extended(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """A copy of ``schema`` with one more column (``StructType.add`` changes the frame's own)."""
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
