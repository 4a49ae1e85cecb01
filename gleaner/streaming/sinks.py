"""B-02, L-01, L-10: sinks that take a batch once, and lose none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.stages import Folder


def claimed(stream: DataFrame, url: Column, ts: str, within: str) -> DataFrame:
    """L-10: the first row of each canonical address; one that comes again ``within`` that time, or before the watermark has passed it, is dropped.

    What is held is one row for each address of that time, so it does not grow with the log.
    """
    return stream.withColumn("canonical", urls.canonical(url)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["canonical"])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def once(path: str, fallback: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """B-02, L-01: what ``foreachBatch`` calls: batch n is written to the folder ``batch=n`` of ``path``, whatever was there before, so a
    batch that comes again adds nothing.

    ``prepare`` is what happens to a batch on its way (gates, projections).  If it or the
    write fails, the batch's rows are kept as they came in the folder of ``fallback``; a later success takes them out
    of there again.  If that write fails too, so does the query, which then begins with the same batch.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        except Exception:
            _delete_quietly(spark, f"{path}/batch={number}")
            batch.write.mode("overwrite").parquet(f"{fallback}/batch={number}")
        else:
            _delete(spark, f"{fallback}/batch={number}")

    return take


def _delete_quietly(spark: SparkSession, path: str) -> None:
    """What a failed write has left goes, if the path can be reached at all."""
    try:
        _delete(spark, path)
    except Exception:
        return


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches of a sink; none if nothing was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def run(stream: DataFrame, name: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All that is there now, through the sink, as a table in the shared folder."""
    folder = Folder(stream.sparkSession, name)
    query = stream.writeStream.foreachBatch(once(folder.path("out"), folder.path("kept"), prepare)).option("checkpointLocation", folder.path("state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return read(stream.sparkSession, folder.path("out"), prepare(stream.sparkSession.createDataFrame([], stream.schema)).schema)
