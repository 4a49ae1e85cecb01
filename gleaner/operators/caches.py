"""L-03: exactly what a cache of bounded size holds, over a log of any length.

A cache that keeps the ``capacity`` keys touched last is, after any stretch of the
log, a merge of what it was before and the keys touched in the stretch: a
list of at most ``capacity`` keys.  So the log is cut into blocks in the order of
time, each block gives its own list, and the state at each block's start is the
merge of all lists before it, found in log2(blocks) rounds in which a block
takes in the list of the block twice as far back.  Then each block is walked
from its own state, in one task that holds ``capacity`` keys at a time; no task sees the log.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.stages import Folder

CAPACITY, LIFE = 500, 6 * 3600


def _newest(rows: DataFrame, capacity: int) -> DataFrame:
    """(block, key, us, order): of each block the ``capacity`` keys touched last, each at its last touch."""
    last = rows.groupBy("block", "key").agg(F.max(F.struct("us", "order")).alias("_at")).select("block", "key", "_at.us", "_at.order")
    return last.withColumn("_rank", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("us"), F.desc("order")))).filter(F.col("_rank") <= capacity).drop("_rank")


def _walk(capacity: int, life: int):
    """Rows in order, each block's state before its log: (order, key, hit) of the log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cache = None, OrderedDict()
        for batch in batches:
            out = []
            for b, is_log, us, order, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    block, cache = b, OrderedDict()
                last = cache.pop(key, None)
                if is_log:
                    out.append((order, key, last is not None and us - last <= life))
                cache[key] = us
                if len(cache) > capacity:
                    cache.popitem(last=False)
            order, key, hit = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(key, pa.string()), pa.array(hit, pa.bool_())], ["order", "key", "hit"])

    return run


def lru_hits(log: DataFrame, key: str, ts: str, order: str, capacity: int = CAPACITY, seconds: int = LIFE, blocks: int | None = None) -> DataFrame:
    """L-03: (order, key, hit) of requests: whether the cache holds the key, no longer than ``seconds`` after it was written or last read.

    A request makes its key the newest; beyond ``capacity`` keys the oldest goes.
    Requests go by time, those of one moment by ``order``, which tells rows apart;
    rows without time or key are left out.  Times are taken as they stand, with or without a zone.
    """
    spark = log.sparkSession
    ship(spark)
    folder = Folder(spark, "lru")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = log.select(us.alias("us"), F.col(order).cast("long").alias("order"), F.col(key).cast("string").alias("key")).filter("us is not null and key is not null")
    parts = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = folder.save(rows.repartitionByRange(parts, "us", "order").withColumn("block", F.spark_partition_id()), "blocks")
    before = folder.save(_newest(rows, capacity), "lists0")
    far, step = 1, 0
    while far < parts:
        # A block's list takes in that of as many blocks as it stands for.
        ahead = before.withColumn("block", F.col("block") + far).filter(F.col("block") < parts)
        step += 1
        before = folder.save(_newest(before.unionByName(ahead), capacity), f"lists{step}")
        far *= 2
    state = before.withColumn("block", F.col("block") + 1).filter(F.col("block") < parts)
    walked = state.select("block", F.lit(False).alias("is_log"), "us", "order", "key").unionByName(rows.select("block", F.lit(True).alias("is_log"), "us", "order", "key"))
    dealt = walked.repartition(parts, "block").sortWithinPartitions("block", "is_log", "us", "order")
    return dealt.mapInArrow(_walk(capacity, seconds * 1_000_000), "order long, key string, hit boolean")
