"""L: the time and state mechanics as Structured Streaming over append-only tables."""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship
from ..sources.stages import Folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000


def events(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A Parquet table as a stream, its time as an event time that takes watermarks."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn(ts, F.col(ts).cast("timestamp"))


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = Folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", folder.path("out")).option("checkpointLocation", folder.path("state")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder.path("out"))


def run_closed(log: DataFrame, ts: str, walk: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """All of a log that has ended through ``walk``, as a table: :func:`run` to the log's end, then on from there with one more row, at ``OVER``, that lets the watermark pass whatever still waits."""
    spark = log.sparkSession
    folder = Folder(spark, name)
    ends, schema = folder.path("ends"), log.schema
    row = spark.range(1).select(*[(F.lit(OVER.isoformat(" ")) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    row.limit(0).write.parquet(ends)
    for step in range(2):
        if step:
            row.write.mode("append").parquet(ends)
        out = walk(log.unionByName(spark.readStream.schema(schema).parquet(ends)))
        out.writeStream.format("parquet").option("path", folder.path("out")).option("checkpointLocation", folder.path("state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(folder.path("out"))


def tumbling(stream: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of closed windows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, ts: str, size: str, step: str, late: str, *keys: str) -> DataFrame:
    """L-02: the look-back window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """L-07: spells of activity; a spell's end plus the gap is when the idle are reaped."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_seen(stream: DataFrame, *keys: str) -> DataFrame:
    """L-01, L-10: one row of each key, ever."""
    return stream.dropDuplicates(list(keys))


#: Keys are dealt to so many buckets; a bucket's keys share one state and one timer.
BUCKETS = 2048
#: Rows without time stand here, behind all others; a row at ``OVER`` ends a log.
LAST, OVER = datetime(9999, 1, 1), datetime(9999, 12, 31)
LAST_US = (LAST - datetime(1970, 1, 1)) // timedelta(microseconds=1)


#: Rows without an order stand behind the others of their moment.
NO_ORDER = (1 << 63) - 1


class Ordered(StatefulProcessor):
    """Walks each key's rows in the order of (time, order), however they were dealt into batches.

    Rows wait in list state until the watermark has passed them: whatever comes
    later is late or stands behind them.  An event-time timer stands at the
    first of them, and behind them at the moment at which a key's state is
    over, so a state goes with its key.

    Grouped are buckets of keys: what waits is one packed value a batch, and what the keys hold is one packed value, so that the calls
    between worker and state store are a few a bucket, not some for each key and row.

    ``step(held, us, row)`` returns (held, output tuple or None); ``held`` is a tuple or None.  ``due(held)`` is the moment at which
    ``end(held)``, which returns (held, output tuple or None), must be called, or None: then the state stays, one entry a key.
    """

    def __init__(self, fields: list[str], names: list[str], step, due, end):
        self.fields, self.names = fields, names
        self.step, self.due, self.end = step, due, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "keys binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            columns = [frame[f].astype(object) for f in self.fields]
            new += zip(*(c.where(c.notna(), None).tolist() for c in columns), strict=True)
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            self.handle.registerTimer(min(r[0] for r in new) // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for (packed,) in self.waiting.get() for r in pickle.loads(packed)] if self.waiting.exists() else []
        rows.sort(key=lambda r: r[:2])
        ready = bisect.bisect_left(rows, now, key=lambda r: r[0])
        before = self.held.get()[0] if self.held.exists() else None
        held, made = {} if before is None else pickle.loads(before), []

        def until(name, us: int) -> tuple | None:
            now_held = held.get(name)
            while now_held is not None and (over := self.due(now_held)) is not None and over < us:
                now_held, out = self.end(now_held)
                if out is not None:
                    made.append((name, *out))
            return now_held

        for us, order, name, *row in rows[:ready]:
            held[name], out = self.step(until(name, us), us, row)
            if out is not None:
                made.append((name, None if order == NO_ORDER else order, *out))
        held = {name: left for name in list(held) if (left := until(name, now)) is not None}
        ahead = rows[ready:]
        if ready:
            self.waiting.put([(pickle.dumps(ahead),)]) if ahead else self.waiting.clear()
        if not held:
            self.held.clear()
        elif (after := pickle.dumps(held)) != before:
            self.held.update((after,))
        overs = [over for h in held.values() if (over := self.due(h)) is not None]
        for us in [r[0] for r in ahead[:1]] + ([min(overs)] if overs else []):
            self.handle.registerTimer(us // 1000)
        if made:
            yield pd.DataFrame(made, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def _ordered(stream: DataFrame, ts: str, order: str, late: str, key: str, columns: dict[str, Column], out: str, step, due=lambda held: None, end=lambda held: (None, None), untimed: bool = False) -> DataFrame:
    """``stream`` through :class:`Ordered`: (key, out).  The key travels as a string, so that a null is one key like others.

    With ``untimed``, rows without time stand behind all others until the log is closed (see :func:`run_closed`); else they are left out.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Workers rename columns that begin with an underscore.
    rows = stream.withWatermark(ts, late).filter(F.coalesce(F.col(ts) < F.lit(OVER.isoformat(" ")).cast("timestamp"), F.lit(untimed)))
    us = F.coalesce(F.unix_micros(ts), F.lit(LAST_US)).alias("us")
    name = F.col(key).cast("string")
    bucket = F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = rows.select(bucket, F.col(ts).alias("time"), us, F.coalesce(F.col(order).cast("long"), F.lit(NO_ORDER)).alias("ordinal"), name.alias("name"), *[c.alias(n) for n, c in columns.items()])
    schema = T.StructType([T.StructField(key, T.StringType()), *T._parse_datatype_string(out).fields])
    walk = Ordered(["us", "ordinal", "name", *columns], schema.names, step, due, end)
    return rows.groupBy("bucket").transformWithStateInPandas(walk, schema, "Append", "EventTime").withColumn(key, F.col(key).cast(stream.schema[key].dataType))


def cache(stream: DataFrame, ts: str, order: str, late: str, key: str, seconds: int, touch: bool = True) -> DataFrame:
    """L-03, L-04, L-09: (key, event, hit) of requests to a cache that forgets a key ``seconds`` after it was written or, with ``touch``, last read."""
    life = seconds * 1_000_000

    def step(held: tuple | None, us: int, row: list):
        # What is over has been dropped before: whatever is held is still good.
        return (held if held and not touch else (us + life,)), (held is not None,)

    return _ordered(stream, ts, order, late, key, {}, "event long, hit boolean", step, lambda held: held[0])


def breaker(stream: DataFrame, ts: str, order: str, late: str, key: str, ok: str, failures: int = 3, seconds: int = 3600, untimed: bool = False) -> DataFrame:
    """L-05 as a stream: (key, event, failures before it, open): a circuit that ``failures`` in a row open until ``seconds`` after the last of them; a success resets it.

    Failures in a row may be far apart, so a count stays until a success: one entry for each key whose last call failed.
    Calls without time, if asked for, come last and find no circuit open.
    """

    def step(held: tuple | None, us: int, row: list):
        n, last = held or (0, 0)
        return (None if row[0] else (n + 1, us)), (n, n >= failures and us < min(LAST_US, last + seconds * 1_000_000))

    return _ordered(stream, ts, order, late, key, {"good": F.coalesce(F.col(ok), F.lit(False))}, "event long, failures long, open boolean", step, untimed=untimed)


def leases(stream: DataFrame, ts: str, order: str, late: str, key: str, kind: str, cap: int, seconds: int = 1800) -> DataFrame:
    """L-08, H-11: (key, event, granted, used, reserved) of a day's budget of ``cap`` calls.

    ``kind`` is "reserve" (a lease of ``seconds`` is granted while used and leased calls are fewer than ``cap``), "success" or "failure" (the oldest
    lease ends; a success is used up) or "corrupt": the counter cannot be read, and
    the budget is exhausted until a call's end writes it anew.  A new day begins with nothing used or leased, unless the
    counter is corrupt.  Leases and day are those at the row's time.  ``granted`` is null unless the row asks for a lease; other
    kinds change nothing.  Without a positive ``cap`` everything is granted and nothing counted.
    """
    life = seconds * 1_000_000

    def loaded(held: tuple | None, us: int) -> tuple:
        day = us // DAY
        if held and held[3]:
            return day, max(0, cap), [], True
        if not held or held[0] != day:
            return day, 0, [], False
        return day, held[1], [t for t in held[2] if t > us - life], False

    def step(held: tuple | None, us: int, row: list):
        if cap <= 0:
            return None, (True if row[0] == "reserve" else None, 0, 0)
        day, used, live, corrupt = loaded(held, us)
        granted = None
        if row[0] == "reserve":
            granted = used + len(live) < cap
            live = [*live, us] if granted else live
        elif row[0] in ("success", "failure"):
            live, used, corrupt = live[1:], used + (row[0] == "success"), False
        elif row[0] == "corrupt":
            corrupt, live, used = True, [], cap
        return (day, used, live, corrupt), (granted, used, len(live))

    # A day's counter is over with the day; a corrupt one stays.
    due = lambda held: None if held[3] else (held[0] + 1) * DAY - 1
    return _ordered(stream, ts, order, late, key, {"kind": F.col(kind)}, "event long, granted boolean, used long, reserved long", step, due)


def reaper(stream: DataFrame, ts: str, order: str, late: str, key: str, lock: str, idle: int = 300, fresh: int = 600) -> DataFrame:
    """L-07: (key, requested, reaped) of keys that no request came for in ``idle`` seconds.

    Rows with ``lock`` are not requests but locks: while the last one is younger than ``fresh`` seconds, the key is not reaped.  A timer
    reaps it, once until the next request, as soon as the watermark has passed the moment.
    """

    def due(held: tuple) -> int | None:
        asked, locked = held
        over = None if asked is None else asked + idle * 1_000_000
        if locked is not None:
            over = max(over or 0, locked + fresh * 1_000_000)
        return over

    def step(held: tuple | None, us: int, row: list):
        asked, locked = held or (None, None)
        return ((asked, us) if row[0] else (us, locked)), None

    def end(held: tuple):
        asked, _ = held
        # Behind the last moment at which its lock is fresh, a key without request is forgotten.
        return None, (None if asked is None else (None, asked, due(held)))

    out = _ordered(stream, ts, order, late, key, {"lock": F.coalesce(F.col(lock), F.lit(False))}, "event long, requested long, reaped long", step, due, end)
    return out.select(key, F.timestamp_micros("requested").alias("requested"), F.timestamp_micros("reaped").alias("reaped"))
