"""Cohort retention by secondary sort.

Clicks are dealt out by client and sorted by time, and each task reads its
stretch once, in Arrow batches.  Where the client or the period changes, one
user is emitted with what the run of clicks was worth, so users are counted
without a set of clients for any cell.

* Equal clicks count once: they are combined in each task before they are
  dealt out by all their columns.
* A client's starts (its first purchase in either state) are minima, combined
  in each task as well.  They meet the clicks by an equi-join that adaptive
  execution may split for a hot client.
* The repartition is by ranges of (client, ts, click), so that a client with a
  third of all clicks has many tasks.  A run that a border cuts in two is the
  first or last of its task and state: those runs, at most four a task, are
  added up by client and period; all others are whole.

Nothing that grows with the input is broadcast or goes to the driver.

Defined results: clicks without ts or client are dropped; a null kind is no
purchase; a null arrived_at is known in state 1 alone; a null click_id arrives
when arrived_at says; a null, infinite or NaN value counts 0.  If ``clients`` has
a client more than once, the smallest of its cities that are not null is its segment.  Clients without a
row there have the segment ''.  Empty tables give no cells.  Columns of other
names are part of what makes clicks equal and are not read otherwise, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spelling import CRC_TABLE, crc_sql
from .workspace import Workspace, shuffle_parts

CUTOFF, STEP = "2024-03-01 00:00:00", 3
DAY = 86_400_000_000
RUNS = "state int, client long, segment string, cohort long, period long, moved boolean, cents long, edge boolean"


def crc_of(x: Column) -> Column:
    """crc32 of a number's decimal digits."""
    return F.crc32(x.cast("string").cast("binary"))


def known_clicks(clicks: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """(client, ts, click, known, buys, cents) of the distinct clicks; ``known``: it arrives before the cutoff."""
    h = crc_of(F.col("click_id"))
    late = F.when(h % 3 == 0, h % 100).otherwise(0).cast("int")
    arrives = F.col("arrived_at") + F.make_dt_interval(F.coalesce(late, F.lit(0)))
    known = F.coalesce(arrives < F.lit(cutoff).cast(clicks.schema["arrived_at"].dataType), F.lit(False))
    worth = F.floor(100 * F.col("value") + F.lit(0.5))
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    rows = clicks.filter("ts is not null and client_id is not null").distinct()
    return rows.select(F.col("client_id").alias("client"), "ts", F.col("click_id").alias("click"), known.alias("known"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("buys"), F.coalesce(F.when(finite, worth), F.lit(0)).cast("long").alias("cents"))


def starts(known: DataFrame, clients: DataFrame) -> DataFrame:
    """(client, first0, first1, segment) of the clients with a purchase; first0 is null where state 0 knows none."""
    first = known.filter("buys").groupBy("client").agg(F.min(F.when(F.col("known"), F.col("ts"))).alias("first0"), F.min("ts").alias("first1"))
    city = clients.groupBy(F.col("client_id").alias("client")).agg(F.coalesce(F.min("city"), F.lit("")).alias("segment"))
    return first.join(city, "client", "left").withColumn("segment", F.coalesce("segment", F.lit("")))


def _micros(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970, 0 for null, and whether they are there."""
    column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), there


def _of_state(state: int, batch: pa.RecordBatch, step: int) -> pa.Table | None:
    """The runs of one batch: a row for each stretch of clicks of one client and period."""
    client, cents = batch.column("client").to_numpy(), batch.column("cents").to_numpy()
    ts, _ = _micros(batch.column("ts"))
    (s0, has), (s1, _) = _micros(batch.column("first0")), _micros(batch.column("first1"))
    start = s1 if state else s0
    use = ts >= start
    if not state:
        use &= has & batch.column("known").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(use)
    if not len(at):
        return None
    day = step * DAY
    moved = has & (s0 // day != s1 // day)
    client, period = client[at], (ts[at] - start[at]) // day
    first = np.flatnonzero(np.concatenate([[True], (client[1:] != client[:-1]) | (period[1:] != period[:-1])]))
    row = at[first]
    columns = [np.full(len(first), state, np.int32), client[first], batch.column("segment").take(pa.array(row)), start[row] // day, period[first], moved[row], np.add.reduceat(cents[at], first), np.zeros(len(first), bool)]
    return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[x.split()[0] for x in RUNS.split(", ")])


def _scan(step: int):
    """Clicks in the order of (client, ts) to runs; the first and the last run of each state are marked, for a neighbour may have the rest."""

    def marked(run: pa.Table) -> pa.Table:
        return run.set_column(run.schema.get_field_index("edge"), "edge", pa.array(np.ones(run.num_rows, bool)))

    def joined(a: pa.Table, b: pa.Table) -> pa.Table:
        """Run ``a`` with the worth of ``b``, which goes on with it."""
        return a.set_column(a.schema.get_field_index("cents"), "cents", pa.array([a["cents"][0].as_py() + b["cents"][0].as_py()], pa.int64()))

    same = lambda a, b: all(a[c][0].as_py() == b[c][0].as_py() for c in ("client", "period"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: list[pa.Table | None] = [None, None]
        begun = [False, False]
        for batch in batches:
            for state in (0, 1):
                runs = _of_state(state, batch, step)
                if runs is None:
                    continue
                held = open_run[state]
                if held is not None and same(held, runs):
                    head, runs = joined(held, runs), runs.slice(1)
                    runs = pa.concat_tables([head, runs])
                elif held is not None:
                    runs = pa.concat_tables([held, runs])
                open_run[state], done = runs.slice(runs.num_rows - 1), runs.slice(0, runs.num_rows - 1)
                if done.num_rows and not begun[state]:
                    yield from marked(done.slice(0, 1)).to_batches()
                    done, begun[state] = done.slice(1), True
                yield from done.combine_chunks().to_batches()
        for last in open_run:
            if last is not None:
                yield from marked(last).to_batches()

    return work


def retention(clicks: DataFrame, clients: DataFrame, cutoff: str = CUTOFF, step: int = STEP, parts: int | None = None) -> DataFrame:
    """(state, segment, cohort, period, users, users_crc32, moved, cents) of the cells that have users.

    State 0 knows the clicks that arrive before ``cutoff``, state 1 all; ``step`` is the length of cohorts and periods in days.
    """
    spark = clicks.sparkSession
    ws = Workspace(spark, "cohorts")
    known = ws.save(known_clicks(clicks, cutoff), "clicks")
    first = ws.save(starts(known, clients), "starts")
    rows = known.join(first, "client").filter("ts >= first1").select("client", "ts", "click", "known", "cents", "first0", "first1", "segment")
    rows = rows.repartitionByRange(parts or shuffle_parts(spark), "client", "ts", "click").sortWithinPartitions("client", "ts").drop("click")
    runs = ws.save(rows.mapInArrow(_scan(step), RUNS), "runs")
    ws.drop(known, first)
    cut = runs.filter("edge").groupBy("state", "client", "segment", "cohort", "period", "moved").agg(F.sum("cents").alias("cents"))
    users = runs.filter("not edge").drop("edge").unionByName(cut)
    cell = users.groupBy("state", "segment", "cohort", "period")
    return cell.agg(F.count("*").alias("users"), F.sum(crc_of(F.col("client"))).alias("users_crc32"), F.sum(F.col("moved").cast("long")).alias("moved"), F.sum("cents").alias("cents"))


def op11_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention(spark.read.parquet(f"{sf_dir}/clicks.parquet"), spark.read.parquet(f"{sf_dir}/clients.parquet"))


OP11_SQL = f"""
WITH {CRC_TABLE},
once AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
summed AS (SELECT *, {crc_sql("click_id::VARCHAR")} AS h FROM once, crc_table),
shaped AS (
  SELECT client_id, ts, kind, coalesce(floor(100 * value + 0.5), 0)::BIGINT AS cents,
         coalesce(arrived_at + to_days(CASE WHEN h % 3 = 0 THEN (h % 100)::INTEGER ELSE 0 END) < TIMESTAMP '2024-03-01 00:00:00', false) AS known
  FROM summed),
told AS (SELECT 1 AS state, * FROM shaped UNION ALL SELECT 0, * FROM shaped WHERE known),
starts AS (SELECT state, client_id, min(ts) AS start FROM told WHERE kind = 'purchase' GROUP BY ALL),
cohorts AS (SELECT *, floor(epoch_us(start) / 86400000000 / 3)::BIGINT AS cohort FROM starts),
named AS (
  SELECT c.*, coalesce(x.city, '') AS segment, count(*) OVER (PARTITION BY c.client_id) = 2 AND max(cohort) OVER (PARTITION BY c.client_id) <> min(cohort) OVER (PARTITION BY c.client_id) AS moved
  FROM cohorts c LEFT JOIN (SELECT client_id, min(city) AS city FROM clients GROUP BY client_id) x USING (client_id)),
known AS (
  SELECT b.state, n.segment, n.cohort, (epoch_us(b.ts) - epoch_us(n.start)) // 259200000000 AS period, b.client_id, n.moved, sum(b.cents) AS cents
  FROM told b JOIN named n ON n.state = b.state AND n.client_id = b.client_id AND b.ts >= n.start GROUP BY ALL),
summary AS (SELECT k.*, {crc_sql("client_id::VARCHAR")} AS crc FROM known k, crc_table)
SELECT state::INTEGER AS state, segment, cohort, period, count(*) AS users, sum(crc)::BIGINT AS users_crc32, count(*) FILTER (moved) AS moved, sum(cents)::BIGINT AS cents
FROM summary GROUP BY state, segment, cohort, period
"""
