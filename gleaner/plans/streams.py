"""Queries that run the event log as a stream to its end; windows that the watermark has closed, and the breaker for all of the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import sinks, streams
from .calls import SQL_BREAKER, SQL_CACHE
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _stream(spark, sf_dir):
    return streams.events(spark, f"{sf_dir}/events.parquet")


@R.query("WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL) SELECT start, event_type, n, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def stream_tumbling(spark, sf_dir):
    out = streams.run(streams.tumbling(_stream(spark, sf_dir), "ts", "1 hour", "10 minutes", "event_type"), "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@R.query("WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * i AS start, event_type, count(*) AS n FROM events, range(7) r(i) GROUP BY ALL) SELECT start, event_type, n FROM w WHERE start + INTERVAL 7 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def stream_sliding(spark, sf_dir):
    out = streams.run(streams.sliding(_stream(spark, sf_dir), "ts", "7 days", "1 day", "10 minutes", "event_type"), "sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@R.query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e), w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s)
 SELECT user_id, start, "end", n FROM w WHERE "end" <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_session(spark, sf_dir):
    out = streams.run(streams.sessions(_stream(spark, sf_dir), "ts", "5 minutes", "10 minutes", "user_id"), "spells")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@R.query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    return streams.run(streams.first_seen(_stream(spark, sf_dir).select("user_id", "event_type"), "user_id", "event_type"), "seen")


#: Keyed state answers for rows that the watermark has passed.
_CLOSED = "(SELECT epoch_us(date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE) FROM events)"


@R.query(f"WITH {SQL_CACHE} SELECT event_id, user_id, hit FROM h JOIN (SELECT event_id, ts FROM events) USING (event_id) WHERE epoch_us(ts) < {_CLOSED}")
def stream_cache(spark, sf_dir):
    """L-03, L-04, L-09 as state that ends: six hours from the last request of a user."""
    out = streams.run(streams.cache(_stream(spark, sf_dir), "ts", "event_id", "10 minutes", "user_id", 6 * 3600), "cache")
    return out.select(F.col("event").alias("event_id"), "user_id", "hit")


@R.query(f"WITH {SQL_BREAKER} SELECT event_id, user_id, failures, open FROM c")
def stream_breaker(spark, sf_dir):
    """L-05 as state, for every event: the log is closed at its end, so those that the watermark has not passed are answered too."""
    log = _stream(spark, sf_dir).withColumn("ok", F.expr("event_type <> 'error'"))
    walk = lambda rows: streams.breaker(rows, "ts", "event_id", "10 minutes", "user_id", "ok", 3, 100 * 3600, untimed=True)
    out = streams.run_closed(log, "ts", walk, "breaker")
    return out.select(F.col("event").alias("event_id"), "user_id", "failures", "open")


@R.query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN event_type = 'view' THEN 'reserve' WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'click' THEN 'failure' WHEN event_type = 'signup' AND event_id % 20 = 0 THEN 'corrupt' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 walk(user_id, n, event_id, us, granted, day, used, live, corrupt) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN, -1::BIGINT, 0::BIGINT, []::BIGINT[], false FROM events
  UNION ALL
  SELECT user_id, n, event_id, us, CASE WHEN kind = 'reserve' THEN u + len(l) < 2 END, us // 86400000000, CASE WHEN kind = 'success' THEN u + 1 WHEN kind = 'corrupt' THEN 2 ELSE u END,
   CASE WHEN kind = 'reserve' AND u + len(l) < 2 THEN list_append(l, us) WHEN kind IN ('success', 'failure') THEN l[2:] WHEN kind = 'corrupt' THEN [] ELSE l END, CASE WHEN kind IN ('success', 'failure') THEN false ELSE c OR coalesce(kind = 'corrupt', false) END
  FROM (SELECT e.*, w.corrupt AS c, CASE WHEN w.corrupt THEN 2 WHEN w.day <> e.us // 86400000000 THEN 0 ELSE w.used END AS u, CASE WHEN w.corrupt OR w.day <> e.us // 86400000000 THEN [] ELSE list_filter(w.live, lambda t: t > e.us - 43200000000) END AS l FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
 SELECT event_id, user_id, granted, used, len(live)::BIGINT AS reserved FROM walk WHERE n > 0 AND us < {_CLOSED}""")
def stream_leases(spark, sf_dir):
    """L-08, H-11: a user's two calls a day: leases of twelve hours that calls end, a new budget each day, and counters that cannot be read."""
    kind = F.expr("CASE WHEN event_type = 'view' THEN 'reserve' WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'click' THEN 'failure' WHEN event_type = 'signup' AND event_id % 20 = 0 THEN 'corrupt' END")
    log = _stream(spark, sf_dir).withColumn("kind", kind)
    out = streams.run(streams.leases(log, "ts", "event_id", "10 minutes", "user_id", "kind", 2, 12 * 3600), "leases")
    return out.select(F.col("event").alias("event_id"), "user_id", "granted", "used", "reserved")


@R.query(f"""WITH RECURSIVE l AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
 r AS (SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type <> 'view'),
 walk(user_id, us, nxt, t) AS (SELECT user_id, us, nxt, us + 21600000000 FROM r UNION ALL
  SELECT w.user_id, w.us, w.nxt, max(l.us) + 43200000000 FROM walk w JOIN l ON l.user_id = w.user_id AND l.us <= w.t GROUP BY w.user_id, w.us, w.nxt, w.t HAVING max(l.us) + 43200000000 > w.t),
 f AS (SELECT user_id, us, nxt, max(t) AS t FROM walk GROUP BY ALL)
 SELECT user_id, make_timestamp(us) AS requested, make_timestamp(t) AS reaped FROM f WHERE (nxt IS NULL OR t < nxt) AND t < {_CLOSED}""")
def stream_reaper(spark, sf_dir):
    """L-07: users without a request for six hours, unless a view locks them for twelve."""
    log = _stream(spark, sf_dir).withColumn("lock", F.expr("event_type = 'view'"))
    out = streams.run(streams.reaper(log, "ts", "event_id", "10 minutes", "user_id", "lock", 6 * 3600, 12 * 3600), "reaper")
    return out.select("user_id", F.col("requested").cast("timestamp_ntz").alias("requested"), F.col("reaped").cast("timestamp_ntz").alias("reaped"))


@R.query("SELECT DISTINCT 'https://x.org/' || user_id || '?b=' || event_type AS canonical FROM events")
def stream_claims(spark, sf_dir):
    """L-01, L-10: each canonical address once, through a sink that takes a batch once; the log is shorter than the time for which addresses are held."""
    i = F.col("user_id").cast("string")
    url = F.concat(F.lit("HTTPS://X.org/"), i, F.lit("/?utm_source="), F.col("event_id").cast("string"), F.lit("&b="), F.col("event_type"), F.lit("#f"))
    log = _stream(spark, sf_dir).withColumn("url", url)
    return sinks.run(sinks.claimed(log, F.col("url"), "ts", "40 days").select("canonical"), "claims")
