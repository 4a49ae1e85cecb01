"""H, I, L in batch: call logs, usage, scorecards, budgets, breakers, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import Folder


def calls_by_lane(calls: DataFrame) -> DataFrame:
    """H-01, H-02: (lane, ok, duration) to calls, ok, failed, mean duration and success rate; lanes without name are left out, bad durations are 0."""
    out = calls.filter(F.trim("lane") != "").groupBy("lane").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.avg(F.coalesce(F.col("duration").try_cast("double"), F.lit(0.0))).alias("avg_ms"))
    return out.withColumn("failed", F.col("calls") - F.col("ok")).withColumn("success_rate", F.col("ok") / F.col("calls") * 100)


def usage(log: DataFrame, now: str, days: int) -> DataFrame:
    """H-03: (ts, kind, tokens_in, tokens_out) of the last days: calls and tokens by kind, and in all (kind null)."""
    end = F.lit(now).cast("timestamp_ntz")
    recent = log.filter((F.col("ts") >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("ts") <= end))
    good = F.col("tokens_in").try_cast("bigint").isNotNull() & F.col("tokens_out").try_cast("bigint").isNotNull()
    tokens = F.when(good, F.col("tokens_in").try_cast("bigint") + F.col("tokens_out").try_cast("bigint")).otherwise(0)
    return recent.rollup("kind").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))


def blocked(log: DataFrame, domain: str, listicle: str | None) -> DataFrame:
    """H-05: one row: events, distinct domains, flagged pages (null without that field)."""
    flagged = F.count_if(F.coalesce(F.col(listicle), F.lit(False))) if listicle else F.lit(None).cast("long")
    return log.agg(F.count("*").alias("events"), F.count_distinct(F.coalesce(domain, F.lit("unknown"))).alias("domains"), flagged.alias("listicles"))


def top_domains(log: DataFrame, domain: str, n: int = 5) -> DataFrame:
    """H-05: the most frequent domains; ties in order of name."""
    return log.groupBy(F.coalesce(domain, F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(n)


#: Values of one key that may meet in one buffer; keys with more are selected from by histograms.
MEDIAN_BUFFER, MEDIAN_BINS = 1 << 18, 1024


def medians(rows: DataFrame, key: str, value: str, buffer: int = MEDIAN_BUFFER, bins: int = MEDIAN_BINS) -> DataFrame:
    """(key, median): the exact median of each key's values that are not null, NaN being the largest.

    Where no key has more than ``buffer`` values they are sorted in a buffer.
    Otherwise the one or two values in the middle are searched for in rounds: the
    values between the ends known so far are counted in ``bins`` bins, combined in
    each task, and the bin with the wanted rank gives the next ends, its own
    smallest and largest value.  No task sees a key's values, whatever their number.
    """
    x = F.col(value).cast("double")
    rows = rows.select(key, F.nanvl(x, F.lit(float("inf"))).alias("_v")).filter("_v is not null")
    span = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if (span.agg(F.max("_n")).first()[0] or 0) <= buffer:
        return rows.groupBy(key).agg(F.median("_v").alias("median"))
    folder = Folder(rows.sparkSession, "medians")
    ranks = F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))
    want = folder.save(span.select(key, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below")), "0")
    step = 0
    while not (ahead := want.filter("_lo < _hi")).isEmpty():
        # Even bins by magnitude and by value in turn: values may lie anywhere between the smallest and the largest doubles.
        scale = (lambda c: F.signum(c) * (F.log(F.abs(c)) + 800)) if step % 2 == 0 else (lambda c: c / 2)
        lo, hi, at = (F.coalesce(scale(F.col(c)), F.lit(0.0)) for c in ("_lo", "_hi", "_v"))
        share = F.nanvl(F.try_divide(at - lo, hi - lo), F.lit(0.0))
        part = F.coalesce(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * bins), F.lit(0))
        # The ends have bins of their own, so each round leaves fewer different values.
        place = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), bins + 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(bins), part.cast("int") + 1)))
        # NULL keys are a key like others.
        met = rows.withColumnRenamed(key, "_k").join(ahead, F.col("_k").eqNullSafe(F.col(key))).filter("_v between _lo and _hi")
        bin_ = met.groupBy(key, "_rank", "_below", place.alias("_place")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        start = F.sum("_n").over(Window.partitionBy(key, "_rank").orderBy("_place")) - F.col("_n") + F.col("_below")
        found = bin_.withColumn("_start", start).filter("_start <= _rank and _rank < _start + _n").select(key, "_rank", "_lo", "_hi", F.col("_start").alias("_below"))
        step += 1
        want = folder.save(want.filter("_lo >= _hi").unionByName(found), str(step))
    return want.groupBy(key).agg(F.avg("_lo").alias("median"))


def scorecard(runs: DataFrame, method: str, ok: str, elapsed: str, chars: str, buffer: int = MEDIAN_BUFFER) -> DataFrame:
    """H-06: attempts, success in percent, exact medians and verdict by method."""
    rows = runs.withColumn("method", F.col(method))
    out = rows.groupBy("method").agg(F.count("*").alias("attempts"), (F.count_if(ok) / F.count("*") * 100).alias("success_pct"))
    for value, name in ((elapsed, "median_ms"), (chars, "median_chars")):
        found = medians(rows, "method", value, buffer).withColumnsRenamed({"method": "_m", "median": name})
        out = out.join(found, F.col("method").eqNullSafe(F.col("_m")), "left").drop("_m")
    v = F.when(F.col("success_pct") >= 50, "KEEP").when((F.col("success_pct") >= 25) & (F.col("median_ms") > 15000), "SLOW-LOW-YIELD").when(F.col("success_pct") < 25, "DROP-CANDIDATE").otherwise("LOW-YIELD")
    return out.withColumn("verdict", v)


def status_counts(log: DataFrame, status: str, *keys: str) -> DataFrame:
    """H-07: how many of each status, and in all (status null), by ``keys``."""
    return log.groupingSets([[*keys, status], [*keys]], *keys, status).agg(F.count("*").alias("n")) if keys else log.rollup(status).agg(F.count("*").alias("n"))


def checker_usage(calls: DataFrame, key: str, prompt: str, output: str) -> DataFrame:
    """H-10: per key calls, characters of prompts and outputs, and estimated tokens: a quarter of them, halves to even, 1 at least where there are any."""
    tokens = lambda n: F.when(F.col(n) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col(n) / 4))).cast("long")
    out = calls.groupBy(key).agg(F.count("*").alias("calls"), F.sum(F.length(F.coalesce(prompt, F.lit("")))).alias("prompt_chars"), F.sum(F.length(F.coalesce(output, F.lit("")))).alias("output_chars"))
    return out.withColumn("prompt_tokens", tokens("prompt_chars")).withColumn("output_tokens", tokens("output_chars"))


def still_dead(dead: DataFrame, alive: DataFrame, *keys: str) -> DataFrame:
    """F-12: dead keys that no test has found alive."""
    return dead.join(alive.select(*keys).distinct(), list(keys), "left_anti")


def engine_detail(requested: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """F-16: per key the requested engines(key, pos, engine) that the registry(engine, enabled) does not know, and those it has disabled, in order."""
    met = requested.join(registry, "engine", "left")
    names = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "engine")))), lambda x: x["engine"]), ",")
    shown = lambda x: F.when(x == "", "-").otherwise(x)
    out = met.groupBy(key).agg(names(F.col("enabled").isNull()).alias("u"), names(~F.col("enabled")).alias("d"))
    return out.select(key, F.concat(F.lit("UNKNOWN="), shown(F.col("u")), F.lit(" DISABLED="), shown(F.col("d"))).alias("detail"))


def report(rows: DataFrame, key: str, title: str, pos: str, line: Column) -> DataFrame:
    """B-08: one Markdown text per key: a heading and its lines in order.  For reports, whose lines are few."""
    said = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("l")))), lambda x: F.concat(F.lit("- "), x["l"]))
    return rows.groupBy(key).agg(F.concat(F.lit(f"## {title}\n\n"), F.array_join(said, "\n")).alias("report"))


def payload_domains(results: DataFrame, key: str, domain: str) -> DataFrame:
    """H-08: results, distinct domains and the share of the most frequent one, per payload: counted by domain first, so a hot payload is combined early."""
    by = results.groupBy(key, domain).agg(F.count("*").alias("n"))
    known = F.col(domain).isNotNull()
    out = by.groupBy(key).agg(F.sum("n").alias("results"), F.count_if(known).alias("domains"), F.max(F.when(known, F.col("n"))).alias("most"), F.sum(F.when(known, F.col("n"))).alias("with_domain"))
    return out.select(key, "results", "domains", F.when(F.col("domains") == 0, 1.0).otherwise(F.col("most") / F.col("with_domain")).alias("top_share"))


def daily_budget(log: DataFrame, ts: str, cap: int) -> DataFrame:
    """H-11: uses by day and whether the cap is reached."""
    return log.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("used")).withColumn("exhausted", F.col("used") >= cap)


def session_row(calls: DataFrame, key: str, lane: str, ok: str, model: str) -> DataFrame:
    """H-04: sorted distinct lanes, failed lanes and models of a session."""
    return calls.groupBy(key).agg(F.array_sort(F.collect_set(lane)).alias("lanes"), F.array_sort(F.collect_set(F.when(~F.col(ok), F.col(lane)))).alias("failed_lanes"), F.array_sort(F.collect_set(model)).alias("models"), F.count("*").alias("calls"))


def telemetry_row(sessions: DataFrame, now: str) -> DataFrame:
    """H-04: the log's row of each session document, with its 22 fields.

    A session has the scalars of the row and session_file, and sources(domain), queries_run(lane, worker_model, error),
    territories(assigned_worker_model), gemini_pro_runs(run_type), and of its audit flagged and claims.  Lists are sorted and
    distinct, without nulls and empty strings; a list that is null has no entries; a question has 200 characters at most.
    """
    listed = lambda c, field: F.coalesce(F.transform(c, lambda x: x[field]), F.array().cast("array<string>"))
    unique = lambda x: F.array_sort(F.array_distinct(F.filter(x, lambda v: F.coalesce(v, F.lit("")) != "")))
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    failed = F.filter("queries_run", lambda q: F.coalesce(q["error"], F.lit("")) != "")
    return sessions.select(
        F.lit(now).alias("ts"),
        F.coalesce("updated_at", "created_at").alias("run_ts"),
        "protocol",
        F.coalesce(F.nullif(F.col("triggered_by"), F.lit("")), F.lit("unknown")).alias("agent"),
        F.lit("observer").alias("source"),
        F.left(F.coalesce("question", F.lit("")), F.lit(200)).alias("question"),
        "final_status",
        "answer_kind",
        "confidence",
        count("sources").alias("n_sources"),
        unique(listed("sources", "domain")).alias("source_domains"),
        count("queries_run").alias("n_queries"),
        unique(listed("queries_run", "lane")).alias("lanes_used"),
        unique(listed(failed, "lane")).alias("lanes_failed"),
        unique(F.concat(listed("territories", "assigned_worker_model"), listed("queries_run", "worker_model"), listed("gemini_pro_runs", "run_type"))).alias("models_used"),
        F.coalesce("flagged", F.lit(False)).alias("flagged"),
        F.coalesce("claims", F.array().cast(sessions.schema["claims"].dataType)).alias("flagged_claims"),
        F.col("total_cost_usd_estimate").alias("cost_usd"),
        F.col("total_duration_ms").alias("duration_ms"),
        "iteration_count",
        "session_id",
        "session_file",
    )


def breaker(log: DataFrame, key: str, ts: str, order: str, ok: str, failures: int = 3, within: str = "1 HOUR") -> DataFrame:
    """L-05: the circuit as each event finds it: open if ``failures`` or more came in a row before it and the last of them less than ``within`` ago; a success resets.

    ``failures`` counts those before the event.  The state of a key is a running
    count over its own events; many keys, each with a log of its own size, are the case this is for.
    """
    w = Window.partitionBy(key).orderBy(ts, order)
    run = log.withColumn("_reset", F.sum(F.when(F.col(ok), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.sum(F.when(F.col(ok), 0).otherwise(1)).over(Window.partitionBy(key, "_reset").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0))
    run = run.withColumn("_count", count)
    before = F.coalesce(F.lag("_count").over(w), F.lit(0))
    return run.withColumn("failures", before.cast("long")).withColumn("open", (F.col("failures") >= failures) & F.coalesce(F.col(ts) < F.lag(ts).over(w) + F.expr(f"INTERVAL {within}"), F.lit(False))).drop("_reset", "_count")


def too_fast(log: DataFrame, key: str, ts: str, order: str, seconds: float) -> DataFrame:
    """I-08: events that come sooner after the one before than they may."""
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(Window.partitionBy(key).orderBy(ts, order)).cast("timestamp"))
    return log.withColumn("gap_us", gap).filter(F.col("gap_us") < int(seconds * 1e6))


def state_changes(log: DataFrame, key: str, ts: str, order: str, alive: str) -> DataFrame:
    """F-11, I-04: newly dead and revived against the state before."""
    was = F.lag(alive).over(Window.partitionBy(key).orderBy(ts, order))
    return log.withColumn("change", F.when(was & ~F.col(alive), "newly_dead").when(~was & F.col(alive), "revived")).filter("change is not null")


def round_robin(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """I-07: slots in turn."""
    return df.withColumn("slot", F.pmod(F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1, F.lit(n)))


def least_used(accounts: DataFrame, key: str, used: str, last: str, cap: float = 4.90) -> DataFrame:
    """A-23: per key the account below the cap that was used longest ago (never used first, then by name)."""
    return accounts.filter(F.col(used) < cap).groupBy(key).agg(F.min_by("account", F.struct(F.col(last).isNotNull().alias("n"), F.col(last).alias("t"), F.col("account").alias("a"))).alias("account"))


def cache_hits(log: DataFrame, key: str, ts: str, order: str, ttl: str) -> DataFrame:
    """L-03: whether each request finds its key in a cache that forgets ``ttl`` after the last request for it; :func:`streaming.streams.cache` does the same, and caches that reading does not extend, as a stream."""
    return log.withColumn("hit", F.coalesce(F.col(ts) <= F.lag(ts).over(Window.partitionBy(key).orderBy(ts, order)) + F.expr(f"INTERVAL {ttl}"), F.lit(False)))


def newest_entries(entries: DataFrame, ts: str, order: str, keep: int = 500) -> DataFrame:
    """L-03: the entries that stay when a cache is pruned to its ``keep`` newest."""
    return entries.orderBy(F.desc(ts), F.desc(order)).limit(keep)


def latest_snapshots(log: DataFrame, url: str, ts: str, status: str, since: str = "2020-01-01") -> DataFrame:
    """A-20: per address its newest good snapshot since a day."""
    good = log.filter((F.col(status) == 200) & (F.col(ts) >= F.lit(since).cast("timestamp_ntz")))
    return good.groupBy(url).agg(F.max(ts).alias("snapshot"))


def reapable(now: Column, last_request: Column, locked: Column, last_reap: Column, idle: int = 300, fresh: int = 600) -> Column:
    """L-07: whether idle helpers may be stopped: the last request is ``idle`` seconds ago, no lock younger than ``fresh`` seconds, and not reaped since that request."""
    age = lambda x: F.unix_micros(now.cast("timestamp")) - F.unix_micros(x.cast("timestamp"))
    held = F.coalesce(age(locked) < fresh * 1_000_000, F.lit(False))
    done = F.coalesce(last_request <= last_reap, F.lit(False))
    return F.coalesce(age(last_request) >= idle * 1_000_000, F.lit(False)) & ~held & ~done


def first_of(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """I-01, L-12: the first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def preflight(kill: Column, breaker_open: Column, ram: Column, pressure: Column, swap: Column, disk: Column, probe: Column) -> Column:
    """L-06: the first gate that is shut, in order."""
    out = F.lit("ok")
    for name, shut in reversed([("killswitch", kill), ("breaker", breaker_open), ("ram", ram), ("pressure", pressure), ("swap", swap), ("disk", disk), ("probe", probe)]):
        out = F.when(shut, name).otherwise(out)
    return out
