"""Queries over the event log as a log of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, caches, gaps, queries, rollups, routing, sessions
from .registry import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@R.query("SELECT event_type AS lane, count(*) AS calls, count(*) FILTER (value > 10) AS ok, count(*) - count(*) FILTER (value > 10) AS failed, round(avg(value), 6) AS avg_ms, round(count(*) FILTER (value > 10) / count(*) * 100, 6)::DOUBLE AS success_rate FROM events GROUP BY 1")
def calls_by_lane(spark, sf_dir):
    log = _events(spark, sf_dir).select(F.col("event_type").alias("lane"), (F.col("value") > 10).alias("ok"), F.col("value").alias("duration"))
    return rollups.calls_by_lane(log).select("lane", "calls", "ok", "failed", F.round("avg_ms", 6).alias("avg_ms"), F.round("success_rate", 6).alias("success_rate"))


_USAGE = "WITH l AS (SELECT event_type AS kind, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS t FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-31')"


def _usage(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    log = _events(spark, sf_dir).select("ts", F.col("event_type").alias("kind"), k.alias("tokens_in"), F.lit("0").alias("tokens_out"))
    return rollups.usage(log, "2024-01-31", 7)


@R.query(f"{_USAGE} SELECT kind, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens FROM l GROUP BY ROLLUP(kind)")
def usage_rollup(spark, sf_dir):
    return _usage(spark, sf_dir)


@R.query(f"{_USAGE} SELECT kind, count(*) AS calls, CAST(sum(t) AS BIGINT) AS tokens FROM l GROUP BY kind")
def llm_usage_window(spark, sf_dir):
    return _usage(spark, sf_dir).filter("kind is not null")


@R.query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS lanes, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (value <= 10)), ';'), '') AS failed_lanes, count(*) AS calls FROM events GROUP BY user_id")
def session_row(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ok", F.col("value") > 10)
    out = rollups.session_row(e, "user_id", "event_type", "ok", "event_type")
    return out.select("user_id", F.array_join("lanes", ";").alias("lanes"), F.array_join("failed_lanes", ";").alias("failed_lanes"), "calls")


@R.query("WITH m AS (SELECT event_type AS method, count(*) AS attempts, count(*) FILTER (value > 20) / count(*) * 100 AS p, median(value) AS ms, median(user_id) AS chars FROM events GROUP BY 1) SELECT method, attempts, round(p, 6)::DOUBLE AS success_pct, round(ms, 6) AS median_ms, chars::DOUBLE AS median_chars, CASE WHEN p >= 50 THEN 'KEEP' WHEN p >= 25 AND ms > 15000 THEN 'SLOW-LOW-YIELD' WHEN p < 25 THEN 'DROP-CANDIDATE' ELSE 'LOW-YIELD' END AS verdict FROM m")
def extractor_scorecard(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("good", F.col("value") > 20)
    out = rollups.scorecard(e, "event_type", "good", "value", "user_id")
    return out.select("method", "attempts", F.round("success_pct", 6).alias("success_pct"), F.round("median_ms", 6).alias("median_ms"), "median_chars", "verdict")


@R.query("SELECT CAST(ts AS DATE) AS day, count(*) AS used, count(*) >= 300 AS exhausted FROM events GROUP BY 1")
def budget_by_day(spark, sf_dir):
    return rollups.daily_budget(_events(spark, sf_dir), "ts", 300)


SQL_BREAKER = """r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
 f AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS n FROM r),
 b AS (SELECT user_id, event_id, coalesce(lag(n) OVER w, 0) AS failures, coalesce(ts < lag(ts) OVER w + INTERVAL 100 HOUR, false) AS near FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 c AS (SELECT user_id, event_id, CAST(failures AS BIGINT) AS failures, failures >= 3 AND near AS open FROM b)"""


@R.query(f"WITH {SQL_BREAKER} SELECT * FROM c")
def breaker_open_intervals(spark, sf_dir):
    """The circuit of a user as each event finds it, for a hundred hours: the log has an event of a user every few hours."""
    e = _events(spark, sf_dir).withColumn("ok", F.expr("event_type <> 'error'"))
    return rollups.breaker(e, "user_id", "ts", "event_id", "ok", within="100 HOURS").select("user_id", "event_id", "failures", "open")


@R.query("WITH g AS (SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events) SELECT user_id, event_id, gap_us FROM g WHERE gap_us < 60000000")
def rate_limit_violations(spark, sf_dir):
    return rollups.too_fast(_events(spark, sf_dir), "user_id", "ts", "event_id", 60).select("user_id", "event_id", "gap_us")


@R.query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 5 AS INT) AS slot FROM events")
def round_robin(spark, sf_dir):
    return rollups.round_robin(_events(spark, sf_dir), "user_id", "event_id", 5).select("event_id", "slot")


@R.query("WITH s AS (SELECT event_id, user_id, event_type <> 'error' AS alive, lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT user_id, event_id, CASE WHEN was AND NOT alive THEN 'newly_dead' ELSE 'revived' END AS change FROM s WHERE was <> alive")
def state_delta(spark, sf_dir):
    return rollups.state_changes(_events(spark, sf_dir).withColumn("alive", F.expr("event_type <> 'error'")), "user_id", "ts", "event_id", "alive").select("user_id", "event_id", "change")


@R.query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def cold_starts(spark, sf_dir):
    return rollups.first_of(_events(spark, sf_dir), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@R.query("SELECT event_id, CASE WHEN value < 1 THEN 'killswitch' WHEN event_type = 'error' THEN 'breaker' WHEN value > 90 THEN 'ram' WHEN user_id % 5 = 0 THEN 'pressure' WHEN user_id % 7 = 0 THEN 'swap' WHEN event_id % 11 = 0 THEN 'disk' WHEN event_id % 13 = 0 THEN 'probe' ELSE 'ok' END AS gate FROM events")
def preflight_gates(spark, sf_dir):
    c = F.col
    shut = [c("value") < 1, F.expr("event_type = 'error'"), c("value") > 90, c("user_id") % 5 == 0, c("user_id") % 7 == 0, c("event_id") % 11 == 0, c("event_id") % 13 == 0]
    return _events(spark, sf_dir).select("event_id", rollups.preflight(*shut).alias("gate"))


@R.query("SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ROLLUP(event_type)")
def status_counts(spark, sf_dir):
    """H-07."""
    return rollups.status_counts(_events(spark, sf_dir).withColumnRenamed("event_type", "status"), "status")


@R.query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE value > 300)")
def still_dead_keys(spark, sf_dir):
    """F-12."""
    e = _events(spark, sf_dir)
    return rollups.still_dead(e.filter("event_type = 'error'").select("user_id").distinct(), e.filter("value > 300"), "user_id")


@R.query("""WITH r AS (SELECT user_id, event_id AS pos, 'e' || event_id % 9 AS engine FROM events), g AS (SELECT 'e' || i AS engine, i % 3 <> 0 AS enabled FROM range(6) t(i)), m AS (SELECT r.*, enabled FROM r LEFT JOIN g USING (engine))
 SELECT user_id, 'UNKNOWN=' || coalesce(string_agg(engine, ',' ORDER BY pos) FILTER (enabled IS NULL), '-') || ' DISABLED=' || coalesce(string_agg(engine, ',' ORDER BY pos) FILTER (NOT enabled), '-') AS detail FROM m GROUP BY user_id""")
def engine_details(spark, sf_dir):
    """F-16: each event asks for one of nine engines, of which six are known and two of these disabled."""
    asked = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("pos"), F.concat(F.lit("e"), F.col("event_id") % 9).alias("engine"))
    known = spark.range(6).select(F.concat(F.lit("e"), F.col("id")).alias("engine"), (F.col("id") % 3 != 0).alias("enabled"))
    return rollups.engine_detail(asked, known, "user_id")


@R.query("SELECT event_type, arg_min(account, (n, t, account)) AS account FROM (SELECT event_type, 'a' || user_id AS account, sum(value) / 1000 AS used, max(ts) FILTER (value > 5) IS NOT NULL AS n, max(ts) FILTER (value > 5) AS t FROM events GROUP BY event_type, user_id) WHERE round(used, 9) < 0.4 GROUP BY event_type")
def least_used_accounts(spark, sf_dir):
    """A-23: users as accounts of a kind of event."""
    by = _events(spark, sf_dir).groupBy("event_type", F.concat(F.lit("a"), F.col("user_id")).alias("account")).agg(F.round(F.sum("value") / 1000, 9).alias("used"), F.max(F.when(F.col("value") > 5, F.col("ts"))).alias("last"))
    return rollups.least_used(by, "event_type", "used", "last", 0.4)


SQL_CACHE = "h AS (SELECT event_id, user_id, coalesce(ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR, false) AS hit FROM events)"


@R.query(f"WITH {SQL_CACHE} SELECT event_id, hit FROM h")
def cache_hits(spark, sf_dir):
    """L-03."""
    return rollups.cache_hits(_events(spark, sf_dir), "user_id", "ts", "event_id", "6 HOURS").select("event_id", "hit")


@R.query("""WITH e AS (SELECT event_id, user_id || ':' || event_type AS key, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events), p AS (SELECT *, lag(pos) OVER w AS before, us - lag(us) OVER w AS gap FROM e WINDOW w AS (PARTITION BY key ORDER BY pos)),
 d AS (SELECT p.event_id, count(DISTINCT e.key) AS others FROM p LEFT JOIN e ON e.pos > p.before AND e.pos < p.pos WHERE gap <= 21600000000 GROUP BY p.event_id)
 SELECT p.event_id, p.key, coalesce(others < 50, false) AS hit FROM p LEFT JOIN d USING (event_id)""")
def cache_evictions(spark, sf_dir):
    """L-03: a cache of fifty that forgets after six hours and drops what was not read for longest; keys are users' kinds of events."""
    log = _events(spark, sf_dir).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return caches.lru_hits(log, "key", "ts", "event_id", 50).select(F.col("order").alias("event_id"), "key", "hit")


@R.query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id DESC LIMIT 500")
def cache_newest(spark, sf_dir):
    """L-03: what stays when the cache is pruned; the limit is the cache's."""
    return rollups.newest_entries(_events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("ts")), "ts", "user_id")


@R.query("SELECT count(*) FILTER (event_type = 'click') AS used, count(*) FILTER (event_type = 'view' AND ts > TIMESTAMP '2024-01-03 11:30:00') AS leased, count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'view' AND ts > TIMESTAMP '2024-01-03 11:30:00') < 300 AS may FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-03'")
def live_leases(spark, sf_dir):
    """L-08, H-11: clicks as uses, views as leases of half an hour."""
    log = _events(spark, sf_dir).select("ts", F.when(F.expr("event_type = 'click'"), "used").when(F.expr("event_type = 'view'"), "leased").alias("kind"))
    return assembly.live_leases(log, "2024-01-03", "2024-01-03 12:00:00")


@R.query("SELECT user_id, count(DISTINCT CASE WHEN value > 5 AND event_type <> 'error' THEN event_id % 4 END) AS models, CASE WHEN count(DISTINCT CASE WHEN value > 5 AND event_type <> 'error' THEN event_id % 4 END) >= 3 THEN 'deep' ELSE 'one_llm' END AS tier FROM events GROUP BY user_id")
def answering_models(spark, sf_dir):
    """G-37."""
    calls = _events(spark, sf_dir).select("user_id", F.when(F.col("value") > 5, 1).otherwise(0).alias("results"), F.when(F.expr("event_type = 'error'"), "e").alias("error"), (F.col("event_id") % 4).alias("model"))
    return gaps.answering_models(calls, "user_id")


_LIMITS = "(VALUES " + ", ".join(f"('{p}', '{t}', {d}, {q}, {n}, {b})" for (p, t), (d, q, n, b) in gaps.LIMITS.items()) + ") l(protocol, tier, depth, questions, leaves, budget)"


@R.query(f"""WITH e AS (SELECT event_id, ['search', 'research', 'deep_research'][1 + event_id % 3] AS protocol, user_id % 5 AS models FROM events), t AS (SELECT *, CASE WHEN models >= 3 THEN 'deep' ELSE 'one_llm' END AS tier FROM e)
 SELECT event_id, CASE WHEN l.depth IS NULL THEN 'flat' ELSE t.tier END AS tier, CAST(coalesce(l.depth, 0) AS INT) AS depth, CAST(coalesce(l.questions, 0) AS INT) AS questions, CAST(coalesce(l.leaves, 0) AS INT) AS leaves, coalesce(l.budget, 0)::DOUBLE AS budget FROM t LEFT JOIN {_LIMITS} ON l.protocol = t.protocol AND l.tier = t.tier""")
def recursion_limits(spark, sf_dir):
    """G-38."""
    protocol = F.get(F.array(*map(F.lit, ("search", "research", "deep_research"))), (F.col("event_id") % 3).cast("int"))
    return _events(spark, sf_dir).select("event_id", gaps.recursion_limits(protocol, F.col("user_id") % 5).alias("l")).select("event_id", "l.*")


@R.query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'SKIP' WHEN 1 THEN CASE WHEN event_type = 'error' OR value > 40 THEN 'FAIL' WHEN user_id % 4 = 0 THEN 'EMPTY' WHEN user_id % 4 = 1 THEN 'CHECK' ELSE 'OK' END WHEN 2 THEN CASE WHEN value > 20 THEN 'OK' ELSE 'FAIL' END WHEN 3 THEN CASE WHEN value > 20 THEN 'OK' ELSE 'CHECK' END ELSE 'CHECK' END AS status, CASE WHEN user_id % 3 = 0 THEN 'FAIL' ELSE 'OK' END AS rung FROM events")
def lane_health(spark, sf_dir):
    """N-21."""
    c = F.col
    kind = F.get(F.array(*map(F.lit, ("mcp", "api", "cli", "local", "scrape"))), (c("event_id") % 5).cast("int"))
    results = F.when(c("user_id") % 4 == 1, None).when(c("user_id") % 4 == 0, 0).otherwise(3)
    status = assembly.lane_health(kind, F.lit(False), c("value") > 20, F.when(c("value") > 40, 500).otherwise(200), results, F.when(F.expr("event_type = 'error'"), "e"))
    needs = F.when(c("user_id") % 3 == 0, F.array(F.lit("docling"), F.lit("fitz"))).otherwise(F.array(F.lit("fitz")))
    return _events(spark, sf_dir).select("event_id", status.alias("status"), assembly.rung_health(needs, F.array(F.lit("fitz"))).alias("rung"))


@R.query("SELECT user_id, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS \"all\", max(n) >= 25 OR sum(n) >= 25 AS enough FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def enough_free(spark, sf_dir):
    """N-12."""
    return assembly.enough_free(_events(spark, sf_dir), "user_id", "event_type", 25)


@R.query("""SELECT event_id, NOT event_id IS NULL AS ts_known, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'boom' END AS error, CAST(user_id % 7 AS INT) AS result_count, CASE WHEN user_id % 2 = 0 THEN 'unknown' ELSE 'bot' END AS agent, ['GOOD', 'THIN', 'EMPTY', 'ERROR', NULL][1 + event_id % 5] AS verdict, event_id % 3 = 0 AS retry, CASE WHEN event_id % 3 = 0 THEN CAST(4 AS INT) END AS prior FROM events""")
def call_rows(spark, sf_dir):
    """D-12."""
    c = F.col
    verdict = F.get(F.array(*[F.lit(x).cast("string") for x in ("GOOD", "THIN", "EMPTY", "ERROR", None)]), (c("event_id") % 5).cast("int"))
    calls = _events(spark, sf_dir).select(F.struct("event_id", "ts").alias("ts"), F.lit("research").alias("protocol"), F.lit("code").alias("topic"), c("event_type").alias("lane"), F.when(F.expr("event_type = 'error'"), "boom").alias("error"), (c("user_id") % 7).cast("int").alias("result_count"), F.lit(0).alias("duration_ms"), F.when(c("user_id") % 2 == 0, " ").otherwise("bot").alias("agent"), verdict.alias("verdict"), F.lit(2).alias("domains"), F.lit(0.5).alias("top_share"), F.lit(4).alias("prior_count"), F.when(c("event_id") % 3 == 0, "THIN").alias("prior_verdict"), F.array(F.lit("x")).alias("transforms"))
    out = queries.call_rows(calls)
    return out.select(c("ts.event_id").alias("event_id"), c("ts.ts").isNotNull().alias("ts_known"), "ok", "error", "result_count", "agent", c("retrieval_verdict").alias("verdict"), c("query_retry").alias("retry"), c("query_retry_prior_result_count").alias("prior"))


def _searches(spark, sf_dir):
    n = F.col("event_id") % 6
    body = F.when(n == 0, "oops").when(n == 1, '{"results": []}').when(n == 2, '{"results": [{"a": 1}, 2, {"b": {}}]}').when(n == 3, '{"error": "down ", "results": [{}]}').when(n == 4, '{"error": {"code": 5}, "results": [{}, {}]}').otherwise("[1]")
    return _events(spark, sf_dir).select(F.col("event_id").alias("key"), F.col("event_type").alias("lane"), F.col("props").alias("question"), body.alias("payload"), (F.col("event_id") % 7 == 0).alias("skipped"))


@R.query("SELECT event_id AS key, event_type AS lane, CAST(CASE event_id % 6 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS INT) AS result_count, CASE WHEN event_id % 6 = 3 THEN 'down ' END AS error FROM events WHERE event_id % 7 <> 0")
def query_calls(spark, sf_dir):
    """D-13: payloads of all shapes."""
    return queries.query_calls(_searches(spark, sf_dir), "question").select("key", "lane", "result_count", "error")


@R.query("""SELECT event_id AS key, CASE event_id % 6 WHEN 0 THEN 'search returned a non-object payload' WHEN 5 THEN 'search returned a non-object payload' WHEN 1 THEN 'search degraded: 0 results' WHEN 3 THEN 'search degraded: down' WHEN 4 THEN 'search degraded: {"code":5}' END AS note FROM events""")
def search_errors(spark, sf_dir):
    """N-10."""
    return _searches(spark, sf_dir).select("key", queries.search_error(F.col("payload")).alias("note"))


@R.query("""SELECT event_id, CAST(i AS INT) AS pos, lane, CASE WHEN lane = 'lost' THEN 'lost api lane config failed' END AS error FROM (SELECT event_id, unnest([0, 1, 2, 3]) AS i, unnest(['arxiv', 'lost', 'dear', 'odd']) AS lane FROM events) WHERE lane IN ('arxiv', 'lost')""")
def free_lanes(spark, sf_dir):
    """N-11, C-08: one lane is free, one unknown, one costs, one says nothing of use."""
    config = spark.sql("SELECT * FROM VALUES ('arxiv', 'api', '0.0'), ('dear', 'api', '0.01'), ('odd', 'api', 'free') AS t(lane, type, cost_per_call_usd)")
    lanes = F.array(*map(F.lit, ("arxiv", "lost", "arxiv", "dear", "odd")))
    return queries.free_lanes(_events(spark, sf_dir).select("event_id", lanes.alias("lanes")), ["event_id"], "lanes", config)


@R.query("SELECT lane, cost FROM (SELECT DISTINCT event_type AS lane FROM events) LEFT JOIN (VALUES ('click', 0.5::DOUBLE), ('view', 0.0)) c(lane, cost) USING (lane)")
def lane_costs(spark, sf_dir):
    """F-08."""
    config = spark.sql("SELECT * FROM VALUES ('click', '0.5'), ('view', '0'), ('error', 'none') AS t(lane, cost_per_call_usd)")
    return routing.with_cost(_events(spark, sf_dir).select(F.col("event_type").alias("lane")).distinct(), config)


_ROLES = "['cross_model_verifier', 'counter_evidence', 'worker', 'scout'][1 + event_id % 4]"
_MODELS = "['opus', 'Sonnet', 'grok', 'unheard', 'gemini-flash'][1 + event_id % 5]"


@R.query(f"""WITH e AS (SELECT event_id, {_ROLES} AS role, {_MODELS} AS asked, lower({_MODELS}) AS m FROM events)
 SELECT event_id, CASE role WHEN 'cross_model_verifier' THEN CASE WHEN m = 'opus' THEN 'opus' ELSE 'sonnet' END WHEN 'counter_evidence' THEN 'grok' ELSE m END AS model, CASE role WHEN 'cross_model_verifier' THEN CASE WHEN m = 'opus' THEN 'opus_subagent' ELSE 'sonnet_inline' END WHEN 'counter_evidence' THEN 'grok_cli' ELSE CASE m WHEN 'opus' THEN 'opus_subagent' WHEN 'sonnet' THEN 'sonnet_inline' WHEN 'grok' THEN 'grok_cli' WHEN 'gemini-flash' THEN 'agy_cli' ELSE 'haiku_subagent' END END AS provider,
  'work/a-topic/' || role || '-t' || event_id || '.brief.md' AS path, starts_with(m, 'gemini-') AS quota, CASE WHEN m = 'gemini-flash' AND (event_id % 3 = 0 OR event_id % 2 = 0) THEN 'night' ELSE asked END AS runs FROM e""")
def dispatches(spark, sf_dir):
    """C-14, C-18."""
    i = F.col("event_id")
    role = F.get(F.array(*map(F.lit, ("cross_model_verifier", "counter_evidence", "worker", "scout"))), (i % 4).cast("int"))
    model = F.get(F.array(*map(F.lit, ("opus", "Sonnet", "grok", "unheard", "gemini-flash"))), (i % 5).cast("int"))
    path = routing.work_paths(F.lit(" A  topic!"), role, F.concat(F.lit("T"), i), "brief")
    runs = routing.resolve_model(model, "gemini-flash", "night", i % 3 != 0, F.when(i % 2 == 0, " Cron ").otherwise("0"))
    return _events(spark, sf_dir).select("event_id", routing.dispatch(role, model).alias("d"), path.alias("path"), routing.uses_quota(model).alias("quota"), runs.alias("runs")).select("event_id", "d.model", "d.provider", "path", "quota", "runs")


@R.query("WITH f AS (SELECT user_id, sum(greatest(0, event_id % 4 - 1)) AS workers, max(user_id % 30) AS declared, 20 AS lanes FROM events GROUP BY user_id) SELECT user_id, CAST(workers AS BIGINT) AS workers, declared, CAST(lanes AS INT) AS lanes FROM f WHERE workers <> declared OR workers <> lanes")
def fleet_errors(spark, sf_dir):
    """C-15."""
    e = _events(spark, sf_dir).select("user_id", (F.col("event_id") % 4 - 1).alias("count"), (F.col("user_id") % 30).alias("declared"), F.array_repeat(F.lit("x"), 20).alias("lanes"))
    return routing.fleet_errors(e, "user_id", "count", "declared", "lanes")


@R.query("SELECT event_id, CAST(i AS INT) AS pos, 'q' || i AS question, 'l' || i AS lane FROM events, range(3) r(i)")
def paired_lists(spark, sf_dir):
    """F-14."""
    some = lambda c: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit(c), i))
    rows = _events(spark, sf_dir).select("event_id", F.posexplode(routing.paired(some("q"), some("l"))).alias("pos", "r"))
    return rows.select("event_id", "pos", F.col("r")["0"].alias("question"), F.col("r")["1"].alias("lane"))


@R.query("""WITH r AS (SELECT user_id, event_id AS pos, ['scout', 'worker', 'final', 'fallback'][1 + event_id % 4] AS kind, value > 25 AS ok, 'a' || event_id AS answer FROM events), s AS (SELECT user_id, bool_or(kind = 'scout' AND ok) AS scouted, arg_min(struct_pack(kind := kind, answer := answer), (CASE kind WHEN 'final' THEN 0 ELSE 1 END, pos)) FILTER (ok AND kind IN ('final', 'fallback')) AS s FROM r GROUP BY user_id)
 SELECT user_id, CASE WHEN scouted AND s IS NOT NULL THEN s.kind ELSE 'abstain' END AS decision, CASE WHEN scouted AND s IS NOT NULL THEN s.answer END AS answer, NOT (scouted AND s IS NOT NULL) AS bypass_gate FROM s""")
def save_decisions(spark, sf_dir):
    """N-16."""
    return assembly.save_decision(_runs(spark, sf_dir), "user_id")


def _runs(spark, sf_dir):
    i = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("scout", "worker", "final", "fallback"))), (i % 4).cast("int"))
    sources = F.array(F.concat(F.lit("s"), i % 3), F.concat(F.lit("s"), i % 5))
    return _events(spark, sf_dir).select("user_id", i.alias("pos"), kind.alias("kind"), (F.col("value") > 25).alias("ok"), F.concat(F.lit("a"), i).alias("answer"), sources.alias("sources"))


@R.query("""WITH r AS (SELECT user_id, event_id AS pos, event_id % 4 = 2 AS final, value > 25 AS ok, 'a' || event_id AS answer FROM events), a AS (SELECT user_id, arg_min(answer, (CASE WHEN final THEN 0 ELSE 1 END, pos)) FILTER (ok) AS answer FROM r GROUP BY user_id),
 x AS (SELECT user_id, event_id * 2 AS place, 's' || event_id % 3 AS s FROM events UNION ALL SELECT user_id, event_id * 2 + 1, 's' || event_id % 5 FROM events), f AS (SELECT user_id, s, min(place) AS place FROM x GROUP BY ALL), l AS (SELECT user_id, string_agg(s, ',' ORDER BY place) AS sources FROM f GROUP BY user_id)
 SELECT user_id, answer, sources, CASE WHEN answer IS NULL THEN 'abstain' ELSE 'complete' END AS status FROM a JOIN l USING (user_id)""")
def assembled_sessions(spark, sf_dir):
    """N-15."""
    return assembly.assemble(_runs(spark, sf_dir), "user_id").select("user_id", "answer", F.array_join("sources", ",").alias("sources"), "status")


@R.query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'no json' WHEN 1 THEN 'said' WHEN 2 THEN 's' || chr(10) || chr(10) || 'Caveats/disagreements:' || chr(10) || '- a' || chr(10) || '- b' ELSE '' END AS summary, 'Territory: A' || chr(10) || 'Role: worker' || chr(10) || 'Worker model: m' || chr(10) || chr(10) || 'Summary:' || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'No summary produced.' END || chr(10) || chr(10) || 'Source paths:' || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'No sources recorded.' ELSE 'p' || chr(10) || 'q' END || chr(10) AS note FROM events")
def worker_outputs(spark, sf_dir):
    """N-14, N-18."""
    i = F.col("event_id")
    args = F.when(i % 4 == 0, "no json").when(i % 4 == 1, '{"summary": " said "}').when(i % 4 == 2, '{"summary": "s", "weak_evidence": ["a ", "", "b"]}')
    paths = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p"), F.lit("q")))
    note = assembly.worker_note(F.lit("A"), F.lit("worker"), F.lit("m"), F.when(i % 2 == 0, " x"), paths)
    return _events(spark, sf_dir).select("event_id", assembly.tool_summary(args).alias("summary"), note.alias("note"))


@R.query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'deep_research' WHEN 1 THEN 'research' ELSE 'search' END AS protocol FROM events")
def protocols(spark, sf_dir):
    """N-17."""
    mode = F.get(F.array(*map(F.lit, ("deep-research", "research", "search", "odd"))), (F.col("event_id") % 4).cast("int"))
    return _events(spark, sf_dir).select("event_id", assembly.protocol(mode).alias("protocol"))


@R.query("SELECT user_id, max(ts) AS snapshot FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-05' GROUP BY user_id")
def latest_snapshots(spark, sf_dir):
    """A-20: events as snapshots of users."""
    log = _events(spark, sf_dir).withColumn("status", F.when(F.expr("event_type = 'error'"), 404).otherwise(200))
    return rollups.latest_snapshots(log, "user_id", "ts", "status", "2024-01-05")


@R.query("""WITH e AS (SELECT event_id, ts, lag(ts) OVER w AS before, lag(ts, 2) OVER w AS older, event_id % 3 = 0 AS locked, event_id % 5 = 0 AS reaped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT event_id, coalesce(epoch_us(ts) - epoch_us(before) >= 300000000, false) AND NOT coalesce(locked AND epoch_us(ts) - epoch_us(older) < 600000000, false) AND NOT coalesce(reaped AND before <= before, false) AS reap FROM e""")
def reapable(spark, sf_dir):
    """L-07: at each event of a user the one before is the last request, the one before that a lock's time; a fifth was reaped since."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).select("event_id", "ts", F.lag("ts").over(w).alias("before"), F.lag("ts", 2).over(w).alias("older"))
    return e.select("event_id", rollups.reapable(F.col("ts"), F.col("before"), F.when(F.col("event_id") % 3 == 0, F.col("older")), F.when(F.col("event_id") % 5 == 0, F.col("before"))).alias("reap"))


@R.query("SELECT event_id, ['a', 'b', 'c'][1 + (event_id + 4) % 3] AS lane, CASE WHEN event_type = 'error' THEN 'x' ELSE 'y' END AS fallback FROM events")
def cyclic_lanes(spark, sf_dir):
    """C-11: a lane for a running number, and the fallback of an empty sequence."""
    e, spare = _events(spark, sf_dir), F.when(F.expr("event_type = 'error'"), "x").otherwise("y")
    return e.select("event_id", routing.cyclic_lane(F.col("event_id") + 5, ["a", "b", "c"], spare).alias("lane"), routing.cyclic_lane(F.col("event_id"), [], spare).alias("fallback"))


@R.query("SELECT o_orderkey, o_orderkey % 4 = 0 AND o_orderstatus = 'F' AS deleted FROM orders")
def soft_deleted(spark, sf_dir):
    """B-03."""
    o = table(spark, sf_dir, "orders")
    return sessions.soft_delete(o, o.filter("o_orderkey % 4 = 0 and o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey", "deleted")


@R.query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS lanes, '{"n":' || count(*) || '}' AS totals FROM events GROUP BY user_id""")
def csv_cells(spark, sf_dir):
    """B-06: cells as they are written."""
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("lanes"), F.struct(F.count("*").alias("n")).alias("totals"))
    return sessions.to_csv_cells(rows)


@R.query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (value > 20)) AS a, list_sort(list(DISTINCT event_type) FILTER (value < 30)) AS b FROM events GROUP BY user_id)
 SELECT user_id, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS less, len(list_intersect(coalesce(a, []), coalesce(b, []))) = len(coalesce(a, [])) AS subset, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS both FROM s""")
def lane_sets(spark, sf_dir):
    """K: difference, subset and union of the lanes of slow and of fast calls."""
    s = _events(spark, sf_dir).groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 30, F.col("event_type"))).alias("b"))
    return s.select("user_id", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("less"), (F.size(F.array_except("a", "b")) == 0).alias("subset"), F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("both"))
