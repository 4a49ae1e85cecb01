"""Queries from sources and claims to confidence, decisions, gaps and sessions.

A document stands for a source of the session that its family numbers, a
benchmark item for a claim of the session ``item_id % 20``.  Domain, date and
topic, which the tables do not hold, follow from the numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import containment, evidence, gaps, gates, rollups, routing, sessions
from ..sources.stages import Folder
from .documents import SQL_SQUASH, SQL_TOKENS
from .registry import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

DOMAINS = ["nytimes.com", "www.reuters.com", "github.com", "arxiv.org", "x.com", "docs.python.org", "blog.example.org", "supremecourt.gov"]
TOPICS = ["legal", "code", "academic", "news", "social"]
DATES = [None, "2023", "2023-11", "2024-01-14", "soon"]
NOW = "2024-01-15 00:00:00"

#: The windows of E-14 by recursion, as RE2 has no lookahead: (doc_id, block, k, w) with k from 1.
SQL_WINDOWS = f"""blocks AS (SELECT doc_id, unnest(bs) AS rest, generate_subscripts(bs, 1) AS block FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n+'), lambda b: {SQL_SQUASH.format(x='b')}), lambda b: b <> '') AS bs FROM documents)),
 cuts(doc_id, block, k, w, rest) AS (SELECT doc_id, block, 0, CAST(NULL AS VARCHAR), rest FROM blocks UNION ALL
   SELECT doc_id, block, k + 1, left(rest, n), substr(rest, n + 1) FROM (SELECT *, CAST(CASE WHEN length(rest) > 500 AND p > 0 AND p <= 249 THEN 500 - p ELSE least(500, length(rest)) END AS BIGINT) AS n FROM (SELECT *, strpos(reverse(left(rest, 500)), ' ') AS p FROM cuts WHERE rest <> ''))),
 windows AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, k) - 1 AS pos, trim(w) AS paragraph FROM cuts WHERE trim(w) <> '')"""
_ITEM = lambda values, n: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][1 + {n}]"
_AUTHORITY = "(VALUES " + ", ".join(f"('{t}', '{d}', {s}, {i})" for t, known in routing.AUTHORITY.items() for i, (d, s) in enumerate(known.items())) + ") a(topic, known, score, pos)"
_SOURCES = f"""src AS (SELECT doc_id, CAST(substr(source, 4) AS INT) AS session, text, {_ITEM(DOMAINS, f'doc_id % {len(DOMAINS)}')} AS domain, {_ITEM(TOPICS, f'CAST(substr(source, 4) AS INT) % {len(TOPICS)}')} AS topic FROM documents),
 auth AS (SELECT src.doc_id, any_value(session) AS session, coalesce(arg_min(CAST(a.score AS DOUBLE), a.pos), 0.0) AS authority FROM src LEFT JOIN {_AUTHORITY} ON a.topic = src.topic AND (src.domain = a.known OR suffix(src.domain, '.' || a.known)) GROUP BY src.doc_id),
 cl AS (SELECT item_id % 20 AS session, item_id AS pos, text AS claim, {SQL_TOKENS.format(x='text')} AS of_ FROM benchmark)"""
_BEST = f"""{SQL_WINDOWS}, {_SOURCES},
 sc AS (SELECT s.doc_id, w.pos AS para, cl.pos AS cpos, paragraph, claim, CASE WHEN len(of_) = 0 THEN 0 ELSE len(list_intersect({SQL_TOKENS.format(x='paragraph')}, of_)) / len(of_) END AS score FROM windows w JOIN src s USING (doc_id) JOIN cl USING (session)),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, para, cpos) AS rk FROM sc) WHERE rk = 1),
 lead AS (SELECT session, arg_min(claim, pos) AS claim FROM cl GROUP BY session),
 best AS (SELECT s.doc_id, s.session, CASE WHEN top.score > 0 THEN left(top.paragraph, 300) ELSE 'n/a' END AS paragraph, CASE WHEN top.score > 0 THEN top.claim ELSE coalesce(lead.claim, 'n/a') END AS claim, coalesce(top.score, 0.0)::DOUBLE AS score FROM src s LEFT JOIN top USING (doc_id) LEFT JOIN lead ON lead.session = s.session)"""
_CONF = f"""{_BEST}, by_source AS (SELECT session, count(*) AS sources, avg(authority) AS authority FROM auth GROUP BY session),
 by_chunk AS (SELECT session, avg(score) AS score, count(*) FILTER (score >= 0.45) AS passed, count(*) FILTER (score < 0.45) AS failed FROM best GROUP BY session),
 conf AS (SELECT session, sources, passed, failed, CASE WHEN passed + failed > 0 THEN round(greatest(0.0, least(1.0, least(sources / 3.0, 1.0) * 0.2 + authority * 0.3 + score * 0.3 + passed / (passed + failed) * 0.2)), 6) ELSE 0.0 END::DOUBLE AS confidence FROM by_source JOIN by_chunk USING (session))"""
_DECISION = f"""{_CONF}, decided AS (SELECT session, CASE WHEN confidence >= 0.7 THEN 'full' WHEN confidence >= 0.35 THEN 'partial' ELSE 'abstain' END AS kind, CASE WHEN confidence >= 0.7 THEN 'complete' ELSE 'weak_sources' END AS status, CASE WHEN confidence >= 0.35 THEN confidence ELSE 0.0 END AS confidence,
  CASE WHEN confidence < 0.7 THEN 'Measured confidence ' || printf('%.2f', confidence) || ' stayed below the full-answer threshold; gather more high-authority sources or stronger paragraph overlap.' END AS open_question FROM conf)"""


def _pick(values: list, n) -> F.Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), n.cast("int"))


def _sources(spark, sf_dir):
    """(doc, session, text, domain, topic) of all documents."""
    session = F.substring("source", 4, 9).cast("int")
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("doc"), session.alias("session"), "text", _pick(DOMAINS, F.col("doc_id") % len(DOMAINS)).alias("domain"), _pick(TOPICS, session % len(TOPICS)).alias("topic"))


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") % 20).cast("int").alias("session"), F.col("item_id").alias("pos"), F.col("text").alias("claim"))


def _best(spark, sf_dir):
    return evidence.best_paragraphs(_sources(spark, sf_dir).select("doc", "session", "text"), _claims(spark, sf_dir), "session", "text", ["doc"]).drop("text")


def _measured(spark, sf_dir, best=None):
    authority = routing.with_authority(_sources(spark, sf_dir).select("doc", "session", "domain", "topic"), keys=["doc", "session"])
    out = evidence.measured(authority, evidence.chunks(best or _best(spark, sf_dir)), "session")
    return out.withColumn("confidence", F.round("confidence", 6))


def _decided(spark, sf_dir, best=None):
    return _measured(spark, sf_dir, best).select("session", "sources", "passed", "failed", evidence.decision(F.col("confidence")).alias("d")).select("session", "sources", "passed", "failed", "d.*")


@R.query(f"WITH RECURSIVE {SQL_WINDOWS} SELECT doc_id, CAST(pos AS INT) AS pos, paragraph FROM windows")
def paragraph_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@R.query(f"WITH {_SOURCES}, t AS (SELECT doc_id, session, {SQL_TOKENS.format(x='text')} AS ts FROM src) SELECT doc_id AS doc, pos AS claim, round(CASE WHEN len(of_) = 0 OR len(ts) = 0 THEN 0 ELSE len(list_intersect(ts, of_)) / len(of_) END, 9)::DOUBLE AS score FROM t JOIN cl USING (session)")
def containment_pairs(spark, sf_dir):
    """Whole documents against each claim of their session, those without a common token too."""
    docs = _sources(spark, sf_dir).select("doc", "session", text.overlap_tokens(F.col("text")).alias("tokens"))
    claims = _claims(spark, sf_dir).select("session", F.col("pos").alias("claim"), text.overlap_tokens(F.col("claim")).alias("of"))
    return docs.join(claims, "session").select("doc", "claim", F.round(text.containment(F.col("tokens"), F.col("of")), 9).alias("score"))


@R.query(f"WITH RECURSIVE {_BEST} SELECT doc_id AS doc, para, cpos AS claim, round(score, 9)::DOUBLE AS score FROM sc WHERE score >= 0.45")
def supported_claims(spark, sf_dir):
    """F-03 from the pass threshold on: every paragraph and claim, found by the claim's rarest tokens."""
    units = containment.paragraph_tokens(_sources(spark, sf_dir), ["session", "doc"], "text")
    sets = containment.claim_tokens(_claims(spark, sf_dir), ["session", "pos"], "claim")
    pairs = containment.supported(units, ["session", "doc", "para"], sets, ["session", "pos"], ["session"], evidence.PASS)
    return pairs.select("doc", F.col("para").cast("long").alias("para"), F.col("pos").alias("claim"), F.round("score", 9).alias("score"))


@R.query(f"WITH RECURSIVE {_BEST} SELECT doc_id AS doc, paragraph, claim, round(score, 9) AS score FROM best")
def best_paragraph(spark, sf_dir):
    return _best(spark, sf_dir).select("doc", "paragraph", "claim", F.round("score", 9).alias("score"))


@R.query(f"WITH RECURSIVE {_BEST} SELECT session, count(*) AS chunks, count(*) FILTER (score >= 0.45) AS passed, count(*) FILTER (score < 0.45) AS failed FROM best GROUP BY session")
def evidence_chunks(spark, sf_dir):
    c = evidence.chunks(_best(spark, sf_dir))
    return c.groupBy("session").agg(F.count("*").alias("chunks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


@R.query(f"WITH RECURSIVE {_CONF} SELECT session, sources, passed, failed, confidence FROM conf")
def session_confidence(spark, sf_dir):
    return _measured(spark, sf_dir).select("session", "sources", "passed", "failed", "confidence")


@R.query(f"WITH RECURSIVE {_DECISION} SELECT session, kind, status, confidence, open_question FROM decided")
def answer_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("session", "kind", "status", "confidence", "open_question")


@R.query(f"""WITH RECURSIVE {_DECISION} SELECT session, kind = 'abstain' OR status IN ('weak_sources', 'insufficient_evidence') OR sources < 2 AS again, printf('%.2f', round(sources / 64.0 - floor(sources / 64.0), 6)) AS share FROM decided JOIN conf USING (session)""")
def follow_ups(spark, sf_dir):
    """G-23, and two-place texts of fractions that are exact halves."""
    d = _decided(spark, sf_dir)
    part = F.round(F.col("sources") / 64.0 - F.floor(F.col("sources") / 64.0), 6)
    return d.select("session", gates.needs_follow_up(F.col("kind"), F.col("status"), F.col("sources")).alias("again"), evidence.two_places(part).alias("share"))


_COMPACT80 = "CASE WHEN length({x}) <= 80 THEN {x} ELSE rtrim(left({x}, 77)) || '...' END"
_GAPS = f"""{_DECISION}, single AS (SELECT session, 0 AS ordinal, 'single-source claim about ' || {_COMPACT80.format(x=SQL_SQUASH.format(x='claim'))} AS topic, 'single-source claim' AS reason, 'high' AS severity FROM best GROUP BY session, claim HAVING min(doc_id) = max(doc_id)),
 weak AS (SELECT session, 1, 'weak post-rerank source pool', 'weak source pool', 'high' FROM conf WHERE failed > passed),
 counter AS (SELECT session, 2, 'counter-evidence not checked', 'no counter-evidence', 'medium' FROM conf WHERE session NOT IN (SELECT session FROM src JOIN labels USING (doc_id) WHERE toxic = 1) AND session % 6 <> 5),
 stale AS (SELECT session, 3, 'stale source ' || domain || ': ' || {_COMPACT80.format(x="left(trim(regexp_replace(trim(split_part(text, chr(10), 1)), '^[# ]+', '')), 200)")}, 'stale data', 'medium'
   FROM (SELECT *, {_ITEM(DATES, f'doc_id % {len(DATES)}')} AS published FROM src WHERE session % 3 = 0) WHERE try_strptime(CASE length(published) WHEN 4 THEN published || '-01-01' WHEN 7 THEN published || '-01' ELSE left(published, 10) END, '%Y-%m-%d') < TIMESTAMP '{NOW}' - INTERVAL 720 HOUR),
 missed AS (SELECT session, 4, 'sub-topic missed: ' || {_COMPACT80.format(x='open_question')}, 'sub-topic missed', 'low' FROM decided WHERE open_question IS NOT NULL),
 lens AS (SELECT session, 5, 'missing 3-lens cross-model verification', 'no 3-lens verification', 'medium' FROM conf WHERE session % 2 = 0 AND session % 4 <> 0),
 gap AS (SELECT * FROM single UNION ALL SELECT * FROM weak UNION ALL SELECT * FROM counter UNION ALL SELECT * FROM stale UNION ALL SELECT * FROM missed UNION ALL SELECT * FROM lens)"""


def _parts(spark, sf_dir):
    """The gaps in their order, and the sessions.  The best pairs and the sessions are written once and read by each gap."""
    folder = Folder(spark, "gaps")
    src, best = _sources(spark, sf_dir), folder.save(_best(spark, sf_dir).drop("paragraph"), "best")
    chunks = evidence.chunks(best).select("session", "claim", F.col("doc").alias("source"), "passed")
    decided = folder.save(_decided(spark, sf_dir, best), "decided")
    known = decided.select("session", F.when(F.col("session") % 2 == 0, "deep_research").otherwise("research").alias("protocol"), F.when(F.col("session") % 4 == 0, 1).otherwise(0).alias("verifications"))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("doc")).distinct()
    flagged = src.join(toxic, "doc", "left_semi").select("session", F.lit(True).alias("counter"))
    disputed = known.filter("session % 6 = 5").select("session")
    dated = src.select("session", "domain", text.title_from_text(F.col("text")).alias("title"), _pick(DATES, F.col("doc") % len(DATES)).alias("published"))
    stale = gaps.stale_sources(dated, NOW, F.when(F.col("session") % 3 == 0, 720))
    missed = gaps.missed_topics(decided.select("session", F.array_compact(F.array("open_question")).alias("open")))
    every = gaps.all_gaps(gaps.single_source_claims(chunks), gaps.weak_pool(chunks), gaps.no_counter_evidence(known, flagged, disputed), stale, missed, gaps.missing_lenses(known))
    return every, decided


@R.query(f"WITH RECURSIVE {_GAPS} SELECT session, topic, severity FROM gap WHERE ordinal = 0")
def single_source_claims(spark, sf_dir):
    chunks = evidence.chunks(_best(spark, sf_dir)).select("session", "claim", F.col("doc").alias("source"), "passed")
    return gaps.single_source_claims(chunks).select("session", "topic", "severity")


@R.query(f"WITH RECURSIVE {_GAPS} SELECT session, topic, reason FROM gap WHERE ordinal = 3")
def stale_sources(spark, sf_dir):
    src = _sources(spark, sf_dir)
    dated = src.select("session", "domain", text.title_from_text(F.col("text")).alias("title"), _pick(DATES, F.col("doc") % len(DATES)).alias("published"))
    return gaps.stale_sources(dated, NOW, F.when(F.col("session") % 3 == 0, 720)).select("session", "topic", "reason")


@R.query(f"WITH RECURSIVE {_GAPS} SELECT session, CAST(ordinal AS INT) AS ordinal, topic, reason, severity FROM gap")
def gap_union(spark, sf_dir):
    return _parts(spark, sf_dir)[0]


_LANES = "(VALUES " + ", ".join(f"('{reason}', [{', '.join(repr(x) for x in lanes)}])" for reason, lanes in gaps.LANES_FOR.items()) + ") r(reason, lanes)"


@R.query(f"""WITH RECURSIVE {_GAPS}, hit AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ordinal, topic) AS n FROM gap WHERE severity IN ('high', 'medium')),
 why AS (SELECT session, string_agg(reason, ', ' ORDER BY n) FILTER (n <= 3) AS reasons FROM hit GROUP BY session),
 lane AS (SELECT session, lane, min(place) AS place FROM (SELECT session, unnest(list_concat(lanes, ['arxiv', 'searxng_general'])) AS lane, n * 100 + unnest(range(len(lanes) + 2)) AS place FROM hit JOIN {_LANES} USING (reason)) GROUP BY session, lane),
 two AS (SELECT session, string_agg(lane, ',' ORDER BY place) AS lanes FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY place) AS rk FROM lane) WHERE rk <= 2 GROUP BY session),
 st AS (SELECT session, session % 5 AS loops, (session % 7) * 0.3 AS cost, reasons, lanes FROM decided LEFT JOIN why USING (session) LEFT JOIN two USING (session))
 SELECT session, loops < 3 AND cost < 1.5 AND reasons IS NOT NULL AS iterate, CASE WHEN loops >= 3 THEN 'max loops reached' WHEN cost >= 1.5 THEN 'cost cap hit' WHEN reasons IS NULL THEN 'no triggering gaps' ELSE 'triggering gaps detected: ' || reasons END AS reason,
  CASE WHEN loops < 3 AND cost < 1.5 AND reasons IS NOT NULL THEN lanes ELSE '' END AS lanes, CAST(loops + 1 AS INT) AS next, round(greatest(0, 1.5 - cost), 6)::DOUBLE AS cost_left FROM st""")
def iterate_decision(spark, sf_dir):
    """Loops and cost follow from the session's number; high and medium gaps trigger."""
    every, decided = _parts(spark, sf_dir)
    s = decided.select("session", (F.col("session") % 5).alias("loops"), (F.col("session") % 7 * F.lit(0.3)).alias("cost"), F.array(F.lit("arxiv"), F.lit("searxng_general")).alias("lanes"))
    return gaps.decide(s, every, ["high", "medium"]).select("session", "iterate", "reason", F.array_join("lanes", ",").alias("lanes"), "next", F.round("cost_left", 6).alias("cost_left"))


@R.query(f"""WITH RECURSIVE {_BEST}, j AS (SELECT session, doc_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY doc_id) AS chunk FROM best WHERE doc_id % 3 <> 0 GROUP BY session, doc_id)
 SELECT s.doc_id AS doc, sha256(CASE WHEN s.doc_id % 2 = 0 AND trim(s.text) <> '' THEN s.text ELSE coalesce(j.chunk, '') END) AS evidence FROM src s LEFT JOIN j ON j.doc_id = s.doc_id""")
def source_evidence(spark, sf_dir):
    """F-06: every other source has no text of its own, every third no chunk."""
    src = _sources(spark, sf_dir).select("session", "doc", F.when(F.col("doc") % 2 == 0, F.col("text")).alias("text"))
    found = _best(spark, sf_dir).filter("doc % 3 <> 0").select("session", "doc", F.col("doc").alias("chunk"), "paragraph")
    return evidence.source_texts(src, found, "session", "doc", "text", "chunk", "paragraph").select("doc", F.sha2("evidence", 256).alias("evidence"))


@R.query("SELECT count(*) AS orphans, count(DISTINCT l_orderkey) AS keys FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def orphan_chunks(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    lost = sessions.orphans(table(spark, sf_dir, "lineitem"), open_, "l_orderkey", "o_orderkey")
    return lost.agg(F.count("*").alias("orphans"), F.count_distinct("l_orderkey").alias("keys"))


@R.query("SELECT s_nationkey, count(*) AS n FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') GROUP BY s_nationkey")
def fk_semi(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(used, "s_suppkey", "left_semi").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@R.query("WITH r AS (SELECT l_orderkey AS session, list(DISTINCT l_suppkey) AS refs FROM lineitem GROUP BY 1), x AS (SELECT session, unnest(refs) AS s_suppkey FROM r) SELECT session, s_suppkey FROM x WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def dangling_references(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.collect_set("l_suppkey").alias("refs"))
    return sessions.dangling(refs, table(spark, sf_dir, "supplier").filter("s_acctbal >= 0"), "session", "refs", "s_suppkey")


@R.query("""WITH s AS (SELECT o_orderkey AS session, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'in_progress' ELSE 'complete' END AS status, CASE o_orderstatus WHEN 'P' THEN 'abstain' ELSE 'full' END AS kind, CASE WHEN o_totalprice > 5000 THEN o_orderpriority ELSE '' END AS answer, o_totalprice / 400000.0 AS confidence FROM orders),
 v AS (SELECT session, unnest(['complete_without_answer', 'abstain_complete', 'confidence_range', 'abstain_confidence']) AS rule, unnest([status = 'complete' AND trim(answer) = '', kind = 'abstain' AND status = 'complete', NOT confidence BETWEEN 0 AND 1, kind = 'abstain' AND confidence <> 0]) AS broken FROM s) SELECT session, rule FROM v WHERE broken""")
def session_contract_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "in_progress").otherwise("complete")
    s = o.select(F.col("o_orderkey").alias("session"), status.alias("status"), F.when(F.col("o_orderstatus") == "P", "abstain").otherwise("full").alias("kind"), F.when(F.col("o_totalprice") > 5000, F.col("o_orderpriority")).otherwise("").alias("answer"), (F.col("o_totalprice") / 400000.0).alias("confidence"))
    return sessions.violations(s)


@R.query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def sessions_newest(spark, sf_dir):
    """The newest hundred: the limit is the report's."""
    o = table(spark, sf_dir, "orders").withColumns({"protocol": F.col("o_orderpriority"), "status": F.col("o_orderstatus")})
    return sessions.index(o, "o_orderdate", "o_orderkey", since="1995-01-01", protocol="1-URGENT", status="O").select("o_orderkey", "o_orderdate")


@R.query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY c_mktsegment")
def new_sessions_anti(spark, sf_dir):
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return sessions.new_rows(table(spark, sf_dir, "customer"), known, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


_ATTEMPTS = """a AS (SELECT l_orderkey AS k, l_linenumber - 1 AS pos, min(CASE l_returnflag WHEN 'A' THEN 'sufficient' WHEN 'R' THEN 'partial' ELSE 'insufficient' END) AS verdict, min(CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'q' || l_partkey % 9 END) AS query, min(l_suppkey % 40) AS fingerprint FROM lineitem GROUP BY ALL)"""


@R.query(f"""WITH {_ATTEMPTS}, r AS (SELECT *, pos > 0 AND trim(query) = '' AS failed, pos > 0 AND EXISTS (SELECT 1 FROM a e WHERE e.k = a.k AND e.pos < a.pos AND e.query = a.query) AS again, pos > 0 AND EXISTS (SELECT 1 FROM a e WHERE e.k = a.k AND e.pos < a.pos AND e.fingerprint = a.fingerprint) AS same FROM a WHERE pos <= 2),
 s AS (SELECT *, failed OR again OR same AS blocked, CASE WHEN failed THEN 'reformulation_failed' WHEN again THEN 'reformulation_repeated' WHEN same THEN 'same_items' WHEN verdict = 'sufficient' THEN 'sufficient' WHEN pos >= 2 THEN 'max_recovery_iterations' END AS stop FROM r),
 e AS (SELECT k, min(pos) FILTER (stop IS NOT NULL) AS fin FROM s GROUP BY k), l AS (SELECT s.* FROM s JOIN e USING (k) WHERE fin IS NULL OR pos <= fin),
 o AS (SELECT k, arg_max(verdict, pos) FILTER (NOT blocked) AS verdict, coalesce(arg_max(stop, pos) FILTER (stop IS NOT NULL), 'no_retriever') AS stopped, max(pos) AS "at" FROM l GROUP BY k)
 SELECT k, CASE WHEN stopped = 'sufficient' THEN 'sufficient' WHEN verdict = 'partial' THEN 'partial' ELSE 'exhausted' END AS terminal, stopped, "at" FROM o""")
def sufficiency_terminal(spark, sf_dir):
    verdict = F.when(F.col("l_returnflag") == "A", "sufficient").when(F.col("l_returnflag") == "R", "partial").otherwise("insufficient")
    attempts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("pos")).agg(F.min(verdict).alias("verdict"), F.min(F.when(F.col("l_partkey") % 7 == 0, "").otherwise(F.concat(F.lit("q"), F.col("l_partkey") % 9))).alias("query"), F.min(F.col("l_suppkey") % 40).alias("fingerprint"))
    return gates.terminal(attempts, "k")


@R.query(f"""WITH {_ATTEMPTS}, i AS (SELECT l_orderkey AS k, l_linenumber - 1 AS pos, min(l_suppkey % 6) AS first FROM lineitem GROUP BY ALL), r AS (SELECT a.k, pos, verdict, pos > 0 AND coalesce(abs(first - lag(first) OVER (PARTITION BY k ORDER BY pos)) <= 2, false) AS same FROM a JOIN i USING (k, pos) WHERE pos <= 2),
 s AS (SELECT *, CASE WHEN same THEN 'same_items' WHEN verdict = 'sufficient' THEN 'sufficient' WHEN pos >= 2 THEN 'max_recovery_iterations' END AS stop FROM r), e AS (SELECT k, min(pos) FILTER (stop IS NOT NULL) AS fin FROM s GROUP BY k),
 o AS (SELECT k, arg_max(verdict, pos) FILTER (NOT same) AS verdict, coalesce(arg_max(stop, pos) FILTER (stop IS NOT NULL), 'no_retriever') AS stopped, max(pos) AS "at" FROM s JOIN e USING (k) WHERE fin IS NULL OR pos <= fin GROUP BY k)
 SELECT k, CASE WHEN stopped = 'sufficient' THEN 'sufficient' WHEN verdict = 'partial' THEN 'partial' ELSE 'exhausted' END AS terminal, stopped, "at" FROM o""")
def sufficiency_same_items(spark, sf_dir):
    """G-15: ten sources an attempt, neighbours in a row; eight of them in common are substantially the same."""
    verdict = F.when(F.col("l_returnflag") == "A", "sufficient").when(F.col("l_returnflag") == "R", "partial").otherwise("insufficient")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("pos")).agg(F.min(verdict).alias("verdict"), F.min(F.col("l_suppkey") % 6).alias("_first"))
    rows = rows.withColumn("items", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.concat(F.lit("s"), F.col("_first") + j)))
    # Queries and fingerprints are all different here, so that the sources decide.
    return gates.terminal(rows.withColumn("query", F.concat(F.lit("q"), "pos")).withColumn("fingerprint", F.col("pos")), "k")


@R.query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, list_sort(list(DISTINCT 'd' || l_suppkey % 5)) AS domains, list_sort(list(DISTINCT 'l' || l_partkey % 4)) AS lanes, coalesce(list_sort(list(DISTINCT 'l' || l_partkey % 4) FILTER (l_returnflag = 'R')), []) AS failed, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS session_id, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS VARCHAR) ELSE 'made' END AS run_ts, o_orderpriority AS protocol, CASE WHEN o_custkey % 3 = 0 THEN 'unknown' ELSE 'c' || o_custkey END AS agent, left(repeat(o_orderpriority || ' ', 30), 200) AS question, coalesce(n, 0) AS n_sources, coalesce(n, 0) AS n_queries, coalesce(array_to_string(domains, ','), '') AS source_domains, coalesce(array_to_string(lanes, ','), '') AS lanes_used, coalesce(array_to_string(failed, ','), '') AS lanes_failed,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, []), CASE WHEN o_orderkey % 2 = 0 THEN ['scout'] ELSE [] END))), ',') AS models_used, o_orderkey % 7 = 0 AS flagged, o_totalprice::DOUBLE AS cost_usd FROM orders LEFT JOIN l ON k = o_orderkey""")
def telemetry_rows(spark, sf_dir):
    """H-04: orders as session documents, their lines as sources and queries."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.struct(F.concat(F.lit("d"), F.col("l_suppkey") % 5).alias("domain"))).alias("sources"),
        F.collect_list(F.struct(F.concat(F.lit("l"), F.col("l_partkey") % 4).alias("lane"), F.col("l_linestatus").alias("worker_model"), F.when(F.col("l_returnflag") == "R", "timeout").otherwise("").alias("error"))).alias("queries_run"),
        F.collect_list(F.struct(F.col("l_returnflag").alias("assigned_worker_model"))).alias("territories"),
    )
    none = F.lit(None)
    made = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        "*", F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("string")).alias("updated_at"), F.lit("made").alias("created_at"), F.col("o_orderpriority").alias("protocol"),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("c"), "o_custkey")).when(F.col("o_custkey") % 2 == 0, "").alias("triggered_by"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(30)).alias("question"), none.cast("string").alias("final_status"), none.cast("string").alias("answer_kind"), none.cast("double").alias("confidence"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("scout").alias("run_type")))).alias("gemini_pro_runs"), F.when(F.col("o_orderkey") % 7 == 0, True).alias("flagged"), none.cast("array<string>").alias("claims"), F.col("o_totalprice").cast("double").alias("total_cost_usd_estimate"), F.lit(0).alias("total_duration_ms"), F.lit(0).alias("iteration_count"), F.lit("f").alias("session_file"),
    )
    row = rollups.telemetry_row(made, NOW)
    text_ = lambda c: F.array_join(c, ",").alias(c)
    return row.select("session_id", "run_ts", "protocol", "agent", "question", F.col("n_sources").cast("long").alias("n_sources"), F.col("n_queries").cast("long").alias("n_queries"), text_("source_domains"), text_("lanes_used"), text_("lanes_failed"), text_("models_used"), "flagged", "cost_usd")
