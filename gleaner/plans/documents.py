"""Queries over source texts: cleaning, hashes, windows, trimming, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly, evidence, gates, sessions
from .registry import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_STOP = "('a','an','and','are','as','at','be','by','for','from','has','have','in','is','it','of','on','or','that','the','their','this','to','was','were','with')"
SQL_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN " + _STOP + "))"
SQL_SQUASH = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"

@R.query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), ' ' || chr(10) || chr(9))) AS cleaned FROM documents")
def cleaned_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clean(F.col("text")), 256).alias("cleaned"))


@R.query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text"), 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@R.query("SELECT DISTINCT sha256(text) AS content_hash, length(text) AS chars FROM documents")
def content_cache(spark, sf_dir):
    """B-07."""
    return sessions.content_cache(table(spark, sf_dir, "documents"), "text").select("content_hash", F.length("content").cast("long").alias("chars"))


_FIRST = "list_filter(list_transform(string_split_regex({x}, '\\r\\n|\\n|\\r'), lambda s: trim(s)), lambda s: s <> '' AND s <> '---')"


@R.query(f"WITH t AS (SELECT doc_id, {_FIRST.format(x='text')} AS ls FROM documents) SELECT doc_id, CASE WHEN len(ls) = 0 THEN '' ELSE left(trim(regexp_replace(ls[1], '^[# ]+', '')), 200) END AS title FROM t")
def title_from_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.title_from_text(F.col("text")).alias("title"))


_FRONT = "CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'Title: \"' || {t} || '\"' || chr(10) || '---' || chr(10) || text WHEN 1 THEN '---' || chr(10) || 'tags: x' || chr(10) || '---' || chr(10) || 'title: no' || chr(10) || text WHEN 2 THEN '# ' || text ELSE text END"


@R.query(f"""WITH m AS (SELECT doc_id, {_FRONT.format(t="left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 30)")} AS x, left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 30) AS t FROM documents), l AS (SELECT *, {_FIRST.format(x='x')} AS ls FROM m)
 SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(trim(t), '^''+|''+$', '', 'g') WHEN len(ls) = 0 THEN '' ELSE left(trim(regexp_replace(ls[1], '^[# ]+', '')), 200) END AS title FROM l""")
def title_from_markdown(spark, sf_dir):
    """E-09: a quarter of the documents have front matter with a title, a quarter without."""
    plain = F.left(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(30))
    matter = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('---\nTitle: "'), F.trim(plain), F.lit('"\n---\n'), F.col("text"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("---\ntags: x\n---\ntitle: no\n"), F.col("text"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.title_from_markdown(matter).alias("title"))


@R.query("SELECT doc_id, CAST(tier AS INT) AS tier, CAST(CASE WHEN tier = 3 THEN least(length(text), 1500) WHEN tier = 2 THEN least(length(text), 9000) ELSE length(text) END AS INT) AS chars, CASE WHEN tier = 3 THEN sha256(left(text, 1500)) WHEN tier = 2 AND length(text) > 9000 THEN sha256(left(text, 8000) || chr(10) || chr(10) || '[... trimmed ' || (length(text) - 9000) || ' chars ...]' || chr(10) || chr(10) || right(text, 1000)) ELSE sha256(text) END AS trimmed FROM documents, (VALUES (1), (2), (3)) t(tier)")
def tier_trim_char_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("tier"))
    return docs.select("doc_id", "tier", text.tier_chars(F.col("text"), F.col("tier")).alias("chars"), F.sha2(text.tier_text(F.col("text"), F.col("tier")), 256).alias("trimmed"))


@R.query(f"SELECT doc_id, array_to_string(list_sort({SQL_TOKENS.format(x='text')}), ' ') AS tokens FROM documents")
def overlap_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.overlap_tokens(F.col("text"))), " ").alias("tokens"))


@R.query(rf"SELECT doc_id, left(trim(regexp_extract({SQL_SQUASH.format(x='text')}, '^(?:.*?[.!?](?: |$)|.*$)')), 280) AS sentence FROM documents")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@R.query(f"WITH s AS (SELECT doc_id, {SQL_SQUASH.format(x='text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(left(t, 157)) || '...' END AS preview, CAST(greatest(1, length(t) // 4) AS INT) AS tokens_floor, CAST(CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, round_even(length(t) / 4.0, 0)) END AS INT) AS tokens_round FROM s")
def previews_and_token_estimates(spark, sf_dir):
    t = text.squash(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text"), 160).alias("preview"), text.tokens_by_length(t).alias("tokens_floor"), text.tokens_rounded(t).cast("int").alias("tokens_round"))


@R.query(r"SELECT doc_id, regexp_replace(text, '(?i)((?:api_key|token|authorization)=)[^&\s]+', '\1***', 'g') AS masked FROM documents")
def masked_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.mask_secrets(F.col("text")).alias("masked"))


_CAPS = rf"""s AS (SELECT doc_id // 50 AS source, doc_id, {SQL_SQUASH.format(x='text')} AS t FROM documents), l AS (SELECT *, least(length(t), 12000) AS n FROM s WHERE t <> ''),
 c AS (SELECT *, greatest(0, least(n, 60000 - coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS clip FROM l)"""


@R.query(f"WITH {_CAPS} SELECT source, doc_id, CAST(clip AS BIGINT) AS clip, sha256(left(t, CAST(clip AS BIGINT))) AS capped FROM c WHERE clip > 0")
def source_caps(spark, sf_dir):
    """Fifty documents are the sources of a session."""
    out = evidence.cap_texts(table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("source"), "doc_id", "text"), "source", "doc_id", "text")
    return out.select("source", "doc_id", "clip", F.sha2("capped", 256).alias("capped"))


@R.query(f"SELECT source, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint, count(*) AS n FROM (SELECT doc_id // 10 AS source, doc_id || ':' || left(sha256({SQL_SQUASH.format(x='text')}), 16) AS line FROM documents) GROUP BY source")
def source_fingerprint(spark, sf_dir):
    """Ten documents are the sources of a session."""
    return evidence.fingerprint(table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("source"), "doc_id", "text"), "source", "doc_id", "text")


_KEY = f"sha256(lang || '|' || lower({SQL_SQUASH.format(x='left(text, 40)')}) || '|' || left(lower({SQL_SQUASH.format(x='text')}), 500))"


@R.query(f"""WITH k AS (SELECT DISTINCT source, {_KEY} AS k FROM documents), n AS (SELECT source, count(*) AS n FROM k GROUP BY source), p AS (SELECT a.source AS a, b.source AS b, count(*) AS shared FROM k a JOIN k b ON a.k = b.k AND a.source < b.source GROUP BY ALL)
 SELECT p.a, p.b, shared, shared / greatest(x.n, y.n) >= 0.8 AS same FROM p JOIN n x ON x.source = p.a JOIN n y ON y.source = p.b""")
def sources_same(spark, sf_dir):
    """Pairs of families with a text in common, as pools of sources whose id is the language."""
    key = evidence.source_key(F.col("lang"), F.left("text", F.lit(40)), F.col("text"))
    return evidence.shared_keys(table(spark, sf_dir, "documents").select("source", key.alias("k")), "source", "k")


_SESSIONS = """s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'abstain' END AS kind, ['complete', 'weak_sources', 'in_progress', 'insufficient_evidence', NULL][1 + doc_id % 5] AS status,
  CASE WHEN doc_id % 3 <> 0 THEN left(sha256(text), 8) END AS answer, CASE WHEN doc_id % 10 <> 9 THEN (doc_id % 10) / 10 END::DOUBLE AS confidence, CAST(doc_id % 6 AS INT) AS sources, CASE WHEN toxic = 1 THEN 'exhausted' WHEN quality = 0 THEN 'partial' WHEN quality = 1 THEN 'sufficient' END AS judged FROM documents LEFT JOIN labels USING (doc_id)),
 e AS (SELECT *, coalesce(coalesce(kind, CASE WHEN coalesce(answer, '') <> '' THEN 'full' END) IN ('full', 'partial') AND status IN ('complete', 'weak_sources', 'insufficient_evidence'), false) AS applies FROM s),
 r AS (SELECT *, CASE WHEN NOT applies THEN 'not_applicable' WHEN sources = 0 THEN 'empty_evidence_pool' WHEN judged = 'sufficient' THEN 'passed' WHEN judged = 'partial' THEN 'partial' ELSE 'sufficiency_exhausted' END AS reason FROM e),
 g AS (SELECT doc_id, kind AS kind_before, status AS status_before, reason, CASE WHEN reason IN ('not_applicable', 'passed') THEN kind WHEN reason = 'partial' THEN 'partial' ELSE 'abstain' END AS kind, CASE WHEN reason IN ('not_applicable', 'passed') THEN status WHEN reason = 'partial' THEN 'weak_sources' ELSE 'insufficient_evidence' END AS status,
  CASE WHEN reason IN ('not_applicable', 'passed', 'partial') THEN answer END AS answer, CASE WHEN reason IN ('not_applicable', 'passed') THEN confidence WHEN reason = 'partial' THEN least(coalesce(confidence, 0.0), 0.5) ELSE 0.0 END::DOUBLE AS confidence FROM r)"""


def _sessions(spark, sf_dir):
    """Sessions of all kinds, statuses and verdicts; documents without label are not judged."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    judged = F.when(F.col("toxic") == 1, "exhausted").when(F.col("quality") == 0, "partial").when(F.col("quality") == 1, "sufficient")
    kind = F.when(i % 4 == 0, "full").when(i % 4 == 1, "partial").when(i % 4 == 2, "abstain")
    status = F.get(F.array(*[F.lit(x).cast("string") for x in ("complete", "weak_sources", "in_progress", "insufficient_evidence", None)]), (i % 5).cast("int"))
    answer = F.when(i % 3 != 0, F.left(F.sha2("text", 256), F.lit(8)))
    return d.select("doc_id", kind.alias("kind"), status.alias("status"), answer.alias("answer"), F.when(i % 10 != 9, (i % 10) / 10).alias("confidence"), (i % 6).cast("int").alias("sources"), judged.alias("judged"))


@R.query(f"WITH {_SESSIONS} SELECT doc_id, kind, status, answer, confidence, reason FROM g")
def evidence_gate_apply(spark, sf_dir):
    """G-16: whatever is not sufficient or partial abstains, an unjudged pool included."""
    return sessions.gated(_sessions(spark, sf_dir)).select("doc_id", "kind", "status", "answer", "confidence", "gate.reason")


@R.query(f"""WITH {_SESSIONS}, x AS (SELECT g.doc_id, reason, CASE WHEN g.doc_id % 8 <> 7 THEN (g.doc_id % 8) / 8 END::DOUBLE AS ac, g.confidence, length(d.text) % 5 AS n, d.lang, coalesce(d.source, '') AS why, g.doc_id % 9 = 0 AS dead FROM g JOIN documents d USING (doc_id)),
 y AS (SELECT *, CASE WHEN dead THEN 'sufficiency checker unavailable' WHEN n > 2 THEN 'source sufficiency is partial: ' || lang || '; ' || n ELSE 'source sufficiency is partial' || CASE WHEN why = '' THEN '' ELSE ': ' || why END END AS asked, reason IN ('empty_evidence_pool', 'sufficiency_exhausted') AS away FROM x)
 SELECT doc_id, CASE WHEN away THEN 0.0 WHEN reason = 'partial' THEN least(coalesce(ac, confidence), 0.5) ELSE ac END::DOUBLE AS answer_confidence,
  CASE WHEN away THEN CASE WHEN n = 0 THEN 'Which independent, on-topic sources directly answer this question?' ELSE 'open' END WHEN reason = 'partial' THEN CASE WHEN n = 0 THEN asked ELSE 'open|' || asked END ELSE CASE WHEN n = 0 THEN '' ELSE 'open' END END AS open,
  CASE WHEN away THEN 0 ELSE n END AS chunks, CASE WHEN away THEN 0 WHEN reason = 'passed' THEN n ELSE 1 END AS passed, CASE WHEN away THEN n WHEN reason = 'passed' THEN 0 ELSE 2 END AS failed,
  CASE WHEN reason = 'not_applicable' THEN 2 WHEN away THEN 0 WHEN n >= 2 THEN 2 WHEN n = 1 THEN 0 ELSE 0 END::INT AS disagreements, CASE WHEN reason = 'not_applicable' THEN 2 WHEN away OR n < 3 THEN 1 ELSE 2 END::INT AS verifications, reason FROM y""")
def gate_outcomes(spark, sf_dir):
    """G-16: confidences, open questions, chunk counts and references as the gate leaves them; a document's length numbers its chunks."""
    n = (F.length("text") % 5).cast("int")
    own = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 8 != 7, (F.col("doc_id") % 8) / 8).alias("answer_confidence"),
        F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("open"))).alias("open"),
        F.transform(F.slice(F.array(*map(F.lit, range(1, 6))), F.lit(1), n), lambda i: i.cast("long")).alias("chunks"),
        F.lit(1).alias("passed"),
        F.lit(2).alias("failed"),
        F.expr("array(named_struct('a', array(1L), 'b', array(2L)), named_struct('a', array(2L), 'b', array(2L)))").alias("disagreements"),
        F.expr("array(array(3L), cast(array() as array<bigint>))").alias("verifications"),
        F.when(F.col("doc_id") % 9 == 0, "failed-closed").alias("route"),
        F.when(n > 2, F.array(F.col("lang"), F.lit(" "), n.cast("string"))).alias("missing"),
        F.col("source").alias("why"),
    )
    out = gates.gate_outcome(_sessions(spark, sf_dir).join(own, "doc_id"))
    size = lambda c: F.size(c).alias(c)
    return out.select("doc_id", "answer_confidence", F.array_join("open", "|").alias("open"), F.size("chunks").cast("long").alias("chunks"), "passed", "failed", size("disagreements"), size("verifications"), "reason")


@R.query(f"WITH {_SESSIONS} SELECT doc_id, reason, kind_before, status_before, reason IN ('empty_evidence_pool', 'sufficiency_exhausted') AS overridden FROM g WHERE reason <> 'not_applicable'")
def gate_decisions(spark, sf_dir):
    """B-04."""
    return sessions.gate_decisions(_sessions(spark, sf_dir), "doc_id").drop("after")


@R.query(f"WITH {_SESSIONS} SELECT doc_id, CASE WHEN reason IN ('empty_evidence_pool', 'sufficiency_exhausted') THEN 0 ELSE 2 END::INT AS kept, CASE WHEN reason IN ('empty_evidence_pool', 'sufficiency_exhausted') THEN 2 ELSE 0 END::INT AS dropped, CASE WHEN reason IN ('empty_evidence_pool', 'sufficiency_exhausted') THEN reason END AS reason FROM g")
def judged_findings(spark, sf_dir):
    """G-41: each session has two chunks."""
    g = sessions.gated(_sessions(spark, sf_dir))
    return g.select("doc_id", gates.judge_findings(F.array(F.col("doc_id"), F.col("doc_id") + 1), F.col("gate")).alias("j")).select("doc_id", F.size("j.kept").alias("kept"), F.size("j.dropped").alias("dropped"), "j.reason")


@R.query(f"""WITH {_SESSIONS}, p AS (SELECT g.*, CASE WHEN g.doc_id % 7 = 0 THEN 'search' ELSE 'research' END AS protocol, CASE g.doc_id % 5 WHEN 0 THEN 'pro-1[x]' WHEN 1 THEN 'pro-10' WHEN 2 THEN 'pro-1' ELSE NULL END AS model, g.doc_id % 3 = 0 AS ok, g.doc_id % 11 = 0 AS final_ok FROM g)
 SELECT doc_id, CASE WHEN NOT (protocol <> 'research' OR coalesce(status = 'in_progress', false) OR (ok AND coalesce(model IN ('pro-1', 'pro-1[x]'), false)) OR final_ok) THEN 'model_interlock' WHEN status = 'complete' AND trim(coalesce(answer, '')) = '' THEN 'complete_without_answer' WHEN kind = 'abstain' AND status = 'complete' THEN 'abstain_complete' WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence_range' WHEN kind = 'abstain' AND confidence <> 0 THEN 'abstain_confidence' END AS problem FROM p""")
def session_save_problems(spark, sf_dir):
    """B-01, G-17: what forbids to save a gated session."""
    i = F.col("doc_id")
    model = F.when(i % 5 == 0, "pro-1[x]").when(i % 5 == 1, "pro-10").when(i % 5 == 2, "pro-1")
    runs = F.array(F.struct(F.lit("scout").alias("role"), (i % 3 == 0).alias("ok"), model.alias("model")), F.struct(F.lit("final").alias("role"), (i % 11 == 0).alias("ok"), F.lit("any").alias("model")))
    s = _sessions(spark, sf_dir).withColumn("protocol", F.when(i % 7 == 0, "search").otherwise("research")).withColumn("runs", runs)
    return sessions.ready(s, ["pro-1"]).select("doc_id", "problem")


@R.query("""WITH v AS (SELECT doc_id, CASE WHEN quality = 1 THEN ' Sufficient' WHEN quality = 0 THEN 'partial' WHEN doc_id % 3 = 0 THEN 'perhaps' END AS first, ['sufficient', 'maybe', NULL, 'INSUFFICIENT'][1 + doc_id % 4] AS second, doc_id % 13 = 0 AS unfiltered, doc_id % 4 = 1 AS vague FROM documents LEFT JOIN labels USING (doc_id)),
 n AS (SELECT *, CASE WHEN lower(trim(first)) IN ('sufficient', 'partial', 'insufficient') THEN lower(trim(first)) END AS a, CASE WHEN lower(trim(second)) IN ('sufficient', 'partial', 'insufficient') THEN lower(trim(second)) END AS b FROM v),
 r AS (SELECT *, coalesce(a, b) AS said, CASE WHEN unfiltered OR coalesce(a, b) IS NULL THEN 'failed-closed' WHEN a IS NOT NULL THEN 'primary' ELSE 'fallback' END AS route FROM n)
 SELECT doc_id, CASE WHEN route = 'failed-closed' OR (said = 'sufficient' AND vague) THEN 'insufficient' ELSE said END AS verdict, route, CASE WHEN route = 'failed-closed' THEN 'checker_failed_closed' WHEN said = 'sufficient' AND vague THEN 'ambiguous_phrase' END AS reason FROM r""")
def judge_verdicts(spark, sf_dir):
    """G-14: verdicts of a first and a second checker, some of no use."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    first = F.when(F.col("quality") == 1, " Sufficient").when(F.col("quality") == 0, "partial").when(i % 3 == 0, "perhaps")
    second = F.get(F.array(*[F.lit(x).cast("string") for x in ("sufficient", "maybe", None, "INSUFFICIENT")]), (i % 4).cast("int"))
    return d.select("doc_id", gates.judge(first, second, i % 13 == 0, i % 4 == 1).alias("j")).select("doc_id", "j.*")


@R.query(f"WITH s AS (SELECT doc_id // 10 AS source, doc_id, {SQL_SQUASH.format(x='text')} AS t, text FROM documents) SELECT source, count(*) AS source_count, CAST(sum(length(text)) AS BIGINT) AS total_chars, sha256(string_agg(doc_id || ':' || left(sha256(t), 16), chr(10) ORDER BY doc_id || ':' || left(sha256(t), 16))) AS fingerprint FROM s GROUP BY source")
def decision_envelopes(spark, sf_dir):
    """N-20: ten documents are the sources of a session."""
    return gates.envelope(table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("source"), "doc_id", "text"), "source", "doc_id", "text")


_STATUS = "CAST([200, 401, 403, 402, 429, 503, 302, 204][1 + doc_id % 8] AS INT)"


@R.query(f"SELECT doc_id, CASE WHEN s BETWEEN 200 AND 299 THEN 'alive' WHEN s IN (401, 403) THEN 'dead_auth' WHEN s = 402 THEN 'dead_credits' WHEN s = 429 THEN 'alive_limited' WHEN s >= 500 THEN 'provider_error' ELSE 'unknown' END AS class, s IN (401, 403, 407, 429, 451) OR doc_id % 9 = 0 AS blocked FROM (SELECT doc_id, {_STATUS} AS s FROM documents)")
def status_classes(spark, sf_dir):
    """E-27, N-07."""
    s = F.get(F.array(*map(F.lit, (200, 401, 403, 402, 429, 503, 302, 204))), (F.col("doc_id") % 8).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.status_class(s).alias("class"), assembly.is_block(s, F.col("doc_id") % 9 == 0, F.lit(None).cast("boolean")).alias("blocked"))


@R.query(r"""WITH p AS (SELECT doc_id, length(text) AS n, trim(split_part(text, chr(10), 1)) AS t, CASE WHEN doc_id % 2 = 0 THEN 'An Author' END AS a, CASE WHEN doc_id % 3 = 0 THEN '2024-01' END AS d, text FROM documents)
 SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(concat_ws(chr(10) || chr(10), nullif(t, ''), 'Author: ' || a, 'Published: ' || d, nullif(text, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), chr(10)), '
{3,}', chr(10) || chr(10), 'g'), '[ 	]{2,}', ' ', 'g'), ' ' || chr(10) || chr(9))) AS payload, t <> '' AND n >= 200 AS accepted FROM p""")
def page_payloads(spark, sf_dir):
    """E-10, E-11."""
    title = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    made = text.payload(title, F.col("text"), F.when(F.col("doc_id") % 2 == 0, "An Author"), F.when(F.col("doc_id") % 3 == 0, "2024-01"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("payload"), text.acceptable(title, F.col("text")).alias("accepted"))


_RAW_DATES = "['D:20240131120000', 'on 2024-02-03 10:00, noon', 'May 2024-05', 'in 1999', 'never', ' 2023-07-01T01:02:03Z;'][1 + doc_id % 6]"


@R.query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '2024-01-31' WHEN 1 THEN '2024-02-03T10:00' WHEN 2 THEN '2024-05' WHEN 3 THEN '1999' WHEN 5 THEN '2023-07-01T01:02:03Z' END AS day, left({_RAW_DATES}, 2) AS raw FROM documents""")
def normalised_dates(spark, sf_dir):
    """E-07 over dates in all shapes."""
    raw = F.get(F.array(*map(F.lit, ("D:20240131120000", "on 2024-02-03 10:00, noon", "May 2024-05", "in 1999", "never", " 2023-07-01T01:02:03Z;"))), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_date(raw).alias("day"), F.left(raw, F.lit(2)).alias("raw"))


def _letters(x, n):
    """The first ``n`` letters and blanks; the pattern stops behind them, where a replacement would rewrite the whole text."""
    return F.regexp_replace(F.regexp_extract(x, rf"\A(?:[^A-Za-z ]*+[A-Za-z ]){{0,{n}}}", 0), "[^A-Za-z ]", "")


_PATHS = "'see /home/me/notes/f' || doc_id || '.txt and https://x.org/a/b/' || doc_id || '.html, ' || left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 40)"


@R.query(f"SELECT doc_id, 'see <path>/f' || doc_id || '.txt and https://x.org/a/b/' || doc_id || '.html, ' || left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 40) AS redacted FROM documents")
def redacted_paths(spark, sf_dir):
    """E-22: a path and an address in front of a document's first letters."""
    x = F.concat(F.lit("see /home/me/notes/f"), F.col("doc_id"), F.lit(".txt and https://x.org/a/b/"), F.col("doc_id"), F.lit(".html, "), _letters(F.col("text"), 40))
    return table(spark, sf_dir, "documents").select("doc_id", assembly.redact_paths(x).alias("redacted"))
