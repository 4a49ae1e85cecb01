"""G-14 to G-25: gates over answers, claims and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.stages import Folder
from .occurrences import occurring

# Patterns of the claim gate and of verbatim checks, marker phrases.
HEDGE = r"(?iU)\b(probably|i think|likely|seems|might)\b"
VERBISH = r"(?iU)\b(is|are|was|were|has|have|had|will|would|can|could|did|does|released|announced|launched|reported|confirmed|said|found|showed|shipped|reached|reach|grew|fell|rose|declined|increased|decreased)\b"
SOURCE = r"(?i)https?://[^\s<>()\]]+|\"[^\"]{6,}\"|“[^”]{6,}”|'[^']{6,}'|‘[^’]{6,}’"
SENTENCE = r"(?<=[.!?])\s+(?=(?!https?://)[A-Z0-9\"'“‘])"
NEGATIVE = ["no study", "does not exist", "doesn't exist", "not found", "nothing found", "measurement vacuum", "couldn't find"]
AFFIRMATIVE = ["arxiv", "doi", "paper", "study", "comparison", "vs", "0."]
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATES = [rf"(?iU)\b{MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*\d{{4}})?\b", r"(?U)\b\d{4}-\d{1,2}-\d{1,2}\b", r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b", rf"(?iU)\b\d{{1,2}}\s+{MONTH}\.?(?:\s+\d{{4}})?\b"]
UNIT = r"(?:\s?(?:%|percent|million|billion|trillion|thousand|k|m|bn))?"
NUMBER = rf"(?iU)(?<![\w/])(?:[$€£]\s*)?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?{UNIT}|(?<![\w/])(?:[$€£]\s*)?\d+(?:\.\d+)?{UNIT}|\b(?:19|20)\d{{2}}\b"


def claim_reasons(claim: Column, source_required: bool = True) -> Column:
    """G-18: why a claim is dropped, joined by ``+``; empty if it stays."""
    words = F.size(F.regexp_extract_all(claim, F.lit("[A-Za-z0-9]+"), F.lit(0)))
    is_claim = (words >= 4) & (claim.rlike(VERBISH) | claim.rlike(r"\d"))
    bare = is_claim & ~claim.rlike(SOURCE)
    return F.concat_ws("+", F.when(bare & claim.rlike(HEDGE), "hedging_without_source"), F.when(bare & F.lit(source_required), "missing_source"))


def gate_claims(x: Column, source_required: bool = True) -> Column:
    """G-18: struct of the text without unsupported claims, how many were dropped, and the flags; the text as it is if none were."""
    lines = F.split(x, r"\r\n|\n|\r")

    def skipped(line: Column) -> Column:
        s = F.trim(line)
        short = s.endswith(":") & (F.size(F.regexp_extract_all(s, F.lit("[A-Za-z0-9]+"), F.lit(0))) <= 8)
        return (s == "") | s.startswith("#") | s.startswith("```") | s.startswith("|") | short

    claims = lambda line: F.filter(F.transform(F.split(line, SENTENCE), lambda x: F.trim(x)), lambda c: c != "")
    judged = F.transform(lines, lambda line: F.struct(line.alias("line"), skipped(line).alias("skip"), F.when(skipped(line), F.array().cast("array<struct<claim:string,why:string>>")).otherwise(F.transform(claims(line), lambda c: F.struct(c.alias("claim"), claim_reasons(c, source_required).alias("why")))).alias("claims")))
    kept = F.transform(judged, lambda j: F.when(j["skip"], j["line"]).otherwise(F.nullif(F.array_join(F.transform(F.filter(j["claims"], lambda c: c["why"] == ""), lambda c: c["claim"]), " "), F.lit(""))))
    flags = F.flatten(F.transform(judged, lambda j: F.transform(F.filter(j["claims"], lambda c: c["why"] != ""), lambda c: F.concat(c["why"], F.lit(": "), text.compact(c["claim"], 160)))))
    gated = F.regexp_replace(F.array_join(F.filter(kept, lambda k: k.isNotNull()), "\n"), r"^\s+|\s+$", "")
    return F.struct(F.when(F.size(flags) == 0, x).otherwise(gated).alias("text"), F.size(flags).alias("dropped"), flags.alias("flags"))


#: Statuses of sessions whose answer is committed, verdicts of judges, reasons.
COMMITTED = ["complete", "weak_sources", "insufficient_evidence"]
VERDICTS, RELEVANCE = ["sufficient", "partial", "insufficient"], ["relevant", "irrelevant"]
PARTIAL_CAP, SAME_SHARE = 0.5, 0.8
#: What is still asked after an answer that is held back, or capped.
STILL_ASKED = "Which independent, on-topic sources directly answer this question?"
UNCHECKED, PARTLY = "sufficiency checker unavailable", "source sufficiency is partial"
STOPS = ["sufficient", "no_retriever", "max_recovery_iterations", "reformulation_failed", "reformulation_repeated", "same_items"]


def enforced(kind: Column, status: Column, answer: Column) -> Column:
    """G-16: whether the gate applies: a full or partial answer (one without kind counts as full) of a committed status."""
    given = F.coalesce(kind, F.when(F.coalesce(answer, F.lit("")) != "", "full"))
    return F.coalesce(given.isin("full", "partial") & status.isin(COMMITTED), F.lit(False))


def evidence_gate(kind: Column, status: Column, answer: Column, confidence: Column, judged: Column, sources: Column) -> Column:
    """G-16: struct of kind, status, answer, confidence and reason once the pool of sources is judged.

    It fails closed: no sources abstain, sufficient passes, partial caps the
    confidence (0 if there is none), and whatever else was said, or nothing, abstains.
    """
    made = lambda k, s, a, c, r: F.struct(k.alias("kind"), s.alias("status"), a.alias("answer"), c.alias("confidence"), F.lit(r).alias("reason"))
    none = F.lit(None).cast("string")
    abstain = lambda r: made(F.lit("abstain"), F.lit("insufficient_evidence"), none, F.lit(0.0), r)
    capped = made(F.lit("partial"), F.lit("weak_sources"), answer, F.least(F.coalesce(confidence, F.lit(0.0)), F.lit(PARTIAL_CAP)), "partial")
    return (
        F.when(~enforced(kind, status, answer), made(kind, status, answer, confidence, "not_applicable"))
        .when(F.coalesce(sources, F.lit(0)) == 0, abstain("empty_evidence_pool"))
        .when(judged == "sufficient", made(kind, status, answer, confidence, "passed"))
        .when(judged == "partial", capped)
        .otherwise(abstain("sufficiency_exhausted"))
    )


def still_missing(route: Column, missing: Column, why: Column) -> Column:
    """G-16: what is asked on after a partial verdict: that no checker answered, or what is missing, else why."""
    lacks = F.array_join(F.filter(F.coalesce(missing, F.array().cast("array<string>")), lambda m: F.trim(m) != ""), "; ")
    detail = F.coalesce(F.nullif(lacks, F.lit("")), F.nullif(F.trim(F.coalesce(why, F.lit(""))), F.lit("")))
    return text.squash(F.when(F.coalesce(route == "failed-closed", F.lit(False)), UNCHECKED).otherwise(F.concat_ws(": ", F.lit(PARTLY), detail)))


def gate_outcome(sessions: DataFrame) -> DataFrame:
    """G-16: sessions with all that the gate changes: kind, status, answer, confidence, answer_confidence, open, chunks, passed, failed, disagreements and verifications, and ``reason``.

    Beside the columns of :func:`evidence_gate` a session has answer_confidence,
    open array<string>, chunks array<bigint>, passed, failed, disagreements array<struct<a, b: array<bigint>>>,
    verifications array<array<bigint>>, and of its judge route, missing array<string> and why.

    Sufficient: all chunks pass.  Partial: both confidences are capped (an unmeasured one of the answer is the session's),
    and what is missing is asked on, once.  Abstaining: no chunks, all of them failed, confidences 0, and a fixed question if none
    was open.  What refers to chunks that are gone is pruned in all three.
    """
    cols = ["kind", "status", "answer", "confidence", "judged", "sources"]
    own = [c for c in sessions.columns if c not in ("kind", "status", "answer", "confidence", "answer_confidence", "open", "chunks", "passed", "failed", "disagreements", "verifications")]
    g, reason = F.col("_gate"), F.col("_gate.reason")
    away, none, total = reason.isin("empty_evidence_pool", "sufficiency_exhausted"), F.array().cast("array<bigint>"), F.size(F.coalesce("chunks", F.array().cast("array<bigint>"))).cast("long")
    opened = F.coalesce("open", F.array().cast("array<string>"))
    asked = still_missing(F.col("route"), F.col("missing"), F.col("why"))
    answered = F.least(F.coalesce(F.col("answer_confidence"), g["confidence"]), F.lit(PARTIAL_CAP))
    chunks = F.when(away, none).otherwise(F.col("chunks"))
    left = lambda refs: F.forall(refs, lambda i: F.array_contains(chunks, i))
    pruned = lambda c, keep: F.when(reason == "not_applicable", F.col(c)).otherwise(F.filter(c, keep))
    return sessions.withColumn("_gate", evidence_gate(*[F.col(c) for c in cols])).select(
        *[F.col(f"`{c}`") for c in own],
        *[g[c].alias(c) for c in ("kind", "status", "answer", "confidence")],
        F.when(away, 0.0).when(reason == "partial", answered).otherwise(F.col("answer_confidence")).alias("answer_confidence"),
        F.when(away & (F.size(opened) == 0), F.array(F.lit(STILL_ASKED))).when((reason == "partial") & ~F.array_contains(opened, asked), F.concat(opened, F.array(asked))).otherwise(opened).alias("open"),
        chunks.alias("chunks"),
        F.when(away, 0).when(reason == "passed", total).otherwise(F.col("passed")).cast("long").alias("passed"),
        F.when(away, total).when(reason == "passed", 0).otherwise(F.col("failed")).cast("long").alias("failed"),
        pruned("disagreements", lambda d: left(d["a"]) & left(d["b"])).alias("disagreements"),
        pruned("verifications", left).alias("verifications"),
        reason.alias("reason"),
    )


def judge_findings(chunks: Column, gated: Column) -> Column:
    """G-41: struct of kept and dropped chunk ids and the reason, from the gate's result: all are dropped if it abstains, all kept otherwise."""
    rejected = gated["reason"].isin("empty_evidence_pool", "sufficiency_exhausted")
    none = F.array().cast("array<bigint>")
    return F.struct(F.when(rejected, none).otherwise(chunks).alias("kept"), F.when(rejected, chunks).otherwise(none).alias("dropped"), F.when(rejected, gated["reason"]).alias("reason"))


def relevant(primary: Column, fallback: Column) -> Column:
    """G-14: whether a source passes the relevance filter: the first checker that gives a valid verdict decides; null if none does."""
    valid = lambda v: F.when(F.lower(F.trim(v)).isin(RELEVANCE), F.lower(F.trim(v)))
    return F.coalesce(valid(primary), valid(fallback)) == "relevant"


def judge(verdict: Column, fallback: Column, unfiltered: Column, ambiguous: Column) -> Column:
    """G-14: struct of verdict, route and reason of a pool: primary, else fallback, else it fails closed; so it does if a source could not be filtered (``unfiltered``).  A sufficient verdict on an ambiguous phrase is not enough."""
    valid = lambda v: F.when(F.lower(F.trim(v)).isin(VERDICTS), F.lower(F.trim(v)))
    said = F.coalesce(valid(verdict), valid(fallback))
    route = F.when(F.coalesce(unfiltered, F.lit(False)) | said.isNull(), "failed-closed").when(valid(verdict).isNotNull(), "primary").otherwise("fallback")
    vague = (said == "sufficient") & F.coalesce(ambiguous, F.lit(False))
    return F.struct(F.when((route == "failed-closed") | vague, "insufficient").otherwise(said).alias("verdict"), route.alias("route"), F.when(route == "failed-closed", "checker_failed_closed").when(vague, "ambiguous_phrase").alias("reason"))


def terminal(attempts: DataFrame, key: str, most: int = 2) -> DataFrame:
    """G-15: how the recovery loop of each key ends, from its attempts (``pos`` from 0, ``verdict``, ``query`` as judged, ``fingerprint`` of its sources).

    It stops at the first sufficient verdict; at an attempt without query (the
    reformulation failed), with one met before, or whose sources are those of an
    earlier attempt or, where there is a column ``items`` (array<string>, a source's :func:`.evidence.source_key` each), share
    SAME_SHARE of the larger set with those of the attempt before (none of these is judged); after ``most`` recoveries; and
    where the attempts end because nothing retrieves more.  What was judged last says whether the end is partial or exhausted.
    """
    w = Window.partitionBy(key).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.array_contains(F.collect_set(c).over(so_far), F.col(c)), F.lit(False))
    # A loop has most + 1 attempts at most, so its windows are short.
    rows = attempts.filter(F.col("pos") <= most)
    later = F.col("pos") > 0
    alike = F.lit(False)
    if "items" in attempts.columns:
        now, before = F.array_distinct("items"), F.array_distinct(F.lag("items").over(w))
        larger = F.greatest(F.size(now), F.size(before))
        alike = F.coalesce(F.when(larger == 0, True).otherwise(F.size(F.array_intersect(now, before)) / larger >= SAME_SHARE), F.lit(False))
    blocked = F.when(later & (F.coalesce(F.trim("query"), F.lit("")) == ""), "reformulation_failed").when(later & seen("query"), "reformulation_repeated").when(later & (seen("fingerprint") | alike), "same_items")
    stop = F.coalesce(blocked, F.when(F.col("verdict") == "sufficient", "sufficient"), F.when(F.col("pos") >= most, "max_recovery_iterations"))
    rows = rows.withColumn("_blocked", blocked.isNotNull()).withColumn("_stop", stop).withColumn("_end", F.min(F.when(F.col("_stop").isNotNull(), F.col("pos"))).over(Window.partitionBy(key)))
    live = rows.filter(F.col("_end").isNull() | (F.col("pos") <= F.col("_end")))
    last = F.max_by("verdict", F.when(~F.col("_blocked"), F.col("pos")))
    out = live.groupBy(key).agg(last.alias("_verdict"), F.coalesce(F.max_by("_stop", F.when(F.col("_stop").isNotNull(), F.col("pos"))), F.lit("no_retriever")).alias("stopped"), F.max("pos").alias("at"))
    return out.select(key, F.when(F.col("stopped") == "sufficient", "sufficient").when(F.col("_verdict") == "partial", "partial").otherwise("exhausted").alias("terminal"), "stopped", "at")


def reformulation(query: Column, tried: Column, most: int = 300) -> Column:
    """N-19: the new query squashed and cut; null if there is none or it was tried before."""
    new = F.left(text.squash(query), F.lit(most))
    return F.when((new != "") & ~F.array_contains(tried, new), new)


def envelope(sources: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """N-20: per key the number of its sources, their characters and their fingerprint."""
    from . import evidence

    sizes = sources.groupBy(key).agg(F.count("*").alias("source_count"), F.sum(F.length(text_col)).alias("total_chars"))
    return sizes.join(evidence.fingerprint(sources, key, id_col, text_col).select(key, "fingerprint"), key)


#: Headings of sections whose tokens are not checked.
UNCERTAIN = ["uncertain", "unknown", "open question", "open questions", "still unknown", "what we don't know", "what we do not know", "limitation", "limitations", "caveat", "caveats"]


def certain(x: Column) -> Column:
    """G-19: the text without its uncertain sections; a heading begins with ``#``, or ends with a colon and has 80 characters at most."""

    def step(state: Column, line: Column) -> Column:
        s = F.trim(line)
        heading = s.startswith("#") | (s.endswith(":") & (F.length(s) <= 80))
        name = F.lower(F.trim(F.regexp_replace(s, "^#+", "")))
        named = F.exists(F.array(*map(F.lit, UNCERTAIN)), lambda m: F.contains(name, m))
        skip = F.when(heading, named).otherwise(state["skip"])
        return F.struct(skip.alias("skip"), F.when(skip, state["kept"]).otherwise(F.concat(state["kept"], F.array(line))).alias("kept"))

    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))
    return F.array_join(F.aggregate(F.split(x, r"\r\n|\n|\r"), start, step, lambda s: s["kept"]), "\n")


def _placed(x: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Matches as structs of type, token, what stands before them on their line's sentence, and after: the offsets come from the pieces between."""
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))

    def rows(m: Column, between: Column) -> Column:
        sides = F.zip_with(F.slice(between, F.lit(1), F.size(m)), F.slice(between, F.lit(2), F.size(m)), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
        token = (lambda t: F.regexp_extract(t, pattern, group)) if group else (lambda t: t)
        return F.zip_with(m, sides, lambda t, s: F.struct(F.lit(kind).alias("type"), F.trim(token(t)).alias("token"), s["before"].alias("before"), t.alias("match"), s["after"].alias("after")))

    none = F.array().cast("array<struct<type:string,token:string,before:string,match:string,after:string>>")
    return text.let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(text.let(F.split(x, pattern, -1), lambda between: rows(m, between))))


def verbatim_tokens(x: Column) -> Column:
    """G-19: array of (type, token, context) of quotes, dates and numbers outside uncertain sections, each (type, token, context) once.

    The context is what stands around the token up to the next sentence end,
    line end or token of its kind.  Single digits that number a line or stand alone in parentheses do not count.
    """

    def of(plain: Column) -> Column:
        numbers = F.filter(_placed(plain, NUMBER, "number"), lambda r: ~(r["token"].rlike(r"^[$€£]?\s*\d$") & ((r["before"].rlike(r"(?:^|\n)\s{0,3}$") & r["after"].startswith(".")) | (r["before"].endswith("(") & r["after"].startswith(")")))))
        every = F.concat(_placed(F.translate(plain, "“”‘’", "\"\"''"), r'"([^"\n]{3,240})"', "quote", 1), *[_placed(plain, d, "date") for d in DATES], numbers)
        context = lambda r: F.concat(F.regexp_extract(r["before"], r"[^.!?\n]*\z", 0), r["match"], F.regexp_extract(r["after"], r"^[^.!?\n]*[.!?\n]?", 0))
        return F.array_distinct(F.transform(F.filter(every, lambda r: r["token"] != ""), lambda r: F.struct(r["type"].alias("type"), r["token"].alias("token"), text.compact(context(r), 260).alias("context"))))

    return text.let(certain(x), of)


def verbatim_check(answers: DataFrame, sources: DataFrame, key: str, answer: str, body: str) -> DataFrame:
    """G-19: per key checked and supported tokens, the unsupported ones and the pass rate.

    The tokens of the answers are exploded, and written once, as they are both looked up and judged; each source is read once for all
    of its key's tokens (see :mod:`.occurrences`).
    """
    tokens = answers.select(key, F.explode(verbatim_tokens(F.coalesce(answer, F.lit("")))).alias("t")).select(key, "t.*")
    numbered = Folder(answers.sparkSession, "verbatim").save(tokens.withColumn("_c", comparable(F.col("token"))), "tokens")
    held = occurring(numbered.select(key, F.col("_c").alias("token")), sources.select(key, comparable(F.col(body)).alias("text")), key).withColumnRenamed("token", "_c")
    judged = numbered.join(held.withColumn("_held", F.lit(True)), [key, "_c"], "left")
    out = judged.groupBy(key).agg(F.count("*").alias("checked"), F.count_if(F.col("_held").isNotNull()).alias("supported"), F.array_sort(F.collect_list(F.when(F.col("_held").isNull(), F.struct("type", "token", "context")))).alias("unsupported"))
    out = answers.select(key).join(out, key, "left").withColumn("checked", F.coalesce("checked", F.lit(0).cast("long"))).withColumn("supported", F.coalesce("supported", F.lit(0).cast("long")))
    return out.withColumn("unsupported", F.coalesce("unsupported", F.array().cast("array<struct<type:string,token:string,context:string>>"))).withColumn("pass_rate", pass_rate(F.col("supported"), F.col("checked")))


def audit(checked: DataFrame, models: DataFrame, key: str, model: str) -> DataFrame:
    """G-20: flagged claims (token, model, check) of verbatim results: the model is the only one that was used, else "unknown"."""
    used = models.filter(F.coalesce(model, F.lit("")) != "").groupBy(key).agg(F.min(model).alias("_a"), F.max(model).alias("_b"))
    who = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("unknown")
    made = F.transform("unsupported", lambda u: F.struct(u["token"].alias("claim"), F.coalesce(who, F.lit("unknown")).alias("model"), F.lit("verbatim").alias("check")))
    return checked.join(used, key, "left").select(key, (F.size("unsupported") > 0).alias("flagged"), made.alias("claims"))


def comparable(x: Column) -> Column:
    return F.lower(text.squash(F.translate(x, "“”‘’", "\"\"''")))


def pass_rate(supported: Column, checked: Column) -> Column:
    """G-19: four places, halves to even; 1 if nothing was to be checked."""
    return F.when(checked == 0, 1.0).otherwise(F.bround(supported / checked, 4))


def disagreements(runs: DataFrame, key: str, pos: str, summary: str) -> DataFrame:
    """G-21, F-15: per key the first run that denies and the first that affirms, if they are two."""
    low = F.lower(F.trim(summary))
    has = lambda markers: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))
    said = runs.filter(F.trim(summary) != "").select(key, pos, has(NEGATIVE).alias("no"), has(AFFIRMATIVE).alias("yes"))
    both = said.groupBy(key).agg(F.min(F.when(F.col("no"), F.col(pos))).alias("denies"), F.min(F.when(F.col("yes"), F.col(pos))).alias("affirms"), F.count("*").alias("n"))
    return both.filter((F.col("n") > 1) & (F.col("denies") != F.col("affirms"))).select(key, "denies", "affirms")


def needs_follow_up(kind: Column, status: Column, sources: Column) -> Column:
    """G-23."""
    return (kind == "abstain") | status.isin("weak_sources", "insufficient_evidence") | (sources < 2)


def weakest(df: DataFrame, key: str, pos: str, sources: str) -> DataFrame:
    """G-23: the first of the territories with the fewest sources."""
    return df.groupBy(key).agg(F.min_by(pos, F.struct(sources, pos)).alias("weakest"))


def interlock(protocol: Column, status: Column, runs: Column, allowed: list[str]) -> Column:
    """G-17: whether a session may be saved: research needs a successful scout whose model is an allowed one (or begins with it and a blank or a bracket), or a successful final or fallback synthesis."""
    known = lambda m: F.exists(F.array(*map(F.lit, allowed)), lambda a: (m == a) | m.startswith(F.concat(a, F.lit(" "))) | m.startswith(F.concat(a, F.lit("["))))
    fine = F.exists(runs, lambda r: ((r["role"] == "scout") & r["ok"] & F.coalesce(known(r["model"]), F.lit(False))) | (r["role"].isin("final", "fallback") & r["ok"]))
    return ~protocol.isin("research", "deep_research") | F.coalesce(status == "in_progress", F.lit(False)) | F.coalesce(fine, F.lit(False))


#: The mark of a source below tier 1, and what tells that a worker failed.
NON_TIER_ONE = "[NON-T1] "
FAILURES = ["error:", "timeout waiting for response", "authentication failed", "invalid_grant", "no response received"]


def tier_one_title(title: Column, required: Column, tier: Column) -> Column:
    """G-24: marks the title of a source below tier 1 where tier 1 is required, once."""
    return F.when(required & (tier > 1) & ~title.startswith(NON_TIER_ONE), F.concat(F.lit(NON_TIER_ONE), title)).otherwise(title)


def tier_one_error(domain: Column, required: Column, tier: Column, authority: Column) -> Column:
    """G-24: what is logged of it; null where nothing is wrong."""
    from .evidence import two_places

    return F.when(required & (tier > 1), F.concat(F.lit("tier-1 required but "), domain, F.lit(" scored T"), tier.cast("string"), F.lit(" (authority="), two_places(authority), F.lit(")")))


def backend_output(x: Column) -> Column:
    """G-25: struct of the answer between its label and that of the sources (empty if it says that nothing was found) and the distinct addresses, right punctuation stripped."""
    answer = F.trim(F.regexp_extract(x, r"(?s)ANSWER:\s*(.*?)\s*(?:SOURCES:|\z)", 1))
    found = F.transform(F.regexp_extract_all(x, F.lit(r"https?://[^\s<>()\]]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;\])>]+$", ""))
    return F.struct(F.when(F.upper(answer) == "NOT_FOUND", "").otherwise(answer).alias("answer"), F.array_distinct(F.filter(found, lambda u: u != "")).alias("urls"))


def failed_run(x: Column) -> Column:
    """G-22: whether a worker's text tells of a failure; no text does."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return (low == "") | F.exists(F.array(*map(F.lit, FAILURES)), lambda m: F.contains(low, m))


def first_success(df: DataFrame, key: str, pos: str, ok: str) -> DataFrame:
    """N-09, N-13: the first attempt in order that worked; null if none did."""
    return df.groupBy(key).agg(F.min(F.when(F.col(ok), F.col(pos))).alias("chosen"))


def carry_last(df: DataFrame, key: str, pos: str, value: str, into: str) -> DataFrame:
    """I-05: the last value met so far, in order."""
    return df.withColumn(into, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(pos)))
