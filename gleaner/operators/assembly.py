"""N, E-17, E-22, I-06, L-08: reader routes, claims of answers, session assembly, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

# Sections, lines and phrases of an answer that are no claims; headers of tables.
META_SECTIONS = ["next action", "what i would do"]
META_LINES = ["caveats/disagreements:", "**moq**", "**gots**"]
SKIP_PHRASES = ["not stated in the source", "not stated in source", "not written down", "no source proves"]
TABLE_HEADERS = ["company", "what they actually do", "what it does", "small runs?", "organic cotton?", "organic cotton"]
LEAST_TOKENS = 4
# Statuses that block, the rungs of the web ladder in order, suffixes and types of documents.
BLOCKING = [401, 403, 407, 429, 451]
RUNGS = ["trafilatura", "crawl4ai", "jina", "crawlee", "scrapling", "firecrawl"]
DOCUMENT_SUFFIXES = [".doc", ".docx", ".mp3", ".m4a", ".pdf", ".png", ".ppt", ".pptx", ".wav", ".xls", ".xlsx"]
DOCUMENT_TYPES = [
    "application/msword",
    "application/pdf",
    "application/vnd.ms-excel",
    "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
]
DOCUMENT_PREFIXES = ["audio/", "image/"]
HTML_SUFFIXES = [".html", ".htm", ".xhtml"]


def document_kind(url: Column, content_type: Column) -> Column:
    """N-03: pdf or document if the type, or else a suffix that needs none, says so; ``maybe_pdf`` for a suffix alone, which may fall through; null for anything else."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    suffix = F.lower(F.regexp_extract(urls.part(url, 3), r"(\.[A-Za-z0-9]+)$", 1))
    named = kind.isin(DOCUMENT_TYPES)
    for prefix in DOCUMENT_PREFIXES:
        named = named | kind.startswith(prefix)
    return F.when(kind == "application/pdf", "pdf").when((suffix != ".pdf") & (suffix.isin(DOCUMENT_SUFFIXES) | named), "document").when(suffix == ".pdf", "maybe_pdf")


def reader_route(url: Column, content_type: Column) -> Column:
    """N-01: document (and nothing after it), maybe_pdf (a document first, the web after it), repository, social or web."""
    kind = document_kind(url, content_type)
    return F.when(kind.isin("pdf", "document"), "document").when(kind == "maybe_pdf", "maybe_pdf").when(urls.repository(url).isNotNull(), "repository").when(urls.social_route(url).isNotNull(), "social").otherwise("web")


def document_engines(kind: Column, local_suffix: Column, prefer_docling: Column) -> Column:
    """N-02: the engines to try in order: for a PDF the preferred one, the other and the general one; for other documents the general one; for other local files but pages their text."""
    some = lambda *names: F.array(*map(F.lit, names))
    pdf = kind.isin("pdf", "maybe_pdf")
    local = F.lower(local_suffix)
    return (
        F.when(pdf & prefer_docling, some("docling", "pymupdf", "markitdown"))
        .when(pdf, some("pymupdf", "docling", "markitdown"))
        .when(kind == "document", some("markitdown"))
        .when(local.isNotNull() & ~local.isin(HTML_SUFFIXES), some("unstructured"))
        .otherwise(F.array().cast("array<string>"))
    )


def web_ladder(tier: Column, paper: Column) -> Column:
    """N-05: the rungs for a page in order: six readers, the browser for tier 3 only, the publisher for what looks like a paper, the archive."""
    one = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(*map(F.lit, RUNGS)), one(F.coalesce(tier == 3, F.lit(False)), "agent_browser"), one(F.coalesce(paper, F.lit(False)), "publisher_oa"), F.array(F.lit("wayback")))


def first_rung(attempts: DataFrame, key: str, rungs: str, method: str, ok: str) -> DataFrame:
    """N-04, N-05: per key the first rung of its ladder (an array column) that gave an acceptable page, and how many were tried; methods that are no rung of it do not count."""
    at = F.array_position(rungs, F.col(method))
    placed = attempts.withColumn("_at", at).filter("_at > 0")
    won = placed.groupBy(key).agg(F.min_by(method, F.when(F.col(ok), F.col("_at"))).alias("method"), F.min(F.when(F.col(ok), F.col("_at"))).cast("int").alias("won"), F.count("*").alias("tried"))
    return won


def record(df: DataFrame, url: str = "url", title: str = "title", body: str = "text", tier: str = "tier", topic: str | None = None) -> DataFrame:
    """N-06: a page as a source record: domain, digest of the cleaned text, characters by tier, preview of 200, whether it is a list of the best; ``cleaned`` is the text."""
    out = df.withColumn("cleaned", text.clean(F.coalesce(body, F.lit(""))))
    name = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.col(url), F.lit("")), F.lit("Untitled"))
    domain = urls.domain(F.col(url))
    return out.select("*", domain.alias("domain"), name.alias("record_title"), F.sha2("cleaned", 256).alias("content_hash"), text.tier_chars(F.col("cleaned"), F.col(tier)).alias("char_count"), F.left(text.tier_text(F.col("cleaned"), F.col(tier)), F.lit(200)).alias("preview"), urls.listicle(F.coalesce(F.trim(title), F.lit("")), F.col(url)).alias("listicle_flagged"))


def is_block(status: Column, robots: Column, failed: Column) -> Column:
    """N-07: refused by status, by robots, or by all rungs."""
    return F.coalesce(status.isin(BLOCKING), F.lit(False)) | F.coalesce(robots, F.lit(False)) | F.coalesce(failed, F.lit(False))


def enough_free(results: DataFrame, key: str, lane: str, least: int = 5) -> DataFrame:
    """N-12: whether one lane, or all together, gave enough results."""
    by = results.groupBy(key, lane).agg(F.count("*").alias("n"))
    return by.groupBy(key).agg(F.max("n").alias("most"), F.sum("n").alias("all")).withColumn("enough", (F.col("most") >= least) | (F.col("all") >= least))


def protocol(mode: Column) -> Column:
    """N-17: unknown modes search."""
    return F.when(mode.isin("search", "research"), mode).when(mode.isin("deep-research", "deep_research"), "deep_research").otherwise("search")


def assemble(runs: DataFrame, key: str) -> DataFrame:
    """N-15, N-16: runs(key, pos, kind, ok, answer, sources array) to one session each: the first successful final answer, else the first successful run's, else none; distinct sources in order."""
    rank = F.when(~F.col("ok"), None).when(F.col("kind") == "final", 0).otherwise(1)
    said = runs.groupBy(key).agg(F.min_by("answer", F.when(rank.isNotNull(), F.struct(rank.alias("r"), "pos"))).alias("answer"), F.array_sort(F.collect_list(F.struct("pos", "sources"))).alias("_s"))
    flat = F.array_distinct(F.flatten(F.transform("_s", lambda s: s["sources"])))
    return said.select(key, F.when(F.size(flat) > 0, F.col("answer")).alias("answer"), flat.alias("sources"), F.when((F.size(flat) > 0) & F.col("answer").isNotNull(), "complete").otherwise("abstain").alias("status"))


def save_decision(runs: DataFrame, key: str) -> DataFrame:
    """N-16: what is saved of runs(key, pos, kind, ok, answer): after a successful scout the first successful final, else fallback synthesis; without one, an abstention that goes round the gate."""
    place = F.when(F.col("kind") == "final", 0).when(F.col("kind") == "fallback", 1)
    said = runs.groupBy(key).agg(F.bool_or((F.col("kind") == "scout") & F.col("ok")).alias("scouted"), F.min_by(F.struct("kind", "answer"), F.when(F.col("ok") & place.isNotNull(), F.struct(place.alias("p"), "pos"))).alias("_s"))
    done = F.coalesce(F.col("scouted"), F.lit(False)) & F.col("_s").isNotNull()
    return said.select(key, F.when(done, F.col("_s.kind")).otherwise("abstain").alias("decision"), F.when(done, F.col("_s.answer")).alias("answer"), (~done).alias("bypass_gate"))


def tool_summary(arguments: Column) -> Column:
    """N-14: the summary of a tool call's JSON arguments, its weak evidence as caveats below; what is no JSON is its own summary."""
    parsed = F.try_parse_json(arguments)
    said = F.trim(F.coalesce(F.get_json_object(arguments, "$.summary"), F.lit("")))
    weak = F.filter(F.transform(F.coalesce(F.from_json(F.get_json_object(arguments, "$.weak_evidence"), "array<string>"), F.array().cast("array<string>")), lambda s: F.trim(s)), lambda w: w != "")
    lines = F.array_join(F.transform(weak, lambda w: F.concat(F.lit("- "), w)), "\n")
    with_caveats = F.regexp_replace(F.concat(said, F.lit("\n\nCaveats/disagreements:\n"), lines), r"^\s+|\s+$", "")
    return F.when(arguments.isNull(), "").when(parsed.isNull(), F.trim(arguments)).when(F.size(weak) > 0, with_caveats).otherwise(said)


def worker_note(territory: Column, role: Column, model: Column, summary: Column, paths: Column) -> Column:
    """N-18: the note of a worker: who it was, its summary, the paths of its sources (an array)."""
    said = F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.lit("No summary produced."))
    listed = F.when(F.size(paths) > 0, F.array_join(paths, "\n")).otherwise("No sources recorded.")
    return F.concat_ws("\n", F.concat(F.lit("Territory: "), territory), F.concat(F.lit("Role: "), role), F.concat(F.lit("Worker model: "), model), F.lit(""), F.lit("Summary:"), said, F.lit(""), F.lit("Source paths:"), listed, F.lit(""))


def lane_health(kind: Column, paid: Column, present: Column, status: Column, results: Column, error: Column) -> Column:
    """N-21: SKIP for paid and mcp lanes; an api lane by its answer (FAIL, EMPTY, OK, CHECK if its shape is unknown), a command or a folder by whether it is there; CHECK for the rest."""
    api = F.when(error.isNotNull() | (status >= 400), "FAIL").when(results == 0, "EMPTY").when(results > 0, "OK").otherwise("CHECK")
    return F.when(paid | (kind == "mcp"), "SKIP").when(kind == "api", api).when(kind == "cli", F.when(present, "OK").otherwise("FAIL")).when((kind == "local") & present, "OK").otherwise("CHECK")


def rung_health(needs: Column, have: Column) -> Column:
    """N-21: OK if all that a rung needs (an array) is there or it needs nothing, else FAIL."""
    return F.when(F.size(F.array_except(needs, have)) <= 0, "OK").otherwise("FAIL")


def redact_paths(x: Column) -> Column:
    """E-22: absolute paths as ``<path>/name``; addresses stay, and so does what is redacted already."""
    bare = F.regexp_replace(x, r"file:///?(?=[\w.@+~-]+/)", "/")
    return F.regexp_replace(bare, r"(?<![\w:/.>])(?:~?/|[A-Za-z]:[\\/])(?:[\w.@+~ -]*[\w.@+~-][\\/])+([\w.@+~-]+)", "<path>/$1")


def claims(answer: Column) -> Column:
    """E-17: the claims of an answer: lines and, of tables, cells with their row's label and column's header; those with a reference like [1] if there are any, else all, else the whole text.

    Three steps over the answer's lines: what each is, what it stands under (a
    fold that carries the section and the table's header on), what it claims.
    """
    within = lambda x, names: x.isin(names)
    starts = lambda x, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: x.startswith(m))
    holds = lambda x, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(x, m))
    none = F.array().cast("array<string>")

    def kind(line: Column) -> Column:
        row = line.startswith("|") & line.endswith("|")
        cells = F.when(row, F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda s: F.trim(s))).otherwise(none)
        heads = (F.size(cells) > 0) & F.forall(cells, lambda c: within(F.lower(c), TABLE_HEADERS) | c.endswith("?"))
        heading = line.startswith("#")
        idle = (line == "") | line.rlike(r"^[|\s:-]*-{2,}[|\s:-]*$") | starts(F.lower(line), META_LINES)
        return F.struct(line.alias("line"), cells.alias("cells"), heads.alias("heads"), F.when(heading, F.lower(F.trim(F.regexp_replace(line, "^#+", "")))).alias("section"), ((line == "") | heading).alias("breaks"), idle.alias("idle"))

    def carry(state: Column, x: Column) -> Column:
        section = F.coalesce(x["section"], state["section"])
        quiet = x["idle"] | x["breaks"] | within(section, META_SECTIONS)
        header = F.when(x["breaks"], none).when(~quiet & x["heads"], x["cells"]).otherwise(state["header"])
        said = F.struct(x["line"].alias("line"), x["cells"].alias("cells"), header.alias("header"))
        return F.struct(section.alias("section"), header.alias("header"), F.when(quiet | x["heads"], state["said"]).otherwise(F.concat(state["said"], F.array(said))).alias("said"))

    def offers(x: Column) -> Column:
        named = lambda k: F.coalesce(F.trim(F.regexp_replace(F.get(x["header"], k), r"\?+$", "")), F.lit(""))
        cells = F.filter(F.transform(x["cells"], lambda c, k: F.when((k > 0) & (c != ""), F.concat_ws(" ", F.get(x["cells"], F.lit(0)), named(k), c))), lambda c: c.isNotNull())
        return F.when(F.size(x["cells"]) > 0, cells).otherwise(F.array(x["line"]))

    start = F.struct(F.lit("").alias("section"), none.alias("header"), F.array().cast("array<struct<line:string,cells:array<string>,header:array<string>>>").alias("said"))
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r\n|\n|\r"), lambda line: kind(F.trim(line)))
    said = F.aggregate(lines, start, carry, lambda state: state["said"])
    every = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(said, offers)), text.squash), lambda c: (F.size(text.overlap_tokens(c)) >= LEAST_TOKENS) & ~holds(F.lower(c), SKIP_PHRASES)))
    whole = text.squash(F.coalesce(answer, F.lit("")))

    def preferred(found: Column) -> Column:
        cited = F.filter(found, lambda c: c.rlike(r"\[\d+\]"))
        return F.when(F.size(cited) > 0, cited).when(F.size(found) > 0, found).when(whole != "", F.array(whole)).otherwise(none)

    return text.let(every, preferred)


def with_claims(df: DataFrame, answer: str, into: str = "claims") -> DataFrame:
    """E-17 as a column."""
    return df.withColumn(into, claims(F.col(answer)))


def spread(df: DataFrame, key: str, pos: str, domain: str) -> DataFrame:
    """I-06: (key, pos, domain, spread) of each key's results in an order in which, where it can be helped, no domain comes three times in a row.

    Of what is left, the first is next whose domain is not that of the two
    before; if all are of that domain, the first.  The results of one question are few, so they are one array.
    """
    one = df.schema[pos].dataType.simpleString(), df.schema[domain].dataType.simpleString()
    empty = F.array().cast(f"array<struct<pos:{one[0]},domain:{one[1]}>>")
    listed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(domain).alias("domain")))).alias("_all"))

    def step(state: Column, _: Column) -> Column:
        left, out = state["left"], state["out"]
        last, before = F.try_element_at(out, F.lit(-1))["domain"], F.try_element_at(out, F.lit(-2))["domain"]
        other = F.array_position(F.transform(left, lambda x: ~x["domain"].eqNullSafe(last)), F.lit(True))
        at = F.when((F.size(out) > 1) & last.eqNullSafe(before) & (other > 0), other).otherwise(1).cast("int")
        return F.struct(F.filter(left, lambda x, i: i != at - 1).alias("left"), F.concat(out, F.array(F.get(left, at - 1))).alias("out"))

    start = F.struct(F.col("_all").alias("left"), empty.alias("out"))
    placed = F.aggregate(F.sequence(F.lit(1), F.size("_all")), start, step, lambda s: s["out"])
    return listed.select(key, F.posexplode(placed).alias("spread", "r")).select(key, F.col("r.pos").alias(pos), F.col("r.domain").alias(domain), F.col("spread").cast("long").alias("spread"))


def live_leases(log: DataFrame, day: str, now: str, cap: int = 300, minutes: int = 30) -> DataFrame:
    """H-11, L-08: uses(ts, kind used or leased) of a day: uses and leases that are not over, against the cap."""
    end = F.lit(now).cast("timestamp_ntz")
    today = log.filter(F.to_date("ts") == F.lit(day).cast("date"))
    live = (F.col("kind") == "leased") & (F.col("ts") > end - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    out = today.agg(F.count_if(F.col("kind") == "used").alias("used"), F.count_if(live).alias("leased"))
    return out.withColumn("may", F.col("used") + F.col("leased") < cap)
