"""C: routing of questions to lanes, authority of domains, topics, territories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls

# Rules in order with their patterns, lanes, topic and whether they skip the web.
RULES = [
    ("gov_tech_transfer", ["nasa software", "patent license", "spinoff", "tech transfer", "commercialize", "dual-use technology", "government technology", "defense open source"], ["nasa_techtransfer", "github_code", "searxng_general", "exa_direct"], "gov_tech", False),
    ("federal_court_ruling", ["court ruling", "supreme court", "circuit court", "appellate", "scotus", "opinion"], ["courtlistener", "congress_gov", "searxng_general", "paid_proxy"], "legal", False),
    ("sec_filing", ["10-k", "10-q", "8-k", "sec filing", "edgar", "form s-1", "proxy statement"], ["sec_edgar", "sec_gov", "searxng_general", "exa_direct"], "finance_filings", False),
    ("campaign_finance", ["campaign finance", "fec", "super pac", "independent expenditure"], ["fec_gov", "openstates", "congress_gov", "searxng_general", "exa_direct"], "politics", False),
    ("legislation", ["bill", "congress", "senate", "house", "statute", "h.r.", "s.b.", "legislation"], ["congress_gov", "openstates", "govinfo_gov", "searxng_general", "exa_direct"], "politics", False),
    ("state_legislation", ["state senate", "state assembly", "governor", "state law"], ["openstates", "searxng_general", "paid_proxy"], "politics", False),
    ("academic_paper", ["arxiv", "paper", "study", "peer-reviewed", "journal", "doi", "et al"], ["arxiv", "semantic_scholar", "core", "papers_with_code", "searxng_general", "exa_direct"], "academic", False),
    ("medical_research", ["clinical trial", "nih", "pubmed", "fda", "peer-reviewed", "randomized", "cohort"], ["pubmed", "semantic_scholar", "fda_gov", "nih_gov", "searxng_general", "exa_direct", "linkup_direct"], "medicine", False),
    ("ml_sota", ["state of the art", "sota", "benchmark", "leaderboard", "ablation"], ["papers_with_code", "hn_algolia", "github_code", "gitlab_code", "codeberg_code", "hf_hub", "semantic_scholar", "exa_direct"], "ml_ai", False),
    ("code_pattern", ["how to", "library", "function", "sdk", "api", "code example", "implementation"], ["github_code", "gitlab_code", "codeberg_code", "sourcehut_code", "sourcegraph", "stack_exchange", "hn_algolia", "searxng_general", "firecrawl_direct"], "code", False),
    ("error_diagnosis", ["error", "exception", "traceback", "bug", "doesn't work", "segfault", "panic"], ["stack_exchange", "github_code", "gitlab_code", "codeberg_code", "sourcegraph", "searxng_general", "exa_direct"], "code", False),
    ("breaking_news", ["today", "breaking", "just announced", "this morning", "last hour"], ["x_pulse", "bluesky_jetstream", "hn_algolia", "searxng_general", "tavily_direct", "firecrawl_direct", "paid_proxy"], "news", False),
    ("social_sentiment", ["reddit", "twitter", "x.com", "what people think", "community reaction"], ["reddit_rss", "x_pulse", "bluesky_jetstream", "hn_algolia", "searxng_forums", "youcom_direct"], "social", False),
    ("counter_evidence_focused", ["counter", "what's wrong with", "failures", "banned", "debunked", "lawsuit against"], ["searxng_forums", "reddit_failures", "hn_algolia", "paid_proxy", "courtlistener"], "any", False),
    ("dataset_lookup", ["dataset", "training data", "csv", "parquet", "kaggle dataset"], ["kaggle", "hf_datasets", "searxng_general", "exa_direct"], "datasets", False),
    ("model_lookup", ["model card", "fine-tune", "checkpoint", "weights", "gguf", "mlx model"], ["hf_hub", "papers_with_code", "github_code", "gitlab_code", "codeberg_code", "searxng_general", "exa_direct"], "ml_ai", False),
    ("memory_recall", ["check memory", "did we discuss", "what do i know about", "have i seen"], ["mentor_memory", "claude_memory_files", "obsidian", "exa_direct"], "personal", True),
    ("general_web", [".*"], ["searxng_general", "linkup_direct", "firecrawl_direct", "paid_proxy"], "general", False),
]
ALWAYS, WEB_LANES, MOST_LANES = ".*", ["searxng_general", "exa_direct"], 10
AUTHORITY = {
    "legal": {"courtlistener.com": 1.0, "supremecourt.gov": 1.0, "uscourts.gov": 1.0, "law.cornell.edu": 0.95, "scotusblog.com": 0.85, "reuters.com": 0.8, "nytimes.com": 0.7, "wikipedia.org": 0.5},
    "finance_filings": {"sec.gov": 1.0, "investor.gov": 0.9, "wsj.com": 0.85, "ft.com": 0.85, "bloomberg.com": 0.8, "reuters.com": 0.8, "yahoo.com": 0.4},
    "politics": {"congress.gov": 1.0, "fec.gov": 1.0, "openstates.org": 1.0, "govinfo.gov": 1.0, "propublica.org": 0.9, "politico.com": 0.8, "reuters.com": 0.85, "nytimes.com": 0.8},
    "medicine": {"pubmed.ncbi.nlm.nih.gov": 1.0, "nejm.org": 1.0, "thelancet.com": 1.0, "jamanetwork.com": 0.95, "cdc.gov": 0.95, "nih.gov": 0.95, "fda.gov": 0.95, "uptodate.com": 0.85, "nytimes.com": 0.5},
    "academic": {"arxiv.org": 0.9, "semanticscholar.org": 0.85, "doi.org": 0.95, "nature.com": 0.95, "science.org": 0.95, "pnas.org": 0.9},
    "code": {"github.com": 0.9, "stackoverflow.com": 0.85, "developer.mozilla.org": 0.95, "docs.python.org": 1.0, "pypi.org": 0.85, "rust-lang.org": 1.0},
    "ml_ai": {"huggingface.co": 0.95, "paperswithcode.com": 0.9, "arxiv.org": 0.9, "openai.com": 0.85, "anthropic.com": 0.9, "ai.googleblog.com": 0.85},
    "news": {"reuters.com": 0.9, "apnews.com": 0.9, "bbc.com": 0.85, "nytimes.com": 0.85, "wsj.com": 0.85, "ft.com": 0.85},
    "social": {"reddit.com": 0.7, "news.ycombinator.com": 0.65, "bsky.app": 0.6, "twitter.com": 0.5, "x.com": 0.5},
}
TOPIC_KEYWORDS = {
    "code": ["github", "source code", "stack overflow", "traceback", "exception", "sdk", "library", "function", "implementation", "code example", "api error"],
    "academic": ["arxiv", "pubmed", "doi", "peer reviewed", "peer-reviewed", "journal", "paper", "clinical trial", "randomized", "cohort", "meta analysis", "study"],
    "business": ["company", "companies", "startup", "startups", "founder", "vc", "venture", "investor", "industry", "market", "business model", "product", "well-known", "uber of", "uber for"],
}
EXAMPLE_ACTIONS = ["name ", "list ", "find ", "which ", "what are ", "identify ", "give me ", "examples", "instances", "cases"]
EXAMPLE_TARGETS = ["companies", "company", "startups", "startup", "products", "product", "examples", "instances", "cases", "often called", "called"]
META_MARKERS = ["what does ", "what counts ", "what qualifies ", "what is meant ", "in this context", "definition", "meaning", "criteria", "how should the answer", "should the answer", "how should this be formatted", "what wording best", "broad industries or narrower"]


def normalise_question(x: Column) -> Column:
    """C-01: stripped lower case; "how do i", "how can i" and "how should i" as "how to"."""
    return F.regexp_replace(F.lower(F.trim(x)), "^how (?:do|can|should) i ", "how to ")


def pattern_regex(pattern: str) -> str:
    """C-02: a literal with word borders where it begins or ends with a word character, and an optional plural."""
    word = re.compile("[0-9A-Za-z_]")
    return "(?iU)" + (r"\b" if word.match(pattern[0]) else "") + re.escape(pattern) + (r"(?:s|es)?\b" if word.match(pattern[-1]) else "")


def route(questions: DataFrame, question: str = "question", rules: list | None = None) -> DataFrame:
    """C-03: ``questions`` with rule, topic and lanes.

    The rules are literal expressions, so no join or shuffle is needed whatever
    the number of questions, and each pattern is matched once: the lengths of
    those that match are one array, from which a rule's count and size follow.
    """
    rules = rules or RULES
    text = normalise_question(F.col(question))
    sizes = lambda t: [F.array_compact(F.array(*[F.when(t.rlike(pattern_regex(p)), len(p)) for p in patterns if p != ALWAYS], F.lit(None).cast("int"))) for _, patterns, *_ in rules]
    hits = F.element_at(F.transform(F.array(text), lambda t: F.array(*sizes(t))), 1)
    known = [F.struct(F.lit(i).alias("idx"), F.lit(name).alias("name"), F.lit(topic).alias("topic"), F.array(*map(F.lit, lanes)).alias("lanes"), F.lit(skip).alias("skip"), F.lit(ALWAYS in patterns).alias("always")) for i, (name, patterns, lanes, topic, skip) in enumerate(rules)]

    def chosen(h: Column) -> Column:
        scored = F.zip_with(h, F.array(*known), lambda x, r: F.struct((-F.size(x)).alias("n"), (-F.aggregate(x, F.lit(0), lambda a, b: a + b)).alias("size"), r["idx"].alias("idx"), r.alias("rule")))
        matched = F.array_sort(F.filter(scored, lambda r: (r["n"] < 0) | r["rule"]["always"]))

        def result(m: Column) -> Column:
            first = F.get(m, F.lit(0))["rule"]
            others = F.filter(m, lambda r: (~r["rule"]["always"]) | (r["idx"] == first["idx"]))
            lanes = F.array_distinct(F.flatten(F.transform(others, lambda r: r["rule"]["lanes"])))
            lanes = F.when(first["skip"], lanes).otherwise(F.array_union(lanes, F.array(*map(F.lit, WEB_LANES))))
            return F.struct(first["name"].alias("rule"), first["topic"].alias("topic"), F.slice(lanes, 1, MOST_LANES).alias("lanes"))

        return F.element_at(F.transform(F.array(matched), result), 1)

    out = questions.withColumn("_r", F.element_at(F.transform(F.array(hits), chosen), 1))
    return out.withColumn("rule", F.col("_r.rule")).withColumn("topic", F.col("_r.topic")).withColumn("lanes", F.col("_r.lanes")).drop("_r")


def authority_table(spark: SparkSession) -> DataFrame:
    """(topic, domain, score, pos): 61 rows."""
    rows = [(topic, name, score, i) for topic, known in AUTHORITY.items() for i, (name, score) in enumerate(known.items())]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', '{d}', {s}D, {p})" for t, d, s, p in rows) + " AS t(topic, domain, score, pos)")


def with_authority(df: DataFrame, domain: str = "domain", topic: str = "topic", keys: list[str] | None = None) -> DataFrame:
    """C-05: ``df`` (one row per ``keys``) with authority: the score of the first configured domain that is the given one or a parent of it; 0 if unknown.

    Parents are exploded, so the join with the fixed table is by equality.
    """
    keys = keys or [c for c in df.columns]
    plain = df.withColumn("_parent", F.explode(urls.parents(urls.bare_domain(F.col(domain)))))
    table = F.broadcast(authority_table(df.sparkSession).select(F.col("topic").alias("_topic"), F.col("domain").alias("_known"), "score", "pos"))
    found = plain.join(table, (F.col(topic) == F.col("_topic")) & (F.col("_parent") == F.col("_known")), "left")
    return found.groupBy(*keys).agg(F.coalesce(F.min_by("score", "pos"), F.lit(0.0)).alias("authority"))


def authority_tier(score: Column, topic: Column) -> Column:
    """C-06: tier 2 without topic; from 0.85 tier 1, from 0.5 tier 2, else 3."""
    return F.when(topic.isNull(), 2).when(score >= 0.85, 1).when(score >= 0.5, 2).otherwise(3)


def choose_provider(lanes: Column) -> Column:
    """C-07: of the first lane that names one; tavily otherwise."""
    named = F.filter(F.transform(lanes, lambda x: F.regexp_extract(x, "tavily|linkup|exa|youcom", 0)), lambda p: p != "")
    return F.coalesce(F.get(named, F.lit(0)), F.lit("tavily"))


def is_free_api(kind: Column, cost: Column) -> Column:
    """C-08: an api lane whose cost is a number and not above 0."""
    return F.coalesce((kind == "api") & (cost.try_cast("double") <= 0), F.lit(False))


def topic_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("'"), F.lit("")), r"\s+", " "))


def _any(x: Column, markers: list[str]) -> Column:
    out = F.contains(x, F.lit(markers[0]))
    for m in markers[1:]:
        out = out | F.contains(x, F.lit(m))
    return out


def question_topic(x: Column) -> Column:
    """C-09: business, code or academic if only its keywords are found; mixed, business or general otherwise."""
    text = topic_text(x)
    code, academic, business = (_any(text, TOPIC_KEYWORDS[k]) for k in ("code", "academic", "business"))
    return F.when(business & ~code & ~academic, "business").when(code & ~academic & ~business, "code").when(academic & ~code & ~business, "academic").when(code | academic, "mixed").otherwise("general")


def seeks_examples(x: Column) -> Column:
    """C-10: an action marker and a target marker."""
    return _any(topic_text(x), EXAMPLE_ACTIONS) & _any(topic_text(x), EXAMPLE_TARGETS)


def is_meta(x: Column) -> Column:
    """C-10: a question about the question."""
    return _any(topic_text(x), META_MARKERS)


def cyclic_lane(index: Column, sequence: list[str], fallback: Column) -> Column:
    """C-11: lane for a 1-based index of a repeating sequence; the fallback for an empty one."""
    if not sequence:
        return fallback
    return F.element_at(F.array(*map(F.lit, sequence)), (F.pmod(index - 1, F.lit(len(sequence))) + 1).cast("int"))


def example_queries(x: Column) -> Column:
    """C-12: searches for examples; around the first quoted phrase if there is one."""
    plain = F.translate(x, "“”‘’", "\"\"''")
    phrase = F.trim(F.coalesce(F.nullif(F.regexp_extract(plain, "\"([^\"]+)\"|'([^']+)'", 1), F.lit("")), F.regexp_extract(plain, "\"([^\"]+)\"|'([^']+)'", 2)))
    first = [F.concat(x, F.lit(s)) for s in (" named examples", " list of examples", " real named cases", " real-world instances")]
    quoted = [F.concat(F.lit('"'), phrase, F.lit('"' + s)) for s in (" examples", " list", " named cases", " real-world instances")]
    more = [F.concat(x, F.lit(s)) for s in (" documented examples", " specific cases with names")]
    return F.concat(F.array(*first), F.when(phrase != "", F.array(*quoted)).otherwise(F.array(*more)))


def fill_subquestions(x: Column, candidates: Column, count: int) -> Column:
    """C-12: distinct candidates, generated searches, then numbered ones, ``count`` in all."""
    direct = F.array_distinct(F.concat(F.filter(candidates, lambda c: ~is_meta(c)), example_queries(x)))
    more = F.transform(F.sequence(F.size(direct) + 1, F.greatest(F.size(direct) + 1, F.lit(count))), lambda i: F.concat(x, F.lit(" named examples evidence source "), i.cast("string")))
    return F.slice(F.concat(direct, more), 1, count)


def territories(df: DataFrame, keys: list[str], parts: str = "parts", lanes: str = "lanes") -> DataFrame:
    """C-13: one row per part with its letter, lanes with provider, and the parts not to overlap with."""
    out = df.select(*keys, parts, lanes, F.posexplode(parts).alias("pos", "description"))
    provider = F.concat(choose_provider(F.col(lanes)), F.lit("_direct"))
    own = F.array_distinct(F.concat(F.slice(lanes, 1, 1), F.array(F.lit("searxng_general"), provider)))
    letters = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.char(i + 65))
    letter = F.char(F.col("pos") + 65)
    return out.select(*keys, letter.alias("territory"), "description", own.alias("assigned_lanes"), F.filter(letters, lambda x: x != letter).alias("not_overlap"))


def slug(x: Column) -> Column:
    """C-17: lower case, other characters as single hyphens, 80 characters at most, no hyphens at the ends."""
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(80)), "-+$", "")


# Providers of models, the model that takes over where a quota is not to be used, and where roles lead.
MODEL_PROVIDERS = {"haiku": "haiku_subagent", "sonnet": "sonnet_inline", "opus": "opus_subagent", "grok": "grok_cli", "mistral": "mistral_free_api", "gemini-flash": "agy_cli", "gemini-pro": "agy_cli"}
DEFAULT_PROVIDER = "haiku_subagent"
UNATTENDED = ["1", "true", "yes", "cron", "launchd", "nightly"]


def safe_name(x: Column) -> Column:
    """C-14: a part of a path: other characters than letters, digits, ``._-`` as single hyphens, none at the ends; "topic" if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(name == "", "topic").otherwise(name)


def dispatch(role: Column, model: Column, providers: dict[str, str] | None = None) -> Column:
    """C-14: struct of model and provider: verifiers use opus if it is asked for, else sonnet; counter-evidence uses grok; all others the model they are given."""
    table = providers or MODEL_PROVIDERS
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    made = lambda m, p: F.struct(m.alias("model"), p.alias("provider"))
    asked = F.lower(F.trim(model))
    return (
        F.when((role == "cross_model_verifier") & (asked == "opus"), made(F.lit("opus"), F.lit("opus_subagent")))
        .when(role == "cross_model_verifier", made(F.lit("sonnet"), F.lit("sonnet_inline")))
        .when(role == "counter_evidence", made(F.lit("grok"), F.lit("grok_cli")))
        .otherwise(made(asked, F.coalesce(F.try_element_at(known, asked), F.lit(DEFAULT_PROVIDER))))
    )


def work_paths(topic: Column, role: Column, territory: Column, kind: str) -> Column:
    """C-14: where a worker's brief or output goes."""
    return F.concat_ws("/", F.lit("work"), safe_name(topic), F.concat(safe_name(role), F.lit("-"), safe_name(territory), F.lit(f".{kind}.md")))


def uses_quota(model: Column) -> Column:
    """C-18: whether a model's name is of the family whose calls are counted."""
    return F.lower(F.trim(F.coalesce(model, F.lit("")))).rlike("^gemini[ -]")


def resolve_model(model: Column, default: str, scheduled: str, budget_left: Column, unattended: Column) -> Column:
    """C-18: the model that runs: the default if none is asked for; the scheduled one in place of a counted one when nobody watches or the budget is gone."""
    asked = F.coalesce(F.nullif(model, F.lit("")), F.lit(default))
    return F.when(uses_quota(asked) & (F.lower(F.trim(F.coalesce(unattended, F.lit("")))).isin(UNATTENDED) | ~budget_left), scheduled).otherwise(asked)


def with_cost(lanes: DataFrame, config: DataFrame, lane: str = "lane") -> DataFrame:
    """F-08: ``lanes`` with the cost of a call, null where the lane is unknown or its cost is no number."""
    return lanes.join(config.select(F.col("lane").alias(lane), F.col("cost_per_call_usd").try_cast("double").alias("cost")), lane, "left")


def paired(questions: Column, *others: Column) -> Column:
    """F-14: arrays of one question each side by side (named by number); an error if their lengths differ."""
    rows = F.arrays_zip(*[x.alias(str(i)) for i, x in enumerate((questions, *others))])
    same = F.lit(True)
    for x in others:
        same = same & (F.size(x) == F.size(questions))
    return F.when(same, rows).otherwise(F.raise_error(F.lit("lists of different lengths")))


def fleet_errors(df: DataFrame, key: str, count: str, declared: str, lanes: str) -> DataFrame:
    """C-15: keys whose workers are not as many as declared, or as the lanes of the plan."""
    sums = df.groupBy(key).agg(F.sum(F.greatest(F.col(count), F.lit(0))).alias("workers"), F.max(declared).alias("declared"), F.max(F.size(lanes)).alias("lanes"))
    return sums.filter((F.col("workers") != F.col("declared")) | (F.col("workers") != F.col("lanes")))


def expand_fleet(df: DataFrame, model: str = "model", count: str = "count") -> DataFrame:
    """C-15: a row per worker."""
    return df.withColumn("worker", F.explode(F.sequence(F.lit(1), F.greatest(F.col(count), F.lit(1))))).filter(F.col(count) > 0)


def newest(df: DataFrame, order: list[Column], n: int, keys: list[str] | None = None) -> DataFrame:
    """J: the first ``n`` rows, of each key if keys are given; the order must end in a unique column."""
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def rule_errors(rules: DataFrame, lanes: DataFrame, models: list[str]) -> DataFrame:
    """C-16: (name, error) of rules(name, patterns, lanes, worker_model, topic): required fields that are missing, lists that are empty, lanes and models that nobody knows."""
    name = F.coalesce("name", F.lit("<unnamed rule>"))
    gone = [F.when(F.col(c).isNull(), F.lit(f"missing required field '{c}'")) for c in ("name", "patterns", "lanes", "worker_model", "topic")]
    empty = [F.when(F.size(c) == 0, F.lit(f"empty list '{c}'")) for c in ("patterns", "lanes")]
    model = F.when(~F.col("worker_model").isin(models), F.concat(F.lit("unknown model "), F.col("worker_model")))
    own = rules.select(name.alias("name"), F.explode(F.array_compact(F.array(*gone, *empty, model))).alias("error"))
    asked = rules.select(name.alias("name"), F.explode("lanes").alias("lane"))
    lost = asked.join(lanes.select("lane").distinct(), "lane", "left_anti").select("name", F.concat(F.lit("unknown lane "), F.col("lane")).alias("error"))
    return own.unionByName(lost).distinct()
