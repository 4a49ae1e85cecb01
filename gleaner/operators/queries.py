"""D: quality of search queries and of what they return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Search operators, lanes that know them, thresholds.
OPERATORS = ["site", "filetype", "intitle", "inurl"]
BROADENING = ["site", "filetype", "inurl"]
WEB_LANES = "searxng|proxy|exa|linkup|tavily|youcom|firecrawl|serper|web"
MOST_TOKENS, FEWEST_TOKENS, FLAG_REPEATS, REPAIR_REPEATS, BROADEN_TOKENS = 14, 2, 2, 3, 5
GOOD_RESULTS, GOOD_DOMAINS, TOP_SHARE = 3, 2, 0.8
PUNCTUATION = r"[.,;:!?()\[\]{}<>]"


def tokens(query: Column) -> Column:
    """D-01: split at white space."""
    return F.filter(F.split(F.coalesce(query, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def _core(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, "^-", ""), "^\"+|\"+$", "")


def operator(token: Column) -> Column:
    """D-02: the operator of a token, ``-`` for a lone one, empty for none."""
    return F.when(token == "-", "-").otherwise(F.regexp_extract(F.lower(_core(token)), f"^({'|'.join(OPERATORS)}):", 1))


def annotate(df: DataFrame, query: str, prefix: str = "q_") -> DataFrame:
    """``df`` with what the functions below read: each step is a column, so nothing is worked out twice.

    tokens: token, op, bare (the meaningful token, null for others), value (of
    an operator); low: meaningful terms in lower case; first: their first forms.
    """
    t, c = prefix + "tokens", lambda name: F.col(prefix + name)
    one = F.transform(tokens(F.col(query)), lambda x: F.struct(x.alias("token"), operator(x).alias("op"), F.regexp_replace(_core(x), f"^{PUNCTUATION}+|{PUNCTUATION}+$", "").alias("bare"), F.regexp_replace(F.trim(F.regexp_replace(_core(x), "^[^:]*:", "")), "^\"+|\"+$", "").alias("value")))
    df = df.withColumn(t, one)
    df = df.withColumn(t, F.transform(t, lambda x: F.struct(x["token"].alias("token"), x["op"].alias("op"), F.when((x["op"] == "") & x["bare"].rlike("[A-Za-z0-9]"), x["bare"]).alias("bare"), _truncated(x).alias("cut"))))
    df = df.withColumn(prefix + "terms", F.filter(F.transform(t, lambda x: x["bare"]), lambda b: b.isNotNull()))
    df = df.withColumn(prefix + "low", F.transform(prefix + "terms", F.lower))
    df = df.withColumn(prefix + "distinct", F.array_distinct(c("low")))
    return df.withColumn(prefix + "counts", F.transform(prefix + "distinct", lambda d: F.struct(F.get(c("terms"), (F.array_position(c("low"), d) - 1).cast("int")).alias("first"), d.alias("low"), F.size(F.filter(c("low"), lambda x: x == d)).alias("n"))))


def _truncated(x: Column) -> Column:
    """D-03: a lone sign, or an operator whose value is missing or too short."""
    short = F.when(x["op"] == "site", ~F.contains(x["value"], F.lit("."))).when(x["op"] == "filetype", F.length(F.regexp_replace(x["value"], r"^\.+|\.+$", "")) < 2).otherwise(F.length(x["value"]) < 2)
    return (F.regexp_replace(x["token"], "^\"+|\"+$", "") == "-") | (x["op"].isin(OPERATORS) & ((x["value"] == "") | short))


def _quotes(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))


def issues(query: Column, lane: Column, prefix: str = "q_") -> Column:
    """D-04: array of codes with details, in a fixed order; the frame is annotated."""
    one = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.alias("detail"))
    when = lambda cond, code, detail: F.when(cond, F.array(one(code, detail))).otherwise(F.array().cast("array<struct<code:string,detail:string>>"))
    n = F.size(prefix + "terms")
    repeats = F.transform(F.filter(prefix + "counts", lambda c: c["n"] >= FLAG_REPEATS), lambda c: c["first"])
    foreign = F.transform(F.filter(prefix + "tokens", lambda t: t["op"].isin("site", "filetype")), lambda t: t["token"])
    return F.concat(
        F.transform(F.filter(prefix + "tokens", lambda t: t["cut"]), lambda t: one("TRUNCATED_OPERATOR", t["token"])),
        when(_quotes(query) % 2 == 1, "UNBALANCED_QUOTES", F.lit('"')),
        when(n < FEWEST_TOKENS, "EMPTY_OR_TRIVIAL", n.cast("string")),
        when(n > MOST_TOKENS, "EXCESSIVE_LENGTH", n.cast("string")),
        when(F.size(repeats) > 0, "DUPLICATE_TERMS", F.array_join(repeats, ",")),
        when((F.size(foreign) > 0) & ~F.lower(F.coalesce(lane, F.lit(""))).rlike(WEB_LANES), "UNSUPPORTED_OPERATOR_FOR_LANE", F.array_join(foreign, ",")),
    )


def repair(df: DataFrame, into: str, prefix: str = "q_") -> DataFrame:
    """D-05: without truncated operators, terms met three times or more only once, quotes closed."""
    kept, many = prefix + "kept", prefix + "many"
    df = df.withColumn(kept, F.filter(prefix + "tokens", lambda t: ~t["cut"])).withColumn(many, F.transform(F.filter(prefix + "counts", lambda c: c["n"] >= REPAIR_REPEATS), lambda c: c["low"]))
    df = df.withColumn(prefix + "lows", F.transform(kept, lambda t: F.coalesce(F.lower(t["bare"]), F.lit(""))))
    again = lambda t, i: F.array_contains(F.col(many), F.lower(F.coalesce(t["bare"], F.lit("")))) & (F.array_position(F.col(prefix + "lows"), F.lower(F.coalesce(t["bare"], F.lit("")))) != i + 1)
    df = df.withColumn(into, F.array_join(F.transform(F.filter(kept, lambda t, i: ~again(t, i)), lambda t: t["token"]), " "))
    return df.withColumn(into, F.when(_quotes(F.col(into)) % 2 == 1, F.concat(F.col(into), F.lit('"'))).otherwise(F.col(into))).drop(kept, many, prefix + "lows")


def verdict(n: Column, domains: Column, top_share: Column, error: Column) -> Column:
    """D-06: ERROR, EMPTY, THIN or GOOD."""
    return F.when(error.isNotNull(), "ERROR").when(n == 0, "EMPTY").when((n < GOOD_RESULTS) | (domains < GOOD_DOMAINS) | (top_share > TOP_SHARE), "THIN").otherwise("GOOD")


def broaden(df: DataFrame, query: str, of: Column, into: str, prefix: str = "q_") -> DataFrame:
    """D-08: for EMPTY and THIN: without the first restrictive operator, else without the first quotes, else without the last of five terms or more; null if nothing changes."""
    ts, at, q = F.col(prefix + "tokens"), prefix + "at", F.col(query)
    strict = F.transform(ts, lambda t: (t["token"].startswith("-") & (t["token"] != "-")) | t["op"].isin(BROADENING))
    df = df.withColumn(at, F.array_position(strict, F.lit(True)).cast("int"))
    words = lambda a: F.array_join(F.transform(a, lambda t: t["token"]), " ")
    fewer = F.when((F.col(at) > 0) & (F.size(ts) > 1), words(F.filter(ts, lambda t, i: i != F.col(at) - 1)))
    unquoted = F.when(q.rlike('"[^"\\n]+"'), F.regexp_replace(q, r'^(?s)(.*?)"([^"\n]+)"(.*)$', "$1$2$3"))
    shorter = F.when((F.size(ts) > 1) & (F.size(prefix + "terms") >= BROADEN_TOKENS), words(F.slice(ts, F.lit(1), F.greatest(F.size(ts) - 1, F.lit(0)))))
    return df.withColumn(into, F.when(of.isin("EMPTY", "THIN"), F.nullif(F.coalesce(fewer, unquoted, shorter), q))).drop(at)


def may_retry(of: Column, lane: Column, cost: Column, paid: list[str]) -> Column:
    """D-09: an EMPTY or THIN verdict on a lane that is not paid and whose cost is known and not above 0."""
    return F.coalesce(of.isin("EMPTY", "THIN") & ~lane.isin(paid) & (cost.try_cast("double") <= 0), F.lit(False))


def rank(of: Column) -> Column:
    return F.when(of == "GOOD", 3).when(of == "THIN", 2).when(of == "EMPTY", 1).otherwise(0)


def second_wins(v1: Column, n1: Column, d1: Column, s1: Column, v2: Column, n2: Column, d2: Column, s2: Column) -> Column:
    """D-10: whether the second attempt beats the first: verdict, then (counts nearly equal) domains and share, then counts, domains, share; ties keep the first."""
    near = F.abs(n1 - n2) <= 1
    by_spread = F.when(d1 != d2, d2 > d1).when(s1 != s2, s2 < s1)
    return F.when(rank(v1) != rank(v2), rank(v2) > rank(v1)).otherwise(F.coalesce(F.when(near, by_spread), F.when(n1 != n2, n2 > n1), by_spread, F.lit(False)))


def counter_query(query: Column) -> Column:
    """D-14: the query that looks for the opposite."""
    return F.concat(query, F.lit(" failure OR problem OR criticism OR limitation OR bug"))


# Names under which a request carries its query, in order.
QUERY_NAMES = ["query", "q", "search_query", "term", "text", "keyword"]


def _parameter(form: Column, name: str) -> Column:
    """The first value of a parameter of form-encoded text, decoded; null if there is none or what it says cannot be decoded."""
    raw = F.regexp_extract(F.concat(F.lit("&"), form), f"[&]{name}=([^&#]*)", 1)
    return F.nullif(F.trim(F.try_url_decode(raw)), F.lit(""))


def _unwrapped(x: Column) -> Column:
    """Without a ``prefix:`` that is no search operator, if several words follow it."""
    said = F.trim(F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))
    rest = F.trim(F.regexp_replace(said, "^[^:]*:", ""))
    prefix = F.lower(F.split_part(said, F.lit(":"), F.lit(1)))
    return F.when(F.contains(said, F.lit(":")) & ~prefix.isin(OPERATORS) & F.contains(F.regexp_replace(said, "^[^:]*:", ""), F.lit(" ")) & (rest != ""), rest).otherwise(said)


def request_query(url: Column, body: Column) -> Column:
    """D-11: the query that a request carries: a field of its JSON body, of its form body, of its address, else the last part of its path if it holds several words; null if none."""
    from ..functions import urls

    text_of = lambda name: F.nullif(F.trim(F.get_json_object(body, f"$.{name}")), F.lit(""))
    json = [F.when(F.ltrim(body).startswith("{"), text_of(n)) for n in QUERY_NAMES]
    last = F.nullif(F.trim(F.try_url_decode(F.replace(F.regexp_extract(urls.part(url, 3), "([^/]+)/*$", 1), F.lit("+"), F.lit("%2B")))), F.lit(""))
    return _unwrapped(F.coalesce(*json, *[_parameter(body, n) for n in QUERY_NAMES], *[_parameter(urls.part(url, 4), n) for n in QUERY_NAMES], F.when(F.contains(last, F.lit(" ")), last)))


def substituted(request: Column, old: Column, new: Column) -> Column:
    """D-11: an address or body with another query in place of its own, encoded or not."""
    from ..sources.payloads import quote

    return F.replace(F.replace(request, quote(old), quote(new)), old, new)


def call_rows(calls: DataFrame) -> DataFrame:
    """D-12: one log row per call (ts, protocol, topic, lane, error, result_count, duration_ms, agent and, where they are known, verdict, domains, top_share, prior_count, prior_verdict, transforms); ok without error, retries told apart."""
    agent = F.coalesce(F.nullif(F.trim("agent"), F.lit("")), F.lit("unknown"))
    retry = F.col("prior_verdict").isNotNull()
    return calls.select(
        "ts", "protocol", "topic", "lane", F.col("error").isNull().alias("ok"), "duration_ms", "result_count", "error", agent.alias("agent"),
        F.col("verdict").alias("retrieval_verdict"), (F.col("verdict") == "EMPTY").alias("retrieval_empty"), F.col("domains").alias("retrieval_unique_domain_count"),
        F.col("top_share").alias("retrieval_top_domain_share"), (F.col("verdict") == "ERROR").alias("retrieval_has_error"),
        retry.alias("query_retry"), F.when(retry, F.col("transforms")).alias("query_retry_transforms"), F.when(retry, F.col("prior_count")).alias("query_retry_prior_result_count"), F.col("prior_verdict").alias("query_retry_prior_verdict"),
    )


def query_calls(payloads: DataFrame, question: str, model: str = "haiku") -> DataFrame:
    """D-13: one row per payload(key, question, lane, payload JSON, skipped): its results are counted, its error kept if it is a text; skipped payloads give none."""
    body = F.col("payload")
    error = F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.error", "variant")) == "STRING", F.get_json_object(body, "$.error"))
    held = F.from_json(F.get_json_object(body, "$.results"), "array<string>")
    n = F.size(F.filter(F.coalesce(held, F.array().cast("array<string>")), lambda r: F.ltrim(r).startswith("{")))
    return payloads.filter(~F.coalesce("skipped", F.lit(False))).select("key", F.col(question).alias("query_text"), "lane", F.lit(model).alias("worker_model"), F.lit(0).alias("duration_ms"), n.alias("result_count"), error.alias("error"))


def search_error(payload: Column) -> Column:
    """N-10: what is noted of a search: it gave no object, an error, or no results; null if all is well."""
    error = F.nullif(F.trim(F.get_json_object(payload, "$.error")), F.lit(""))
    n = F.size(F.coalesce(F.from_json(F.get_json_object(payload, "$.results"), "array<string>"), F.array().cast("array<string>")))
    return F.when(~F.coalesce(F.ltrim(payload).startswith("{"), F.lit(False)) | F.try_parse_json(payload).isNull(), "search returned a non-object payload").when(error.isNotNull(), F.concat(F.lit("search degraded: "), error)).when(n == 0, "search degraded: 0 results")


def free_lanes(df: DataFrame, keys: list[str], lanes: str, config: DataFrame) -> DataFrame:
    """N-11: one row per key and distinct lane in order, with its config's error (an unknown lane is one of its own row and stops no other) or none if it is a free api lane; other lanes go."""
    from .routing import is_free_api

    each = df.select(*keys, F.posexplode(F.array_distinct(lanes)).alias("pos", "lane"))
    met = each.join(config.select("lane", "type", "cost_per_call_usd"), "lane", "left")
    unknown = F.col("type").isNull()
    return met.filter(unknown | is_free_api(F.col("type"), F.col("cost_per_call_usd"))).select(*keys, "pos", "lane", F.when(unknown, F.concat(F.col("lane"), F.lit(" api lane config failed"))).alias("error"))
