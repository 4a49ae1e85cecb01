"""Text expressions: cleaning, paragraphs, tokens, overlap, trimming.

All are Column to Column and stay in the JVM.  IDs name the operator inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not count as evidence, and words that do not count as query terms.
EVIDENCE_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "with"]
QUERY_STOPWORDS = ["a", "an", "and", "are", "did", "does", "for", "from", "how", "in", "is", "latest", "of", "on", "or", "question", "the", "this", "to", "today", "was", "what", "when", "where", "who", "why"]
SIMILARITY_STOPWORDS = ["the", "and", "for", "with", "from", "that", "this"]

#: A window of a long paragraph: the rest if it fits, else up to the last space after 250 characters, else 500 characters.
WINDOW = r"(?s).{1,500}\z|.{251,499}(?= )|.{500}"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is computed once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def squash(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean(x: Column) -> Column:
    """E-06: line ends as LF, lines stripped, at most one blank line, runs of blanks as one."""
    lines = F.regexp_replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    stripped = F.array_join(F.transform(F.split(lines, "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(stripped, "\n{3,}", "\n\n"), "[ \t]{2,}", " "), r"(?U)^\s+|\s+$", "")


def norm_date(x: Column) -> Column:
    """E-07: a PDF date, or the first ISO date-time, year-month or year of a text."""
    text = F.trim(x)
    pdf = F.regexp_extract(text, r"^D:(\d{4})(\d{2})(\d{2})", 0)
    iso = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}(?:[T ][^ ]+)?|\d{4}-\d{2}|\d{4}", 0)
    full = F.regexp_replace(F.replace(iso, F.lit(" "), F.lit("T")), "[.;,]+$", "")
    as_pdf = F.concat_ws("-", F.substring(pdf, 3, 4), F.substring(pdf, 7, 2), F.substring(pdf, 9, 2))
    return F.when(pdf != "", as_pdf).when(iso == "", None).otherwise(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), full).otherwise(iso))


def partial_date(x: Column) -> Column:
    """Start of a partial ISO date (year, year-month or date) in UTC; null if it is none."""
    return F.try_to_timestamp(F.when(F.length(x) == 4, F.concat(x, F.lit("-01-01"))).when(F.length(x) == 7, F.concat(x, F.lit("-01"))).otherwise(F.left(x, F.lit(10))), F.lit("yyyy-MM-dd"))


def title_from_text(x: Column) -> Column:
    """E-09: the first line that is neither blank nor a rule, without heading marks, 200 characters at most."""
    lines = F.filter(F.transform(F.split(x, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda s: (s != "") & (s != "---"))
    return F.when(F.size(lines) > 0, F.left(F.trim(F.regexp_replace(F.get(lines, F.lit(0)), "^[# ]+", "")), F.lit(200))).otherwise("")


def title_from_markdown(x: Column) -> Column:
    """E-09: the title that front matter gives in its first lines, without quotes; else that of the text."""
    lines = F.transform(F.split(x, r"\r\n|\n|\r"), lambda s: F.trim(s))
    matter = lambda all_: F.slice(all_, F.lit(2), F.lit(39))
    end = lambda all_: F.array_position(matter(all_), F.lit("---"))
    named = lambda all_: F.get(F.filter(F.when(end(all_) > 0, F.slice(matter(all_), F.lit(1), (end(all_) - 1).cast("int"))).otherwise(matter(all_)), lambda s: F.lower(s).startswith("title:")), F.lit(0))
    given = let(lines, lambda all_: F.when(F.get(all_, F.lit(0)) == "---", named(all_)))
    return F.coalesce(F.left(F.regexp_replace(F.trim(F.regexp_replace(given, "^[^:]*:", "")), "^['\"]+|['\"]+$", ""), F.lit(200)), title_from_text(x))


def payload(title: Column, body: Column, author: Column, published: Column) -> Column:
    """E-10: title, author, date and body as one cleaned text; missing parts are left out."""
    part = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), F.trim(x)))
    return clean(F.concat_ws("\n\n", F.nullif(F.trim(title), F.lit("")), part("Author: ", author), part("Published: ", published), F.nullif(body, F.lit(""))))


def acceptable(title: Column, text: Column, least: int = 200) -> Column:
    """E-11: a title, and enough text."""
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & (F.length(F.coalesce(text, F.lit(""))) >= least)


def tier_text(x: Column, tier: Column) -> Column:
    """E-12: whole text for tier 1 or none, head and tail for tier 2, the start for tier 3."""
    cut = F.concat(F.left(x, F.lit(8000)), F.lit("\n\n[... trimmed "), (F.length(x) - 9000).cast("string"), F.lit(" chars ...]\n\n"), F.right(x, F.lit(1000)))
    return F.when(tier == 3, F.left(x, F.lit(1500))).when((tier == 2) & (F.length(x) > 9000), cut).otherwise(x)


def tier_chars(x: Column, tier: Column) -> Column:
    """E-12: the number of characters that goes with it."""
    return F.when(tier == 3, F.least(F.length(x), F.lit(1500))).when(tier == 2, F.least(F.length(x), F.lit(9000))).otherwise(F.length(x))


def paragraphs(x: Column) -> Column:
    """E-14: paragraphs between blank lines, squashed; longer ones in windows of 500 characters at most."""
    blocks = F.filter(F.transform(F.split(x, r"(?U)\n\s*\n+"), squash), lambda b: b != "")
    windows = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(WINDOW), F.lit(0))))
    return F.filter(F.transform(windows, lambda x: F.trim(x)), lambda w: w != "")


def overlap_tokens(x: Column) -> Column:
    """E-15: distinct ``[a-z0-9]+`` tokens of two characters or more that are no stop words."""
    tokens = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(EVIDENCE_STOPWORDS)))


def containment(paragraph: Column, claim: Column) -> Column:
    """E-16: share of the claim's tokens in the paragraph's; both are token arrays."""
    both = F.size(F.array_intersect(paragraph, claim))
    return F.when((F.size(paragraph) == 0) | (F.size(claim) == 0), 0.0).otherwise(both / F.size(claim))


def query_terms(x: Column) -> Column:
    """E-18: terms of three characters or more, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda t: ~t.isin(QUERY_STOPWORDS))


def term_matches(text: Column, terms: Column) -> Column:
    """E-18: how many terms are substrings of a lower-case text."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def min_matches(terms: Column) -> Column:
    """E-18: none for no terms, 1 for one, else half of them and at least 2."""
    n = F.size(terms)
    return F.when(n == 0, 0).when(n == 1, 1).otherwise(F.greatest(F.lit(2), ((n + 1) / 2).cast("int")))


def first_sentence(x: Column) -> Column:
    """E-19: up to the first full stop, question or exclamation mark before a space; 280 characters at most."""
    return F.left(F.trim(F.get(F.split(squash(x), r"(?<=[.!?])\s+", 2), F.lit(0))), F.lit(280))


def backend_answer(x: Column) -> Column:
    """E-19: the answer of a backend without labels and addresses; empty if it says that nothing was found."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(?im)^answer:\s*", ""), r"(?im)^sources:\s*$", "")
    text = squash(F.regexp_replace(bare, r"https?://[^\s<>()\]]+", ""))
    return F.when((text == "") | (F.lower(text) == "not_found"), "").otherwise(first_sentence(text))


def tokens_by_length(x: Column) -> Column:
    """E-20: a quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))


def tokens_rounded(x: Column) -> Column:
    """E-20: a quarter of the characters, halves to even, 1 at least; none for no text."""
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.length(x) / 4).cast("int")))


def compact(x: Column, most: int) -> Column:
    """E-21: squashed, and cut with an ellipsis beyond ``most`` characters."""
    text = squash(x)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(most - 3))), F.lit("...")))


def preview(x: Column, most: int = 500) -> Column:
    """E-21: squashed, and after ``most`` characters an ellipsis."""
    text = squash(x)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("...")))


def mask_secrets(x: Column, known: list[str] | None = None) -> Column:
    """E-23: known values of six characters or more and values of keys, tokens and authorizations as ``***``."""
    for value in known or []:
        if len(value) >= 6:
            x = F.replace(x, F.lit(value), F.lit("***"))
    return F.regexp_replace(x, r"(?i)((?:api_key|token|authorization)=)[^&\s]+", "$1***")


def json_object(x: Column) -> Column:
    """E-24: the text from the first brace to the last, without code fences; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(x, r"(?m)^```[a-zA-Z]*\s*$", ""), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def json_array(x: Column) -> Column:
    """E-24: the strings of the array from the first bracket to the last, squashed, empty ones left out; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(x, r"(?m)^```[a-zA-Z]*\s*$", ""), r"(?s)\[.*\]", 0)
    parsed = F.from_json(found, "array<string>")
    return F.when(found != "", F.filter(F.transform(parsed, squash), lambda s: s != ""))


def grounding_reply(x: Column) -> Column:
    """E-25: struct of status, answer and confidence of a model's JSON reply; null for another status or an answer that is missing."""
    body = json_object(x)
    get = lambda name: F.get_json_object(body, f"$.{name}")
    status, answer = get("status"), squash(F.coalesce(get("answer"), F.lit("")))
    made = lambda a, c: F.struct(status.alias("status"), a.alias("answer"), c.alias("confidence"))
    return F.when(status == "not_found", made(F.lit(""), F.lit(0.0))).when(status.isin("grounded", "partial") & (answer != ""), made(answer, confidence(get("confidence"))))


def missing_list(x: Column, most: int = 8) -> Column:
    """E-26: of a JSON value (null, a string, an array or anything else) the squashed strings, empty ones left out; of an array ``most`` at most."""
    value = F.try_parse_json(x)
    kind = F.schema_of_variant(value)
    one = squash(F.coalesce(F.try_variant_get(value, "$", "string"), x))
    some = F.filter(F.transform(F.from_json(x, "array<string>"), squash), lambda s: s != "")
    none = F.array().cast("array<string>")
    return F.when(value.isNull() | (kind == "VOID"), none).when(kind.startswith("ARRAY"), F.slice(some, 1, most)).when(one == "", none).otherwise(F.array(one))


def result_count(body: Column) -> Column:
    """E-28: how many results a body holds: a JSON array, an id list, the first list under a known name (or its hits), or a feed's entries; null if its shape is unknown."""
    size = lambda path: F.size(F.from_json(F.get_json_object(body, path), "array<string>"))
    listed = lambda path: F.when(F.ltrim(F.get_json_object(body, path)).startswith("["), size(path))
    names = ("results", "items", "data", "hits", "papers")
    feed = F.when(body.rlike(r"(?i)<(?:\w+:)?feed\b"), F.regexp_count(body, F.lit(r"(?i)<(?:\w+:)?entry\b")))
    whole = F.when(F.ltrim(body).startswith("[") & F.try_parse_json(body).isNotNull(), F.size(F.from_json(body, "array<string>")))
    return F.coalesce(whole, listed("$.esearchresult.idlist"), *[c for n in names for c in (listed(f"$.{n}"), listed(f"$.{n}.hits"))], feed)


def confidence(x: Column) -> Column:
    """E-25: a number between 0 and 1; 0 for anything else."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(0.0))))


def status_class(code: Column) -> Column:
    """E-27: what an HTTP status says about a key."""
    return F.when(code.between(200, 299), "alive").when(code.isin(401, 403), "dead_auth").when(code == 402, "dead_credits").when(code == 429, "alive_limited").when(code >= 500, "provider_error").otherwise("unknown")


def similarity_tokens(x: Column) -> Column:
    """G-39: lower-case runs of letters and digits longer than two characters, less a few words; distinct and sorted."""
    parts = F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(SIMILARITY_STOPWORDS))))


def similarity(a: Column, b: Column) -> Column:
    """G-39: Jaccard of two token arrays, or the ratio of sizes if one holds the other; 0 if one is empty."""
    both, least, most = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).when(both == least, least / most).otherwise(both / (F.size(a) + F.size(b) - both))
