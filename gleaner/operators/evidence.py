"""F-03, G-01 to G-13: support of claims by paragraphs, confidence, decisions, grounding."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import containment

# Pass threshold, weights and limits.
PASS, FULL, PARTIAL = 0.45, 0.70, 0.35
SOURCE_TARGET, W_SOURCES, W_AUTHORITY, W_SCORE, W_SUPPORT = 3, 0.2, 0.3, 0.3, 0.2
SOURCE_CHARS, TOTAL_CHARS, MOST_SOURCES = 12_000, 60_000, 3


def best_paragraphs(sources: DataFrame, claims: DataFrame, key: str, text_col: str, ids: list[str], pos: str = "pos", claim: str = "claim") -> DataFrame:
    """F-03, G-01: ``sources`` with paragraph (300 characters at most), claim and score: of all pairs of a source's paragraphs and its key's claims the first with the largest score.

    ``ids`` tell sources of a key apart.  The best pair is found from counts of
    shared tokens (see :mod:`.containment`); a source's text meets nothing but its one best pair.  Without
    a score above 0 the paragraph is "n/a" and the claim the first one; without claims that is "n/a", too.
    """
    top = containment.best_pairs(sources.filter(F.col(key).isNotNull()), [key, *ids], text_col, claims, [key, pos], claim, [key], [key, *ids])
    said = claims.groupBy(key, pos).agg(F.min(claim).alias("_said"))
    first = claims.groupBy(key).agg(F.min(F.struct(pos, claim)).alias("_first")).select(key, F.col(f"_first.`{claim}`").alias("_first"))
    named = top.select(key, *ids, F.col("para").alias("_para"), F.col(pos).alias("_pos"), F.col("score").alias("_score")).join(said.withColumnRenamed(pos, "_pos"), [key, "_pos"], "left")
    out = sources.join(named, [key, *ids], "left").join(first, key, "left")
    return out.select(
        *[F.col(f"`{c}`") for c in sources.columns],
        F.when(F.col("_para").isNotNull(), F.left(F.get(text.paragraphs(F.col(text_col)), F.col("_para")), F.lit(300))).otherwise("n/a").alias("paragraph"),
        F.coalesce("_said", "_first", F.lit("n/a")).alias("claim"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
    )


def chunks(best: DataFrame, threshold: float = PASS) -> DataFrame:
    """G-02: passed from the threshold on."""
    return best.withColumn("passed", F.col("score") >= threshold)


def measured(sources: DataFrame, found: DataFrame, key: str, authority: str = "authority") -> DataFrame:
    """G-03, G-05: per key sources, mean authority, mean score, passed and failed chunks and the confidence; each mean at its own grain."""
    by_source = sources.groupBy(key).agg(F.count("*").alias("sources"), F.avg(authority).alias("authority"))
    by_chunk = found.groupBy(key).agg(F.avg("score").alias("score"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    both = by_source.join(by_chunk, key, "left")
    return both.withColumn("confidence", session_confidence(F.col("sources"), F.col("authority"), F.col("score"), F.col("passed") / (F.col("passed") + F.col("failed"))))


def session_confidence(sources: Column, authority: Column, score: Column, passed: Column) -> Column:
    """G-03: weighted number of sources, mean authority, mean score and share of passed chunks; 0 without sources or chunks."""
    value = F.least(sources / SOURCE_TARGET, F.lit(1.0)) * W_SOURCES + authority * W_AUTHORITY + score * W_SCORE + passed * W_SUPPORT
    return F.when((sources > 0) & score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.0)


#: The doubles next to the middles between cents, and whether a number that is one rounds up (its exact value decides, halves to even).
_MIDDLES = [(c + 0.5) / 100 for c in range(101)]
_UP = [Fraction(m) > Fraction(2 * c + 1, 200) or (Fraction(m) == Fraction(2 * c + 1, 200) and c % 2 == 1) for c, m in enumerate(_MIDDLES)]


def two_places(x: Column) -> Column:
    """A number from 0 to 1 with two places, rounded by its exact binary value."""
    c = F.floor(x * 100).cast("int")
    middle = F.get(F.array(*map(F.lit, _MIDDLES)), c)
    cents = c + F.when(x > middle, 1).when(x < middle, 0).otherwise(F.get(F.array(*map(F.lit, _UP)), c).cast("int"))
    return F.concat((cents / 100).cast("int").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def decision(confidence: Column, full: Column | None = None, partial: Column | None = None, abstain: Column | None = None) -> Column:
    """G-04: struct of answer kind, status, stated confidence and open question; missing thresholds are the default ones."""
    full, partial = F.coalesce(F.lit(None).cast("double") if full is None else full, F.lit(FULL)), F.coalesce(F.lit(None).cast("double") if partial is None else partial, F.lit(PARTIAL))
    abstain = F.coalesce(F.lit(None).cast("double") if abstain is None else abstain, F.lit(PARTIAL))
    question = F.concat(F.lit("Measured confidence "), two_places(confidence), F.lit(" stayed below the full-answer threshold; gather more high-authority sources or stronger paragraph overlap."))
    unmeasured = F.lit("Session confidence could not be measured from sources and evidence.")
    made = lambda kind, status, c, q: F.struct(F.lit(kind).alias("kind"), F.lit(status).alias("status"), c.alias("confidence"), q.alias("open_question"))
    return (
        F.when(confidence.isNull(), made("abstain", "weak_sources", F.lit(0.0), unmeasured))
        .when(confidence >= full, made("full", "complete", confidence, F.lit(None).cast("string")))
        .when((confidence < partial) & (confidence < abstain), made("abstain", "weak_sources", F.lit(0.0), question))
        .otherwise(made("partial", "weak_sources", confidence, question))
    )


def grounding_confidence(sources: Column, authority: Column) -> Column:
    """G-06: number of sources and mean authority, their weights made to add up to 1."""
    total = W_SOURCES + W_AUTHORITY
    value = F.least(sources / SOURCE_TARGET, F.lit(1.0)) * (W_SOURCES / total) + authority * (W_AUTHORITY / total)
    return F.when(sources > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.0)


def grounding_status(confidence: Column) -> Column:
    return F.when(confidence >= FULL, "grounded").when(confidence >= PARTIAL, "partial").otherwise("not_found")


def candidates(results: DataFrame, key: str, pos: str, terms: str, title: str = "title", snippet: str = "snippet", url: str = "url", n: int = MOST_SOURCES) -> DataFrame:
    """G-07: per key the first ``n`` addresses by relevance (ties in order) that match enough terms, then without repeats."""
    hay = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(snippet, F.lit(""))))
    hit = text.term_matches(hay, F.col(terms))
    ok = results.withColumn("_hit", hit).filter((F.col("_hit") >= text.min_matches(F.col(terms))) & (F.trim(url) != ""))
    top = ok.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_hit"), pos))).filter(F.col("_n") <= n)
    return top.groupBy(key, F.trim(url).alias("url")).agg(F.min("_n").alias("rank"))


def merge_sources(old: DataFrame, new: DataFrame, key: str, n: int = MOST_SOURCES) -> DataFrame:
    """G-08: (key, url, pos) of both: the old ones, then new addresses, ``n`` in all."""
    both = old.select(key, "url", F.lit(0).alias("_new"), "pos").unionByName(new.select(key, "url", F.lit(1).alias("_new"), "pos"))
    first = both.groupBy(key, "url").agg(F.min(F.struct("_new", "pos")).alias("_at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_at", "url"))).filter(F.col("rank") <= n).select(key, "url", "rank")


def cap_texts(sources: DataFrame, key: str, order: str, text_col: str, each: int = SOURCE_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """G-10: squashed texts clipped so that, in order, they fit the total of their key; ``clip`` is what remains of each.  ``order`` is unique within its key.

    A closed form of the running budget over (key, order, length) only: of each
    key just the rows that get something meet their texts again.
    """
    length = F.least(F.length(text.squash(F.col(text_col))), F.lit(each)).cast("long")
    sizes = sources.select(key, order, length.alias("_len")).filter("_len > 0")
    before = F.coalesce(F.sum("_len").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    clipped = sizes.select(key, order, F.greatest(F.lit(0).cast("long"), F.least(F.col("_len"), F.lit(total) - before)).alias("clip")).filter("clip > 0")
    return sources.join(clipped, [key, order]).withColumn("capped", F.left(text.squash(F.col(text_col)), F.col("clip").cast("int")))


def fingerprint(sources: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """G-11: per key the digest of its sorted ``id:digest`` lines, and how many there are.

    The lines of one session's sources, which are few and short.
    """
    line = F.concat(F.col(id_col).cast("string"), F.lit(":"), F.left(F.sha2(text.squash(F.col(text_col)), 256), F.lit(16)))
    return sources.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))


def same_sources(left: Column, right: Column, least: float = 0.8) -> Column:
    """G-12: whether two sets of keys share enough of the larger one; two empty sets do."""
    most = F.greatest(F.size(left), F.size(right))
    return F.when(most == 0, True).otherwise(F.size(F.array_intersect(left, right)) / most >= least)


def source_key(id_: Column, title: Column, body: Column) -> Column:
    """G-12: digest of id, title and the text's beginning, the latter two in squashed lower case."""
    low = lambda x: F.lower(text.squash(F.coalesce(x, F.lit(""))))
    return F.sha2(F.concat_ws("|", id_.cast("string"), low(title), F.left(low(body), F.lit(500))), 256)


def shared_keys(keys: DataFrame, group: str, key: str, least: float = 0.8) -> DataFrame:
    """G-12 between groups: (a, b, shared, same) of all pairs of groups with a key in common, from distinct (group, key).

    The pairs meet over their keys and only counts are kept, so no group is gathered.
    """
    distinct = keys.select(F.col(group).alias("g"), F.col(key).alias("k")).distinct()
    size = distinct.groupBy("g").agg(F.count("*").alias("n"))
    pairs = distinct.withColumnRenamed("g", "a").join(distinct.withColumnRenamed("g", "b"), "k").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = pairs.join(size.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "shared", (F.col("shared") / F.greatest("na", "nb") >= least).alias("same"))


# Words that a plain phrase may hold besides, and first words that make it a question.
PHRASE_STOPWORDS = ["a", "an", "and", "for", "of", "the", "to", "with"]
PHRASE_QUESTIONS = ["what", "why", "how", "when", "where", "who", "which", "compare", "latest"]


def ambiguous_phrase(x: Column, families: Column) -> Column:
    """G-13: one to four words besides stop words, all in lower case, no digit, the first no question word, met in fewer than two families of sources."""
    words = F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(PHRASE_STOPWORDS))
    plain = (x == F.lower(x)) & ~x.rlike(r"(?U)\d")
    return F.size(words).between(1, 4) & plain & ~F.coalesce(F.get(words, F.lit(0)).isin(PHRASE_QUESTIONS), F.lit(False)) & (families < 2)


def family(domain: Column, id_: Column) -> Column:
    """G-13: a source's family: its domain, else its id up to a colon."""
    return F.coalesce(F.nullif(F.lower(F.trim(domain)), F.lit("")), F.split_part(id_.cast("string"), F.lit(":"), F.lit(1)))


def heuristic_answer(backend: Column, snippets: Column, texts: Column, question: Column) -> Column:
    """G-09: the first backend answer that says something, else the first sentence of a snippet, then of a text, that has enough of the question's terms; empty if there is none.  All are arrays in order."""
    terms = text.query_terms(question)

    def fits(s: Column) -> Column:
        return (s != "") & ((F.size(terms) == 0) | (text.term_matches(F.lower(s), terms) >= text.min_matches(terms)))

    said = F.get(F.filter(F.transform(backend, text.backend_answer), lambda a: a != ""), F.lit(0))
    first = lambda xs: F.get(F.filter(F.transform(F.filter(xs, lambda x: x.isNotNull()), text.first_sentence), fits), F.lit(0))
    return F.coalesce(said, first(snippets), first(texts), F.lit(""))


def with_snippets(sources: DataFrame, results: DataFrame, key: str, pos: str, url: str = "url", snippet: str = "snippet") -> DataFrame:
    """F-07: each source's snippet by address, from the last result that has it; empty without one."""
    last = results.filter(F.coalesce(url, F.lit("")) != "").groupBy(key, url).agg(F.max_by(F.trim(F.coalesce(snippet, F.lit(""))), pos).alias("snippet"))
    return sources.join(last, [key, url], "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def verified_sources(pages: DataFrame, key: str, pos: str, url: str = "url", body: str = "text", n: int = MOST_SOURCES) -> DataFrame:
    """N-08: of each key the first ``n`` distinct addresses whose page has a text."""
    good = pages.filter(F.trim(F.coalesce(body, F.lit(""))) != "").groupBy(key, url).agg(F.min(pos).alias("_pos"))
    return good.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_pos", url))).filter(F.col("rank") <= n).drop("_pos")


def source_texts(sources: DataFrame, found: DataFrame, key: str, id_col: str, text_col: str, chunk_id: str, paragraph: str) -> DataFrame:
    """F-06: each source's own text, else the paragraphs of its chunks in order, a blank line between them; ``found(key, id, chunk id, paragraph)``."""
    joined = found.groupBy(key, id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(chunk_id).alias("c"), F.col(paragraph).alias("p")))), lambda x: x["p"]), "\n\n").alias("_chunks"))
    own = F.nullif(F.trim(F.coalesce(text_col, F.lit(""))), F.lit(""))
    return sources.join(joined, [key, id_col], "left").withColumn("evidence", F.coalesce(F.when(own.isNotNull(), F.col(text_col)), "_chunks", F.lit(""))).drop("_chunks")
