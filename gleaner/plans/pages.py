"""Queries over web pages: addresses, kinds, authority, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import assembly, evidence, gates, rollups, routing
from ..sources import html, payloads
from .documents import SQL_SQUASH, SQL_TOKENS
from .evidence import SQL_WINDOWS
from .registry import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_CANON = """
 parts AS (SELECT page_id, url,
   lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
   lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
   regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM pages),
 canon AS (SELECT *, list_sort(list_transform(list_filter(string_split(query, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ('_ga', 'fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term')),
     lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)) AS pairs FROM parts),
 urls AS (SELECT *, scheme || '://' || host || rtrim(path, '/') || CASE WHEN len(pairs) > 0 THEN '?' || replace(array_to_string(pairs, '&'), '%20', '+') ELSE '' END AS canonical FROM canon)
"""


@R.query(f"WITH {_CANON} SELECT page_id, canonical FROM urls")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@R.query(f"WITH {_CANON} SELECT page_id, host AS domain, regexp_replace(split_part(host, ':', 1), '^\\.+', '') AS bare FROM urls")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), urls.bare_domain(F.col("url")).alias("bare"))


@R.query(f"WITH {_CANON}, p AS (SELECT page_id, string_split(split_part(host, ':', 1), '.') AS x FROM urls) SELECT page_id, array_to_string(x[i:], '.') AS parent, CAST(i AS INT) AS depth FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM p)")
def url_registered_suffixes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls.parents(urls.bare_domain(F.col("url")))).alias("pos", "parent")).select("page_id", "parent", (F.col("pos") + 1).alias("depth"))


@R.query(f"WITH {_CANON} SELECT canonical, min(page_id) AS page_id FROM urls GROUP BY canonical")
def url_dedupe_first(spark, sf_dir):
    seen = table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))
    return rollups.first_of(seen, ["canonical"], "page_id").select("canonical", "page_id")


@R.query(f"WITH {_CANON} SELECT host AS domain, count(*) AS pages, count(DISTINCT canonical) AS distinct_urls FROM urls GROUP BY host")
def seen_url_counts(spark, sf_dir):
    seen = table(spark, sf_dir, "pages").select(urls.domain(F.col("url")).alias("domain"), urls.canonical(F.col("url")).alias("canonical"))
    return seen.groupBy("domain").agg(F.count("*").alias("pages"), F.count_distinct("canonical").alias("distinct_urls"))


_TITLE = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@R.query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@R.query()
def html_main_text(spark, sf_dir):
    """A parser's result; held against a plain loop in the tests."""
    return html.with_text(table(spark, sf_dir, "pages")).select("page_id", "text")


@R.query(rf"""WITH {_CANON}, t AS (SELECT page_id, path, {_TITLE} AS title FROM urls JOIN pages USING (page_id))
 SELECT page_id, regexp_matches(title, '(?i)(?:\b(?:best|top|cheapest|worst|greatest)\b[^.]{{0,40}}?\b(?:\d{{1,3}}|picks|list|roundup)\b)|(?:\b\d{{1,3}}\s+(?:best|top|greatest)\b)|(?:\b(?:best|top)\s+\d{{1,3}}\b)')
   OR regexp_matches(replace(lower(path), '_', '-'), '(?:/(?:top|best)(?:[-/]|$))|(?:/(?:top|best)-\d{{1,3}}(?:-|/|$))|(?:-vs-)') AS listicle FROM t""")
def listicle_flags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.listicle(html.title(F.col("html")), F.col("url")).alias("listicle"))


@R.query(rf"""WITH {_CANON} SELECT page_id, regexp_matches(url, '(?i)10\.\d{{4,9}}/[^\s"''<>&]+') OR regexp_matches(path, '(?i)S\d{{15,17}}')
  OR regexp_matches(split_part(host, ':', 1), '(?:^|\.)(?:sciencedirect\.com|researchgate\.net|mdpi\.com|springer\.com|wiley\.com|tandfonline\.com|sagepub\.com|nature\.com|cell\.com|jstor\.org|academic\.oup\.com)$') AS paper,
  nullif(regexp_extract(url, '(?i)10\.\d{{4,9}}/[^\s"''<>&]+'), '') AS doi FROM urls""")
def paper_like_flags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.paper_like(F.col("url")).alias("paper"), urls.doi(F.col("url")).alias("doi"))


_AUTHORITY = "(VALUES " + ", ".join(f"('{t}', '{d}', {s}, {i})" for t, known in routing.AUTHORITY.items() for i, (d, s) in enumerate(known.items())) + ") a(topic, known, score, pos)"
_SCORES = f"""{_CANON}, q AS (SELECT page_id, split_part(host, ':', 1) AS bare, t.topic FROM urls, (VALUES ('code'), ('news'), ('social'), ('academic'), ('unknown')) t(topic)),
 scored AS (SELECT q.page_id, q.topic, coalesce(arg_min(CAST(a.score AS DOUBLE), a.pos), 0.0) AS authority FROM q LEFT JOIN {_AUTHORITY} ON a.topic = q.topic AND (q.bare = a.known OR suffix(q.bare, '.' || a.known)) GROUP BY q.page_id, q.topic)"""


def _scored(spark, sf_dir):
    topics = F.explode(F.array(*map(F.lit, ["code", "news", "social", "academic", "unknown"])))
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("domain"), topics.alias("topic"))
    return routing.with_authority(rows, keys=["page_id", "topic"])


@R.query(f"WITH {_SCORES} SELECT page_id, topic, authority FROM scored")
def authority_score(spark, sf_dir):
    return _scored(spark, sf_dir)


@R.query(f"WITH {_SCORES} SELECT topic, CAST(CASE WHEN authority >= 0.85 THEN 1 WHEN authority >= 0.5 THEN 2 ELSE 3 END AS INT) AS tier, count(*) AS n FROM scored GROUP BY 1, 2")
def authority_tier_counts(spark, sf_dir):
    tiers = _scored(spark, sf_dir).withColumn("tier", routing.authority_tier(F.col("authority"), F.col("topic")))
    return tiers.groupBy("topic", "tier").agg(F.count("*").alias("n"))


@R.query(f"WITH {_SCORES}, s AS (SELECT topic, count(*) AS n, avg(authority) AS a FROM scored GROUP BY topic) SELECT topic, round(least(n / 3.0, 1.0) * 0.4 + a * 0.6, 9) AS confidence FROM s")
def grounding_confidence(spark, sf_dir):
    by = _scored(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n"), F.avg("authority").alias("a"))
    return by.select("topic", F.round(evidence.grounding_confidence(F.col("n"), F.col("a")), 9).alias("confidence"))


@R.query(f"WITH {_CANON} SELECT domain, CAST(n AS BIGINT) AS n FROM (SELECT host AS domain, count(*) AS n FROM urls GROUP BY host) ORDER BY n DESC, domain LIMIT 5")
def blocked_top_domains(spark, sf_dir):
    return rollups.top_domains(table(spark, sf_dir, "pages").select(urls.domain(F.col("url")).alias("domain")), "domain")


@R.query(rf"""WITH {_CANON}, t AS (SELECT host, replace(lower(path), '_', '-') AS path FROM urls)
 SELECT count(*) AS events, count(DISTINCT host) AS domains, count(*) FILTER (regexp_matches(path, '(?:/(?:top|best)(?:[-/]|$))|(?:/(?:top|best)-\d{{1,3}}(?:-|/|$))|(?:-vs-)')) AS listicles FROM t""")
def blocked_summary(spark, sf_dir):
    log = table(spark, sf_dir, "pages").select(urls.domain(F.col("url")).alias("domain"), urls.listicle(F.lit(""), F.col("url")).alias("listicle"))
    return rollups.blocked(log, "domain", "listicle")


_RESULTS = f"""WITH {_CANON}, r AS (SELECT page_id // 7 AS payload, regexp_replace(split_part(host, ':', 1), '^www\\.', '') AS domain FROM urls),
 d AS (SELECT payload, domain, count(*) AS n FROM r GROUP BY ALL), q AS (SELECT payload, CAST(sum(n) AS BIGINT) AS results, count(*) AS domains, max(n) / sum(n) AS top_share FROM d GROUP BY payload)"""


def _payloads(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "pages").select(F.expr("page_id div 7").alias("payload"), urls.result_domain(none, F.col("url")).alias("domain"))
    return rollups.payload_domains(rows, "payload", "domain")


@R.query(f"{_RESULTS} SELECT payload, results, domains, round(top_share, 9) AS top_share, CASE WHEN results = 0 THEN 'EMPTY' WHEN results < 3 OR domains < 2 OR top_share > 0.8 THEN 'THIN' ELSE 'GOOD' END AS verdict FROM q")
def result_quality(spark, sf_dir):
    from ..operators import queries

    p = _payloads(spark, sf_dir)
    return p.select("payload", "results", "domains", F.round("top_share", 9).alias("top_share"), queries.verdict(F.col("results"), F.col("domains"), F.col("top_share"), F.lit(None).cast("string")).alias("verdict"))


@R.query(f"""{_RESULTS}, v AS (SELECT *, CASE WHEN results < 3 OR domains < 2 OR top_share > 0.8 THEN 2 ELSE 3 END AS rank FROM q)
 SELECT a.payload, CASE WHEN a.rank <> b.rank THEN b.rank > a.rank
   WHEN abs(a.results - b.results) <= 1 AND a.domains <> b.domains THEN b.domains > a.domains
   WHEN abs(a.results - b.results) <= 1 AND a.top_share <> b.top_share THEN b.top_share < a.top_share
   WHEN a.results <> b.results THEN b.results > a.results WHEN a.domains <> b.domains THEN b.domains > a.domains
   WHEN a.top_share <> b.top_share THEN b.top_share < a.top_share ELSE false END AS second FROM v a JOIN v b ON b.payload = a.payload + 1""")
def retry_winner(spark, sf_dir):
    from ..operators import queries

    c = F.col
    v = _payloads(spark, sf_dir).withColumn("v", queries.verdict(c("results"), c("domains"), c("top_share"), F.lit(None).cast("string")))
    a, b = v.alias("a"), v.withColumn("payload", c("payload") - 1).alias("b")
    win = queries.second_wins(*[c(f"{x}.{n}") for x in "ab" for n in ("v", "results", "domains", "top_share")])
    return a.join(b, c("a.payload") == c("b.payload")).select(c("a.payload").alias("payload"), win.alias("second"))


@R.query(f"""WITH {_CANON}, old AS (SELECT page_id // 10 AS q, canonical AS url, page_id AS pos FROM urls WHERE page_id % 10 < 2), new AS (SELECT page_id // 10 AS q, canonical AS url, page_id AS pos FROM urls WHERE page_id % 10 >= 2),
 both_ AS (SELECT q, url, 0 AS n, pos FROM old UNION ALL SELECT q, url, 1, pos FROM new), f AS (SELECT q, url, min((n, pos)) AS place FROM both_ GROUP BY q, url),
 r AS (SELECT q, url, CAST(row_number() OVER (PARTITION BY q ORDER BY place, url) AS INT) AS rank FROM f) SELECT q, url, rank FROM r WHERE rank <= 3""")
def source_merge(spark, sf_dir):
    """Two of each ten pages stand for sources that are already there, the rest for new ones; all pages are used."""
    p = table(spark, sf_dir, "pages").select(F.expr("page_id div 10").alias("q"), urls.canonical(F.col("url")).alias("url"), F.col("page_id").alias("pos"))
    return evidence.merge_sources(p.filter("pos % 10 < 2"), p.filter("pos % 10 >= 2"), "q")




def _addressed(spark, sf_dir):
    """(page_id, url, kind): some pages as repositories, posts and documents, with types."""
    i, n = F.col("page_id").cast("string"), F.col("page_id") % 8
    made = F.when(n == 0, F.concat(F.lit("https://github.com/a/r"), i, F.lit("/tree/main/x"))).when(n == 1, F.concat(F.lit("https://www.tiktok.com/@"), i)).when(n == 2, F.concat(F.lit("https://a.org/p"), i, F.lit(".pdf"))).when(n == 3, F.concat(F.lit("https://a.org/p"), i, F.lit(".DOCX?x=1"))).when(n == 4, F.concat(F.lit("https://www.instagram.com/p/"), i)).when(n == 5, F.concat(F.lit("https://github.com/a/r/issues/"), i)).otherwise(F.col("url"))
    kind = F.get(F.array(*map(F.lit, ("application/pdf; charset=x", "text/html", "", "image/png"))), (F.expr("page_id div 8") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", made.alias("url"), kind.alias("kind"))


@R.query(f"""WITH p AS (SELECT page_id, page_id % 8 AS n, page_id // 8 % 4 AS k FROM pages), d AS (SELECT *, CASE WHEN k = 0 THEN 'pdf' WHEN n = 3 OR (k = 3 AND n <> 2) THEN 'document' WHEN n = 2 AND k = 3 THEN 'maybe_pdf' WHEN n = 2 THEN 'maybe_pdf' END AS kind FROM p)
 SELECT page_id, CASE WHEN kind IN ('pdf', 'document') THEN 'document' WHEN kind = 'maybe_pdf' THEN 'maybe_pdf' WHEN n = 0 THEN 'repository' WHEN n IN (1, 4) THEN 'social' ELSE 'web' END AS route,
  CASE WHEN kind IN ('pdf', 'maybe_pdf') THEN CASE WHEN page_id % 3 = 0 THEN 'docling,pymupdf,markitdown' ELSE 'pymupdf,docling,markitdown' END WHEN kind = 'document' THEN 'markitdown' WHEN page_id % 5 = 0 THEN 'unstructured' ELSE '' END AS engines,
  CASE WHEN n = 0 THEN 'a/r' || page_id || '@main/x' END AS repo, CASE n WHEN 1 THEN 'tiktok' WHEN 4 THEN 'instagram' END AS actor FROM d""")
def reader_route(spark, sf_dir):
    """N-01 to N-03, E-05, A-24."""
    p = _addressed(spark, sf_dir)
    u, kind = F.col("url"), assembly.document_kind(F.col("url"), F.col("kind"))
    local = F.when(F.col("page_id") % 5 == 0, ".TXT").when(F.col("page_id") % 5 == 1, ".html")
    repo = urls.repository(u)
    return p.select("page_id", assembly.reader_route(u, F.col("kind")).alias("route"), F.array_join(assembly.document_engines(kind, local, F.col("page_id") % 3 == 0), ",").alias("engines"), F.when(repo.isNotNull(), F.concat(repo["owner"], F.lit("/"), repo["repo"], F.lit("@"), repo["branch"])).alias("repo"), urls.social_route(u).alias("actor"))


_LADDER = "list_concat(['trafilatura', 'crawl4ai', 'jina', 'crawlee', 'scrapling', 'firecrawl'], CASE WHEN page_id % 3 = 0 THEN ['agent_browser'] ELSE [] END, CASE WHEN page_id % 4 = 0 THEN ['publisher_oa'] ELSE [] END, ['wayback'])"


@R.query(f"""WITH a AS (SELECT page_id, {_LADDER} AS ladder, unnest(['jina', 'publisher_oa', 'agent_browser', 'wayback']) AS method, unnest([page_id % 5 = 0, page_id % 7 < 4, page_id % 2 = 0, page_id % 6 = 1]) AS ok FROM pages), t AS (SELECT *, list_position(ladder, method) AS place FROM a WHERE list_contains(ladder, method))
 SELECT page_id, arg_min(method, place) FILTER (ok) AS method, CAST(min(place) FILTER (ok) AS INT) AS won, count(*) AS tried FROM t GROUP BY page_id""")
def ladder_winners(spark, sf_dir):
    """N-04, N-05: four attempts at each page, some on rungs that its ladder lacks."""
    i = F.col("page_id")
    tries = F.array(*[F.struct(F.lit(m).alias("method"), ok.alias("ok")) for m, ok in (("jina", i % 5 == 0), ("publisher_oa", i % 7 < 4), ("agent_browser", i % 2 == 0), ("wayback", i % 6 == 1))])
    ladder = assembly.web_ladder(F.when(i % 3 == 0, 3).otherwise(1), i % 4 == 0)
    a = table(spark, sf_dir, "pages").select("page_id", ladder.alias("ladder"), F.explode(tries).alias("t")).select("page_id", "ladder", "t.*")
    return assembly.first_rung(a, "page_id", "ladder", "method", "ok")




@R.query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'A &amp; ' || page_id ELSE {_TITLE} END AS title, CASE WHEN page_id % 3 = 0 THEN 'Me, I' END AS author, CASE WHEN page_id % 3 = 0 THEN '2024-02-03' END AS published FROM pages")
def page_meta(spark, sf_dir):
    """E-08: a third of the pages have meta elements."""
    head = F.concat(F.lit('<head><meta property="og:title" content="A &amp;amp; '), F.col("page_id"), F.lit("\"><meta content='Me, I' name='author'><meta name=\"date\" content=\"on 2024-02-03\">"))
    page = F.when(F.col("page_id") % 3 == 0, F.replace(F.col("html"), F.lit("<head>"), head)).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", html.meta(page).alias("m")).select("page_id", "m.title", "m.author", F.col("m.published_date").alias("published"))


@R.query(f"""WITH {_CANON}, p AS (SELECT page_id, url, {_TITLE} AS title, host, path, html AS body, CAST(1 + page_id % 3 AS INT) AS tier FROM urls JOIN pages USING (page_id, url)),
 c AS (SELECT *, trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' ' || chr(10) || chr(9)) AS t FROM p)
 SELECT page_id, host AS domain, CASE WHEN title <> '' THEN title ELSE url END AS title, sha256(t) AS content_hash, CAST(CASE tier WHEN 3 THEN least(length(t), 1500) WHEN 2 THEN least(length(t), 9000) ELSE length(t) END AS INT) AS char_count, left(t, 200) AS preview FROM c""")
def page_records(spark, sf_dir):
    """N-06: pages as they are for texts."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", html.title(F.col("html")).alias("title"), F.col("html").alias("text"), (1 + F.col("page_id") % 3).cast("int").alias("tier"))
    return assembly.record(p).select("page_id", "domain", F.col("record_title").alias("title"), "content_hash", "char_count", "preview")


@R.query(f"""WITH p AS (SELECT page_id, page_id // 10 AS q, {_TITLE} AS title, url, page_id % 4 = 0 AS blank FROM pages), w AS (SELECT q, arg_min(title, page_id) AS question FROM p GROUP BY q),
 t AS (SELECT p.*, list_filter(regexp_extract_all(lower(question), '[a-z0-9]{{3,}}'), lambda t: t NOT IN ('a','an','and','are','did','does','for','from','how','in','is','latest','of','on','or','question','the','this','to','today','was','what','when','where','who','why')) AS terms FROM p JOIN w USING (q)),
 h AS (SELECT *, len(list_filter(terms, lambda x: contains(lower(title) || ' ' || CASE WHEN blank THEN '' ELSE lower(url) END, x))) AS hit FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hit DESC, page_id) AS n FROM h WHERE hit >= CASE WHEN len(terms) = 0 THEN 0 WHEN len(terms) = 1 THEN 1 ELSE greatest(2, (len(terms) + 1) // 2) END)
 SELECT q, trim(url) AS url, CAST(min(n) AS INT) AS rank FROM k WHERE n <= 3 GROUP BY q, trim(url)""")
def candidate_top3(spark, sf_dir):
    """G-07: ten pages are the results of a question, which is the first one's title."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr("page_id div 10").alias("q"), html.title(F.col("html")).alias("title"), "url", F.when(F.col("page_id") % 4 != 0, F.col("url")).alias("snippet"))
    asked = p.groupBy("q").agg(text.query_terms(F.min_by("title", "page_id")).alias("terms"))
    return evidence.candidates(p.join(asked, "q"), "q", "page_id", "terms")


@R.query(f"""WITH {_CANON}, p AS (SELECT page_id, page_id // 10 AS q, canonical AS url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 's' || page_id END AS body FROM urls), f AS (SELECT q, url, min(page_id) AS place FROM p WHERE body <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place, url) AS rank FROM f), l AS (SELECT q, url, arg_max(body, page_id) AS snippet FROM p GROUP BY ALL)
 SELECT r.q, r.url, CAST(rank AS INT) AS rank, snippet FROM r JOIN l ON l.q = r.q AND l.url = r.url WHERE rank <= 3""")
def verified_sources(spark, sf_dir):
    """N-08, F-07: a third of the pages has no text."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr("page_id div 10").alias("q"), urls.canonical(F.col("url")).alias("url"), F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.concat(F.lit("s"), F.col("page_id"))).alias("text"))
    return evidence.with_snippets(evidence.verified_sources(p, "q", "page_id"), p, "q", "page_id", snippet="text")


@R.query("""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '[NON-T1] T' ELSE 'T' || page_id END AS title, CAST(1 + page_id % 3 AS INT) AS tier, page_id % 2 = 0 AS required, (page_id % 200) / 200.0 AS authority FROM pages)
 SELECT page_id, CASE WHEN required AND tier > 1 AND NOT starts_with(title, '[NON-T1] ') THEN '[NON-T1] ' || title ELSE title END AS title, CASE WHEN required AND tier > 1 THEN 'tier-1 required but d.org scored T' || tier || ' (authority=' || printf('%.2f', authority::DOUBLE) || ')' END AS error FROM p""")
def tier_one_marks(spark, sf_dir):
    """G-24."""
    i = F.col("page_id")
    title = F.when(i % 3 == 0, "[NON-T1] T").otherwise(F.concat(F.lit("T"), i))
    tier, required = (1 + i % 3).cast("int"), i % 2 == 0
    return table(spark, sf_dir, "pages").select("page_id", gates.tier_one_title(title, required, tier).alias("title"), gates.tier_one_error(F.lit("d.org"), required, tier, (i % 200) / F.lit(200.0)).alias("error"))




@R.query("""WITH p AS (SELECT page_id, unnest([0, 1, 2]) AS n FROM pages WHERE page_id % 5 < 4)
 SELECT page_id, 't' || page_id || '-' || n AS title, CASE WHEN page_id % 5 = 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || n || '/' ELSE 'http://x/' || page_id || '/' || n END AS url, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'd' END AS snippet FROM p WHERE NOT (page_id % 5 = 3 AND n = 1) AND page_id % 5 <> 0
 UNION ALL SELECT page_id, 'PubMed ' || n, 'https://pubmed.ncbi.nlm.nih.gov/' || n || '/', '' FROM p WHERE page_id % 5 = 0""")
def payload_results(spark, sf_dir):
    """A-08 to A-10: id lists, lists under several names, items without title, payloads without any."""
    i = F.col("page_id")
    item = lambda n: F.concat(F.lit('{"title": "t'), i, F.lit(f'-{n}", "link": "http://x/'), i, F.lit(f'/{n}", "description": "d"}}'))
    three = F.concat_ws(", ", item(0), F.when(i % 5 == 3, F.lit('{"url": "http://no.title"}')).otherwise(item(1)), item(2))
    body = F.when(i % 5 == 0, '{"esearchresult": {"idlist": ["0", "1", "2"]}}').when(i % 5 == 1, F.concat(F.lit('{"hits": ['), three, F.lit("]}"))).when(i % 5 == 2, F.concat(F.lit('{"results": ['), three, F.lit('], "items": [{}]}'))).when(i % 5 == 3, F.concat(F.lit('{"data": ['), three, F.lit("]}"))).otherwise('{"count": 0}')
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(payloads.items(body)).alias("pos", "item"))
    return payloads.compact_results(rows, "page_id", "pos").select("page_id", "title", "url", "snippet")


@R.query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://u' WHEN 1 THEN 'http://h' WHEN 2 THEN 'https://www.semanticscholar.org/paper/7' WHEN 3 THEN 'https://news.ycombinator.com/item?id=7' WHEN 4 THEN 'https://www.courtlistener.com/?q=id:7' END AS url,
 CAST(CASE page_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 END AS INT) AS results FROM pages""")
def item_addresses(spark, sf_dir):
    """A-09, E-28: items with addresses and ids only, bodies of all shapes."""
    n = F.col("page_id") % 6
    item = F.when(n == 0, '{"url": "http://u", "html_url": "http://h"}').when(n == 1, '{"url": "", "html_url": "http://h"}').when(n == 2, '{"paperId": "7"}').when(n == 3, '{"objectID": "7"}').when(n == 4, '{"id": "7"}').otherwise("{}")
    lane = F.when(n == 2, "semantic_scholar").when(n == 3, "hn_algolia").when(n == 4, "courtlistener").otherwise("x")
    body = F.when(n == 0, "[1, 2]").when(n == 1, '{"esearchresult": {"idlist": [1, 2, 3]}}').when(n == 2, '{"hits": {"hits": [5]}}').when(n == 3, "<a:feed><a:entry/><a:entry></a:entry></a:feed>").when(n == 4, '{"papers": [{}, {}]}').otherwise("nothing")
    return table(spark, sf_dir, "pages").select("page_id", payloads.item_url(item, lane).alias("url"), text.result_count(body).alias("results"))


@R.query("""WITH p AS (SELECT page_id, url, unnest([0, 1]) AS n FROM pages) SELECT page_id, CASE n WHEN 0 THEN 'A & <i>' || page_id || '</i>' ELSE 'CD' END AS title, CASE WHEN n = 0 THEN url ELSE 'http://x/' || page_id END AS url, CASE n WHEN 1 THEN 'me' END AS author FROM p""")
def feed_entries(spark, sf_dir):
    """A-07: pages as entries of feeds with and without a prefix: one without author, one without link, one with both, one in a comment."""
    i, p = F.col("page_id"), F.when(F.col("page_id") % 2 == 0, "").otherwise("a:")
    el = lambda name, inner, attrs="": F.concat(F.lit("<"), p, F.lit(name + attrs + ">"), inner, F.lit("</"), p, F.lit(name + ">"))
    link = lambda address: F.concat(F.lit("<"), p, F.lit("link rel='self' href='"), F.replace(address, F.lit("&"), F.lit("&amp;")), F.lit("'/>"))
    name = lambda x: el("author", el("name", F.lit(x)))
    one = el("entry", F.concat(F.lit("<m:title>no</m:title>"), el("title", F.concat(F.lit("A &amp; <![CDATA[<i>"), i, F.lit("</i>]]>")), " type='html'"), link(F.col("url")), link(F.lit("http://second"))))
    two = el("entry", F.concat(el("title", F.lit("B")), name("/u/you")))
    three = el("entry", F.concat(name("/u/me"), el("title", F.lit("C<!-- c -->D")), link(F.concat(F.lit("http://x/"), i))))
    hidden = F.concat(F.lit("<!--"), el("entry", F.concat(el("title", F.lit("E")), link(F.lit("http://e")))), F.lit("-->"))
    space = F.when(p == "", f" xmlns='{payloads.ATOM}' xmlns:m='urn:m'").otherwise(f" xmlns:m='urn:m' xmlns:a='{payloads.ATOM}'")
    feed = F.concat(F.lit("<"), p, F.lit("feed"), space, F.lit(">"), el("title", F.lit("F")), one, two, three, hidden, F.lit("</"), p, F.lit("feed>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(payloads.atom(feed)).alias("e")).select("page_id", "e.*")


@R.query("""SELECT page_id, 'http://h/s?q=a%20b%2F' || page_id || '&n=5' AS address, '{"query": "a b/' || page_id || '", "n": 5}' AS body, 'k' AS key_header, 'exa' AS provider, CASE page_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'optional' WHEN 2 THEN 'env' WHEN 3 THEN 'file' ELSE 'label' END AS auth,
 CASE page_id % 3 WHEN 0 THEN 'spinoff' WHEN 1 THEN 'software' ELSE 'patent' END AS stream, CASE WHEN page_id % 2 = 0 THEN 'a%20class+org:o' ELSE 'org:o+a%20tool' END AS clause FROM pages""")
def lane_requests(spark, sf_dir):
    """A-02, A-04 to A-06."""
    i = F.col("page_id")
    made = payloads.request(F.lit("http://h/s?q={query}&n=5"), {"query": F.concat(F.lit("a b/"), i)}, {"X-Key": "env:KEY", "X-None": "env:UNSET"}, {"KEY": "k"}, F.lit('{"query": "{query}", "n": 5}'))
    auth = F.get(F.array(*map(F.lit, ("", "Optional key", "env:K", "file:/x", "label"))), (i % 5).cast("int"))
    stream = payloads.stream_of(F.get(F.array(*map(F.lit, ("a Spinoff of software", "open source", "engine"))), (i % 3).cast("int")))
    q = F.when(i % 2 == 0, "a class").otherwise(" a tool")
    p = table(spark, sf_dir, "pages").select("page_id", made.alias("r"), payloads.provider(F.lit("exa_direct")).alias("provider"), payloads.auth_kind(auth).alias("auth"), stream.alias("stream"), payloads.org_clause(q, payloads.resource_of(q), "o").alias("clause"))
    return p.select("page_id", F.col("r.url").alias("address"), F.col("r.body").alias("body"), F.when(F.size("r.headers") == 1, F.col("r.headers")["X-Key"]).alias("key_header"), "provider", "auth", "stream", "clause")


@R.query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'grounded' WHEN 1 THEN 'not_found' WHEN 3 THEN 'partial' END AS status, CASE page_id % 5 WHEN 0 THEN 'A b' WHEN 1 THEN '' WHEN 3 THEN 'c' END AS answer, CASE page_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 END::DOUBLE AS confidence,
 CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'one thing' WHEN 2 THEN 'a|b' WHEN 3 THEN '' ELSE '5' END AS missing, CASE page_id % 5 WHEN 2 THEN 'x y|z' END AS questions FROM pages""")
def model_replies(spark, sf_dir):
    """E-24 to E-26."""
    n = F.col("page_id") % 5
    reply = F.when(n == 0, 'ok ```json\n{"status": "grounded", "answer": " A  b", "confidence": 7}\n```').when(n == 1, '{"status": "not_found", "answer": "x", "confidence": 1}').when(n == 2, '{"status": "sure", "answer": "x"}').when(n == 3, '{"status": "partial", "answer": "c", "confidence": "high"}').otherwise("no json")
    missing = F.when(n == 0, F.lit(None).cast("string")).when(n == 1, '" one  thing"').when(n == 2, '["a", " ", "b"]').when(n == 3, "null").otherwise("5")
    listed = F.when(n == 2, 'so: ["x  y", "", "z"] .').otherwise("none")
    p = table(spark, sf_dir, "pages").select("page_id", text.grounding_reply(reply).alias("g"), F.array_join(text.missing_list(missing), "|").alias("missing"), F.array_join(text.json_array(listed), "|").alias("questions"))
    return p.select("page_id", "g.status", "g.answer", "g.confidence", "missing", "questions")


@R.query("""WITH c AS (SELECT page_id, list_filter(['The mill of ' || page_id || ' spins organic cotton [1]', 'Acme Mills Ltd Small runs yes from fifty pieces [2]'], lambda x: true) AS cs FROM pages) SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'Short ' || page_id ELSE array_to_string(CASE WHEN page_id % 3 = 0 THEN cs ELSE ['Uncited mill ' || page_id || ' has cotton looms', 'Acme Mills Ltd plenty of pieces there'] END, '|') END AS claims FROM c""")
def answer_claims(spark, sf_dir):
    """E-17: answers with references and a table, without references, and too short ones."""
    i = F.col("page_id").cast("string")
    cited = F.concat(F.lit("# Findings\nThe mill of "), i, F.lit(" spins organic cotton [1]\nUncited line about cotton mills there\n| Company | Small runs? |\n|---|---|\n| Acme Mills Ltd | yes from fifty pieces [2] |\n\n# Next action\nWrite to the mill about cotton prices [3]"))
    plain = F.concat(F.lit("Caveats/disagreements: of the mill there are many\nUncited mill "), i, F.lit(" has cotton looms\n|Acme Mills Ltd|plenty of pieces there|\nWhat they pay is not stated in the source\nUncited mill "), i, F.lit("  has cotton looms"))
    answer = F.when(F.col("page_id") % 3 == 0, cited).when(F.col("page_id") % 3 == 1, plain).otherwise(F.concat(F.lit(" Short  "), i))
    return assembly.with_claims(table(spark, sf_dir, "pages").select("page_id", answer.alias("a")), "a").select("page_id", F.array_join("claims", "|").alias("claims"))


@R.query(f"WITH RECURSIVE {_CANON}, d AS (SELECT page_id // 10 AS q, list(struct_pack(pos := page_id, d := regexp_extract(host, '[a-z]+$')) ORDER BY page_id) AS l FROM urls GROUP BY 1),\n s(q, l, o) AS (SELECT q, l, []::STRUCT(pos BIGINT, d VARCHAR)[] FROM d UNION ALL SELECT q, list_filter(l, lambda x: x.pos <> l[nx].pos), list_append(o, l[nx]) FROM (SELECT *, CASE WHEN len(o) > 1 AND o[-1].d = o[-2].d THEN coalesce(nullif(list_position(list_transform(l, lambda x: x.d <> o[-1].d), true), 0), 1) ELSE 1 END AS nx FROM s WHERE len(l) > 0))\n SELECT q, p.pos AS page_id, CAST(nx AS BIGINT) AS spread FROM (SELECT q, unnest(o) AS p, unnest(range(len(o))) AS nx FROM s WHERE len(l) = 0)")
def spread_domains(spark, sf_dir):
    """I-06: ten pages of a question, by the ends of their hosts."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr("page_id div 10").alias("q"), F.regexp_extract(urls.domain(F.col("url")), "[a-z]+$", 0).alias("domain"))
    return assembly.spread(p, "q", "page_id", "domain").select("q", "page_id", "spread")


@R.query("SELECT DISTINCT 'lane not configured: l' || page_id % 7 AS error FROM pages WHERE page_id % 7 >= 4")
def unconfigured_lanes(spark, sf_dir):
    """A-13, C-16, F-09."""
    need = table(spark, sf_dir, "pages").select(F.concat(F.lit("l"), F.col("page_id") % 7).alias("lane"))
    return payloads.unconfigured(need, spark.range(4).select(F.concat(F.lit("l"), F.col("id")).alias("lane"))).select("error")


_MEMORY = f"""f AS (SELECT doc_id, 'Project: p' || chr(10) || 'Topic: t' || doc_id % 3 || chr(10) || trim(text) AS text FROM documents WHERE doc_id % 4 <> 0 ORDER BY doc_id DESC LIMIT 200)"""


@R.query(f"""WITH RECURSIVE {_MEMORY}, {SQL_WINDOWS.replace('FROM documents', 'FROM f')}, q AS (SELECT item_id, {SQL_TOKENS.format(x='text')} AS of_ FROM benchmark),
 s AS (SELECT item_id, doc_id, max(len(list_intersect({SQL_TOKENS.format(x='paragraph')}, of_)) / len(of_)) AS score FROM windows, q GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0) SELECT item_id AS question_id, doc_id AS id, round(score, 9)::DOUBLE AS score FROM r WHERE n <= 5""")
def memory_results(spark, sf_dir):
    """A-11: the newest two hundred records that are not stale; 200 and 5 are the lane's limits."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("p").alias("project"), F.concat(F.lit("t"), F.col("doc_id") % 3).alias("topic"), F.col("text").alias("content"), F.col("doc_id").alias("created_at"), (F.col("doc_id") % 4 == 0).alias("stale"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return payloads.memory_results(d, q).select("question_id", "id", F.round("score", 9).alias("score"))


@R.query(f"""WITH RECURSIVE f AS (SELECT doc_id, left(text, 4000) AS text FROM documents WHERE trim(text) <> ''), {SQL_WINDOWS.replace('FROM documents', 'FROM f')}, q AS (SELECT item_id, {SQL_TOKENS.format(x='text')} AS of_ FROM benchmark),
 w AS (SELECT doc_id, {SQL_TOKENS.format(x='paragraph')} AS t FROM windows), s AS (SELECT item_id, doc_id, max(len(list_intersect(t, of_)) / len(of_)) AS score FROM w, q WHERE list_has_any(t, of_) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s)
 SELECT item_id AS question_id, doc_id AS path, round(score, 9)::DOUBLE AS score FROM r WHERE n <= 5""")
def file_results(spark, sf_dir):
    """A-12: documents as files, of which the lane reads 4,000 characters; five files a question."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.left("text", F.lit(4000)).alias("content"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return payloads.file_results(files, q).select("question_id", "path", F.round("score", 9).alias("score"))


@R.query("SELECT page_id, ['doi', 'journal', 'number', 'title', 'doi', NULL, 'journal'][1 + page_id % 7] AS kind, CASE page_id % 7 WHEN 0 THEN '10.1234/p' || page_id WHEN 1 THEN '2072-666X 9 3 ' || page_id WHEN 2 THEN 'S0123456789012345' WHEN 3 THEN 'A title here' WHEN 4 THEN '10.5555/q' || page_id WHEN 6 THEN 'micromachines 9 3 ' || page_id END AS value FROM pages")
def doi_routes(spark, sf_dir):
    """A-21: addresses of all kinds."""
    i, n = F.col("page_id").cast("string"), F.col("page_id") % 7
    made = F.when(n == 0, F.concat(F.lit("https://doi.org/10.1234/p"), i, F.lit("})."))).when(n == 6, F.concat(F.lit("https://www.mdpi.com/micromachines/9/3/"), i, F.lit("/pdf"))).when(n == 1, F.concat(F.lit("https://www.mdpi.com/2072-666X/9/3/"), i)).when(n == 2, "https://x.com/science/article/pii/S0123456789012345").when(n == 3, F.concat(F.lit("https://www.researchgate.net/publication/"), i, F.lit("_A_title%20here"))).when(n == 4, F.concat(F.lit("https://x.org/?d=10.5555%2Fq"), i)).otherwise(F.concat(F.lit("https://www.mdpi.com/2072-666X/9/3/s"), i))
    return table(spark, sf_dir, "pages").select("page_id", urls.doi_route(made).alias("d")).select("page_id", "d.kind", "d.value")


@R.query("""WITH r AS (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN 'r' || page_id END AS name FROM pages), n AS (SELECT page_id, coalesce(name, '<unnamed rule>') AS name FROM r)
 SELECT DISTINCT name, error FROM (SELECT name, 'missing required field ' || chr(39) || 'name' || chr(39) AS error FROM n WHERE page_id % 4 = 0 UNION ALL SELECT name, 'empty list ' || chr(39) || 'patterns' || chr(39) FROM n WHERE page_id % 5 = 0 UNION ALL SELECT name, 'unknown model gpt' FROM n WHERE page_id % 3 = 0 UNION ALL SELECT name, 'unknown lane l' || page_id % 7 FROM n WHERE page_id % 7 > 4 UNION ALL SELECT name, 'missing required field ' || chr(39) || 'topic' || chr(39) FROM n WHERE page_id % 11 = 0)""")
def rule_errors(spark, sf_dir):
    """C-16."""
    i = F.col("page_id")
    rules = table(spark, sf_dir, "pages").select(F.when(i % 4 != 0, F.concat(F.lit("r"), i)).alias("name"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p"))).alias("patterns"), F.array(F.concat(F.lit("l"), i % 7)).alias("lanes"), F.when(i % 3 == 0, "gpt").otherwise("haiku").alias("worker_model"), F.when(i % 11 != 0, "code").alias("topic"))
    return routing.rule_errors(rules, spark.range(5).select(F.concat(F.lit("l"), F.col("id")).alias("lane")), ["haiku"])
