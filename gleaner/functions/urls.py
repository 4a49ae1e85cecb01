"""Address expressions: canonical form, domains, kinds of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and hosts of publishers.
TRACKING = ["_ga", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
PUBLISHERS = ["sciencedirect.com", "researchgate.net", "mdpi.com", "springer.com", "wiley.com", "tandfonline.com", "sagepub.com", "nature.com", "cell.com", "jstor.org", "academic.oup.com"]
LISTICLE_TITLE = r"(?i)(?:\b(?:best|top|cheapest|worst|greatest)\b[^.]{0,40}?\b(?:\d{1,3}|picks|list|roundup)\b)|(?:\b\d{1,3}\s+(?:best|top|greatest)\b)|(?:\b(?:best|top)\s+\d{1,3}\b)"
LISTICLE_PATH = r"(?:/(?:top|best)(?:[-/]|$))|(?:/(?:top|best)-\d{1,3}(?:-|/|$))|(?:-vs-)"
JOURNAL = r"^/([^/]+)/(\d+)/(\d+)/(\d+)(?:/|$)"
DOI = r"10\.\d{4,9}/[^\s\"'<>&]+"

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, number: int) -> Column:
    """1 scheme, 2 host with port and user, 3 path, 4 query."""
    return F.regexp_extract(url, _URL, number)


def domain(url: Column) -> Column:
    """E-02: lower-case host with port and user, "local" without one."""
    return F.coalesce(F.nullif(F.lower(part(url, 2)), F.lit("")), F.lit("local"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), "^.*@", ""), ":.*$", "")


def form_encoded(x: Column) -> Column:
    """Form encoding that leaves letters, digits and ``-_.~``; a blank becomes a plus."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def canonical(url: Column) -> Column:
    """E-01: no fragment, tracking parameters or trailing slashes; scheme and host in lower case; parameters decoded, sorted and encoded alike, with a sign of equality each."""
    pairs = F.transform(F.filter(F.split(part(url, 4), "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(form_encoded(p["k"]), F.lit("="), form_encoded(p["v"]))), "&")
    scheme, place = F.lower(part(url, 1)), F.lower(part(url, 2))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(place != "", F.concat(F.lit("//"), place)).otherwise(""), F.regexp_replace(part(url, 3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def bare_domain(x: Column) -> Column:
    """C-04: lower case without scheme, path, port and leading dots."""
    return F.regexp_replace(F.split_part(F.split_part(F.regexp_replace(F.lower(F.trim(x)), "^.*?://", ""), F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)), r"^\.+", "")


def result_domain(given: Column, *urls: Column) -> Column:
    """D-07: the given domain, else the host of the first address, without port and ``www.``; null for mail addresses."""
    first = F.coalesce(*[F.nullif(F.trim(u), F.lit("")) for u in urls])
    raw = F.coalesce(F.nullif(F.lower(F.trim(given)), F.lit("")), F.nullif(F.lower(F.coalesce(F.nullif(part(first, 2), F.lit("")), part(first, 3))), F.lit("")))
    plain = F.regexp_replace(F.split_part(F.split_part(raw, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)), r"^www\.", "")
    return F.when(F.contains(raw, F.lit("@")) & ~F.contains(raw, F.lit("/")), None).otherwise(F.nullif(plain, F.lit("")))


def listicle(title: Column, url: Column) -> Column:
    """E-03: "top ten" pages by title or path."""
    return title.rlike(LISTICLE_TITLE) | F.replace(F.lower(part(url, 3)), F.lit("_"), F.lit("-")).rlike(LISTICLE_PATH)


def paper_like(url: Column) -> Column:
    """E-04: a DOI, an article number in the path, or a publisher's host."""
    known = F.lit(False)
    for p in PUBLISHERS:
        known = known | (host(url) == p) | host(url).endswith("." + p)
    return url.rlike("(?i)" + DOI) | part(url, 3).rlike(r"(?i)S\d{15,17}") | known


def doi(url: Column) -> Column:
    """A-21: the DOI of an address without closing punctuation; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(url, "(?i)" + DOI, 0), r"[).,;:\] }]+$", "")
    return F.nullif(found, F.lit(""))


def doi_route(url: Column) -> Column:
    """A-21: struct of how a DOI is found and by what: in the address itself, by journal, volume, issue and page, by an article number, or by a title in the path; null if nothing leads to one."""
    path = part(url, 3)
    journal, *parts = [F.regexp_extract(path, JOURNAL, k) for k in range(5)]
    number = F.regexp_extract(path, r"(?i)S\d{15,17}", 0)
    title = F.regexp_extract(_decoded(path), r"(?i)/publication/\d+_([^/?#]+)", 1)
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return (
        F.when(doi(_decoded(url)).isNotNull(), made("doi", doi(_decoded(url))))
        .when(host(url).endswith("mdpi.com") & (journal != ""), made("journal", F.concat_ws(" ", *parts)))
        .when(number != "", made("number", number))
        .when(title != "", made("title", F.trim(F.replace(title, F.lit("_"), F.lit(" ")))))
    )


def repository(url: Column) -> Column:
    """E-05: struct of owner, repo and branch of a repository's root or tree; null for anything else."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(part(url, 3), "/+$", ""), r"\.git$", ""), "/"), lambda s: s != "")
    at_root, in_tree = F.size(parts) == 2, (F.size(parts) > 2) & (F.get(parts, F.lit(2)) == "tree")
    branch = F.nullif(F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts), F.lit(1))), "/"), F.lit(""))
    found = F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("repo"), F.when(in_tree, branch).alias("branch"))
    return F.when(F.lower(part(url, 2)).isin("github.com", "www.github.com") & (at_root | in_tree), found)


def social_route(url: Column) -> Column:
    """A-24: the reader for a social network's host or subdomain; null for others."""
    of = lambda name: (host(url) == name) | host(url).endswith("." + name)
    return F.when(of("instagram.com"), "instagram").when(of("tiktok.com"), "tiktok")


def parents(x: Column) -> Column:
    """``a.b.c`` as [a.b.c, b.c, c], for equi-joins on domain suffixes."""
    labels = F.split(x, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
