"""A-17, E-08: titles, meta data and main text of web pages.

The title has an expression of its own.  The main text is parsed by Arrow
batches with the standard library; what counts as main text is our own rule:
script, style, navigation and footers are dropped, block elements end a line.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..shipping import ship

_DROPPED = {"script", "style", "noscript", "nav", "footer", "aside", "head", "template"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "header", "blockquote", "pre"}


#: The named characters that end in a semicolon, from the standard library's table.
_NAMED = json.dumps({name[:-1]: char for name, char in html5.items() if name.endswith(";")})


def unescaped(x: Column) -> Column:
    """E-08: character references undone once: all names, decimal and hexadecimal numbers, each up to its semicolon; what is none stays as it is, and a number that is no character becomes U+FFFD."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def undone(piece: Column) -> Column:
        def put(name: Column) -> Column:
            hexed = F.when(name.rlike("^#[xX]"), F.substring(name, F.lit(3), F.length(name))).otherwise(F.conv(F.substring(name, F.lit(2), F.length(name)), 10, 16))
            code = F.when(F.length(hexed) <= 6, F.conv(hexed, 16, 10).cast("long"))
            valid = F.coalesce((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.lit(False))
            char = F.when(valid, F.decode(F.unhex(F.lpad(hexed, F.lit(8), F.lit("0"))), "UTF-32")).otherwise("\ufffd")
            known = F.when(name == "", None).when(name.startswith("#"), char).otherwise(F.try_element_at(named, name))
            return F.coalesce(F.concat(known, F.substring(piece, F.length(name) + 2, F.length(piece))), F.concat(F.lit("&"), piece))

        return text.let(F.regexp_extract(piece, "^(#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,9}|[A-Za-z][A-Za-z0-9]*);", 1), put)

    pieces = F.split(x, "&")
    return F.when(~F.contains(x, F.lit("&")), x).otherwise(F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), undone), "")))


def title(page: Column) -> Column:
    """E-08: the title element, squashed, character references undone."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))


# Where pages say their title, author and date, in order.
TITLE_KEYS = ["og:title", "twitter:title", "parsely-title", "citation_title"]
AUTHOR_KEYS = ["author", "article:author", "parsely-author", "citation_author"]
DATE_KEYS = ["article:published_time", "date", "pubdate", "citation_publication_date", "parsely-pub-date"]


def meta(page: Column) -> Column:
    """E-08: struct of title (of the meta elements, else the title element), author and normalised date."""
    attribute = lambda tag, name: F.coalesce(F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1))
    tags = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<meta\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0)), lambda t: F.struct(attribute(t, "property").alias("property"), attribute(t, "name").alias("name"), F.trim(unescaped(attribute(t, "content"))).alias("content")))

    def of(found: Column) -> Column:
        def first(keys: list[str]) -> Column:
            by = lambda field, key: F.get(F.filter(found, lambda t: (t[field] == key) & (t["content"] != "")), F.lit(0))["content"]
            return F.coalesce(*[x for k in keys for x in (by("property", k), by("name", k))])

        return F.struct(F.coalesce(first(TITLE_KEYS), title(page)).alias("title"), first(AUTHOR_KEYS).alias("author"), text.norm_date(first(DATE_KEYS)).alias("published_date"))

    return text.let(tags, of)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.dropped: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _DROPPED:
            self.dropped.append(tag)
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.dropped:
            while self.dropped.pop() != tag:
                pass
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)


def main_text(page: str | None) -> str:
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def with_text(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    return pages.withColumn(into, parse(page))
