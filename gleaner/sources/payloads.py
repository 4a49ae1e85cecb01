"""A-04 to A-14: requests to lanes, and what comes back, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER_SUFFIX = "_direct"


def quote(x: Column) -> Column:
    """Percent-encoding that leaves only letters, digits and ``-_.~``."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A-04: a template with ``{name}`` replaced by quoted values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), quote(value))
    return template


def request(endpoint: Column, values: dict[str, Column], headers: dict[str, str], env: dict[str, str | None], body: Column | None = None) -> Column:
    """A-04: struct of address, headers and body of a lane's request.

    ``{name}`` in the endpoint is replaced by quoted values.  A header
    ``env:NAME`` takes what the environment gives and is left out if that is not set.  A body template gets its values as JSON texts.
    """
    given = {name: env.get(spec[4:]) if spec.startswith("env:") else spec for name, spec in headers.items()}
    pairs = [F.lit(x) for name, value in given.items() if value for x in (name, value)]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    filled = F.lit(None).cast("string")
    if body is not None:
        filled = body
        for name, value in values.items():
            # The JSON text of a one-element array, without its brackets.
            filled = F.replace(filled, F.lit('"{' + name + '}"'), F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))
    return F.struct(fill(endpoint, values).alias("url"), made.alias("headers"), filled.alias("body"))


def provider(x: Column) -> Column:
    """A-02: ``name_direct`` as ``name``."""
    return F.regexp_replace(x, PROVIDER_SUFFIX + "$", "")


def auth_kind(spec: Column) -> Column:
    """A-06: none, optional, env, file or label; no secret is read."""
    s = F.lower(F.trim(F.coalesce(spec, F.lit("none"))))
    return F.when(s.isin("", "none"), "none").when(s.startswith("optional"), "optional").when(s.startswith("env:"), "env").when(s.startswith("file:"), "file").otherwise("label")


def stream_of(query: Column) -> Column:
    """A-05: which stream of a technology-transfer lane a query is for."""
    q = F.lower(query)
    return F.when(q.contains("spinoff"), "spinoff").when(q.contains("software") | q.contains("open source"), "software").otherwise("patent")


def resource_of(query: Column) -> Column:
    """A-05: whether a code host is searched for code or for repositories."""
    q = F.lower(query)
    words = ["code", "implementation", "source file", "function", "class", "module"]
    return F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w)), "code").otherwise("repositories")


def org_clause(query: Column, resource: Column, org: str) -> Column:
    """A-05: the quoted query with its organisation, which leads where repositories are searched."""
    q = quote(F.trim(query))
    return F.when(resource == "repositories", F.concat(F.lit(f"org:{org}+"), q)).otherwise(F.concat(q, F.lit(f"+org:{org}")))


def items(payload: Column) -> Column:
    """A-08: the first list of a JSON payload under results, data, hits or items, as JSON texts; ids of an id list as items with title and id."""
    lists = [F.from_json(F.get_json_object(payload, f"$.{name}"), "array<string>") for name in ("results", "data", "hits", "items")]
    ids = F.transform(F.from_json(F.get_json_object(payload, "$.esearchresult.idlist"), "array<string>"), lambda i: F.to_json(F.struct(i.alias("id"), F.concat(F.lit("PubMed "), i).alias("title"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), i, F.lit("/")).alias("url"))))
    return F.coalesce(lists[0], ids, *lists[1:], F.array().cast("array<string>"))


def item_url(item: Column, lane: Column) -> Column:
    """A-09: the first address of an item, else one made from its id."""
    get = lambda name: F.nullif(F.get_json_object(item, f"$.{name}"), F.lit(""))
    made = F.when(lane == "semantic_scholar", F.concat(F.lit("https://www.semanticscholar.org/paper/"), get("paperId"))).when(lane == "hn_algolia", F.concat(F.lit("https://news.ycombinator.com/item?id="), get("objectID"))).when(lane == "courtlistener", F.concat(F.lit("https://www.courtlistener.com/?q=id:"), get("id")))
    return F.coalesce(*[get(n) for n in ("url", "absolute_url", "html_url", "paper_url", "story_url")], made)


def compact_results(items_: DataFrame, key: str, pos: str, item: str = "item", n: int = 10) -> DataFrame:
    """A-10: of JSON items those with address (url, else link) and title, the first ``n`` of each key: url, title, snippet (content, snippet or description), engine, published_date and score."""
    from ..operators.routing import newest

    get = lambda *names: F.coalesce(*[F.nullif(F.trim(F.get_json_object(F.col(item), f"$.{x}")), F.lit("")) for x in names])
    made = items_.select(key, pos, get("url", "link").alias("url"), get("title").alias("title"), F.coalesce(get("content", "snippet", "description"), F.lit("")).alias("snippet"), get("engine").alias("engine"), get("published_date", "publishedDate").alias("published_date"), get("score").try_cast("double").alias("score"))
    return newest(made.filter(F.col("url").isNotNull() & F.col("title").isNotNull()), [F.col(pos)], n, [key])


#: Fixed value: the namespace of the feeds that are read.
ATOM = "http://www.w3.org/2005/Atom"
_FEED = "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,author:array<struct<name:string>>>>"


def atom(xml: Column) -> Column:
    """A-07: array of title, url and author of a feed's entries that have title and address, each from its own entry.

    The XML reader takes the elements of the Atom namespace, be it the default one or bound to a prefix, with entities and CDATA
    undone and comments left out; the first link counts, and the first author with a name.  What is no XML, or no Atom feed, has no entries.
    """
    bound = rf"xmlns(?::([\w.-]+))?\s*=\s*[\"']{ATOM}[\"']"
    prefix = F.regexp_extract(xml, bound, 1)
    plain = F.when(prefix == "", xml).otherwise(F.regexp_replace(xml, F.concat(F.lit("<(/?)"), prefix, F.lit(":")), F.lit("<$1")))
    entries = F.from_xml(F.when(xml.rlike(bound), plain), F.lit(_FEED))["entry"]
    text_ = lambda x: F.trim(F.coalesce(x, F.lit("")), F.lit(" \t\r\n"))
    names = lambda e: F.filter(F.transform(F.coalesce(e["author"], F.array()), lambda a: text_(a["name"])), lambda n: n != "")
    made = F.transform(
        entries,
        lambda e: F.struct(
            text_(e["title"]).alias("title"),
            text_(F.get(e["link"], F.lit(0))["_href"]).alias("url"),
            F.nullif(F.regexp_replace(F.coalesce(F.get(names(e), F.lit(0)), F.lit("")), "^/u/", ""), F.lit("")).alias("author"),
        ),
    )
    return F.coalesce(F.filter(made, lambda r: (r["title"] != "") & (r["url"] != "")), F.array().cast("array<struct<title:string,url:string,author:string>>"))


def memory_results(records: DataFrame, questions: DataFrame, scan: int = 200, n: int = 5) -> DataFrame:
    """A-11: of the newest ``scan`` records(id, project, topic, content, created_at, stale) that are not stale the ``n`` that support each question(question_id, question) best, with a score above 0: best first, then by id.

    The scan is the lane's own limit; what it leaves is a fixed number of rows.
    """
    text_ = F.trim(F.concat_ws("\n", F.concat(F.lit("Project: "), F.col("project")), F.concat(F.lit("Topic: "), F.col("topic")), F.trim(F.coalesce("content", F.lit("")))))
    recent = records.filter(~F.col("stale")).orderBy(F.desc("created_at"), F.desc("id")).limit(scan).select("id", text_.alias("text"))
    return _supporting(recent, questions, "id", n)


def file_results(files: DataFrame, questions: DataFrame, n: int = 5) -> DataFrame:
    """A-12: of files(path, content) the ``n`` that support each question best, with a score above 0: best first, then by path."""
    return _supporting(files.filter(F.trim("content") != "").select("path", F.col("content").alias("text")), questions, "path", n)


def _supporting(rows: DataFrame, questions: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows that support each question best, from counts of shared tokens; a text meets the questions only that it is best for."""
    from ..functions import text as texts
    from ..operators import containment
    from ..operators.routing import newest

    # Texts are dealt by id first: what a text shares with questions is then counted where it is, not dealt again.
    dealt = rows.repartition(id_col)
    pairs = containment.best_pairs(dealt, [id_col], "text", questions, ["question_id"], "question", [], ["question_id", id_col])
    best = newest(pairs, [F.desc("score"), F.col(id_col)], n, ["question_id"])
    return best.join(rows, id_col).select("question_id", id_col, F.left(F.get(texts.paragraphs(F.col("text")), F.col("para")), F.lit(300)).alias("snippet"), "score")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A-14: objects of a JSON-lines log; blank, broken and other lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """A-14: how many lines of a log are kept and rejected."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    good = F.coalesce(F.expr("schema_of_variant(try_parse_json(value)) like 'OBJECT%'"), F.lit(False))
    return lines.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("rejected"))


def local_files(spark: SparkSession, glob: str, most: int = 4000) -> DataFrame:
    """A-12: (path, content) of text files, the first characters of each."""
    return spark.read.format("text").option("wholetext", True).load(glob).select(F.col("_metadata.file_path").alias("path"), F.left("value", F.lit(most)).alias("content"))


def unconfigured(needed: DataFrame, configured: DataFrame) -> DataFrame:
    """A-13, C-16, F-09: lanes that are needed and not configured, as errors."""
    return needed.select("lane").distinct().join(configured.select("lane"), "lane", "left_anti").withColumn("error", F.concat(F.lit("lane not configured: "), F.col("lane")))
