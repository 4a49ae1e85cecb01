"""Line dedup by a log-template tree.

A line's way through the tree has a fixed depth: its number of words, then its
first ``depth`` words, words with digits counting as ``<*>``.  Within a leaf a
word stays in the template if it recurs at its place; all other words are
variable fields (``<*>``).  A template that keeps at least ``constant`` of its
words and recurs itself is dropped: its lines go from all documents but the
first that has it (the smallest doc_id), so that no content is lost altogether.
To recur is to be met in ``min_lines`` lines or more (each distinct line of a
document once) and in two documents at least.

Everything is counted and nothing gathered: tasks combine before each shuffle,
so a line that a third of all documents share costs a row for each task.  A leaf
that does not recur cannot hold a template that does, and one whose lines are
all the same has that line as its template.  Only lines of the other leaves have
their words counted, each distinct line once with its number.

A leaf goes by a 64-bit hash, a line or template by 128 bits.

Words are runs of characters other than ``[\\x20\\x09-\\x0D]`` within lines cut
at ``\\n``.  Lines of fewer than ``min_words`` words (those without a word, as a
rule) are never dropped.

What is dropped of a document is a sorted list of line numbers, and its text is
put together from the slices between them, so a long document costs no more than
its length.

Defined results: null and empty texts come back as they are; rows without
doc_id are neither counted nor changed; rows that share a doc_id count as one
document, and a line that goes goes from each of them.  An empty table gives an
empty one.  Other columns stay as they are, but for one with the name of an
added column, which is replaced; their names clash with nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits
from .matches import let
from .workspace import Workspace

DEPTH, MIN_LINES, MIN_WORDS, CONSTANT = 3, 2, 1, 0.7
_WORDS = r"[^\x20\x09-\x0D]+"


_SPACES = "\t\x0b\x0c\r"


def _plain(line: Column) -> Column:
    """Whether single blanks are all the white space of a line that has a word; such lines need no pattern."""
    odd = line.startswith(" ") | line.endswith(" ") | F.contains(line, F.lit("  "))
    for c in _SPACES:
        odd = odd | F.contains(line, F.lit(c))
    return (line != "") & ~odd


def _words(line: Column) -> Column:
    return F.when(_plain(line), F.split(line, " ")).otherwise(F.regexp_extract_all(line, F.lit(_WORDS), F.lit(0)))


def _count(line: Column) -> Column:
    return F.when(_plain(line), F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).otherwise(F.regexp_count(line, F.lit(_WORDS + "+")))


def _leaf(line: Column, n: Column, depth: int) -> Column:
    """Hash of the number of words and the leading words; only these are taken out of the line."""
    head = F.regexp_extract(line, rf"^(?:[\x20\x09-\x0D]*+{_WORDS}+){{1,{depth}}}", 0)
    lead = F.when(_plain(line), F.substring_index(line, " ", depth)).otherwise(F.array_join(F.regexp_extract_all(head, F.lit(_WORDS), F.lit(0)), " "))
    return F.xxhash64(n, F.when(lead.rlike("[0-9]"), F.regexp_replace(lead, "[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(lead))


def _key(line: Column) -> Column:
    """128 bits in place of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _met(*n: Column) -> list[Column]:
    """Lines, first and last document of a group."""
    return [F.sum(n[0]).alias("n") if n else F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]


def recurring(docs: DataFrame, ws: Workspace, depth: int = DEPTH, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, constant: float = CONSTANT) -> DataFrame:
    """(key, first) of ``docs(id, text)``: the lines, by key, that are dropped after document ``first``."""
    recurs = (F.col("n") >= min_lines) & (F.col("lo") < F.col("hi"))
    lines = docs.filter("id is not null and text is not null").select("id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = lines.select(F.col("id").alias("lo"), F.col("id").alias("hi"), "line", _count(F.col("line")).alias("words")).filter(F.col("words") >= min_words)
    lines = lines.select("lo", "hi", "line", _leaf(F.col("line"), F.col("words"), depth).alias("leaf"))
    one = _key(F.col("line"))
    leaves = lines.select("leaf", "lo", "hi", one["a"].alias("a"), one["b"].alias("b")).groupBy("leaf").agg(*_met(), F.min("a").alias("a"), F.max("a").alias("a2"), F.max("b").alias("b"))
    leaves = ws.save(leaves.filter(recurs), "leaves")
    # In a leaf of one line all words stay: the line is the template.
    alone = leaves.filter("a = a2").select(F.struct("a", "b").alias("key"), F.col("lo").alias("first"))
    busy = leaves.filter("a <> a2").select("leaf")
    near = bits.near(lines, "leaf", busy, busy.count())
    distinct = ws.save(near.select("leaf", "lo", "hi", "line").join(busy, "leaf").groupBy("leaf", "line").agg(*_met()), "lines")

    words = distinct.select("leaf", "n", "lo", "hi", _key(F.col("line")).alias("key"), F.posexplode(_words(F.col("line"))).alias("at", "word"))
    kept = words.groupBy("leaf", "at", "word").agg(*_met(F.col("n"))).filter(recurs).select("leaf", "at", "word", F.lit(True).alias("kept"))
    marked = words.join(kept, ["leaf", "at", "word"], "left")
    shaped = marked.groupBy("leaf", "key", "n", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("kept"), F.col("word")).otherwise(F.lit("<*>")).alias("word")))).alias("at"), F.avg(F.coalesce(F.col("kept").cast("int"), F.lit(0))).alias("share"))
    shaped = ws.save(shaped.filter(F.col("share") >= constant).select("leaf", "key", "n", "lo", "hi", F.array_join(F.transform("at", lambda x: x["word"]), " ").alias("template")).withColumn("same", _key(F.col("template"))), "templates")
    found = shaped.groupBy("leaf", "same").agg(*_met(F.col("n"))).filter(recurs).select("leaf", "same", F.col("lo").alias("first"))
    return shaped.join(found, ["leaf", "same"]).select("key", "first").unionByName(alone)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str | None = None, counts: tuple[str, str] | None = None, depth: int = DEPTH, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, constant: float = CONSTANT) -> DataFrame:
    """``docs`` with the remaining lines in ``into`` (default: the text column) and, on request, numbers of lines and of dropped lines."""
    ws = Workspace(docs.sparkSession, "lines")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    drops = ws.save(recurring(plain, ws, depth, min_lines, min_words, constant), "drops")
    ws.drop_all(but=drops)
    # A row goes by its doc_id and a hash of its text: the line numbers are those of that text.
    lines = plain.filter("id is not null and text is not null").select("id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    gone = lines.select("id", "h", "at", _key(F.col("line")).alias("key")).join(drops, "key").filter(F.col("id") > F.col("first")).groupBy("id", "h").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    mark = "_" * (1 + max((len(n) for n in docs.columns), default=0))
    gone = gone.select(F.col("id").alias(mark + "id"), F.col("h").alias(mark + "h"), F.col("gone").alias(mark + "gone"))
    text, at = F.col(f"`{text_col}`").cast("string"), F.col(mark + "gone")

    def rest(split: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(0)), F.transform(at, lambda x: x + 1)), F.concat(at, F.array(F.size(split)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(split, a + 1, b - a))), "\n")

    new = F.when(at.isNull(), text).otherwise(let(F.split(text, "\n"), rest))
    joined = docs.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col(mark + "id")) & (F.xxhash64(text) == F.col(mark + "h")), "left")
    extra = []
    if counts:
        n = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
        extra = [n.alias(counts[0]), F.when(at.isNull(), 0).otherwise(F.size(at)).cast("long").alias(counts[1])]
    name = into or text_col
    taken = {name, *(counts or ())}
    return joined.select(*[new.alias(n) if n == name else F.col(f"`{n}`") for n in docs.columns if n == name or n not in taken], *([] if name in docs.columns else [new.alias(name)]), *extra)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs, into="kept_text", counts=("n_lines", "n_dropped")).select("doc_id", "n_lines", "n_dropped", "kept_text")


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words
  FROM (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL)
), leaves AS (
  SELECT doc_id, line, words,
         len(words) || ' ' || array_to_string(list_transform(words[1:3], lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), ' ') AS leaf
  FROM lines WHERE len(words) >= 1
), busy AS (
  SELECT leaf FROM leaves GROUP BY leaf HAVING count(*) >= 2 AND min(doc_id) < max(doc_id)
), distinct_lines AS (
  SELECT leaf, line, first(words) AS words, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi
  FROM leaves WHERE leaf IN (FROM busy) GROUP BY leaf, line
), placed AS (
  SELECT leaf, line, n, lo, hi, unnest(words) AS word, unnest(range(len(words))) AS place FROM distinct_lines
), kept AS (
  SELECT leaf, place, word FROM placed GROUP BY leaf, place, word HAVING sum(n) >= 2 AND min(lo) < max(hi)
), shaped AS (
  SELECT p.leaf, p.line, p.n, p.lo, p.hi,
         string_agg(CASE WHEN k.word IS NULL THEN '<*>' ELSE p.word END, ' ' ORDER BY p.place) AS template, count(k.word) / count(*) AS share
  FROM placed p LEFT JOIN kept k ON p.leaf = k.leaf AND p.place = k.place AND p.word = k.word GROUP BY p.leaf, p.line, p.n, p.lo, p.hi
), found AS (
  SELECT leaf, template, min(lo) AS first FROM shaped WHERE share >= 0.7
  GROUP BY leaf, template HAVING sum(n) >= 2 AND min(lo) < max(hi)
), gone AS (
  SELECT l.doc_id, list(DISTINCT l.line) AS gone
  FROM leaves l JOIN shaped s ON l.leaf = s.leaf AND l.line = s.line AND s.share >= 0.7
  JOIN found f ON s.leaf = f.leaf AND s.template = f.template
  WHERE l.doc_id > f.first GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: list_contains(gone, x))), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, x)), chr(10)) END AS kept_text
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
