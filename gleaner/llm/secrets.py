r"""Secret scan: patterns propose, a random forest removes false positives.

Candidates, in one leftmost, non-overlapping search: values assigned to a word
like token or password (quoted ones may hold any sign but white space), runs of
eight or more of ``[A-Za-z0-9+/_-]`` (and padding) that hold a digit, runs that
begin with a well-known prefix or have 32 characters whatever they hold, and
headers of private keys.  A candidate's features are its length, its make-up and
the transitions between kinds of characters, the share of it that words of a
dictionary cover, whether it looks like a path, a well-known prefix, and the
words and signs beside it.  The dictionary is taken from the corpus: the ``WORDS``
words that most documents hold (a fixed number; counts are of all documents),
with a few that stand in place of secrets.

The forest is trained on labelled findings, any table of (value, before, after,
label); :func:`labelled` makes the default set from rules, by hashing row
numbers, ``TRAINING`` rows in all.

All is DataFrame functions and the JVM's forest; nothing is shuffled but word
counts and the training rows.  Candidates of a document are never gathered.

Defined results: null and empty texts have no candidates and give no rows; a
repeated row gives its candidates again; an empty table gives no rows.  A value
has no greatest length.  Offsets
are code points, the end exclusive.  Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matches import matches

TRAINING, TREES, DEPTH, SEED, WINDOW, THRESHOLD, WORDS = 9000, 32, 8, 11, 24, 0.5, 512

_RUN = "[A-Za-z0-9+/_-]"
_NAME = "[A-Za-z0-9_-]"
_KEYWORD = "token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|credential|auth|bearer|private"
_PREFIX = "AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|AIza|glpat-"
_ASSIGN = rf"(?<!{_NAME}){_NAME}{{0,24}}?(?i:{_KEYWORD}){_NAME}{{0,12}}[\"']?\s{{0,2}}[=:]\s{{0,2}}"
_GIVEN = [r"\"([^\"\s]{6,}+)", r"'([^'\s]{6,}+)", r"([^\s\"'<>,;()]{6,}+)"]
#: A match ends where the value ends; the closing quote is looked at in the text and missing in the match.
ASSIGNED = rf"{_ASSIGN}(?:{_GIVEN[0]}(?=\")|{_GIVEN[1]}(?=')|{_GIVEN[2]})"
_MATCHED = rf"^{_ASSIGN}(?:{'|'.join(_GIVEN)})$"
CANDIDATE = rf"{ASSIGNED}|-----BEGIN [A-Z ]{{0,24}}PRIVATE KEY-----|(?<!{_RUN})(?:(?=[A-Za-z+/_-]*+[0-9]){_RUN}{{8,}}+={{0,2}}|(?:{_PREFIX}){_RUN}{{12,}}+|{_RUN}{{32,}}+={{0,2}})"
PREFIX = f"^(?:{_PREFIX}|-----BEGIN)"
KEYWORD = f"(?i)(?:{_KEYWORD})"
HARMLESS = r"(?i)(?:commit|sha-?\d*|md5|uuid|guid|checksum|digest|hash|version|revision|isbn|order|phone|card|serial)"
#: Words that stand in place of secrets, whatever the corpus holds.
PLACEHOLDERS = ["password", "passwd", "changeme", "change", "example", "sample", "secret", "token", "test", "user", "your", "here", "name", "file", "data", "main", "image", "page", "version", "release", "index", "string", "required", "none", "null", "true", "false", "xxxx", "0000", "1234"]
FEATURES = ["length", "digits", "upper", "lower", "other", "hex", "transitions", "distinct", "covered", "path", "prefix", "keyword", "assigned", "quoted", "harmless"]


def dictionary(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> list[str]:
    """The words of four to twelve letters that most documents hold, ``words`` of them, and the placeholders."""
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), F.lit("(?<![a-z0-9])[a-z]{4,12}(?![a-z0-9])"), F.lit(0)))).alias("word"))
    top = each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return sorted({r["word"] for r in top.collect()} | set(PLACEHOLDERS))


def covering(words: list[str]) -> str:
    """A pattern of the words, longer ones first, that branches on their first character."""
    by = defaultdict(list)
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by[w[0]].append(re.escape(w[1:]))
    return "(?i)(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by.items())) + ")"


def candidates(text: Column) -> Column:
    """array<struct<start, end, value, before, after>>."""

    def value(s: Column) -> Column:
        given = F.concat(*[F.coalesce(F.regexp_extract(s["value"], _MATCHED, k), F.lit("")) for k in (1, 2, 3)])
        size = F.when(given != "", F.length(given)).otherwise(F.length(s["value"]))
        before = F.right(F.concat(s["before"], F.left(s["value"], F.length(s["value"]) - size)), F.lit(WINDOW))
        return F.struct((s["end"] - size).alias("start"), s["end"].alias("end"), F.right(s["value"], size).alias("value"), before.alias("before"), s["after"].alias("after"))

    return F.transform(matches(text, CANDIDATE, WINDOW), value)


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """(..., value, before, after) with FEATURES as doubles; ``words``: the dictionary."""
    v = F.col("value")
    size = F.length(v)
    share = lambda kind: (size - F.length(F.regexp_replace(v, kind, ""))) / size
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    made = {
        "length": size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "other": share("[A-Za-z0-9]") * -1 + 1,
        "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "transitions": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / size,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / size,
        "covered": share(covering(words)),
        "path": F.size(F.split(v, "/")) - 1 + F.when(F.col("before").rlike(r"[./\\~]$"), 1).otherwise(0),
        "prefix": v.rlike(PREFIX),
        "keyword": F.col("before").rlike(KEYWORD),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$"),
        "quoted": F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"),
        "harmless": F.col("before").rlike(HARMLESS),
    }
    return found.withColumns({name: F.coalesce(made[name].cast("double"), F.lit(0.0)) for name in FEATURES})


def labelled(spark: SparkSession, rows: int = TRAINING) -> DataFrame:
    """Findings (kind, value, before, after, label) made by rules: nine kinds of secrets, nine of harmless strings."""
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    pick = lambda salt, *options: F.element_at(F.array(*[F.lit(o) for o in options]), F.pmod(F.crc32(F.concat(F.col("id").cast("string"), F.lit(salt))), F.lit(len(options))).cast("int") + 1)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), "[+/=\\s]", "x7")
    letters = lambda salt: F.translate(h(salt), "0123456789abcdef", "kqzmwvyjxaeourtb")
    upper = F.translate(F.upper(F.left(h("k"), F.lit(16))), "0123456789ABCDEF", "Q7RS3TUV5WXY2ZJK")
    digits = lambda n: F.left(F.regexp_replace(F.concat(h("d"), h("e")), "[a-f]", ""), n)
    key = pick("w", "token", "password", "secret", "api_key", "auth_token", "passwd", "credential")
    sign = pick("s", "=", ": ", " = ", "=\"", ": \"", " = \"", ": '")
    prose = pick("p", "of the and ", "in this ", "die und ", "que los ", "et de la ", "with from. ", "", "is\n")
    quote = F.when(sign.rlike("\"$"), F.lit("\"")).when(sign.rlike("'$"), F.lit("'")).otherwise(F.lit(" "))
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))
    kind = F.col("id") % 18
    made = [
        F.concat(F.lit("AKIA"), upper),
        F.left(h("a"), pick("n", 32, 40, 40, 64)),
        F.left(h("b"), pick("n", 12, 16, 18, 20)),
        F.left(b64("c"), pick("n", 20, 24, 32, 40)),
        F.concat(pick("g", "ghp_", "sk-", "gho_"), F.left(b64("f"), F.lit(36))),
        F.concat(F.lit("eyJ"), b64("j")),
        F.concat(F.left(letters("l"), pick("n", 9, 12, 16, 24)), pick("m", "", "", "!", "#", ".")),
        F.concat(pick("f", "Hunter", "Winter", "dragon", "Monkey", "sunshine", "correct"), pick("g", "", "horse", "battery", "staple"), digits(pick("n", 1, 2, 4)), pick("m", "!", "$", "#", "?!", "")),
        F.left(F.concat(letters("o"), letters("r")), pick("n", 32, 40, 48)),
        F.left(h("m"), pick("n", 32, 40, 64)),
        uuid,
        digits(pick("n", 10, 13, 14, 16, 19)),
        F.concat(pick("f", "src/main/", "usr/local/lib", "img_2024", "docs/page-", "static/v"), digits(F.lit(3)), pick("g", "/index", "-file", "_test", "/readme", "final")),
        F.concat(pick("f", "version", "release-", "windows", "iso-8859-", "chapter", "covid-19-"), digits(F.lit(2)), pick("g", "vaccine", "unicode", "update", "edition", "beta")),
        F.concat(pick("f", "your_password_", "changeme", "example_token_", "xxxxxxxx", "testuser", "0000000"), digits(F.lit(3))),
        F.concat(pick("f", "required", "string", "your_", "example", "none_", "change"), pick("g", "_here", "_name", "password", "_token", "_user", "data")),
        F.concat_ws("-", pick("f", "the", "this", "some", "with"), pick("g", "page", "file", "user", "test"), pick("m", "which", "there", "about", "other"), pick("n2", "could", "would", "first", "water"), pick("n3", "people", "words", "place", "after")),
        F.concat(pick("f", "request", "session", "username", "localhost", "process"), pick("g", ".user", ".data", ".name", "[index]", ".value")),
    ]
    value = F.element_at(F.array(*made), (kind + 1).cast("int"))
    given = kind.isin(1, 2, 3, 6, 7, 14, 15, 17)
    before = (
        F.when(given, F.concat(prose, key, sign))
        .when(kind.isin(4, 5, 8), F.when(F.pmod(F.crc32(h("q")), F.lit(2)) == 0, prose).otherwise(F.concat(key, sign)))
        .when(kind == 9, F.concat(prose, pick("q", "commit ", "sha256:", "md5 ", "checksum ", "", "digest=")))
        .when(kind == 10, F.concat(prose, pick("q", "uuid ", "id=", "", "guid: ")))
        .otherwise(prose)
    )
    after = F.when(given, quote).otherwise(pick("z", " of the", ", and", ". In", ""))
    return spark.range(rows).select(kind.alias("kind"), value.alias("value"), F.right(before, F.lit(WINDOW)).alias("before"), after.alias("after"), (kind < 9).cast("double").alias("label"))


def fit(findings: DataFrame, words: list[str] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest over labelled findings (value, before, after, label), one partition so that its sampling repeats; ``words``: the dictionary."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings.coalesce(1), words or PLACEHOLDERS))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows.select("features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, words: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, kind, start, end, value, score, secret; ``words`` is the dictionary that the forest was trained with."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(candidates(text)).alias("c")).select("doc_id", "c.*")
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found, words or PLACEHOLDERS)))
    score = F.round(vector_to_array("probability")[1], 9)
    kind = F.when(F.col("value").rlike("^A[KS]IA"), "cloud_key").when(F.col("value").rlike("^eyJ"), "web_token").when(F.col("value").rlike("^-----BEGIN"), "private_key").when(F.col("prefix") == 1, "service_token").when(F.col("before").rlike(r"(?i)passw|pwd"), "password").when(F.col("keyword") == 1, "named_token").otherwise("string")
    return scored.select("doc_id", kind.alias("kind"), "start", "end", "value", score.alias("score"), ((score >= threshold) | (kind == "private_key")).alias("secret"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = dictionary(docs)
    return scan(docs, fit(labelled(spark), words), words)
