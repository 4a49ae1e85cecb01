r"""Spelling variants of words, found without pairs.

Words are the maximal runs of letters that the documents hold (whole texts,
A-Z lower-cased), from ``LEAST`` code points and two occurrences on.  Two words
are near if one inserted, deleted or replaced code point makes one the other.

* Each word gets a ``rank``: a long whose order is that of falling counts, then
  of code points.  The best of some words is their smallest rank, so nothing
  below moves words.
* Replacements: a word of L code points stands in L wildcard groups (position,
  prefix, suffix).  A group has at most one word for each letter there is; it
  keeps its size and its two best words, and each member reads from it how many
  others there are and which is the best other.
* Insertions and deletions: a word's distinct deletions join the vocabulary.
  Each hit tells the longer word of the shorter one and the other way round.
  A bit table of bounded size keeps deletions that are no words out of the shuffle.
* What the groups and hits say is added up for each word: never is a pair of
  two words of one group made.

Runs are counted in each task, by document first, before they are shuffled.
Keys of up to ``PLAIN`` code points are the strings themselves; the keys of
longer ones, which would take the square of the length, are their length and
two polynomial hashes modulo 2^61 - 1, made in one pass.

Defined results: null and empty texts have no words; a null doc_id counts as
the empty string in the checksum that says which runs are altered; rows that
repeat count again.  An empty table gives an empty one.  Ties of counts go to
the smaller word in code-point order.  Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits
from .workspace import Workspace

LEAST, TWICE, RATIO, ALTER, PLAIN = 7, 2, 10, 31, 64
#: Distinct runs that a worker holds before it hands them on.
FLUSH = 200_000
PRIME, BASES = (1 << 61) - 1, (0x1B873593CC9E2D51, 0x0E6546B64A7F4A7D)


def _counts(least: int, alter: int):
    """(id, text) to (word, n): altered runs of ``least`` code points or more, as often as a task has met them."""
    run = re.compile("[a-zÀ-ÿ]{%d,}+" % least)

    def made(found: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py()
                if not text:
                    continue
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # bytes.lower() lower-cases A-Z alone.
                for word, n in Counter(run.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % alter == 0:
                        if len(word) == least:
                            continue
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    total[word] = total.get(word, 0) + n
                if len(total) > FLUSH:
                    yield made(total)
                    total = {}
        yield made(total)

    return work


def vocabulary(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, twice: int = TWICE, alter: int = ALTER) -> DataFrame:
    """(rank, word, n) of all words, ranks in the order of falling n, then of the word."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = rows.mapInArrow(_counts(least, alter), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= twice)
    counted = ws.save(counted, "counted")
    words = ws.save(counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "words")
    ws.drop(counted)
    return words


def _hashed(word: str) -> tuple[list[list[int]], list[list[int]]]:
    """For each base the hashes of the prefixes, from that of none on, and the base's powers."""
    sums, powers = [], []
    for base in BASES:
        s, p = [0], [1]
        for c in word:
            s.append((s[-1] + ord(c) * p[-1]) % PRIME)
            p.append(p[-1] * base % PRIME)
        sums.append(s)
        powers.append(p)
    return sums, powers


def _long_keys(plain: int):
    """(rank, word) of words over ``plain`` code points to (rank, kind, key): itself (0), its wildcards (1), its deletions (2)."""

    def keys(word: str) -> Iterator[tuple[int, str]]:
        (a, b), (p, q) = _hashed(word)
        size = len(word)
        back = [pow(base, -1, PRIME) for base in BASES]
        named = lambda n, x, y: f"\x01{n}:{x % PRIME:x}:{y % PRIME:x}"
        yield 0, named(size, a[-1], b[-1])
        for i, c in enumerate(word):
            yield 1, named(size, a[-1] - ord(c) * p[i], b[-1] - ord(c) * q[i]) + f":{i}"
            if i + 1 < size and word[i + 1] == c:
                continue
            if size - 1 > plain:
                yield 2, named(size - 1, a[i] + (a[-1] - a[i + 1]) * back[0], b[i] + (b[-1] - b[i + 1]) * back[1])
            else:
                yield 2, word[:i] + word[i + 1 :]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ranks, kinds, names = [], [], []
                for kind, key in keys(word):
                    ranks.append(rank)
                    kinds.append(kind)
                    names.append(key)
                    if len(ranks) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ranks), pa.array(kinds, pa.int32()), pa.array(names)], ["rank", "kind", "key"])
                        ranks, kinds, names = [], [], []
                yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(names, pa.string())], ["rank", "kind", "key"])

    return work


def _without(at: Column, put: str) -> Column:
    """The word, ``put`` in place of its letter ``at``."""
    word = F.col("word")
    return F.concat(F.substring(word, F.lit(1), at - 1), F.lit(put), F.substring(word, at + 1, F.length(word)))


def links(words: DataFrame, least: int = LEAST, plain: int = PLAIN, ws: Workspace | None = None) -> DataFrame:
    """(rank, n_near, best) of the words that are near another, ``best`` the smallest rank among those."""
    ws = ws or Workspace(words.sparkSession, "spelling")
    size = F.length("word")
    short, long = words.filter(size <= plain), words.filter(size > plain).select("rank", "word")
    hashed = ws.save(long.mapInArrow(_long_keys(plain), "rank long, kind int, key string"), "long")
    kind = lambda k: hashed.filter(F.col("kind") == k).select("rank", "key")

    spread = short.select("rank", "word", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    wild = spread.select("rank", _without(F.col("at"), "\0").alias("key")).unionByName(kind(1))
    # A group has at most one word a letter: at most some ninety.
    group = wild.groupBy("key").agg(F.array_sort(F.collect_list("rank")).alias("ranks")).filter(F.size("ranks") > 1)
    one, two = F.element_at("ranks", 1), F.element_at("ranks", 2)
    group = group.select("ranks", (F.size("ranks") - 1).cast("long").alias("others"), one.alias("one"), two.alias("two"))
    replaced = group.select(F.explode("ranks").alias("rank"), "others", "one", "two").select("rank", "others", F.when(F.col("rank") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("best"))

    known = short.select(F.col("rank").alias("other"), F.col("word").alias("key")).unionByName(kind(0).withColumnRenamed("rank", "other"))
    cut = spread.filter((size > least) & (F.substring("word", F.col("at"), F.lit(1)) != F.substring("word", F.col("at") + 1, F.lit(1))))
    cut = cut.select("rank", _without(F.col("at"), "").alias("key")).unionByName(kind(2))
    hits = bits.near(cut, "key", known.select("key"), words.count()).join(known, "key")
    both = F.array(F.struct(F.col("rank"), F.col("other").alias("best")), F.struct(F.col("other").alias("rank"), F.col("rank").alias("best")))
    changed = hits.select(F.explode(both).alias("x")).select("x.rank", F.lit(1).cast("long").alias("others"), "x.best")
    return replaced.unionByName(changed).groupBy("rank").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, ws: Workspace) -> DataFrame:
    """``forms(rank, to)``, which lead to ever smaller ranks, to (rank, root): the last that is reached.

    Each round doubles the steps taken, so chains of k forms take log2 k rounds; counts grow tenfold with each form, so there are few.
    """
    at = ws.save(forms.select("rank", F.col("to").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("rank").alias("root"), F.col("root").alias("ahead"))
        step = ws.save(at.join(ahead, "root", "left").select("rank", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        ws.drop(at)
        at = step.select("rank", "root")
        if step.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, twice: int = TWICE, ratio: int = RATIO, alter: int = ALTER, plain: int = PLAIN) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: ``form`` its best near word, if that is ``ratio`` times as frequent."""
    ws = Workspace(docs.sparkSession, "spelling")
    words = vocabulary(docs, ws, id_col, text_col, least, twice, alter)
    near = links(words, least, plain, ws)
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    scored = words.join(near, "rank", "left").join(best, "best", "left")
    worth = F.col("form_n") >= ratio * F.col("n")
    scored = ws.save(scored.select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(worth, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "scored")
    last = roots(scored.filter("best is not null").select("rank", F.col("best").alias("to")), ws)
    named = last.join(words.select(F.col("rank").alias("root"), F.col("word").alias("_root")), "root").select("rank", "_root")
    return scored.join(named, "rank", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The checksum of a string's bytes (zlib's), from a table of 256 that is made by its rule.
CRC_TABLE = """
crc_table AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i)))"""


def crc_sql(text: str) -> str:
    hexed = f"hex(encode({text}))"
    taken = f"list_transform(range(length({hexed}) // 2), lambda k: ('0x' || substr({hexed}, 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {taken}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
found AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)),
often AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, length(run) AS size, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY ALL),
summed AS (SELECT run, size, n, {crc_sql("id || ':' || run")} AS h FROM often, crc_table),
altered AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
spots AS (SELECT word, n, unnest(range(length(word))) AS k FROM words),
wild AS (SELECT DISTINCT word, n, k, substr(word, 1, k) AS a, substr(word, k + 2) AS b FROM spots),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM wild x JOIN wild y ON x.k = y.k AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM wild x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM wild x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word, n),
forms AS (SELECT word, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n, n_near FROM best),
walk AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, root FROM walk w WHERE NOT EXISTS (SELECT 1 FROM forms f WHERE f.word = w.root AND f.form IS NOT NULL))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM words w LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
"""
