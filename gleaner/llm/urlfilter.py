r"""URL filter by a ratio of character language models.

Rules (a host and the beginning of a path) say of some URLs that they are
accepted or rejected.  The others are judged by two smoothed variable-order
Markov models of bytes, one of accepted and one of rejected URLs: what counts is
the difference of the two log-likelihoods, divided by the number of symbols,
against a calibrated threshold.

* Counts: a task counts (context, next byte) for contexts of 0 to ``DEPTH`` bytes
  over the URLs of either kind; the counts are combined before they are shuffled.
  A URL begins after ``DEPTH`` start symbols and ends with an end symbol.
* Variable order: a context and a byte that follows it are kept if they make up
  ``SHARE`` or more of the kind's symbols, a share and no count, so the model of
  a larger corpus is of the same kind.  Each order then has at most 1 / SHARE
  entries: at most 2 * (DEPTH + 1) / SHARE = 917,504 in all, whatever the input,
  so the model may be broadcast.
* Smoothing: the probability after the longest context that is kept is mixed
  with that after the next shorter one, down to an equal share for each of 256
  bytes, by the number of bytes that are kept after it (Witten and Bell) and
  the occurrences of those that are not; so probabilities add up to 1.
* Calibration: one in ``FOLDS`` of the URLs that a rule fits (by crc32 of the URL,
  so equal URLs stand on one side) is no part of the models.  The threshold is
  the one at which the shares of wrongly rejected and of wrongly accepted URLs
  among them have the least sum (of several, the one next to 0), from counts in ``BINS`` bins.

Defined results: a null url counts as the empty one; without ``://`` host and path
are empty, no rule fits, and the models judge the string as it stands.  Without
rejected or without accepted URLs the threshold is 0 and the model of the kind
that lacks gives each byte an equal share; without both all differences are 0
and URLs are allowed.  Repeated rows count again, an empty table gives an empty
one, a null page_id stays null.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

#: (verdict, host, beginning of the path) of the fixed rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DEPTH, SHARE, FOLDS = 6, 2.0**-16, 5
#: Bins of the differences a symbol, for the threshold: of 1 / SCALE each, BINS / 2 on either side of 0.
SCALE, BINS = 256, 8192
START, END = 1, 0
KINDS = ("allow", "block")
#: URLs whose symbols are handled together have at most about so many bytes.
CHUNK = 1 << 18


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as ``host/beginning``; null if none does."""
    found = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        found = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(h + p)).otherwise(found)
    return found


def symbols(urls: Sequence[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (depth + 1, n) of the symbols of some URLs, by order, and where each URL's symbols begin.

    A key holds the next byte, above it the context, nearest byte first, and above both the order plus 1; a context's key is that
    without the lowest byte.
    """
    joined = np.frombuffer(b"".join(bytes([START]) * depth + u + bytes([END]) for u in urls), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 for u in urls])
    begins = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat((np.arange(len(urls)) + 1) * depth, sizes)
    key = joined[at]
    keys = [key + (1 << 56)]
    for k in range(1, depth + 1):
        key = key + (joined[at - k] << (8 * k))
        keys.append(key + ((k + 1) << 56))
    return np.stack(keys), begins


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, some URLs) of a column, nulls as the empty one."""
    held, size, first = [], 0, 0
    for k, u in enumerate(column):
        held.append((u.as_py() or "").encode())
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def in_models(url: bytes) -> bool:
    return zlib.crc32(url) % FOLDS != 0


def _counts(depth: int):
    """(url, verdict) of URLs with a rule to (kind, key, n), what a batch holds added up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            says = batch.column(1).to_pylist()
            for first, urls in _chunks(batch.column(0)):
                for kind, name in enumerate(KINDS):
                    own = [u for k, u in enumerate(urls) if says[first + k] == name and in_models(u)]
                    if own:
                        key, n = np.unique(symbols(own, depth)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], ["kind", "key", "n"])

    return work


class Markov:
    """Sorted keys with their counts; sorted contexts with what follows them: all, kept, and how many different kept."""

    def __init__(self, key: np.ndarray, n: np.ndarray, context: np.ndarray, total: np.ndarray):
        order = np.argsort(key)
        self.key, self.n = key[order], n[order].astype(np.float64)
        order = np.argsort(context)
        self.context, self.total = context[order], total[order].astype(np.float64)
        at = np.searchsorted(self.context, self.key >> 8)
        self.kept = np.bincount(at, self.n, len(self.context))
        self.kinds = np.bincount(at, minlength=len(self.context)).astype(np.float64)

    @staticmethod
    def _found(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, key), max(0, len(table) - 1))
        return at, table[at] == key if len(table) else np.zeros(len(key), bool)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Of each symbol after its context; ``keys``: as :func:`symbols` gives them."""
        p = np.full(keys.shape[1], 1 / 256)
        for key in keys:
            at, met = self._found(self.context, key >> 8)
            if not met.any():
                continue
            at, own = at[met], key[met]
            where, there = self._found(self.key, own)
            n = np.where(there, self.n[where], 0.0)
            rest = self.kinds[at] + self.total[at] - self.kept[at]
            p[met] = (n + rest * p[met]) / (self.kept[at] + rest)
        return p


def fit(labelled: DataFrame, ws: Workspace, depth: int = DEPTH, share: float = SHARE) -> list[Markov]:
    """The models of ``labelled(url, verdict)``, in the order of KINDS."""
    counts = ws.save(labelled.mapInArrow(_counts(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    sizes = {r["kind"]: r["n"] for r in counts.filter(F.shiftright("key", 56) == 1).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    models = []
    for kind in range(len(KINDS)):
        least = max(1.0, share * sizes.get(kind, 0))
        after = counts.filter(F.col("kind") == kind).groupBy(F.shiftright("key", 8).alias("context"))
        # A context is followed by 256 different bytes at most.
        often = F.collect_list(F.when(F.col("n") >= least, F.struct("key", "n")))
        kept = after.agg(F.sum("n").alias("total"), often.alias("often")).filter(F.size("often") > 0).toArrow()
        often = pa.chunked_array([c.flatten() for c in kept["often"].chunks], kept["often"].type.value_type).combine_chunks()
        often = often.combine_chunks() if isinstance(often, pa.ChunkedArray) else often
        models.append(Markov(often.field("key").to_numpy(), often.field("n").to_numpy(), kept["context"].to_numpy(), kept["total"].to_numpy()))
    ws.drop(counts)
    return models


def difference(models: list[Markov], urls: Sequence[bytes], depth: int = DEPTH) -> np.ndarray:
    """log10-likelihood of each URL as accepted less that as rejected, a symbol."""
    if not urls:
        return np.zeros(0)
    keys, begins = symbols(urls, depth)
    parts = [np.add.reduceat(np.log10(m.probability(keys)), begins) for m in models]
    return (parts[0] - parts[1]) / np.diff(np.append(begins, keys.shape[1]))


def score(pages: DataFrame, models: list[Markov], depth: int = DEPTH) -> DataFrame:
    """``pages(page_id, url, ...)`` with ``score`` and ``held_out`` (the URL is no part of the models)."""
    shared = pages.sparkSession.sparkContext.broadcast(models)
    at = pages.columns.index("url")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, out = [np.zeros(0)], []
            for _, urls in _chunks(batch.column(at)):
                parts.append(difference(shared.value, urls, depth))
                out += [not in_models(u) for u in urls]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts)), pa.array(out, pa.bool_())], [*batch.schema.names, "score", "held_out"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(work, f"{fields}, score double, held_out boolean")


def threshold(scored: DataFrame) -> float:
    """From ``scored(verdict, score)`` of URLs with a rule: URLs are accepted from this difference on."""
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("score") * SCALE) + BINS // 2))
    found = scored.groupBy("verdict", place.cast("int").alias("bin")).count().collect()
    n = np.zeros((len(KINDS), BINS))
    for r in found:
        n[KINDS.index(r["verdict"]), r["bin"]] = r["count"]
    if not n.sum(1).all():
        return 0.0
    below = np.cumsum(np.concatenate([np.zeros((2, 1)), n], 1), 1) / n.sum(1, keepdims=True)
    wrong = below[0] + 1 - below[1]
    edges = (np.arange(BINS + 1) - BINS // 2) / SCALE
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; ``score``: the difference, whether or not a rule decides."""
    ws = Workspace(pages.sparkSession, "urls")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    says = F.lit(None).cast("string")
    for verdict, h, p in rules:
        says = F.when(F.col("rule") == h + p, F.lit(verdict)).otherwise(says)
    rows = rows.withColumn("verdict", says)
    models = fit(rows.filter("verdict is not null").select("url", "verdict"), ws, depth, share)
    scored = ws.save(score(rows, models, depth), "scored")
    limit = threshold(scored.filter("held_out and verdict is not null").select("verdict", "score"))
    own = F.when(F.col("score") >= limit, F.lit(KINDS[0])).otherwise(F.lit(KINDS[1]))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
