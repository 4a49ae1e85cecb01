"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target text (documents
labelled good and not toxic) and one of the raw text (all documents), give each
document a log importance weight: the sum over its n-grams of the log ratio of
their probabilities.  Gumbel top-k turns the weights into a sample without
replacement: the k documents with the largest weight plus Gumbel noise stay.

* The n-grams are words, pairs of neighbouring words and, under one symbol
  whatever the words, repeats of a word.  Words and pairs have models of their
  own (``buckets`` and ``pairs`` places of one table).
* Target text is taken from at most ``LABELS`` labelled documents (by hash of
  their id), whose ids are broadcast; the raw model counts over all documents.  A task folds its documents into at
  most one row of counts a place before they are shuffled, so what is shuffled and
  what reaches the driver (one fixed-size table) do not grow with the corpus.
* A document's own n-grams are taken out of both models before it is weighed,
  so labelled documents have no advantage over others.
* The ratio of a place is ``(t + c) / (r T / R + c)`` for counts t of T target
  and r of R raw n-grams.  Its log is moved towards 0 by ``MARGIN`` standard
  errors and ``DEAD``, so rare and ordinary n-grams say nothing.  Plain log ratios
  do not give right results here: the many rare words of a long document outweigh
  the few that tell it is toxic (the README has the figures).
* The ratios are centred on their median over target text.  Otherwise each
  ordinary word would add the same small amount (what odd words take away from
  the raw model) and long documents would win for their length.
* k is given as a share of the documents (``keep``), or it is the number of
  documents whose keys reach the key that ``recall`` of the labelled good documents reach.
* The k-th largest key is found by counting: four rounds, each a histogram of
  16 further bits of the sortable key, so no sort and no task sees all rows.
  The noise is a hash of doc_id and ``seed``; rows that tie with the k-th stay.

Defined results: null and empty texts have weight 0; null doc_id counts as -1
for the noise; rows that repeat count again; without labelled good documents all weights are 0 and all rows
stay, and an empty table gives an empty one.  Labels with a null doc_id, quality or toxic value are skipped;
if labels of a document contradict each other it is not target text.  The
input's other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from . import kernel
from .workspace import Workspace, extended

BUCKETS, PAIRS, SMOOTHING, RECALL, LABELS, SEED = 1 << 21, 1 << 20, 0.5, 0.98, 1_000_000, 7
#: Bytes of text whose n-grams are sorted together.
CHUNK = 1 << 19
#: Of words and of pairs: standard errors, and the part of a ratio that says nothing.
MARGIN, DEAD = np.array([4.0, 8.0]), np.array([0.25, 1.0])
_ID = np.uint64(0x2545F4914F6CDD1D)


def features(c: kernel.Chunk, buckets: int = BUCKETS, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, count) of a chunk's hashed n-grams, sorted by document.

    Words (case kept) have the places below ``buckets`` but for the last, which is
    that of repeats: words like the one before them that are the third of five
    such pairs or more (``a a a a``, ``a a b b c c``); pairs of words have the
    places from ``buckets`` on.  n of one word or pair in a document count as
    1 + floor(log2 n), or one babbling document would make its words rare in
    target text; repeats all count.
    """
    w = kernel.words(c, lower=False)
    if not len(w.hash):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    size = buckets + pairs
    docs = np.repeat(np.arange(c.n), w.per_doc)
    keys = [docs * size + (w.hash % np.uint64(buckets - 1)).astype(np.int64)]
    same = docs[1:] == docs[:-1]
    with np.errstate(over="ignore"):
        both = kernel.mix(w.hash[:-1] * kernel._GRAM + w.hash[1:])[same]
    keys.append(docs[:-1][same] * size + buckets + (both % np.uint64(pairs)).astype(np.int64))
    again = np.zeros(len(docs) + 4, dtype=np.int8)
    again[5:] = (w.hash[1:] == w.hash[:-1]) & same
    again = np.flatnonzero((again[4:] > 0) & (again[4:] + again[3:-1] + again[2:-2] + again[1:-3] + again[:-4] >= 3))
    keys.append(docs[again] * size + buckets - 1)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    place = key % size
    return key // size, place, np.where(place == buckets - 1, count, np.frexp(count)[1])


def _counts(buckets: int, pairs: int, shared):
    """(id, text) to (bucket, target, raw): one row per place that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's counts: half the room of longs, and far from their end.
        raw, target = np.zeros(buckets + pairs, np.int32), np.zeros(buckets + pairs, np.int32)
        for batch in batches:
            good = among(batch.column(0), shared.value)
            for c in kernel.chunks(batch.column(1), CHUNK):
                d, b, n = features(c, buckets, pairs)
                n = n.astype(np.int32)
                np.add.at(raw, b, n)
                chosen = good[c.first + d]
                np.add.at(target, b[chosen], n[chosen])
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(target[met].astype(np.int64)), pa.array(raw[met].astype(np.int64))], ["bucket", "target", "raw"])

    return run


class Model:
    """Counts of the places in target and raw text; words and pairs are two models side by side."""

    def __init__(self, buckets: int, pairs: int, smoothing: float, good: np.ndarray, target: np.ndarray, raw: np.ndarray):
        self.buckets, self.pairs, self.smoothing, self.good = buckets, pairs, smoothing, good
        self.target, self.raw = target, raw
        self.scale, self.center = np.zeros(2), np.zeros(2)
        for k, part in enumerate((slice(0, buckets), slice(buckets, buckets + pairs))):
            t, r = target[part].astype(np.float64), raw[part].astype(np.float64)
            self.scale[k] = t.sum() / max(1.0, r.sum())
            if self.scale[k]:
                ratio = np.log((t + smoothing) / (r * self.scale[k] + smoothing))
                order = np.argsort(ratio)
                self.center[k] = ratio[order[np.searchsorted(np.cumsum(t[order]), t.sum() / 2)]]

    def _sure(self, t: np.ndarray, r: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Centred log ratios, moved towards 0 by DEAD and MARGIN standard errors."""
        ratio = np.log((t + self.smoothing) / (r + self.smoothing)) - self.center[kind]
        slack = DEAD[kind] + MARGIN[kind] * np.sqrt(np.maximum(1 - self.scale[kind], 0) / (r + self.smoothing))
        return np.sign(ratio) * np.maximum(np.abs(ratio) - slack, 0)

    def weights(self, c: kernel.Chunk, good: np.ndarray) -> np.ndarray:
        d, b, n = features(c, self.buckets, self.pairs)
        if not self.scale[0]:
            return np.zeros(c.n)
        kind = (b >= self.buckets).astype(np.int64)
        t = self.target[b].astype(np.float64) - np.where(good[d], n, 0)
        r = (self.raw[b].astype(np.float64) - n) * self.scale[kind]
        ratio = np.where(self.scale[kind] > 0, self._sure(np.maximum(t, 0), np.maximum(r, 0), kind), 0)
        return np.bincount(d, n * ratio, c.n)


def gumbel(ids: pa.Array, seed: int) -> np.ndarray:
    ids = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)
    with np.errstate(over="ignore"):
        u = (kernel.mix(kernel.mix(ids * _ID + np.uint64(seed)) + _ID) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def ordered(key: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order."""
    bits = (key + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def target_ids(labels: DataFrame, most: int = LABELS) -> np.ndarray:
    """Sorted ids of the good documents among at most about ``most`` labelled ones (by hash of the id)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality"), F.col("toxic")).na.drop()
    known = known.groupBy("id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    return np.sort(chosen.filter("good").select("id").toArrow().column("id").to_numpy())


def among(ids: pa.Array, good: np.ndarray) -> np.ndarray:
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    if not len(good):
        return np.zeros(len(ids), dtype=bool)
    return known & (good[np.minimum(np.searchsorted(good, ids), len(good) - 1)] == ids)


def fit(docs: DataFrame, good: np.ndarray, buckets: int = BUCKETS, pairs: int = PAIRS, smoothing: float = SMOOTHING) -> Model:
    """The two models of ``docs(id, text)``; ``good``: sorted ids of the target text."""
    spark = docs.sparkSession
    ship(spark)
    counts = docs.mapInArrow(_counts(buckets, pairs, spark.sparkContext.broadcast(good)), "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    # Twelve bytes a place: four-byte counts are exact to seven digits.
    rows = counts.select(F.col("bucket").cast("int"), F.col("target").cast("float"), F.col("raw").cast("float")).toArrow()
    target, raw = np.zeros(buckets + pairs, np.float32), np.zeros(buckets + pairs, np.float32)
    for batch in rows.to_batches():
        met = batch.column(0).to_numpy()
        target[met], raw[met] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    del rows
    return Model(buckets, pairs, smoothing, good, target, raw)


def weigh(docs: DataFrame, model: Model, seed: int = SEED, id_col: str = "_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with log_weight, sample_key, _key (the key as an ordered long) and _good, their names after ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = [prefix + "log_weight", prefix + "sample_key", prefix + "_key", prefix + "_good"]
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = among(batch.column(i), shared.value.good)
            parts = [shared.value.weights(c, good[c.first : c.last]) for c in kernel.chunks(batch.column(t), CHUNK)]
            weight = np.concatenate(parts) if parts else np.zeros(0)
            key = weight + gumbel(batch.column(i), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight), pa.array(key), pa.array(ordered(key)), pa.array(good)], [*batch.schema.names, *made])

    schema = docs.schema
    for name, kind in zip(made, (T.DoubleType(), T.DoubleType(), T.LongType(), T.BooleanType()), strict=True):
        schema = extended(schema, name, kind)
    return docs.mapInArrow(run, schema)


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest value of the long column ``_key``; None keeps nothing."""
    if k <= 0:
        return None
    prefix, left = 0, k
    shifted = keys.select((F.col("_key").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))).alias("u"))
    for step in range(4):
        low = 48 - 16 * step
        part = shifted if not step else shifted.filter(F.shiftrightunsigned("u", low + 16) == F.lit(prefix).cast("long"))
        counts = {r["d"]: r["n"] for r in part.groupBy(F.shiftrightunsigned("u", low).bitwiseAND(0xFFFF).cast("long").alias("d")).agg(F.count("*").alias("n")).collect()}
        for digit in sorted(counts, reverse=True):
            if counts[digit] >= left:
                prefix = prefix << 16 | digit
                break
            left -= counts[digit]
        else:
            return -(1 << 63)
    value = prefix ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value


def limit_of(keys: DataFrame, keep: float | None, recall: float) -> int | None:
    """The smallest ``_key`` that stays; None if all stay."""
    if keep is not None:
        return kth_largest(keys, round(keys.count() * keep))
    good = keys.filter("_good")
    n = good.count()
    return kth_largest(good, -int(-n * recall // 1)) if n else -(1 << 63)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float | None = None, recall: float = RECALL, buckets: int = BUCKETS, pairs: int = PAIRS, smoothing: float = SMOOTHING, seed: int = SEED, most: int = LABELS) -> DataFrame:
    """(doc_id, log_weight, sample_key, kept) of every row of ``docs``."""
    ws = Workspace(docs.sparkSession, "quality")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = fit(rows, target_ids(labels, most), buckets, pairs, smoothing)
    keys = ws.save(weigh(rows, model, seed).select("_id", "log_weight", "sample_key", "_key", "_good"), "keys")
    limit = limit_of(keys, keep, recall)
    return keys.select(F.col("_id").alias("doc_id"), "log_weight", "sample_key", (F.col("_key") >= F.lit(limit).cast("long") if limit is not None else F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float | None = None, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.  The weights are made twice, so that no text is shuffled."""
    ws = Workspace(docs.sparkSession, "quality")
    names = docs.columns
    mark = "_" * (1 + max((len(n) for n in names), default=0))
    rows = docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{id_col}`").cast("long").alias(mark + "id"))
    plain = rows.select(F.col(mark + "id").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = fit(plain, target_ids(labels))
    limit = limit_of(ws.save(weigh(plain, model).select("_key", "_good"), "keys"), keep, recall)
    if limit is None:
        return docs.limit(0)
    weighed = weigh(rows, model, id_col=mark + "id", text_col=text_col, prefix=mark)
    return weighed.filter(F.col(mark + "_key") >= F.lit(limit).cast("long")).select(*[F.col(f"`{n}`") for n in names])


def op8_quality_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
