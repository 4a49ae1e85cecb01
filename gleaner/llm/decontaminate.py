"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (A-Z) runs of non-space bytes.  Every run of
``min_match`` words of a document is hashed by a running Karp-Rabin hash and
looked up among the runs of the benchmark items; documents and items that
share such a seed are tiled: seeds on one diagonal join to maximal matches,
the longest match whose words are all unmarked is marked first (of equal ones
the first in the item, then in the document), what marking leaves of the others
goes back in line, until no match of ``min_match`` words remains.  Hashes only
propose: the words of a match are compared byte by byte before it is marked.
The share of an item's words that the tiles cover does not depend on the order
of its passages in the document.  A document is contaminated if some item is
covered to at least ``threshold``.

Items reach the workers as broadcast blocks of at most ``block_words`` words;
a larger benchmark is a chain of blocks, so what is broadcast is bounded and
no item is left out.  Documents stay where they are: nothing is shuffled.  The
seeds of a document are expanded ``SLICE`` at a time and joined to matches at
once, so a repetitive document against a repetitive item holds matches (one for
each diagonal), not pairs of places.

Defined results: null or empty texts and items have no words; an item with
fewer than ``min_match`` words matches nothing; an empty benchmark
contaminates nothing, and an empty table gives an empty one.  Of items covered
alike the one with the smallest item_id is named; one without item_id counts like others and is named, by null, after all that have one.  Each input row gives one row,
repeated rows included; items that repeat count once.  The input's other columns
stay, but for one with the name of the added column, which is replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from . import kernel
from .workspace import extended

MIN_MATCH, THRESHOLD, BLOCK_WORDS, SLICE = 5, 0.5, 2_000_000, 1_000_000
_SEEN_BITS = 22

RESULT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType()), T.StructField("contaminated", T.BooleanType())])


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The words of lower-cased bytes."""
    raw = kernel._LOWER[data].tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class Items:
    """Benchmark items with their seeds in order of hash."""

    def __init__(self, ids: list[int | None], texts: list[str], min_match: int):
        self.ids, self.min_match = ids, min_match
        hashes, items, starts, self.words, self.bytes = [], [], [], [], []
        for k, text in enumerate(texts):
            data = np.frombuffer(text.encode(), np.uint8)
            w = kernel.words(kernel.Chunk(0, 1, data, np.array([0, len(data)])))
            self.words.append(w.hash)
            self.bytes.append(spelled(data, w.start, w.end))
            if len(w.hash) >= min_match:
                h, _ = kernel.grams(w, min_match)
                hashes.append(h)
                items.append(np.full(len(h), k))
                starts.append(np.arange(len(h)))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        h, k, i = join(hashes, np.uint64), join(items, np.int64), join(starts, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.start = h[order], k[order], i[order]
        self.seen = np.zeros(1 << _SEEN_BITS, dtype=bool)
        self.seen[(self.hash >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)] = True


def _joined(k: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (item, start in the item, start in the document, seeds) with those that go on joined."""
    order = np.lexsort((i, j - i, k))
    k, i, j, n = k[order], i[order], j[order], n[order]
    fresh = np.ones(len(i), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + n[:-1])
    first = np.flatnonzero(fresh)
    return k[first], i[first], j[first], np.add.reduceat(n, first) if len(first) else n


def matches(items: Items, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of seeds of one document: its places that are seeds, with their ranges among the items' seeds."""
    reps = right - left
    ends = np.cumsum(reps)
    out, s = None, 0
    while s < len(place):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + SLICE, "right")))
        r = reps[s:e]
        seed = np.repeat(left[s:e], r) + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
        part = _joined(items.item[seed], items.start[seed], np.repeat(place[s:e], r), np.ones(len(seed), np.int64))
        out = part if out is None else _joined(*[np.concatenate([x, y]) for x, y in zip(out, part, strict=True)])
        s = e
    return out


def tile(item: list, doc: list, i: np.ndarray, j: np.ndarray, n: np.ndarray, min_match: int) -> tuple[int, int]:
    """Words of ``item`` that greedy tiles cover, and the number of tiles; ``i``, ``j`` and ``n`` are the starts of the matches in both and their words."""
    queue = list(zip((-n).tolist(), i.tolist(), j.tolist(), strict=True))
    heapq.heapify(queue)
    in_item, in_doc = bytearray(len(item)), set()
    tiles = 0
    while queue:
        n, a, b = heapq.heappop(queue)
        free = [not in_item[a + k] and b + k not in in_doc and item[a + k] == doc[b + k] for k in range(-n)]
        if all(free):
            in_item[a : a - n] = b"\1" * -n
            in_doc.update(range(b, b - n))
            tiles += 1
            if all(in_item):
                break
            continue
        start = None
        for k, fits in enumerate([*free, False]):
            if fits and start is None:
                start = k
            elif not fits and start is not None:
                if k - start >= min_match:
                    heapq.heappush(queue, (start - k, a + start, b + start))
                start = None
    return sum(in_item), tiles


def _measure(items: Items, threshold: float, at: int, name: str, carried: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            best: list[tuple[float, int, int] | None] = [None] * n
            if carried is not None:
                best = [x["tiles"] > 0 and (x["coverage"], x["item_id"], x["tiles"]) or None for x in batch.column(carried).to_pylist()]
            for c in kernel.chunks(batch.column(at)):
                w = kernel.words(c)
                if len(w.hash) < items.min_match or not len(items.hash):
                    continue
                h, doc = kernel.grams(w, items.min_match)
                hit = np.flatnonzero(items.seen[(h >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)])
                left, right = np.searchsorted(items.hash, h[hit], "left"), np.searchsorted(items.hash, h[hit], "right")
                some = right > left
                hit, left, right = hit[some], left[some], right[some]
                if not len(hit):
                    continue
                # Full runs come first in grams(), document by document; short documents never match.
                long_ = w.per_doc >= items.min_match
                count = np.where(long_, w.per_doc - items.min_match + 1, 0)
                before = np.concatenate([[0], np.cumsum(count)])
                place = hit - before[doc[hit]]
                rows, first = np.unique(doc[hit], return_index=True)
                for row, s, e in zip(rows.tolist(), first.tolist(), [*first[1:].tolist(), len(hit)], strict=True):
                    k, i, j, n_seeds = matches(items, place[s:e], left[s:e], right[s:e])
                    span = slice(w.bounds[row], w.bounds[row + 1])
                    lo = int(c.bounds[row])
                    words = spelled(c.data[lo : c.bounds[row + 1]], w.start[span] - lo, w.end[span] - lo)
                    cut = np.flatnonzero(k[1:] != k[:-1]) + 1
                    for x, y in zip([0, *cut], [*cut, len(k)], strict=True):
                        item = items.bytes[k[x]]
                        covered, tiles = tile(item, words, i[x:y], j[x:y], n_seeds[x:y] + items.min_match - 1, items.min_match)
                        share, who = covered / len(item), items.ids[k[x]]
                        old = best[c.first + row]
                        if covered and (old is None or (-share, who is None, who or 0) < (-old[0], old[1] is None, old[1] or 0)):
                            best[c.first + row] = (share, who, tiles)
            out = [{"item_id": b[1], "coverage": b[0], "tiles": b[2], "contaminated": b[0] >= threshold} if b else {"item_id": None, "coverage": 0.0, "tiles": 0, "contaminated": False} for b in best]
            kind = pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("contaminated", pa.bool_())])
            columns = [x for q, x in enumerate(batch.columns) if q != carried]
            names = [x for q, x in enumerate(batch.schema.names) if q != carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], [*names, name])

    return run


def measure(docs: DataFrame, benchmark: DataFrame, into: str = "contamination", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct column ``into``: item_id, coverage, tiles, contaminated."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    words = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    docs = docs.drop(into)
    out, carried = docs, None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).distinct().orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(Items([r["i"] for r in part], [r["t"] for r in part], min_match))
        at = docs.columns.index(text_col)

        def run(batches, shared=shared, carried=carried):
            yield from _measure(shared.value, threshold, at, into, carried)(batches)

        out = out.mapInArrow(run, extended(docs.schema, into, RESULT))
        carried = len(docs.columns)
    return out


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measure(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "contamination.*")
