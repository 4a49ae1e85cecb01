"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Steps
-----
1. One pass over the texts gives each document the size and a 128-bit digest of
   its shingle set and a SuperMinHash signature folded into band hashes.
   SuperMinHash gives each element one random permutation of the signature's
   slots; its j-th slot gets the value ``j + r``, so the slots of one element
   are correlated and a document is finished as soon as no later rank can lower
   any slot.  All elements of a batch advance rank by rank together.
2. Equal sets collapse to their smallest id (map-side combined, so a group of
   copies never meets in one task).
3. Band hashes held by several sets give candidate clusters (connected
   components of "shares a band with").  Members are compared on their full
   sets, first with the cluster's centre (the member met in most buckets);
   those that do not link with the centre are compared with all others of the
   cluster in blocks of bounded size.  No candidate is left out and no pair
   table is written; a block returns a spanning forest of its links.
4. Components of the confirmed links give the groups.

With 40 bands of 7 rows a pair at similarity 0.8 meets with probability
0.9999; with 32 bands of 8 rows a pair at 0.85 does with 0.99996.  Paths over
third documents add to that.

Defined results
---------------
Null or blank texts have no shingles and link with nothing.  Rows that share a
doc_id are one document.  Rows without doc_id join a group only as an equal
set and are never its kept document, unless nothing identified is in it: then
component_id is null and they are kept.  An empty table gives an empty one.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .workspace import Workspace

BANDS, ROWS, BLOCK = 40, 7, 128
#: Bytes of text whose signatures are made together: each of their shingles has a permutation of the slots.
CHUNK = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(elements: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Signatures (documents x size) of the sets ``elements[bounds[i]:bounds[i+1]]``.

    A slot holds ``rank << 48 | random``, the smallest over the set's elements.
    An empty set keeps all ones.
    """
    n = len(bounds) - 1
    sig = np.full(n * size, _EMPTY, dtype=np.uint64)
    per_doc = np.diff(bounds)
    doc = np.repeat(np.arange(n), per_doc)
    h, perm = elements, None
    with np.errstate(over="ignore"):
        for rank in range(size):
            draw = kernel.mix(h + np.uint64(rank + 1) * _STEP)
            pick = rank + (((draw & np.uint64(0xFFFF)) * np.uint64(size - rank)) >> np.uint64(16)).astype(np.int64)
            if perm is None:
                slot = pick
            else:
                rows = np.arange(len(h))
                slot = perm[rows, pick].astype(np.int64)
                perm[rows, pick] = perm[:, rank]
            np.minimum.at(sig, doc * size + slot, (np.uint64(rank) << np.uint64(48)) | (draw >> np.uint64(16)))
            open_ = sig.reshape(n, size).max(axis=1) >= (np.uint64(rank + 1) << np.uint64(48))
            stay = open_[doc]
            if not stay.any():
                break
            if perm is None:
                h, doc, pick = h[stay], doc[stay], pick[stay]
                perm = np.tile(np.arange(size, dtype=np.uint16), (len(h), 1))
                perm[np.arange(len(h)), pick] = 0
            elif not stay.all():
                h, doc, perm = h[stay], doc[stay], perm[stay]
    return sig.reshape(n, size)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros((len(sig), bands), dtype=np.uint64)
        part = sig[:, : bands * rows].reshape(len(sig), bands, rows)
        for i in range(rows):
            out = out * np.uint64(0xD6E8FEB86659FD93) + kernel.mix(part[:, :, i])
        return kernel.mix(out + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP)


def _profile(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in kernel.chunks(batch.column(1), CHUNK):
                h, at = kernel.gram_sets(kernel.words(c), shingle)
                sums = np.zeros(len(h) + 1, dtype=np.uint64)
                sums2 = np.zeros(len(h) + 1, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    np.cumsum(h, out=sums[1:])
                    np.cumsum(kernel.mix(h + _STEP), out=sums2[1:])
                    d1, d2 = sums[at[1:]] - sums[at[:-1]], sums2[at[1:]] - sums2[at[:-1]]
                hashes = band_hashes(superminhash(h, at, bands * rows), bands, rows).astype(np.int64)
                full = np.diff(at) > 0
                ends = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[full].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(np.diff(at)), pa.array(d1.astype(np.int64)), pa.array(d2.astype(np.int64)), lists], ["id", "n", "d1", "d2", "bands"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in kernel.chunks(batch.column(1)):
                h, at = kernel.gram_sets(kernel.words(c), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), kernel.binary_array(h, at)], ["rep", "shingles"])

    return run


def _linked(n1: np.ndarray, n2: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (n1 + n2 - both)


def _verify(percent: int):
    """(rep, center, shingles, of_center) to (rep, center, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                out.append(bool(_linked(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["rep", "center", "linked"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block of sets."""
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros(k * k, dtype=np.int64)
    rare = (df[col] > 1) & (df[col] <= 16)
    order = np.argsort(col[rare], kind="stable")
    o, c = owner[rare][order], col[rare][order]
    for gap in range(1, 16):
        if gap >= len(c):
            break
        same = c[gap:] == c[:-gap]
        if not same.any():
            break
        out += np.bincount(o[:-gap][same] * k + o[gap:][same], minlength=k * k)
    out = out.reshape(k, k)
    out = out + out.T
    often = df[col] > 16
    names, dense = np.unique(col[often], return_inverse=True)
    who = owner[often]
    for first in range(0, len(names), 8192):
        here = (dense >= first) & (dense < first + 8192)
        m = np.zeros((k, min(8192, len(names) - first)), dtype=np.float32)
        m[who[here], dense[here] - first] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _block(percent: int):
    """A spanning forest of the links within one block (or between its two sides)."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        n = np.array([len(s) for s in sets])
        link = _linked(n[:, None], n[None, :], intersections(sets), percent)
        if (side == 1).any():
            link &= side[:, None] != side[None, :]
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
            x, y = root(int(i)), root(int(j))
            if x != y:
                parent[y] = x
                a.append(int(ids[i]))
                b.append(int(ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    ``percent`` is the smallest linked Jaccard similarity in hundredths.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = ws.save(docs.mapInArrow(_profile(shingle, bands, rows), "id long, n long, d1 long, d2 long, bands array<long>"), "profile")
    reps = ws.save(profile.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")).filter("rep is not null"), "reps")

    hashes = reps.select("rep", F.explode("bands").alias("b"))
    buckets = hashes.groupBy("b").agg(F.count("*").alias("c"), F.min("rep").alias("lead")).filter("c > 1")
    shares = ws.save(hashes.join(buckets, "b").groupBy("rep", "lead").agg(F.sum("c").alias("met")), "shares")
    clusters = components(shares.select(F.col("rep").alias("a"), F.col("lead").alias("b")), ws)
    met = shares.groupBy(F.col("rep").alias("id")).agg(F.sum("met").alias("met"))
    members = ws.save(clusters.join(met, "id").select(F.col("id").alias("rep"), F.col("comp").alias("cluster"), "met"), "members")
    centers = members.groupBy("cluster").agg(F.max_by("rep", F.struct("met", F.bitwise_not("rep"))).alias("center"))
    members = members.join(centers, "cluster").select("rep", "cluster", "center")
    texts = docs.join(members.select(F.col("rep").alias("id")), "id", "left_semi")
    sets = ws.save(texts.mapInArrow(_sets(shingle), "rep long, shingles binary").join(members, "rep"), "sets")

    of_center = sets.filter("rep = center").select("center", F.col("shingles").alias("of_center"))
    star = sets.filter("rep <> center").join(of_center, "center").select("rep", "center", "shingles", "of_center")
    star = ws.save(star.mapInArrow(_verify(percent), "rep long, center long, linked boolean"), "star")

    linked = star.filter("linked").select(F.col("center").alias("a"), F.col("rep").alias("b"))
    apart = star.filter("not linked").select("rep", F.lit(True).alias("apart"))
    placed = sets.join(apart, "rep", "left").select("rep", "cluster", "shingles", F.coalesce("apart", F.lit(False)).alias("apart"))
    sizes = sets.select("rep", "cluster").join(apart, "rep", "left").groupBy("cluster").agg(F.ceil(F.count("apart") / block).cast("int").alias("n_apart"), F.ceil((F.count("*") - F.count("apart")) / block).cast("int").alias("n_rest")).filter("n_apart > 0")
    dealt = placed.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("apart"), F.col("n_apart")).otherwise(F.col("n_rest"))).cast("int"))
    other = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    inner = F.transform(other("n_apart"), lambda j: F.struct(F.lit(0).alias("kind"), F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"), (j < F.col("own")).cast("int").alias("side")))
    outer = F.transform(F.when(F.col("n_rest") > 0, other("n_rest")).otherwise(F.array().cast("array<int>")), lambda j: F.struct(F.lit(1).alias("kind"), F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    crossed = F.transform(other("n_apart"), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    dealt = dealt.select("rep", "shingles", "cluster", F.explode(F.when(F.col("apart"), F.concat(inner, outer)).otherwise(crossed)).alias("at")).select("rep", "shingles", "cluster", "at.*")
    blocks = ws.save(dealt.repartition("cluster", "kind", "i", "j").groupBy("cluster", "kind", "i", "j").applyInArrow(_block(percent), "a long, b long"), "links")
    groups = components(linked.unionByName(blocks), ws)
    ws.drop(sets, shares, members)

    of_set = reps.select("n", "d1", "d2", "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("comp", "rep").alias("comp"))
    out = profile.select("id", "n", "d1", "d2").join(of_set, ["n", "d1", "d2"], "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group; rows without id stay."""
    gone = near_duplicates(docs, id_col, text_col, **how).filter("not kept and doc_id is not null").select("doc_id").distinct()
    mark = "_" * (1 + max((len(n) for n in docs.columns), default=0))
    return docs.join(gone.withColumnRenamed("doc_id", mark), F.col(f"`{id_col}`").cast("long") == F.col(mark), "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85, bands=32, rows=8)
