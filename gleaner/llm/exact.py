"""Exact duplicates by stateful streaming.

The documents are read as a stream.  A disk-backed state store (RocksDB) holds
one row for each digest of a normalised text, without expiry: the number of
rows, the document that stays (its identifier, its length) and the locator of
its content (file and row in the file).  The state is a streaming aggregation,
so a task combines its own rows before they are shuffled and a text that a
third of all rows share costs one row for each task.

A digest alone never decides: the rows whose digest is held by more than one
row are the hits, and their full normalised bytes are compared (the distinct
texts of each digest are counted, again combined in each task).  A bit table of
bounded size keeps rows that are no hits out of that shuffle.  A document of an
earlier run that is not at ``path`` is read back by its locator for this.  If
bytes differ under one digest, that digest's rows are grouped by their whole
text instead.

The query's checkpoint and the state live below ``spark.checkpoint.dir``; with
``state_dir`` given, later calls go on from the same state, so a document that
came in an earlier run counts as seen.

Defined results: null counts as the empty text, and empty texts are equal to
each other; white space ``[\\x20\\x09-\\x0D]`` is deleted before comparing; of
equal texts the row with the most code points in the original stays, then the
smallest doc_id (nulls last).  Repeated rows are members like any other; rows
that repeat the kept doc_id are kept with it.  An empty table gives an empty
one.  Other columns are not read, so their names cannot clash.  Where a digest
does clash, group_size counts the rows at ``path`` and the one that can be read back.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits
from .workspace import Workspace

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _shape(docs: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("length"), normalised(text).alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.withColumn("sha", F.sha2("norm", 256)).withColumn("digest", F.left("sha", F.lit(digest_bits // 4)))


def _best() -> Column:
    """Largest for the row that stays: most code points, then the smallest id, none last."""
    return F.struct(F.col("length"), F.col("id").isNotNull().alias("some"), F.bitwise_not("id").alias("order"))


def ingest(spark: SparkSession, path: str, schema: T.StructType, state_dir: str, id_col: str, text_col: str, digest_bits: int = 256) -> DataFrame:
    """Feed all files at ``path`` that the state has not seen to it; returns the state."""
    # As a glob, the path may be one file as well as a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    rows = _shape(stream, id_col, text_col, digest_bits).select("id", "length", "digest", "file", "row")
    state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max_by(F.struct("id", "length", "file", "row"), _best()).alias("stays"))
    # Without fallocate, a store with little in it takes little disk.
    store = "spark.sql.streaming.stateStore"
    wanted = {f"{store}.providerClass": ROCKSDB, f"{store}.rocksdb.changelogCheckpointing.enabled": "true", f"{store}.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return read_state(spark, state_dir)


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """(digest, n, id, length, file, row): the state as the last batch left it."""
    raw = spark.read.format("statestore").load(state_dir)
    value = raw.schema["value"].dataType.fieldNames()
    return raw.select(F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("n"), *[F.col(f"value.`{value[1]}`.{c}").alias(c) for c in ("id", "length", "file", "row")])


def exact_duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, digest_bits: int = 256) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256, kept_file, kept_row.

    ``digest_bits`` (a multiple of 4) is for tests of colliding digests.
    """
    ws = Workspace(spark, "exact")
    docs = spark.read.parquet(path)
    seen = ws.save(ingest(spark, path, docs.schema, state_dir or ws.path("state"), id_col, text_col, digest_bits), "seen")
    shaped = _shape(docs, id_col, text_col, digest_bits)

    busy = seen.filter("n > 1").select("digest", "id", "length", "file", "row")
    earlier = _located(spark, docs.schema, busy.join(shaped.select("file").distinct(), "file", "left_anti"), id_col, text_col, digest_bits) if state_dir else None
    # Full bytes of the hits: a digest with more than one text clashes.
    hits = bits.near(shaped.select("norm", "digest"), "digest", busy.select("digest"), busy.count())
    hits = hits.unionByName(earlier.select("norm", "digest")) if earlier else hits
    clashes = ws.save(hits.distinct().groupBy("digest").count().filter("count > 1").select("digest"), "clashes")
    light = shaped.select("id", "length", "digest", "sha")
    kept = seen.select("digest", F.col("n").alias("group_size"), F.col("id").alias("keep_id"), "file", "row")
    if clashes.isEmpty():
        out = light.join(kept, "digest")
    else:
        clean = light.join(clashes, "digest", "left_anti").join(kept, "digest")
        apart = shaped.join(clashes, "digest", "left_semi")
        known = apart.unionByName(earlier.join(clashes, "digest", "left_semi")) if earlier else apart
        whole = known.groupBy("norm").agg(F.count("*").alias("group_size"), F.max_by(F.struct("id", "file", "row"), _best()).alias("stays"))
        split = apart.select("digest", "id", "length", "sha", "norm").join(whole, "norm").select("digest", "id", "length", "sha", "group_size", F.col("stays.id").alias("keep_id"), "stays.file", "stays.row")
        out = clean.unionByName(split)
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("file").alias("kept_file"), F.col("row").alias("kept_row"))


def _located(spark: SparkSession, schema: T.StructType, wanted: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame | None:
    """The rows that wanted(file, row) locates, shaped; None if there are none.  The names of files, not of documents, reach the driver."""
    files = [unquote(r["file"]) for r in wanted.select("file").distinct().collect()]
    if not files:
        return None
    rows = _shape(spark.read.schema(schema).parquet(*files), id_col, text_col, digest_bits)
    return rows.join(wanted.select("file", "row"), ["file", "row"], "left_semi")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet").drop("kept_file", "kept_row")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY len DESC, doc_id) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
