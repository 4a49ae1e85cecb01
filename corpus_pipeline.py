"""The training-data pipeline: good documents, without recurring lines, near
copies and benchmark passages, as tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of ``docs``.  Nulls, empty and repeated rows fare as the
operators' docstrings say: a null text has no lines, shingles or tokens and
stays null until it is encoded as no tokens; a row without doc_id passes.  An
empty table gives an empty one.  Columns with the names of the last stage's are
replaced by them; others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontaminate, lines, minhash, quality
from gleaner.llm.workspace import Workspace


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-resampling classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur in two documents or more go from all documents but the first, and documents left
    without a word with them; n_chars follows the text."""
    mark, word = "_" * (1 + max(map(len, docs.columns))), r"[^\x20\x09-\x0D]"
    out = lines.drop_lines(docs, into=mark)
    bare = F.coalesce(F.col("text").rlike(word) & ~F.col(mark).rlike(word), F.lit(False))
    out = out.filter(~bare).withColumn("text", F.col(mark)).drop(mark)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 stays, the one with the smallest doc_id."""
    return minhash.keep_one(docs, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    mark = "_" * (1 + max(map(len, docs.columns)))
    return decontaminate.measure(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=mark).filter(~F.col(mark)["contaminated"]).drop(mark)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, ids (packed little-endian unsigned 32 bits), n_tokens, and whether decoding gives the text again."""
    path, pattern = bpe.default_vocabulary()
    coded = bpe.encode(docs, path, pattern, bytes_col="decoded")
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.withColumn("n_tokens", F.expr("octet_length(ids) div 4")).withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: Hashed n-gram weights and signatures are not SQL; tests/llm hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written before the next reads it."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
