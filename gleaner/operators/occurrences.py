"""G-19: which of a key's tokens occur in its texts, at a cost that is linear in the texts.

The tokens of a key make one automaton (Aho-Corasick), which reads each of the
key's texts once and finds all tokens at once, however many there are.  Tokens and texts come to
a task by key, tokens first, and stream through it: a task holds one automaton
and one batch of texts.  A key with many texts is dealt to several tasks, each with
its tokens; one with many tokens has them in several automata, which each read its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Texts of a key that go to one task, and tokens of an automaton.
TEXTS, TOKENS = 4096, 50_000


def _automaton(tokens: list[str]):
    from ahocorasick import Automaton

    made = Automaton()
    for i, token in enumerate(tokens):
        made.add_word(token, i)
    made.make_automaton()
    return made


def _scan(key: str):
    """Rows (key, part, block, is_text, value) in this order to the distinct (key, token) that a part's texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tokens, machine, found = None, [], None, set()
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for *now, is_text, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != group:
                    out += [(group[0], tokens[i]) for i in found] if found else []
                    group, tokens, machine, found = now, [], None, set()
                if not is_text:
                    tokens.append(value)
                elif len(found) < len(tokens):
                    machine = machine or _automaton(tokens)
                    found.update(i for _, i in machine.iter(value))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), pa.array([t for _, t in out], pa.string())], [key, "token"])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([group[0]] * len(found), kind), pa.array([tokens[i] for i in found], pa.string())], [key, "token"])

    return run


def occurring(tokens: DataFrame, texts: DataFrame, key: str, most_texts: int = TEXTS, most_tokens: int = TOKENS) -> DataFrame:
    """(key, token): the distinct tokens of ``tokens(key, token)`` that are a substring of a text of their key in ``texts(key, text)``.

    Rows without key, token or text, and empty tokens, are left out; letters count as they stand.
    """
    ship(tokens.sparkSession)
    asked = tokens.select(key, "token").filter(F.col(key).isNotNull() & (F.col("token") != "")).distinct()
    read = texts.select(key, "text").filter(F.col(key).isNotNull() & F.col("text").isNotNull())
    # Keys with more of either than goes together, and in how many parts: few, as each takes many rows.
    parts = lambda df, most, name: df.groupBy(key).count().filter(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias(name))
    many = parts(read, most_texts, "_parts").join(parts(asked, most_tokens, "_blocks"), key, "full")
    deal = lambda df: df.join(many, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = deal(asked).select(key, every("_parts").alias("part"), F.pmod(F.xxhash64("token"), "_blocks").cast("int").alias("block"), F.lit(False).alias("is_text"), F.col("token").alias("value"))
    read = deal(read).select(key, F.pmod(F.xxhash64("text"), "_parts").cast("int").alias("part"), every("_blocks").alias("block"), F.lit(True).alias("is_text"), F.col("text").alias("value"))
    dealt = asked.unionByName(read).repartition(key, "part", "block").sortWithinPartitions(key, "part", "block", "is_text")
    schema = T.StructType([T.StructField(key, tokens.schema[key].dataType), T.StructField("token", T.StringType())])
    return dealt.mapInArrow(_scan(key), schema).distinct()
