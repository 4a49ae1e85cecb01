"""F-03: set containment of claims in paragraphs, by an inverted index of tokens.

Claims are turned into rows (token, claim); the tokens of paragraphs meet them by
an equi-join, and how many tokens a paragraph and a claim share is a count over
the joined rows, combined in each task before it is shuffled.  Pairs without a
common token are never made, no task sees all claims of a key, and what travels
are ids, not texts or token arrays.

Where only pairs from a threshold ``t`` on are asked for, a claim of n tokens is
found by its ``n - ceil(t n) + 1`` rarest tokens alone (a paragraph that lacks all
of them has less than ``t n`` of the claim's tokens), and paragraphs of less than
``t n`` tokens are passed over; the candidates are then measured in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def paragraph_tokens(rows: DataFrame, ids: list[str], text_col: str) -> DataFrame:
    """(ids, para, tokens): the token set of each paragraph, by its place from 0 on."""
    paras = rows.select(*ids, F.posexplode(text.paragraphs(F.col(text_col))).alias("para", "_text"))
    return paras.select(*ids, "para", text.overlap_tokens(F.col("_text")).alias("tokens"))


def claim_tokens(claims: DataFrame, ids: list[str], claim: str) -> DataFrame:
    """(ids, tokens, size) of the distinct claims; of several with the same ids the smallest counts."""
    tokens = claims.groupBy(*ids).agg(F.min(claim).alias("_claim")).select(*ids, text.overlap_tokens(F.col("_claim")).alias("tokens"))
    return tokens.withColumn("size", F.size("tokens"))


def postings(sets: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, size, token): a row for each token of each set."""
    return sets.select(*ids, "size", F.explode("tokens").alias("token"))


def shared(units: DataFrame, unit: list[str], sets: DataFrame, ids: list[str], on: list[str]) -> DataFrame:
    """(unit, ids, size, shared) of the pairs with a common token, ``on`` being columns of both that must be equal.

    ``units(unit, tokens)`` are paragraphs or whole texts, ``sets(ids, tokens, size)`` claims.
    """
    tokens = units.select(*unit, F.explode("tokens").alias("token"))
    met = tokens.join(postings(sets, ids), [*on, "token"])
    return met.groupBy(*unit, *[c for c in ids if c not in on]).agg(F.min("size").alias("size"), F.count("*").alias("shared"))


def least_shared(size: Column, threshold: float) -> Column:
    """How many of ``size`` tokens make up the threshold."""
    return F.greatest(F.lit(1), F.ceil(size * threshold - 1e-9)).cast("int")


def rarest(sets: DataFrame, ids: list[str], threshold: float) -> DataFrame:
    """(ids, size, token): of each set the rarest tokens that no other set at the threshold can all lack.

    A token is the rarer the fewer of the sets hold it; ties go by the alphabet.
    """
    each = postings(sets, ids)
    known = each.groupBy("token").agg(F.count("*").alias("_df"))
    placed = each.join(known, "token").withColumn("_place", F.row_number().over(Window.partitionBy(*ids).orderBy("_df", "token")))
    return placed.filter(F.col("_place") <= F.col("size") - least_shared(F.col("size"), threshold) + 1).select(*ids, "size", "token")


def supported(units: DataFrame, unit: list[str], sets: DataFrame, ids: list[str], on: list[str], threshold: float) -> DataFrame:
    """(unit, ids, score) of the pairs whose containment is ``threshold`` (above 0) or more."""
    own = [c for c in ids if c not in on]
    tokens = units.select(*unit, F.size("tokens").alias("_n"), F.explode("tokens").alias("token"))
    met = tokens.join(rarest(sets, ids, threshold), [*on, "token"]).filter(F.col("_n") >= least_shared(F.col("size"), threshold))
    pairs = met.select(*unit, *own).distinct()
    full = pairs.join(units, unit).join(sets.select(*ids, F.col("tokens").alias("_of")), ids)
    return full.select(*unit, *own, text.containment(F.col("tokens"), F.col("_of")).alias("score")).filter(F.col("score") >= threshold)


def best_pairs(rows: DataFrame, ids: list[str], text_col: str, claims: DataFrame, claim_ids: list[str], claim: str, on: list[str], per: list[str]) -> DataFrame:
    """(per, para, the claims' other ids, score): for each ``per`` the pair with the largest score above 0; ties go to the first paragraph, then to the first claim."""
    units = paragraph_tokens(rows, ids, text_col)
    pairs = shared(units, [*ids, "para"], claim_tokens(claims, claim_ids, claim), claim_ids, on)
    own = [c for c in claim_ids if c not in on and c not in per]
    best = F.min(F.struct((-F.col("shared") / F.col("size")).alias("less"), "para", *own)).alias("_top")
    top = pairs.groupBy(*per).agg(best)
    return top.select(*per, F.col("_top.para").alias("para"), *[F.col(f"_top.`{c}`").alias(c) for c in own], (-F.col("_top.less")).alias("score"))
