"""A bit table of bounded size that tells most rows without a partner apart before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the broadcast table, 64 bits each: so many at least and at most.
LEAST, MOST = 1 << 18, 1 << 20


def mark(df: DataFrame, column: str, keys: DataFrame, into: str, expected: int | None = None, how: str = "left") -> DataFrame:
    """``df`` and whether its long (or other) ``column`` may be among the one of ``keys``: never false for one that is.

    The table has about 16 bits for each of the ``expected`` keys, within LEAST
    and MOST rows; with far more keys it lets more rows pass, and no other size grows.
    With ``how`` "inner" rows without an entry in the table go in the join.
    """
    rows = LEAST
    while rows < MOST and expected and rows * 4 < expected:
        rows *= 2
    mixed = lambda name: F.xxhash64(name)  # noqa: E731  a mixed key, as the column may be any number
    place = lambda name: mixed(name).bitwiseAND(rows - 1)
    bit = lambda name: F.shiftright(mixed(name), 32).bitwiseAND(63).cast("int")
    own = "_" * (1 + max((len(n) for n in [*df.columns, into]), default=0))
    key = keys.columns[0]
    table = keys.groupBy(place(key).alias(f"{own}place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(key))).alias(f"{own}bits"))
    joined = df.withColumn(f"{own}place", place(column)).join(F.broadcast(table), f"{own}place", how)
    found = F.call_function("shiftrightunsigned", F.coalesce(f"{own}bits", F.lit(0).cast("long")), bit(column)).bitwiseAND(1) == 1
    return joined.withColumn(into, found).drop(f"{own}place", f"{own}bits")


def near(df: DataFrame, column: str, keys: DataFrame, expected: int | None = None, how: str = "left") -> DataFrame:
    """The rows of ``df`` that :func:`mark` marks."""
    flag = "_" * (1 + max((len(n) for n in df.columns), default=0))
    return mark(df, column, keys, flag, expected, how).filter(F.col(flag)).drop(flag)
