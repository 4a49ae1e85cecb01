r"""Matches of a pattern with their offsets, in SQL functions.

The matches of a text and the pieces between them come from the same leftmost,
non-overlapping search, so a match starts where the lengths of all before it
add up to.  These sums are made by doubling (log2 n steps over the whole
array), and what stands beside a match is cut from the two pieces next to it:
the work grows with the text, not with the square of its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is computed once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def running(x: Column) -> Column:
    """Running sums of an array of ints."""

    def step(sums: Column, k: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), k)
        shifted = F.concat(F.array_repeat(F.lit(0), far), F.slice(sums, F.lit(1), F.size(sums) - far))
        return F.zip_with(sums, shifted, lambda a, b: a + b)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(x).cast("double"))).cast("int") - 1)
    return F.when(F.size(x) < 2, x).otherwise(F.aggregate(steps, x, step))


def matches(text: Column, pattern: str, window: int) -> Column:
    """array<struct<start, end, value, before, after>>: offsets in code points, the end exclusive; ``before`` and ``after`` are at most ``window`` characters of the pieces beside."""

    def placed(found: Column, between: Column) -> Column:
        n = F.size(found)
        sides = F.zip_with(F.slice(between, F.lit(1), n), F.slice(between, F.lit(2), n), lambda a, b: F.struct(F.length(a).alias("gap"), F.right(a, F.lit(window)).alias("before"), F.left(b, F.lit(window)).alias("after")))
        both = F.zip_with(found, sides, lambda m, s: F.struct(m.alias("value"), F.length(m).alias("size"), s["gap"].alias("gap"), s["before"].alias("before"), s["after"].alias("after")))

        def with_ends(rows: Column) -> Column:
            ends = running(F.transform(rows, lambda r: r["gap"] + r["size"]))
            return F.zip_with(rows, ends, lambda r, e: F.struct((e - r["size"]).alias("start"), e.alias("end"), r["value"].alias("value"), r["before"].alias("before"), r["after"].alias("after")))

        return let(both, with_ends)

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found, F.split(text, pattern, -1))))
