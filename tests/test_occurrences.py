"""Tokens in texts against a plain search."""

import random

import pytest

from gleaner.operators.occurrences import occurring


@pytest.mark.parametrize(("texts", "tokens"), [(4096, 50_000), (3, 50_000), (2, 2)])
def test_occurring(spark, texts, tokens):
    rng = random.Random(1)
    letters = "abé "
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    # One key has most of the rows; tokens are parts of each other.
    keys = lambda n: [0 if rng.random() < 0.5 else rng.randrange(1, 5) for _ in range(n)]
    asked = [(k, some(rng.randrange(1, 6))) for k in keys(120)] + [(0, "ab"), (0, "ab"), (3, ""), (3, None), (None, "a"), (9, "a"), (1, "b" * 50)]
    read = [(k, some(rng.randrange(0, 12))) for k in keys(60)] + [(1, None), (None, "a"), (1, ""), (2, "b" * 30_000), (1, "x" + "b" * 50), (8, "a")]
    got = occurring(spark.createDataFrame(asked, "k int, token string"), spark.createDataFrame(read, "k int, text string"), "k", texts, tokens).collect()
    want = {(k, t) for k, t in asked if k is not None and t and any(q == k and x is not None and t in x for q, x in read)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_nothing(spark):
    none = spark.createDataFrame([], "k string, token string")
    assert occurring(none, spark.createDataFrame([("a", "b")], "k string, text string"), "k").collect() == []
