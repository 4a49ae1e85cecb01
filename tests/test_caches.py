"""A bounded cache against a plain simulation."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest

from gleaner.operators import caches


def simulated(rows, capacity, seconds):
    cache, out = OrderedDict(), {}
    for i, t, k in sorted((r for r in rows if r[1] and r[2] is not None), key=lambda r: (r[1], r[0])):
        last = cache.pop(k, None)
        out[i] = last is not None and t - last <= timedelta(seconds=seconds)
        cache[k] = t
        if len(cache) > capacity:
            cache.popitem(last=False)
    return out


@pytest.mark.parametrize(("capacity", "seconds", "blocks"), [(1, 10**6, 4), (5, 40, 1), (5, 60, 13), (20, 10**6, 8), (500, 100, 5)])
def test_lru(spark, capacity, seconds, blocks):
    rng = random.Random(capacity)
    t, rows = datetime(2024, 1, 1), []
    for i in range(800):
        t += timedelta(seconds=rng.choice([0, 0, 1, 5]))
        rows.append((i, t, f"k{int(rng.paretovariate(0.6)) % 60}" if rng.random() < 0.7 else "hot"))
    # Stretches in which one key alone is asked for leave blocks with short lists.
    rows += [(1000 + i, t + timedelta(seconds=i), "same") for i in range(200)] + [(2000 + i, t + timedelta(seconds=300 + i), f"k{i % 9}") for i in range(30)]
    rows += [(5000, None, "k1"), (5001, t, None)]
    rng.shuffle(rows)
    got = caches.lru_hits(spark.createDataFrame(rows, "i long, ts timestamp, key string").withColumnRenamed("i", "block"), "key", "ts", "block", capacity, seconds, blocks).collect()
    want = simulated(rows, capacity, seconds)
    assert {r.order: r.hit for r in got} == want and len(got) == len(want)
    assert len(set(want.values())) == 2


def test_lru_empty(spark):
    assert caches.lru_hits(spark.createDataFrame([], "i long, ts timestamp, key string"), "key", "ts", "i").collect() == []
