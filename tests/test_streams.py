"""Keyed state of the streams against plain loops: the same answers however the log is cut into files."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.streaming import streams

LATE = timedelta(minutes=10)
KINDS = ["reserve"] * 6 + ["success"] * 2 + ["failure", "corrupt", "other", None]


def made(seed=5, n=300):
    rng = random.Random(seed)
    t, rows = datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, 1, 60, 400, 3000, 3000]))
        rows.append((i, t, rng.choice(["a", "a", "b", "c", None]), rng.random() < 0.4, rng.choice(KINDS)))
    return rows, rng


@pytest.fixture
def log(request, spark, tmp_path):
    """The log in so many files, rows up to nine minutes out of order."""
    rows, rng = made()
    came = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(540)))
    path, size = str(tmp_path / "log.parquet"), -(-len(came) // request.param)
    for k in range(request.param):
        spark.createDataFrame(came[k * size : k * size + size], "i long, ts timestamp, k string, ok boolean, kind string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    end = max(r[1] for r in rows) - LATE
    return stream, rows, end


def closed(rows, end):
    return {r[0] for r in rows if r[1] < end}


@pytest.mark.parametrize("touch", [True, False])
@pytest.mark.parametrize("log", [4], indirect=True)
def test_cache(log, touch):
    stream, rows, end = log
    until, want = {}, {}
    for i, t, k, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = k in until and t <= until[k]
        if touch or not want[i]:
            until[k] = t + timedelta(seconds=3600)
    out = streams.run(streams.cache(stream, "ts", "i", "10 minutes", "k", 3600, touch), "cache").collect()
    assert {r.event: r.hit for r in out} == {i: want[i] for i in closed(rows, end)}
    assert len(out) == len({r.event for r in out}) and {r.k for r in out} == {"a", "b", "c", None}


@pytest.mark.parametrize("log", [4], indirect=True)
def test_breaker(log):
    stream, rows, end = log
    n, last, want = {}, {}, {}
    for i, t, k, ok, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = (n.get(k, 0), n.get(k, 0) >= 3 and t < last[k] + timedelta(hours=1))
        n[k], last[k] = (0, t) if ok else (n.get(k, 0) + 1, t)
    out = streams.run(streams.breaker(stream, "ts", "i", "10 minutes", "k", "ok"), "breaker")
    assert {r.event: (r.failures, r.open) for r in out.collect()} == {i: want[i] for i in closed(rows, end)}


@pytest.mark.parametrize("log", [1, 4], indirect=True)
def test_breaker_of_a_closed_log(log):
    """Every row is answered, the last ten minutes of the log and rows without time, which come last, included."""
    stream, rows, _ = log
    stream = stream.withColumn("ts", F.when(F.col("i") % 50 != 7, F.col("ts")))
    n, last, want = {}, {}, {}
    for i, t, k, ok, _ in sorted(((i, None if i % 50 == 7 else t, *r) for i, t, *r in rows), key=lambda r: (r[1] is None, r[1] or LATE, r[0])):
        want[i] = (n.get(k, 0), bool(n.get(k, 0) >= 3 and t and t < last[k] + timedelta(hours=1)))
        n[k], last[k] = (0, t) if ok else (n.get(k, 0) + 1, t)
    out = streams.run_closed(stream, "ts", lambda s: streams.breaker(s, "ts", "i", "10 minutes", "k", "ok", untimed=True), "breaker").collect()
    assert {r.event: (r.failures, r.open) for r in out} == want and len(out) == len(rows)
    assert any(opened for _, opened in want.values())


class Counter:
    """A day's budget as a file that is read and written at each call."""

    def __init__(self, cap):
        self.cap, self.file = cap, None

    def load(self, now):
        if self.file == "corrupt":
            return [now.date(), self.cap, []]
        if self.file is None or self.file[0] != now.date():
            return [now.date(), 0, []]
        return [self.file[0], self.file[1], [t for t in self.file[2] if t > now - timedelta(minutes=30)]]

    def call(self, kind, now):
        if kind == "corrupt":
            self.file = "corrupt"
        day, used, live = self.load(now)
        granted = None
        if kind == "reserve":
            granted = used + len(live) < self.cap
            if granted:
                live.append(now)
                self.file = [day, used, live]
        elif kind in ("success", "failure"):
            used += kind == "success"
            self.file = [day, used, live[1:]]
            live = live[1:]
        return granted, used, len(live)


@pytest.mark.parametrize("log", [1, 2, 10], indirect=True)
def test_leases(log, cap=3):
    stream, rows, end = log
    counters, want = defaultdict(lambda: Counter(cap)), {}
    for i, t, k, _, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = counters[k].call(kind, t)
    out = streams.run(streams.leases(stream, "ts", "i", "10 minutes", "k", "kind", cap), "leases")
    assert {r.event: (r.granted, r.used, r.reserved) for r in out.collect()} == {i: want[i] for i in closed(rows, end)}
    assert {g for g, *_ in want.values()} == {True, False, None}


@pytest.mark.parametrize("log", [4], indirect=True)
def test_leases_without_cap(log):
    stream, rows, end = log
    out = streams.run(streams.leases(stream, "ts", "i", "10 minutes", "k", "kind", 0), "leases").collect()
    assert {r.event for r in out} == closed(rows, end)
    assert {(r.granted, r.used, r.reserved) for r in out} == {(True, 0, 0), (None, 0, 0)}


@pytest.mark.parametrize("log", [4], indirect=True)
def test_reaper(log):
    stream, rows, end = log
    want, state = set(), defaultdict(lambda: [None, None])
    last = {k: max(t for _, t, q, *_ in rows if q == k) for _, _, k, *_ in rows}
    for now in sorted({r[1] + timedelta(seconds=s) for r in rows for s in (0, 300, 600)}):
        # A request at a moment comes before the reaper does.
        for _, t, k, ok, _ in sorted(rows, key=lambda r: (r[1], r[0])):
            if t == now:
                state[k][0 if not ok else 1] = t
        for k, (asked, locked) in list(state.items()):
            if now < end and asked and now - asked >= timedelta(seconds=300) and not (locked and now - locked < timedelta(seconds=600)):
                want.add((k, asked, now))
                state[k] = [None, locked]
    out = streams.run(streams.reaper(stream, "ts", "i", "10 minutes", "k", "ok"), "reaper").collect()
    assert {(r.k, r.requested, r.reaped) for r in out} == want and len(out) == len(want)
    assert len(want) > 20 and last
