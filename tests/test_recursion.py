"""Recursion plans against a plain loop, guards included."""

import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.operators import gaps
from gleaner.plans import questions

DATA = "/root/testdata/sf0.001"
DROP = {"the", "and", "for", "with", "from", "that", "this"}


def tokens(x):
    return {t for t in "".join(c.lower() if c.isalnum() else " " for c in x).split() if len(t) > 2 and t not in DROP}


def similar(a, b):
    a, b = tokens(a), tokens(b)
    if not a or not b:
        return 0.0
    return min(len(a), len(b)) / max(len(a), len(b)) if a <= b or b <= a else len(a & b) / len(a | b)


def taken(proposed, asked, dropped, limit):
    new = []
    for q in proposed:
        q = re.sub(r"\s+", " ", q).strip()
        if not q:
            continue
        if any(similar(q, p) >= 0.86 for p in asked + new):
            dropped.append(q)
            continue
        new.append(q)
        if len(new) >= limit:
            break
    return new


def plain_plan(protocol, models, cost, scout, below):
    depth, width, cap, budget = gaps.LIMITS.get((protocol, "deep" if models >= 3 else "one_llm"), (0, 0, 0, 0.0))
    nodes, asked, dropped = [], [], []
    if cost >= budget or depth <= 0 or cap <= 0:
        return nodes, dropped
    new = taken(scout, asked, dropped, cap)
    asked += new
    level = [(str(i), 1, q, (budget - cost) / len(new)) for i, q in enumerate(new)]
    while level:
        nodes += level
        ahead = []
        for name, d, q, part in level:
            count = len(nodes) + len(ahead)
            if d >= depth or count >= cap:
                continue
            new = taken(below.get(q, []), asked, dropped, min(width, cap - count))
            asked += new
            ahead += [(f"{name}.{i}", d + 1, x, part / len(new)) for i, x in enumerate(new)]
        level = ahead
    return nodes, dropped


def compare(sessions, scout, below):
    got = {r.session: r for r in gaps.plan_recursion(sessions, scout, below).collect()}
    first, under = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for r in sorted(scout.collect(), key=lambda r: (r.session, r.pos)):
        first[r.session].append(r.question or "")
    for r in sorted(below.collect(), key=lambda r: (r.session, r.pos)):
        under[r.session][re.sub(r"\s+", " ", r.parent).strip()].append(r.question or "")
    deepest = 0
    for s in sessions.collect():
        nodes, dropped = plain_plan(s.protocol, s.models, s.cost, first[s.session], under[s.session])
        r = got.pop(s.session)
        assert [tuple(n)[:3] for n in r.nodes] == [n[:3] for n in nodes]
        assert [n.budget for n in r.nodes] == pytest.approx([n[3] for n in nodes])
        assert (r.leaves, list(r.dropped)) == (len(nodes), dropped)
        deepest = max([deepest, *(n[1] for n in nodes)])
    assert not got
    return deepest


def test_plans(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(14)]
    question = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 5)))
    sessions, scout, below = [], [], []
    for s in range(60):
        protocol, models = rng.choice(["research", "deep_research", "search"]), rng.choice([0, 2, 3, 5])
        sessions.append((s, protocol, models, rng.choice([0.0, 0.1, 0.5, 1.5, 2.0])))
        known = [question() for _ in range(20)]
        scout += [(s, k, f"  {q} ") for k, q in enumerate(known[: rng.choice([0, 1, 5, 20])])]
        below += [(s, q, k, rng.choice([question(), "", q, None, "and the"])) for q in set(known) for k in range(rng.randrange(6))]
        below += [(s, q, 100 + k, question()) for _, _, _, q in below[-30:] if q for k in range(2)]
    made = (spark.createDataFrame(sessions, "session int, protocol string, models int, cost double"), spark.createDataFrame(scout, "session int, pos int, question string"), spark.createDataFrame([(s, p, k, q) for k, (s, p, _, q) in enumerate(below)], "session int, parent string, pos int, question string"))
    assert compare(*made) == 3


def test_guards(spark):
    sessions = spark.createDataFrame([(1, "research", 1, 0.0), (2, "research", 3, 0.5), (3, "research", 3, 0.75), (4, "deep_research", 1, 0.1), (5, "research", 3, None)], "session int, protocol string, models int, cost double")
    scout = sessions.select("session", F.posexplode(F.array(F.lit("alpha beta"), F.lit("gamma delta"))).alias("pos", "question"))
    below = sessions.select("session", F.lit("alpha beta").alias("parent"), F.lit(0).alias("pos"), F.lit("epsilon zeta").alias("question"))
    got = {r.session: [(n.node, round(n.budget, 6)) for n in r.nodes] for r in gaps.plan_recursion(sessions, scout, below).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [("0", 0.1), ("1", 0.1)], 5: [("0", 0.25), ("1", 0.25), ("0.0", 0.25)]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_conversations(spark):
    assert compare(*questions.recursion_inputs(spark, DATA)) >= 2


@pytest.mark.parametrize("least", [0.3, 0.6, 0.86])
def test_keep_first_is_the_ordered_walk(spark, least):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(12)] + ["the", "ab"]
    rows = [(k % 3, k, " ".join(rng.choices(words, k=rng.randrange(0, 7)))) for k in range(150)] + [(5, 0, None), (5, 1, "")]
    # A chain in which each is similar to the next alone.
    rows += [(7, k, " ".join(f"link{j}" for j in range(k, k + 12))) for k in range(9)]
    df = spark.createDataFrame(rows, "k int, i int, q string")
    got = {tuple(r) for r in gaps.keep_first(df, "k", "i", "q", least).collect()}
    pairs = {(r.k, r.a, r.b) for r in gaps.similar_pairs(df, "k", "i", "q", least).collect()}
    assert pairs == {(k, i, j) for k, i, q in rows for k2, j, p in rows if k == k2 and i < j and q and p and similar(q, p) >= least}
    want, kept = set(), defaultdict(list)
    for k, i, q in rows:
        if not any(similar(q or "", p) >= least for p in kept[k]):
            kept[k].append(q or "")
            want.add((k, i))
    assert got == want


def test_texts_are_dealt_once(spark):
    """Parents meet proposals where those are: of the plan of a level, no exchange but the one by session carries proposals."""
    c = spark.range(50).select((F.col("id") % 5).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("What of mill "), F.col("id"), F.lit("? And of its looms? ")).alias("text"))
    _, _, below = questions.recursion_rows(c)
    parents = spark.range(5).select(F.col("id").alias("session"), F.lit("x").alias("_parents")).hint("shuffle_hash")
    plan = below.join(parents, "session").groupBy("session", "parent").count()._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning(") == 2
