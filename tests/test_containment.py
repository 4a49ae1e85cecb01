"""Containment by the inverted index against all pairs."""

import random
import re
from collections import defaultdict

import duckdb
import pytest

from gleaner.functions import text
from gleaner.operators import containment, evidence
from gleaner.plans import evidence as plans

STOP = set(text.EVIDENCE_STOPWORDS)


def tokens(x):
    return {t for t in re.findall("[a-z0-9]+", (x or "").lower()) if len(t) > 1 and t not in STOP}


def share(p, c):
    return len(tokens(p) & tokens(c)) / len(tokens(c)) if tokens(p) and tokens(c) else 0.0


def made(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(500)] + ["the", "of", "A1", "é"]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    sources = [(k, rng.randrange(4), "\n\n".join(sentence(rng.randrange(1, 20)) for _ in range(rng.randrange(4)))) for k in range(60)]
    claims = [(rng.randrange(5), k, sentence(rng.randrange(1, 9))) for k in range(30)]
    sources += [(100, 1, None), (101, 1, ""), (102, None, "w1 w2"), (103, 9, "w1"), (104, 0, "w1 " * 400)]
    claims += [(1, 50, None), (1, 51, "the of"), (1, 52, ""), (None, 53, "w1"), (2, 54, claims[0][2]), (2, 54, claims[0][2])]
    return sources, claims


@pytest.mark.parametrize("threshold", [0.01, 0.34, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("seed", [1, 2])
def test_supported_pairs(spark, seed, threshold):
    sources, claims = made(seed)
    units = containment.paragraph_tokens(spark.createDataFrame(sources, "doc int, key int, body string"), ["key", "doc"], "body")
    sets = containment.claim_tokens(spark.createDataFrame(claims, "key int, pos int, claim string"), ["key", "pos"], "claim")
    got = {(r.doc, r.para, r.pos): r.score for r in containment.supported(units, ["key", "doc", "para"], sets, ["key", "pos"], ["key"], threshold).collect()}
    want = {}
    for doc, key, body in sources:
        paras = [p for p in (body or "").split("\n\n") if p.strip()]
        if len(paras) == 1 and len(paras[0]) > 500:
            continue
        for i, p in enumerate(paras):
            for k, pos, c in claims:
                if k is not None and k == key and share(p, c) >= threshold:
                    want[doc, i, pos] = share(p, c)
    assert {k: v for k, v in got.items() if k[0] != 104} == want


def test_best_of_all_pairs(spark):
    sources, claims = made(3)
    rows = spark.createDataFrame(sources, "doc int, key int, body string").selectExpr("*", "doc as pos", "body as claim")
    got = evidence.best_paragraphs(rows.drop("pos", "claim"), spark.createDataFrame(claims, "key int, pos int, claim string"), "key", "body", ["doc"]).collect()
    assert len(got) == len(sources)
    by_key = defaultdict(list)
    for k, pos, c in claims:
        by_key[k].append((pos, c))
    for r in got:
        if r.doc == 104:
            continue
        best = ("n/a", min(by_key[r.key])[1] if r.key is not None and by_key[r.key] else "n/a", 0.0)
        for p in [p for p in (r.body or "").split("\n\n") if p.strip()]:
            for _, c in sorted(by_key[r.key], key=lambda x: x[0]) if r.key is not None else []:
                if share(p, c) > best[2]:
                    best = (p[:300], c, share(p, c))
        assert (r.paragraph, r.claim, r.score) == best
    assert evidence.best_paragraphs(rows.select("doc", "key", "body").limit(0), spark.createDataFrame(claims, "key int, pos int, claim string"), "key", "body", ["doc"]).collect() == []


def test_no_all_pairs_step(spark):
    """Sources meet claims by (key, token), and no array of claims is made."""
    sources, claims = made(4)
    df = evidence.best_paragraphs(spark.createDataFrame(sources, "doc int, key int, body string"), spark.createDataFrame(claims, "key int, pos int, claim string"), "key", "body", ["doc"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Cartesian" not in plan and "token" in plan


def test_all_pairs_of_a_session(spark, tmp_path):
    """Pairs without a common token are rows too; null texts, equal ids and empty claims as in SQL."""
    con = duckdb.connect()
    con.execute("create table documents as select * from (values (1, 'loom mill', 'src1'), (2, 'nothing alike', 'src1'), (2, 'loom', 'src1'), (3, NULL, 'src1'), (4, '', 'src1'), (5, 'loom', 'src2'), (6, 'loom', NULL)) t(doc_id, text, source)")
    con.execute("create table benchmark as select * from (values (1, 'the loom of a mill'), (21, 'the of'), (41, NULL), (61, 'cotton'), (2, 'wool')) t(item_id, text)")
    for t in ("documents", "benchmark"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    got = [(r.doc, r.claim, r.score) for r in plans.containment_pairs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(plans.ORACLES["containment_pairs"]).fetchall(), key=repr)
    assert (2, 1, 0.0) in got and len(got) == 5 * 4 + 1
