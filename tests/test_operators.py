"""Goldens of routing, query quality, gates, gaps, rollups, sources and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators import evidence, gaps, gates, queries, rollups, routing, sessions
from gleaner.sources import html, payloads


@pytest.mark.parametrize(
    ("question", "rule"),
    [
        ("Find NASA software patent license opportunities", "gov_tech_transfer"),
        ("what do the papers say", "academic_paper"),
        ("reddit", "social_sentiment"),
        ("nothing of the kind", "general_web"),
        ("How do I call it", "code_pattern"),
        ("check memory of papers and journals", "academic_paper"),
        ("billing", "general_web"),
    ],
)
def test_route(spark, question, rule):
    row = routing.route(spark.createDataFrame([(question,)], "question string")).first()
    assert row.rule == rule
    assert len(row.lanes) <= 10 and len(set(row.lanes)) == len(row.lanes)


def test_route_lanes(spark):
    rows = routing.route(spark.createDataFrame([("nasa software patent license",), ("reddit",), ("did we discuss it",)], "question string")).collect()
    assert rows[0].lanes == ["nasa_techtransfer", "github_code", "searxng_general", "exa_direct"]
    assert rows[1].lanes[:6] == ["reddit_rss", "x_pulse", "bluesky_jetstream", "hn_algolia", "searxng_forums", "youcom_direct"]
    assert rows[2].lanes == ["mentor_memory", "claude_memory_files", "obsidian", "exa_direct"]


def test_authority(spark):
    df = spark.createDataFrame([("a", "www.nytimes.com", "legal"), ("b", "sec.gov:443", "finance_filings"), ("c", "x.org", "legal"), ("d", "sec.gov", None), ("e", "notsec.gov", "finance_filings")], "k string, domain string, topic string")
    got = {r.k: r.authority for r in routing.with_authority(df, keys=["k"]).collect()}
    assert got == {"a": 0.7, "b": 1.0, "c": 0.0, "d": 0.0, "e": 0.0}


def test_slug_and_provider(spark):
    row = spark.range(1).select(routing.slug(F.lit("  What's  up, Doc? ")).alias("s"), routing.choose_provider(F.array(F.lit("arxiv"), F.lit("linkup_direct"))).alias("p"), routing.cyclic_lane(F.lit(4), ["a", "b", "c"], F.lit("z")).alias("c")).first()
    assert tuple(row) == ("what-s-up-doc", "linkup", "a")


def query(spark, q, lane="searxng_general"):
    df = queries.annotate(spark.createDataFrame([(q,)], "q string"), "q")
    df = queries.broaden(queries.repair(df, "repaired"), "q", F.lit("THIN"), "broadened")
    return df.withColumn("codes", F.transform(queries.issues(F.col("q"), F.lit(lane)), lambda i: i["code"])).first()


def test_queries(spark):
    r = query(spark, "cotton maker UK small run UK site:c")
    assert r.codes == ["TRUNCATED_OPERATOR", "DUPLICATE_TERMS"]
    assert r.repaired == "cotton maker UK small run UK"
    assert query(spark, 'find "open quote here').repaired == 'find "open quote here"'
    assert query(spark, "cotton cotton cotton manufacturer").repaired == "cotton manufacturer"
    assert query(spark, "- x").codes == ["TRUNCATED_OPERATOR", "EMPTY_OR_TRIVIAL"]
    assert query(spark, "paper site:a.org review", "arxiv").codes == ["UNSUPPORTED_OPERATOR_FOR_LANE"]
    assert query(spark, "paper site:a.org review").broadened == "paper review"
    assert query(spark, 'the "exact phrase" there').broadened == "the exact phrase there"
    assert query(spark, "one two three four five").broadened == "one two three four"
    assert query(spark, "one two").broadened is None


def test_result_quality(spark):
    def verdict(*domains):
        df = spark.createDataFrame([(1, d) for d in domains], "p int, d string")
        r = rollups.payload_domains(df, "p", "d")
        return r.select(queries.verdict(F.col("results"), F.col("domains"), F.col("top_share"), F.lit(None).cast("string")).alias("v"), "top_share").first()

    assert tuple(verdict("a", "b", "c", "a")) == ("GOOD", 0.5)
    assert tuple(verdict("a", "a", "a", "a", "a", "b")) == ("THIN", 5 / 6)
    assert tuple(verdict(None, None, None)) == ("THIN", 1.0)


def test_retry_winner(spark):
    def wins(*v):
        return spark.range(1).select(queries.second_wins(*[F.lit(x) for x in v]).alias("w")).first().w

    assert wins("THIN", 9, 1, 1.0, "GOOD", 4, 3, 0.5)
    assert wins("GOOD", 5, 2, 0.6, "GOOD", 4, 3, 0.6)
    assert not wins("GOOD", 4, 2, 0.5, "GOOD", 4, 2, 0.5)


def test_confidence(spark):
    row = spark.range(1).select(
        evidence.session_confidence(F.lit(2), F.lit(0.5), F.lit(0.4), F.lit(1.0)).alias("s"),
        evidence.grounding_confidence(F.lit(2), F.lit(0.2)).alias("a"),
        evidence.grounding_confidence(F.lit(2), F.lit(0.9)).alias("b"),
        evidence.decision(F.lit(0.2)).alias("d"),
        evidence.decision(F.lit(0.6), F.lit(0.5), F.lit(0.3), F.lit(0.3)).alias("e"),
        evidence.decision(F.lit(None).cast("double")).alias("f"),
        evidence.decision(F.lit(0.4), None, F.lit(0.5), F.lit(0.3)).alias("g"),
    ).first()
    assert row.s == pytest.approx(2 / 3 * 0.2 + 0.15 + 0.12 + 0.2)
    assert row.a == pytest.approx(0.38666666666666666) and row.b == pytest.approx(0.8066666666666666)
    assert tuple(row.d)[:3] == ("abstain", "weak_sources", 0.0) and row.d.open_question.startswith("Measured confidence 0.20 stayed below")
    assert tuple(row.e) == ("full", "complete", 0.6, None)
    assert row.f.kind == "abstain" and "could not be measured" in row.f.open_question
    # Between the abstention's limit and the partial one an answer is partial.
    assert row.g.kind == "partial"


def test_two_places(spark):
    values = [i / 1000 for i in range(1001)] + [i / 64 for i in range(65)] + [0.015, 0.035, 0.145, 0.285, 0.575]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.v: r.t for r in df.select("v", evidence.two_places(F.col("v")).alias("t")).collect()} == {v: f"{v:.2f}" for v in values}


def test_best_paragraphs(spark):
    sources = spark.createDataFrame([(1, "s", "Nothing here at all.\n\nThe mill spins organic cotton daily."), (2, "s", ""), (3, "s", "zebra"), (4, "t", "The mill spins cotton"), (5, "s", None)], "doc int, session string, text string")
    claims = spark.createDataFrame([("s", 1, "mill spins organic cotton"), ("s", 0, "unrelated claim words")], "session string, pos int, claim string")
    got = {r.doc: (r.paragraph, r.claim, r.score) for r in evidence.best_paragraphs(sources, claims, "session", "text", ["doc"]).collect()}
    none = ("n/a", "unrelated claim words", 0.0)
    assert got == {1: ("The mill spins organic cotton daily.", "mill spins organic cotton", 1.0), 2: none, 3: none, 4: ("n/a", "n/a", 0.0), 5: none}


def test_evidence_gate_fails_closed(spark):
    rows = [(k, s, "a", c, v, n) for k in ("full", None) for s in ("complete", "in_progress", None) for c in (0.8, None) for v in ("sufficient", "partial", "exhausted", "odd", None) for n in (0, 2)]
    df = spark.createDataFrame(rows, "kind string, status string, answer string, confidence double, judged string, sources int")
    for r in df.select("*", gates.evidence_gate(*[F.col(c) for c in df.columns]).alias("g")).collect():
        if r.status != "complete":
            assert (r.g.kind, r.g.reason) == (r.kind, "not_applicable")
        elif r.sources == 0 or r.judged not in ("sufficient", "partial"):
            assert (r.g.kind, r.g.status, r.g.answer, r.g.confidence) == ("abstain", "insufficient_evidence", None, 0.0)
        elif r.judged == "partial":
            assert (r.g.kind, r.g.status, r.g.confidence) == ("partial", "weak_sources", 0.5 if r.confidence else 0.0)
        else:
            assert (r.g.kind, r.g.confidence, r.g.reason) == (r.kind, r.confidence, "passed")


def test_phrases_failures_and_titles(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    vague = lambda x, n=1: one(evidence.ambiguous_phrase(F.lit(x), F.lit(n)))
    assert [vague(x) for x in ("mercury", "the cat of paris", "c++ and re-use", "latest cat", "how now", "Cat", "cat 5", "a b c d e f", "of the")] == [True, True, True, False, False, False, False, False, False]
    assert not vague("mercury", 2)
    failed = lambda x: one(gates.failed_run(F.lit(x).cast("string")))
    assert [failed(x) for x in (None, " ", "Error: no", "invalid_grant", "No response received", "The study failed to replicate")] == [True, True, True, True, True, False]
    mark = lambda t, tier=2: one(gates.tier_one_title(F.lit(t), F.lit(True), F.lit(tier)))
    assert [mark("T"), mark("[NON-T1] T"), mark("T", 1)] == ["[NON-T1] T", "[NON-T1] T", "T"]
    out = one(gates.backend_output(F.lit("x ANSWER: NOT_FOUND\nSOURCES: https://a.b/c).")))
    assert (out.answer, out.urls) == ("", ["https://a.b/c"])


def test_judge(spark):
    one = lambda *a: tuple(spark.range(1).select(gates.judge(*[F.lit(x).cast("string") if i < 2 else F.lit(x) for i, x in enumerate(a)]).alias("v")).first().v)
    assert one("Sufficient ", None, False, False) == ("sufficient", "primary", None)
    assert one("eh", "partial", False, False) == ("partial", "fallback", None)
    assert one("eh", None, False, False) == ("insufficient", "failed-closed", "checker_failed_closed")
    assert one("sufficient", None, True, False)[0] == "insufficient"
    assert one("sufficient", None, False, True) == ("insufficient", "primary", "ambiguous_phrase")


def test_claim_gate(spark):
    gate = lambda t: spark.range(1).select(gates.gate_claims(F.lit(t)).alias("g")).first().g
    kept = 'The product was released in 2024 (https://x.org/a).'
    assert gate(kept).text == kept
    g = gate("It likely shipped last year to customers.\n" + kept)
    assert g.dropped == 1 and g.text == kept and g.flags[0].startswith("hedging_without_source+missing_source: ")
    assert gate("The company makes good things").dropped == 0
    assert gate("# It is a heading of four words\n").dropped == 0


def plain_tokens(text):
    """(type, token) of a text by a plain loop: sections, quotes, dates, numbers."""
    lines, skip = [], False
    for line in re.split(r"\r\n|\n|\r", text):
        s = line.strip(" ")
        if s.startswith("#") or (s.endswith(":") and len(s) <= 80):
            skip = any(m in s.lstrip("#").strip(" ").lower() for m in gates.UNCERTAIN)
        if not skip:
            lines.append(line)
    text, out = "\n".join(lines), []
    for m in re.finditer(r'"([^"\n]{3,240})"', text.translate(str.maketrans("“”‘’", "\"\"''"))):
        out.append(("quote", m[1].strip(" ")))
    for d in gates.DATES:
        out += [("date", m[0].strip(" ")) for m in re.finditer(d.replace("U)", ")").replace("(?)", ""), text)]
    for m in re.finditer(gates.NUMBER.replace("(?iU)", "(?i)"), text):
        bare = m[0].strip(" ").lstrip("$€£").strip(" ")
        if len(bare) == 1 and bare.isdigit():
            before, after = text[: m.start()], text[m.end() :]
            if (re.search(r"(?:^|\n)[ ]{0,3}$", before) and after.startswith(".")) or (before.endswith("(") and after.startswith(")")):
                continue
        out.append(("number", m[0].strip(" ")))
    return sorted(set(t for t in out if t[1]))


def test_verbatim(spark):
    rng = random.Random(8)
    bits = ["Version 42.5", " cost $1,200", " on June 2, 2026", " 2024-01-02", ": “to be or not”.", "\n1. first", " (2)", "(3 things)", "\n# Open questions\n", "\nCaveats:\n", "\n## Facts\n", " 5 million", " 3/4/2024", "x7", " 12 May", '"ab"', '"abc"', " 100%", "é9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: sorted({(x.type, x.token) for x in r.v}) for r in df.select("i", gates.verbatim_tokens(F.col("t")).alias("v")).collect()}
    assert got == {i: plain_tokens(t) for i, t in enumerate(texts)}


def test_verbatim_check_and_audit(spark):
    answers = spark.createDataFrame([(1, 'It has 42 looms and "a long quote" of 1990. It has 42 looms and "a long quote" of 1990.'), (2, "no tokens"), (3, "made 77 and 78")], "k int, answer string")
    sources = spark.createDataFrame([(1, "The mill had 42  looms; A LONG\nquote"), (1, None), (3, "only 77")], "k int, body string")
    checked = gates.verbatim_check(answers, sources, "k", "answer", "body")
    got = {r.k: (r.checked, r.supported, [u.token for u in r.unsupported], r.pass_rate) for r in checked.collect()}
    assert got == {1: (3, 2, ["1990"], 0.6667), 2: (0, 0, [], 1.0), 3: (2, 1, ["78"], 0.5)}
    models = spark.createDataFrame([(1, "m"), (1, "m"), (3, "m"), (3, "n")], "k int, model string")
    flagged = {r.k: (r.flagged, [tuple(c) for c in r.claims]) for r in gates.audit(checked, models, "k", "model").collect()}
    assert flagged == {1: (True, [("1990", "m", "verbatim")]), 2: (False, []), 3: (True, [("78", "unknown", "verbatim")])}


def test_gaps(spark):
    c = spark.createDataFrame([(1, "x", 1, True), (1, "x", 2, False), (1, "y", 1, False), (1, "y", 1, False)], "session int, claim string, source int, passed boolean")
    assert [r.topic for r in gaps.single_source_claims(c).collect()] == ["single-source claim about y"]
    assert gaps.weak_pool(c).count() == 1
    s = spark.createDataFrame([(1, 0, 0.0, ["arxiv"]), (2, 3, 0.0, ["arxiv"]), (3, 0, 2.0, None), (4, 0, 0.0, None)], "session int, loops int, cost double, lanes array<string>")
    counter = gaps.no_counter_evidence(s, c.withColumn("counter", F.col("source") == 2), s.filter("session = 3"))
    assert sorted((r.session, r.reason) for r in counter.collect()) == [(2, "no counter-evidence"), (4, "no counter-evidence")]
    dated = spark.createDataFrame([(1, "d.org", "T", "2023"), (1, "e.org", "U", "2024-01-14"), (1, "f.org", "V", "soon"), (2, "g.org", "W", "2020")], "session int, domain string, title string, published string")
    stale = gaps.stale_sources(dated, "2024-01-15", F.when(F.col("session") == 1, 72))
    assert [(r.topic, r.reason) for r in stale.collect()] == [("stale source d.org: T", "stale data")]
    picked = spark.range(1).select(gaps.lanes_for(F.array(F.lit("no counter-evidence"), F.lit("stale data")), F.array(F.lit("arxiv")), 4).alias("l")).first().l
    assert picked == ["reddit_failures", "searxng_forums", "arxiv", "x_pulse"]
    out = {r.session: r.reason for r in gaps.decide(s, gaps.all_gaps(gaps.single_source_claims(c), gaps.weak_pool(c)), ["high"]).collect()}
    assert out[1] == "triggering gaps detected: single-source claim, weak source pool"
    assert out[2] == "max loops reached" and out[3] == "cost cap hit"


def test_recovery_loop(spark):
    rows = [
        (1, 0, "partial", "q", "f"), (1, 1, "sufficient", "r", "g"), (1, 2, "partial", "s", "h"),
        (2, 0, "partial", "q", "f"), (2, 1, "sufficient", "q", "g"),
        (3, 0, "insufficient", "q", "f"), (3, 1, "partial", "r", "f"),
        (4, 0, "partial", "q", "f"),
        (5, 0, "insufficient", "q", "f"), (5, 1, "partial", "r", "g"), (5, 2, "insufficient", "s", "h"), (5, 3, "sufficient", "t", "i"),
        (6, 0, "partial", "q", "f"), (6, 1, "sufficient", None, "g"),
    ]
    df = spark.createDataFrame(rows, "k int, pos int, verdict string, query string, fingerprint string")
    got = {r.k: (r.terminal, r.stopped, r["at"]) for r in gates.terminal(df, "k").collect()}
    assert got == {1: ("sufficient", "sufficient", 1), 2: ("partial", "reformulation_repeated", 1), 3: ("exhausted", "same_items", 1), 4: ("partial", "no_retriever", 0), 5: ("exhausted", "max_recovery_iterations", 2), 6: ("partial", "reformulation_failed", 1)}


def test_recovery_stops_at_much_the_same_sources(spark):
    old = [f"s{i}" for i in range(10)]
    rows = [(k, pos, "partial", f"q{pos}", f"f{pos}", items) for k, new in enumerate([old[:8] + ["x", "y"], old[:7] + ["x", "y", "z"], [], old + ["x", "y"], old + old]) for pos, items in ((0, old), (1, new))]
    rows += [(9, 0, "partial", "q", "f", []), (9, 1, "sufficient", "r", "g", [])]
    df = spark.createDataFrame(rows, "k int, pos int, verdict string, query string, fingerprint string, items array<string>")
    got = {r.k: r.stopped for r in gates.terminal(df, "k").collect()}
    assert got == {0: "same_items", 1: "no_retriever", 2: "no_retriever", 3: "same_items", 4: "same_items", 9: "same_items"}


@pytest.mark.parametrize(("n", "buffer"), [(0, 0), (2, 0), (999, 0), (1000, 0), (1000, 1 << 18)])
def test_medians(spark, n, buffer):
    rng = random.Random(n)
    pick = [lambda: rng.gauss(0, 1), lambda: rng.choice([1.0, 2.0]), lambda: 10.0 ** rng.randrange(-300, 300), lambda: rng.choice([float("inf"), float("-inf"), 0.0, 5.0, float("nan")]), lambda: rng.randrange(10**15)]
    rows = [(k if k else None, float(pick[k]())) for k in range(5) for _ in range(n)] + [(1, None)] * 3
    got = {r.k: r.median for r in rollups.medians(spark.createDataFrame(rows, "k int, v double"), "k", "v", buffer, 64).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        vs = sorted(float("inf") if v != v else v for q, v in rows if q == k and v is not None)
        want[k] = (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2
    assert got == pytest.approx(want, rel=1e-15)


def test_journal_paths_and_page_suffixes(spark):
    from gleaner.functions import urls
    from gleaner.operators import assembly

    asked = {"https://www.mdpi.com/2072-666X/9/3/125/pdf": ("journal", "2072-666X 9 3 125"), "https://www.mdpi.com/2072-666X/9/3/s125": None, "https://doi.org/10.1234/ab}": ("doi", "10.1234/ab")}
    df = spark.createDataFrame([(u,) for u in asked], "u string").select("u", urls.doi_route(F.col("u")).alias("d"))
    assert {r.u: r.d and tuple(r.d) for r in df.collect()} == asked
    engines = spark.createDataFrame([(s,) for s in (".xhtml", ".HTM", ".md")], "s string").select("s", assembly.document_engines(F.lit(None).cast("string"), F.col("s"), F.lit(False)).alias("e"))
    assert {r.s: r.e for r in engines.collect()} == {".xhtml": [], ".HTM": [], ".md": ["unstructured"]}


def test_similar_pairs(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i % 3, i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, t string")
    sets = {i: set(t.split()) for _, i, t in rows}

    def ratio(a, b):
        least, most, both = sorted((len(a), len(b)))[0], max(len(a), len(b)), len(a & b)
        return 0 if not least else least / most if both == least else both / len(a | b)

    for least in (0.2, 0.5, 0.86):
        want = {(k, i, j): ratio(sets[i], sets[j]) for k, i, _ in rows for l, j, _ in rows if k == l and i < j and ratio(sets[i], sets[j]) >= least}
        assert {(r.k, r.a, r.b): r.similarity for r in gaps.similar_pairs(df, "k", "i", "t", least).collect()} == pytest.approx(want)


def test_greedy_dedupe(spark):
    q = F.array(*map(F.lit, ["red green blue", "red green blue", "red green", "one two three", "blue green red now"]))
    kept = spark.range(1).select(gaps.dedupe_questions(q, 3, 0.86).alias("k")).first().k
    assert kept == ["red green blue", "red green", "one two three"]


def test_budget_of_texts(spark):
    df = spark.createDataFrame([("s", i, "x" * n) for i, n in enumerate([20_000, 12_000, 30_000, 12_000, 11_000, 11_000])], "k string, i int, t string")
    got = [r.clip for r in evidence.cap_texts(df, "k", "i", "t").orderBy("i").collect()]
    assert got == [12_000, 12_000, 12_000, 12_000, 11_000, 1_000]


def test_breaker(spark):
    rows = [("u", i, f"2024-01-01 00:{i:02d}:00", ok) for i, ok in enumerate([False, False, False, False, True, False, False])]
    df = spark.createDataFrame(rows, "u string, i int, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [(r.failures, r.open) for r in rollups.breaker(df, "u", "ts", "i", "ok").orderBy("i").collect()]
    assert got == [(0, False), (1, False), (2, False), (3, True), (4, True), (0, False), (1, False)]
    # Three failures that are hours apart open it as well, until an hour after the last.
    rows = [("u", i, t, ok) for i, (t, ok) in enumerate([("2024-01-01 00:00:00", False), ("2024-01-01 05:00:00", False), ("2024-01-01 10:00:00", False), ("2024-01-01 10:59:59", True), ("2024-01-01 12:00:00", True)])]
    df = spark.createDataFrame(rows, "u string, i int, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.open for r in rollups.breaker(df, "u", "ts", "i", "ok").orderBy("i").collect()] == [False, False, False, True, False]


def test_sessions(spark):
    s = spark.createDataFrame([("a", "complete", "full", "", 0.5), ("b", "abstain", "abstain", None, 0.0)], "session string, status string, kind string, answer string, confidence double")
    assert [tuple(r) for r in sessions.violations(s).collect()] == [("a", "complete_without_answer")]


def test_payloads(spark):
    get = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert get(payloads.quote(F.lit("a b~c*d/é"))) == "a%20b~c%2Ad%2F%C3%A9"
    assert len(get(payloads.items(F.lit('{"hits": [{"title": "a"}, {"title": "b"}]}')))) == 2
    ids = get(payloads.items(F.lit('{"esearchresult": {"idlist": ["7"]}}')))
    assert '"url":"https://pubmed.ncbi.nlm.nih.gov/7/"' in ids[0]
    assert get(payloads.item_url(F.lit('{"objectID": "9"}'), F.lit("hn_algolia"))) == "https://news.ycombinator.com/item?id=9"
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>T</title><link href='http://x'/><author><name>/u/me</name></author></entry></feed>"
    assert [tuple(r) for r in get(payloads.atom(F.lit(feed)))] == [("T", "http://x", "me")]
    mixed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A</title><link href='a'/></entry><entry><title>B</title></entry><entry><title>C</title><link rel='x' href='c'/><author><name>/u/you</name></author></entry></feed>"
    assert [tuple(r) for r in get(payloads.atom(F.lit(mixed)))] == [("A", "a", None), ("C", "c", "you")]
    assert get(payloads.auth_kind(F.lit("env:KEY"))) == "env"


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nbroken\n[1]\n{"a": 2}\n')
    assert payloads.rejected_lines(spark, str(tmp_path)).first().asDict() == {"kept": 2, "rejected": 2}


def test_html(spark):
    page = "<html><head><title> A &amp;\n B </title><script>var x = '</p>';</script></head><body><nav>menu</nav><p>One <b>two<p>three</body></html>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    rows = html.with_text(df).select(html.title(F.col("html")).alias("t"), "text").collect()
    assert rows[0].t == "A & B" and rows[0].text == "One two\nthree"
    assert rows[1].text == "" and rows[2].text == ""


def test_character_references(spark):
    import html as std
    from html.entities import html5

    texts = [f"a &{name} b" for name in html5 if name.endswith(";")] + ["&#233;&#xe9;&#128512; &amp;lt; & &; &nosuch; &#x110000; &#0; &#xD800; &#; x&amp", "plain", "", None, "&lt;&lt;&gt;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", html.unescaped(F.col("x")).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    # A name without its semicolon stays.
    assert got == {i: None if t is None else std.unescape(t) if not t.endswith("x&amp") else std.unescape(t[:-4]) + "&amp" for i, t in enumerate(texts)}


def test_local_lanes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Nothing here.\n\nThe mill spins organic cotton.")
    (tmp_path / "b.txt").write_text("cotton only")
    (tmp_path / "c.txt").write_text("  ")
    asked = spark.createDataFrame([(1, "who spins organic cotton"), (2, "zebra crossing")], "question_id int, question string")
    got = payloads.file_results(payloads.local_files(spark, str(tmp_path / "*.txt")), asked).orderBy("question_id", F.desc("score")).collect()
    assert [(r.question_id, r.path[-5:], r.snippet) for r in got] == [(1, "a.txt", "The mill spins organic cotton."), (1, "b.txt", "cotton only")]
    records = [(i, "p", "t", "organic cotton" if i % 2 else "other", f"2024-01-{i:02d}", i == 3) for i in range(1, 10)]
    memory = spark.createDataFrame(records, "id int, project string, topic string, content string, created_at string, stale boolean")
    assert [r.id for r in payloads.memory_results(memory, asked, scan=4).orderBy("id").collect()] == [7, 9]


def test_request(spark):
    made = payloads.request(F.lit("http://h/{query}?t={token}"), {"query": F.lit("a b"), "token": F.lit("x/y")}, {"A": "env:SET", "B": "env:NOT", "C": "plain"}, {"SET": "v"}, F.lit('{"q": "{query}"}'))
    r = spark.range(1).select(made.alias("r")).first().r
    assert (r.url, r.headers, r.body) == ("http://h/a%20b?t=x%2Fy", {"A": "v", "C": "plain"}, '{"q": "a b"}')


def test_sessions_saved_and_read(spark, tmp_path):
    """What the gate and the interlock let pass is written by day and read back; the rest is handed back."""
    runs = [("scout", True, "pro-1")]
    rows = [(1, "full", "complete", "a", 0.9, "sufficient", 2, "research", runs), (2, "full", "complete", "a", 0.9, "odd", 2, "research", runs), (3, "full", "complete", "a", 0.9, "sufficient", 2, "research", [("scout", False, "pro-1")]), (4, "full", "complete", " ", 0.9, "sufficient", 1, "search", [])]
    schema = "session int, kind string, status string, answer string, confidence double, judged string, sources int, protocol string, runs array<struct<role:string,ok:boolean,model:string>>"
    df = spark.createDataFrame(rows, schema).withColumn("created", F.lit("2024-02-03 04:05:06").cast("timestamp_ntz"))
    path = str(tmp_path / "sessions")
    rest = sessions.save(df, path, "created", ["pro-1"])
    assert {r.session: r.problem for r in rest.collect()} == {3: "model_interlock", 4: "complete_without_answer"}
    (tmp_path / "sessions" / "created_date=2024-02-03" / "s.evidence-gate-decision.json").write_text('{"session": 9}')
    back = sessions.load(spark, path, "session int, kind string, answer string, confidence double")
    assert {tuple(r) for r in back.collect()} == {(1, "full", "a", 0.9), (2, "abstain", None, 0.0)}
    known = sessions.gate_decisions(df, "session")
    assert {r.session: (r.reason, r.overridden) for r in known.collect()}[2] == ("sufficiency_exhausted", True)


def test_page_meta(spark):
    page = """<head><title>T</title><META name='twitter:title' content='Tw'><meta property="og:title" content="Og &amp; x"><meta content="2024-05-06T07:08" property="article:published_time"></head>"""
    rows = spark.createDataFrame([(page,), ("<title> Only </title>",), ("",)], "p string").select(html.meta(F.col("p")).alias("m")).collect()
    assert tuple(rows[0].m) == ("Og & x", None, "2024-05-06T07:08")
    assert tuple(rows[1].m) == ("Only", None, None) and tuple(rows[2].m) == ("", None, None)
