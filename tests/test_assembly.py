from pyspark.sql import functions as F

from gleaner.operators import assembly


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_claims(spark):
    answer = "# Findings\nThe mill has made organic cotton since 1990 [1]\nUncited line about cotton mills there\n| Company | Small runs? |\n|---|---|\n| Acme Mills Ltd | yes from fifty pieces [2] |\n\n# Next action\nWrite to the mill about cotton prices"
    rows = assembly.with_claims(spark.createDataFrame([(answer,), ("Short one.",), (None,)], "a string"), "a").collect()
    assert rows[0].claims == ["The mill has made organic cotton since 1990 [1]", "Acme Mills Ltd Small runs yes from fifty pieces [2]"]
    assert rows[1].claims == ["Short one."] and rows[2].claims == []


def test_paths(spark):
    red = lambda s: one(spark, assembly.redact_paths(F.lit(s)))
    assert red("see /home/me/notes/a.txt now") == "see <path>/a.txt now"
    assert red("at https://x.org/a/b/c.html") == "at https://x.org/a/b/c.html"
    assert red(red("see /home/me/notes/a.txt")) == "see <path>/a.txt"


def test_routes(spark):
    route = lambda u, t=None: one(spark, assembly.reader_route(F.lit(u), F.lit(t).cast("string")))
    urls = [("https://a.org/x.pdf", None), ("https://a.org/x.pdf", "text/html"), ("https://a.org/x", "application/pdf; q"), ("https://a.org/x.docx", "text/html"), ("https://a.org/x", "image/png"), ("https://github.com/a/b", None), ("https://www.tiktok.com/@x", None), ("https://a.org", None)]
    assert [route(*u) for u in urls] == ["maybe_pdf", "maybe_pdf", "document", "document", "document", "repository", "social", "web"]
    assert one(spark, assembly.web_ladder(F.lit(3), F.lit(True)))[-3:] == ["agent_browser", "publisher_oa", "wayback"]
    assert one(spark, assembly.web_ladder(F.lit(1), F.lit(None).cast("boolean"))) == [*assembly.RUNGS, "wayback"]
    assert one(spark, assembly.protocol(F.lit("deep-research"))) == "deep_research"
    assert one(spark, assembly.is_block(F.lit(451), F.lit(False), F.lit(False)))


def test_spread(spark):
    rows = [(q, i, d) for q, ds in ((1, "aaab"), (2, "aaaba"), (3, "aaa"), (4, "a")) for i, d in enumerate(ds)]
    got = {}
    for r in assembly.spread(spark.createDataFrame(rows, "q int, pos int, d string"), "q", "pos", "d").orderBy("q", "spread").collect():
        got.setdefault(r.q, []).append(r.pos)
    assert got == {1: [0, 1, 3, 2], 2: [0, 1, 3, 2, 4], 3: [0, 1, 2], 4: [0]}


def test_save_decision(spark):
    rows = [(1, 0, "scout", True, "s"), (1, 1, "final", False, "f"), (1, 2, "fallback", True, "b"), (2, 0, "scout", False, "s"), (2, 1, "final", True, "f"), (3, 0, "scout", True, "s")]
    df = spark.createDataFrame(rows, "k int, pos int, kind string, ok boolean, answer string")
    got = {r.k: (r.decision, r.answer, r.bypass_gate) for r in assembly.save_decision(df, "k").collect()}
    assert got == {1: ("fallback", "b", False), 2: ("abstain", None, True), 3: ("abstain", None, True)}


def test_assemble(spark):
    rows = [(1, 0, "worker", True, "w", ["u", "v"]), (1, 1, "final", True, "f", ["v", "x"]), (2, 0, "worker", False, "w", ["u"]), (3, 0, "final", True, "f", [])]
    df = spark.createDataFrame(rows, "s int, pos int, kind string, ok boolean, answer string, sources array<string>")
    got = {r.s: (r.answer, r.sources, r.status) for r in assembly.assemble(df, "s").collect()}
    assert got == {1: ("f", ["u", "v", "x"], "complete"), 2: (None, ["u"], "abstain"), 3: (None, [], "abstain")}


def test_leases(spark):
    rows = [("2024-01-01 10:00:00", "used"), ("2024-01-01 11:50:00", "leased"), ("2024-01-01 10:50:00", "leased"), ("2023-12-31 11:59:00", "used")]
    log = spark.createDataFrame(rows, "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert tuple(assembly.live_leases(log, "2024-01-01", "2024-01-01 12:00:00", cap=2).first()) == (1, 1, False)
