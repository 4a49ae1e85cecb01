"""G-19: the tokens of an answer are taken out of it once."""

from gleaner.operators import gates


def test_tokens_are_found_once(spark):
    """No pattern runs again where tokens are looked up and judged."""
    df = spark.createDataFrame([(1, 'A "long quote" of 42 looms on June 2, 2021, 7% more'), (2, None), (3, "none")], "k int, a string")
    out = gates.verbatim_check(df, spark.createDataFrame([(1, "the 42 looms"), (1, "a LONG  quote")], "k int, b string"), "k", "a", "b")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    got = {r.k: (r.checked, r.supported, sorted(u.token for u in r.unsupported)) for r in out.collect()}
    # "2" is within "42".
    assert got == {1: (6, 3, ["2021", "7%", "June 2, 2021"]), 2: (0, 0, []), 3: (0, 0, [])}
