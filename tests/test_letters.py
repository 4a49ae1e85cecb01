"""E-22's query: a document's first letters without a pass over the rest of it."""

import duckdb

from gleaner.plans import documents


def test_first_letters(spark, tmp_path):
    texts = ["", None, "a b", "1\n2é\t", "x1" * 60, "\n\n" + "Ab 9😀" * 30, "abc" * 20 + "é" * 5000, "9" * 5000 + "tail", "a" * 39 + "\r\n" + "b" * 5]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    con.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    df = documents.redacted_paths(spark, str(tmp_path))
    assert "regexp_replace(text" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = dict(map(tuple, df.collect()))
    assert got == dict(con.execute(documents.ORACLES["redacted_paths"]).fetchall())
