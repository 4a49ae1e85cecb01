"""A-12: what files share with questions is counted where the file is."""

from gleaner.sources import payloads


def test_files_are_dealt_once(spark, tmp_path):
    """No exchange is by paragraph; ties go by path."""
    files = spark.createDataFrame([(i, f"loom mill w{i % 4}\n\ncotton w{i}") for i in range(40)] + [(99, None), (98, " ")], "path long, content string")
    asked = spark.createDataFrame([(1, "w3 loom"), (2, "cotton"), (3, "the of"), (4, None)], "question_id int, question string")
    for name, rows in (("files", files), ("asked", asked)):
        rows.write.parquet(f"{tmp_path}/{name}")
    files, asked = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("files", "asked"))
    df = payloads.file_results(files, asked)
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "hashpartitioning(path" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(" in x and ", para" in x]
    got = [(r.question_id, r.path, r.score) for r in df.collect()]
    assert sorted(got) == [(1, p, 1.0) for p in (3, 7, 11, 15, 19)] + [(2, p, 1.0) for p in range(5)]
