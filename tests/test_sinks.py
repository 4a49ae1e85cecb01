"""A sink that takes a batch once and loses none."""

import pytest
from pyspark.sql import functions as F

from gleaner.sources.stages import shared_folder
from gleaner.streaming import sinks


def rows(spark, path):
    return sorted(r.i for r in sinks.read(spark, path, "i int").collect())


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    out, kept = str(tmp_path / "out"), str(tmp_path / "kept")
    take = sinks.once(out, kept)
    first, second = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(3,)], "i int")
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        take(batch, number)
    assert rows(spark, out) == [1, 2, 3] and rows(spark, kept) == []


def test_a_failing_path_loses_nothing(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    out, kept = str(tmp_path / "file" / "out"), str(tmp_path / "kept")
    batch = spark.createDataFrame([(1,), (2,)], "i int")
    sinks.once(out, kept)(batch, 7)
    sinks.once(out, kept)(batch, 7)
    assert rows(spark, kept) == [1, 2]

    good = str(tmp_path / "good")
    broken = sinks.once(good, kept, lambda df: df.select(F.raise_error(F.lit("gate")).cast("int").alias("i")))
    broken(batch, 8)
    assert rows(spark, kept) == [1, 1, 2, 2] and rows(spark, good) == []
    # Once it can be written, it is no longer kept aside.
    sinks.once(good, kept)(batch, 8)
    assert rows(spark, kept) == [1, 2] and rows(spark, good) == [1, 2]

    # Where nothing can be written, the query fails and keeps its place.
    with pytest.raises(Exception):  # noqa: B017
        sinks.once(out, str(tmp_path / "file" / "kept"))(batch, 9)


def test_no_local_folder_on_a_cluster():
    assert shared_folder("yarn", "hdfs://x/c/", "file:/w") == "hdfs://x/c" and shared_folder("local[4]", None, "file:/w") is None
    assert shared_folder("yarn", None, "hdfs://x/w/") == "hdfs://x/w/_gleaner"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder("spark://m:7077", None, warehouse)
