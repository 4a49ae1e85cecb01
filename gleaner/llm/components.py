"""Connected components of an edge table, distributed.

Union-find by label propagation with pointer jumping: each round every node
takes the smallest label among its own and its neighbours', then the label of
that label.  Each round is written to the workspace, so the plan stays short
and nothing but one changed-rows count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``edges(a, b)`` to ``(id, comp)``: comp is the smallest id reachable.

    Ids are longs without nulls.  Loops and repeated edges are allowed; no
    edges give no rows.
    """
    both = ws.save(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = ws.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("comp").alias("up"))
        step = step.join(up, "new").select("id", F.least("new", "up").alias("comp"), (F.least("new", "up") < F.col("comp")).alias("moved"))
        step = ws.save(step, "labels")
        moved = step.filter("moved").limit(1).count()
        ws.drop(labels)
        labels = step
        if not moved:
            ws.drop(both)
            return labels.select("id", "comp")
