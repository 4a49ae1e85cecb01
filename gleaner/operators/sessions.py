"""B, F-04, F-05, F-10, A-16: keeping sessions, and queries for what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """F-04: rows whose parent is missing."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def dangling(refs: DataFrame, ids: DataFrame, key: str, array: str, id_col: str) -> DataFrame:
    """F-05: (key, ref) of references in an array column that name nothing."""
    return refs.select(key, F.explode(array).alias(id_col)).join(ids.select(id_col), id_col, "left_anti").select(key, id_col).distinct()


def contract() -> dict:
    """The rules of sessions(status, kind, answer, confidence), by what breaks them."""
    return {
        "complete_without_answer": (F.col("status") == "complete") & (F.trim(F.coalesce("answer", F.lit(""))) == ""),
        "abstain_complete": (F.col("kind") == "abstain") & (F.col("status") == "complete"),
        "confidence_range": ~F.col("confidence").between(0, 1),
        "abstain_confidence": (F.col("kind") == "abstain") & (F.col("confidence") != 0),
    }


def violations(sessions: DataFrame) -> DataFrame:
    """Contract of sessions(session, status, kind, answer, confidence): one row per broken rule; none means valid."""
    broken = F.array_compact(F.array(*[F.when(cond, name) for name, cond in contract().items()]))
    return sessions.select("session", F.explode(broken).alias("rule"))


def new_rows(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """F-10, L-01: rows not known yet, one of each key."""
    return rows.join(known.select(key), key, "left_anti").dropDuplicates([key])


def index(sessions: DataFrame, created: str, key: str, since: str | None = None, until: str | None = None, limit: int = 100, protocol: str | None = None, status: str | None = None) -> DataFrame:
    """A-16: the newest sessions of a period, of a protocol and status if they are given."""
    out = sessions
    if since:
        out = out.filter(F.col(created) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        out = out.filter(F.col(created) < F.lit(until).cast("timestamp_ntz"))
    if protocol:
        out = out.filter(F.col("protocol") == protocol)
    if status:
        out = out.filter(F.col("status") == status)
    return out.orderBy(F.desc(created), F.desc(key)).limit(limit)


def gated(sessions: DataFrame) -> DataFrame:
    """B-01: sessions(kind, status, answer, confidence, judged, sources, ...) as the evidence gate leaves them, with what it decided in ``gate``."""
    from . import gates

    out = sessions.withColumn("gate", gates.evidence_gate(*[F.col(c) for c in ("kind", "status", "answer", "confidence", "judged", "sources")]))
    return out.select(*[F.col(f"gate.{c}").alias(c) if c in ("kind", "status", "answer", "confidence") else F.col(f"`{c}`") for c in sessions.columns], "gate")


def ready(sessions: DataFrame, allowed: list[str]) -> DataFrame:
    """B-01: gated sessions(protocol, runs, ...) with ``problem``: what forbids to save them (the model interlock, then the contract), null if nothing does."""
    from . import gates

    rules = contract()
    problem = F.coalesce(F.when(~gates.interlock(F.col("protocol"), F.col("status"), F.col("runs"), allowed), "model_interlock"), *[F.when(cond, name) for name, cond in rules.items()])
    return gated(sessions).withColumn("problem", problem)


def save(sessions: DataFrame, path: str, created: str, allowed: list[str] | None = None) -> DataFrame:
    """B-01, B-02: append by day, as JSON documents, what the gate and the interlock let pass (``allowed`` None: sessions that are judged already); returns the rest, which is kept as it was."""
    if allowed is None:
        good, bad = sessions, sessions.limit(0)
    else:
        checked = ready(sessions, allowed)
        good, bad = checked.filter("problem is null").drop("problem"), checked.filter("problem is not null")
    good.withColumn("created_date", F.to_date(created)).write.mode("append").partitionBy("created_date").json(path)
    return bad


def gate_decisions(sessions: DataFrame, key: str) -> DataFrame:
    """B-04: one row per session that the gate was applied to: what it was and what it became, as JSON."""
    out = gated(sessions).filter("gate.reason <> 'not_applicable'").select(key, F.col("gate.reason").alias("reason"), F.to_json("gate").alias("after"))
    return out.join(sessions.select(key, F.col("kind").alias("kind_before"), F.col("status").alias("status_before")), key).withColumn("overridden", F.col("reason").isin("empty_evidence_pool", "sufficiency_exhausted"))


def load(spark, path: str, schema) -> DataFrame:
    """A-15: all session documents of a tree, however deep; sidecars of the gate are skipped."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path).filter(~F.col("_metadata.file_name").contains("evidence-gate-decision"))


def soft_delete(sessions: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """B-03: a flag in place of removal."""
    return sessions.join(ids.select(key).distinct().withColumn("deleted", F.lit(True)), key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def to_csv_cells(df: DataFrame) -> DataFrame:
    """B-06: arrays of strings joined by ``;``, other nested cells as JSON."""
    cells = []
    for name, kind in df.dtypes:
        cells.append(F.array_join(name, ";").alias(name) if kind == "array<string>" else F.to_json(name).alias(name) if kind.startswith(("array", "struct", "map")) else F.col(name))
    return df.select(*cells)


def write_csv(df: DataFrame, path: str) -> None:
    to_csv_cells(df).write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """B-05."""
    df.write.mode("append").json(path)


def content_cache(pages: DataFrame, text_col: str) -> DataFrame:
    """B-07: one row per distinct text, by its digest."""
    return pages.select(F.sha2(text_col, 256).alias("content_hash"), F.col(text_col).alias("content")).dropDuplicates(["content_hash"])
