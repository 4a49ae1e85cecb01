"""All queries over the driver's tables and the SQL they are checked against."""

from __future__ import annotations

from . import calls, documents, evidence, pages, questions, streams

QUERIES: dict = {}
ORACLES: dict = {}
for module in (pages, documents, questions, evidence, calls, streams):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
FLAGSHIP = "answer_decision"
