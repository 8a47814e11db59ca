"""Registered queries, wired to the fixture tables."""

from occupipe.plans import (
    cleaning,
    corpora,
    evaluation,
    extraction,
    ingest,
    models,
    relational,
    sampling,
    scoring,
    streams,
    taxonomy,
)
from occupipe.plans.registry import ORACLE, QUERIES

__all__ = [
    "ORACLE",
    "QUERIES",
    "cleaning",
    "corpora",
    "evaluation",
    "extraction",
    "ingest",
    "models",
    "relational",
    "sampling",
    "scoring",
    "streams",
    "taxonomy",
]
