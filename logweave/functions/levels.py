"""Severity ranks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): ingestion severity ranks.
INGEST_RANK = {"TRACE": 0, "DEBUG": 1, "INFO": 2, "WARN": 3, "WARNING": 3,
               "ERROR": 4, "FATAL": 5, "CRITICAL": 5}
# Concept severity ranks (a separate, shorter ladder).
CONCEPT_RANK = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "FATAL": 4, "CRITICAL": 4}


def _lookup(ranks: dict[str, int], key: Column) -> Column:
    m = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, key), F.lit(-1))


def ingest_rank(level: Column) -> Column:
    """Rank of a level (case-insensitive); missing or unknown -> -1."""
    return F.when(level.isNull() | (level == ""), F.lit(-1)).otherwise(_lookup(INGEST_RANK, F.upper(level)))


def concept_rank(level: Column) -> Column:
    """Rank on the concept ladder (exact, case-sensitive); others -> -1."""
    return F.when(level.isNull(), F.lit(-1)).otherwise(_lookup(CONCEPT_RANK, level))


def ingest_rank_sql(expr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in INGEST_RANK.items())
    return f"(CASE upper(coalesce({expr}, '')) {whens} ELSE -1 END)"


def concept_rank_sql(expr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CONCEPT_RANK.items())
    return f"(CASE {expr} {whens} ELSE -1 END)"
