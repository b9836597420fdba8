"""Query catalogue: every registered query has a Spark plan and (where SQL can say it) a DuckDB oracle.

Queries read the given tables (or data Spark derives from them) and end in flat, named,
rounded columns so the oracle comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    operators: str


REGISTRY: dict[str, Query] = {}


def register(name: str, operators: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from . import (  # noqa: F401
        q_bleu,
        q_circuits,
        q_corrupt,
        q_divergence,
        q_entities,
        q_flow,
        q_io,
        q_match,
        q_patterns,
        q_pipeline,
        q_relational,
        q_scores,
    )

    return REGISTRY
