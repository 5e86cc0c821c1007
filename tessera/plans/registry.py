"""The queries of the inventory's operators and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import Inventory, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "score_distribution_l2"


def query(name: str, sql: str | None = None):
    """Registers a function of an Inventory as a query, with the SQL for the same rows."""

    def register(plan: Callable[[Inventory], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Inventory(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return plan

    return register


from . import dashboards, graphs, ingestion, profiles, scalars, searches, similarity, temporal  # noqa: E402, F401  each registers its queries
