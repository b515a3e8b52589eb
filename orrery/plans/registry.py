"""All queries of the core library by name, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.plans import core_queries, preparation

_MODULES = [preparation, core_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.hybrid_retrieve(spark, sf_dir)
