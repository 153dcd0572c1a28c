"""All queries of the core, in one registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaline.plans import analytics, filters, flows, graphs, knowledge, language, learning, maintenance, memories, mutations, problems, recall, surfaces, tasks, understanding, vectors
from tessaline.plans.registry import Registry

MODULES = (problems, memories, filters, mutations, analytics, flows, knowledge, surfaces, graphs, learning, tasks, language, vectors, recall, maintenance, understanding)


def registry() -> Registry:
    return Registry().merge(*(m.REGISTRY for m in MODULES))


def flagship(spark: SparkSession, base: str) -> DataFrame:
    return problems.p3_valid_rows(spark, base)
