"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.plans import core, expressions, extraction, flows, reports

MODULES = (core, reports, expressions, extraction, flows)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reconciliation(spark, sf_dir)
