"""Queries of the core problems: units and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.operators.timestamps import timestamp_cases
from orderloom.operators.units import unit_cases
from orderloom.plans.units_sql import unit_cases_sql
from orderloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_cases(table(spark, sf_dir, "purchase_order_items"), table(spark, sf_dir, "part_catalog"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamp_cases(*(table(spark, sf_dir, t) for t in ("inbound_emails", "purchase_orders", "mail_sources")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found}
ORACLES = {"p1_found": unit_cases_sql()}
