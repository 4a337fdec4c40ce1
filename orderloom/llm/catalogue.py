"""Queries of the llm subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.addresses import ADDRESS_FIELDS, address_pairs, place_classes
from orderloom.llm.encode import encode_texts, share_vocabulary
from orderloom.llm.languages import label_cases, language_segments
from orderloom.llm.names import name_groups, name_pairs
from orderloom.llm.newtext import new_lines
from orderloom.llm.packing import fill_report, pack_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_pairs(_table(spark, sf_dir, "purchase_orders"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(_table(spark, sf_dir, "purchase_orders"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_classes(_table(spark, sf_dir, "purchase_orders").select(F.explode(F.array(*ADDRESS_FIELDS)).alias("address")))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_groups(_table(spark, sf_dir, "purchase_orders"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_lines(_table(spark, sf_dir, "inbound_emails"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents"), share_vocabulary(spark))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), share_vocabulary(spark))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p7_packed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_cases(_table(spark, sf_dir, "documents"))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_segments(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_segments": p8_segments}


def oracles() -> dict[str, str]:
    return {}
