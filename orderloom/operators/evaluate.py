"""Extracted records against expected ones, field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.orders import values_match


def long_form(records: DataFrame, fields: list[str], key: str = "document_id") -> DataFrame:
    """key, path, field, value: header fields, ``line_items.count`` and the fields of each item by position."""
    head = F.array(*(F.struct(F.lit(f).alias("path"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    rows = records.select(key, F.explode(head).alias("x"))
    counts = records.select(key, F.struct(F.lit("line_items.count").alias("path"), F.lit("line_number").alias("field"), F.size("line_items").cast("string").alias("value")).alias("x"))
    names = records.schema["line_items"].dataType.elementType.fieldNames()
    items = records.select(key, F.posexplode("line_items").alias("i", "item"))
    path = lambda n: F.concat(F.lit("line_items["), (F.col("i") + 1).cast("string"), F.lit(f"].{n}"))
    cells = items.select(key, F.explode(F.array(*(F.struct(path(n).alias("path"), F.lit(n).alias("field"), F.col(f"item.{n}").cast("string").alias("value")) for n in names))).alias("x"))
    return rows.unionByName(counts).unionByName(cells).select(key, "x.*")


def evaluate(expected: DataFrame, actual: DataFrame, key: str = "document_id") -> DataFrame:
    """key, path, expected, actual, matches of every expected field; a missing item counts as NULL."""
    e = expected.select(key, "path", "field", F.col("value").alias("expected"))
    a = actual.select(key, "path", F.col("value").alias("actual"))
    both = e.join(a, [key, "path"], "left")
    return both.select(key, "path", "expected", "actual", values_match("field", "expected", "actual").alias("matches"))


def accuracy(results: DataFrame, key: str = "document_id") -> DataFrame:
    """key, total, correct, accuracy per document and over all (key NULL); 1.0 where nothing is expected."""
    counts = results.rollup(key).agg(F.count("*").alias("total"), F.count_if("matches").alias("correct"))
    return counts.select(key, "total", "correct", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(1.0)).alias("accuracy"))


def passes(results: DataFrame, least: float) -> DataFrame:
    """One row: overall accuracy and whether it reaches ``least``."""
    whole = results.agg(F.count("*").alias("total"), F.count_if("matches").alias("correct"))
    share = F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(1.0))
    return whole.select(share.alias("accuracy"), (share >= least).alias("passed"))
