"""Order header fields of parsed documents: label candidates from text and tables, resolved by rank.

All of it is local to a document's row, no exchange: candidates by themselves are array expressions, header
fields and whole extractions are read in Arrow batches, as the same expressions took many times as long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import vocab
from orderloom.functions.orders import strip_markdown
from orderloom.functions.text import blank_to_null, let, strip
from orderloom.operators.items import ITEM, item_tables
from orderloom.operators.reading import HEADER_FIELDS, ITEM_FIELDS, read_batches

BLOCK_FIELDS = (*vocab.PARTY_FIELDS, *vocab.ADDRESS_FIELDS)


def _until_stop(ahead: Column) -> Column:
    """Texts of array<struct<stop,text>> before the first that stops."""
    texts = lambda a: F.transform(a, lambda x: x["text"])
    return let(F.array_position(F.transform(ahead, lambda x: x["stop"]), F.lit(True)).cast("int"), lambda n: texts(F.when(n > 0, F.slice(ahead, F.lit(1), n - 1)).otherwise(ahead)))


def text_candidates(lines: Column) -> Column:
    """Values on or below label lines: the rest of the line first, then the next line that is no label.

    Array of struct(field, value, evidence, priority) in order of place; a label without a value is
    kept with NULL, as it says where its field was first met.
    """

    def found(x: Column, i: Column) -> Column:
        field, rest, evidence = x["label"]["field"], x["label"]["rest"], strip(x["line"])
        block = field.isin(*BLOCK_FIELDS)
        ahead = F.transform(F.slice(lines, i + 2, 4), lambda y: F.struct(y["label"].isNotNull().alias("stop"), strip_markdown(y["line"]).alias("text")))

        def options(following: Column) -> Column:
            inline = F.when((rest == "") & block, F.array_join(following, "\n")).otherwise(rest)
            below = F.when(~block, F.get(following, F.lit(0)))
            first = F.struct(field.alias("field"), blank_to_null(inline).alias("value"), evidence.alias("evidence"), F.lit(0).alias("priority"))
            second = F.struct(field.alias("field"), blank_to_null(below).alias("value"), F.concat_ws(" / ", evidence, below).alias("evidence"), F.lit(1).alias("priority"))
            return F.filter(F.array(first, second), lambda o: (o["priority"] == 0) | o["value"].isNotNull())

        return let(_until_stop(ahead), options)

    none = F.array().cast("array<struct<field:string,value:string,evidence:string,priority:int>>")
    return F.flatten(F.transform(lines, lambda x, i: F.when(x["label"].isNotNull(), found(x, i)).otherwise(none)))


def table_candidates(parts: Column) -> Column:
    """Values in, right of or below label cells; of item tables only the totals rows count, if there are any."""

    def found(p: Column, x: Column) -> Column:
        stops = lambda r, c: F.exists(p["labels"], lambda y: (y["r"] == r) & (y["c"] == c))
        field, cell, row = x["label"]["field"], x["cell"], F.get(p["rows"], x["r"])
        beside = F.get(F.filter(F.transform(row, lambda v, c: F.struct(c.alias("c"), v.alias("v"))), lambda s: (s["c"] > x["c"]) & (s["v"] != "")), F.lit(0))

        def options(b: Column) -> Column:
            right = F.when(b.isNotNull() & ~stops(x["r"], b["c"]), b["v"])
            under = blank_to_null(F.get(F.get(p["rows"], x["r"] + 1), x["c"]))
            below = F.when(right.isNull() & ~stops(x["r"] + 1, x["c"]), under)
            option = lambda value, evidence, priority: F.struct(field.alias("field"), value.alias("value"), evidence.alias("evidence"), F.lit(priority).alias("priority"))
            every = F.array(
                option(blank_to_null(x["label"]["rest"]), cell, 0), option(right, F.concat_ws(" | ", cell, right), 0), option(below, F.concat_ws(" / ", cell, below), 1),
            )
            return F.filter(every, lambda o: o["value"].isNotNull())

        return let(beside, options)

    def of_table(p: Column) -> Column:
        seen = F.filter(p["labels"], lambda x: p["header_r"].isNull() | (F.size(p["totals"]) == 0) | F.array_contains(p["totals"], x["r"]))
        return F.flatten(F.transform(seen, lambda x: found(p, x)))

    return F.flatten(F.transform(parts, of_table))


def candidates_of(docs: DataFrame) -> DataFrame:
    """Adds ``candidates``: those of the text, then those of the tables."""
    both = let(F.col("lines"), lambda lines: F.concat(text_candidates(lines), table_candidates(F.col("parts"))))
    return item_tables(docs).withColumn("candidates", both)


def header_fields(docs: DataFrame, date_order: str = "MDY") -> DataFrame:
    """document_id, one column per header field (typed), evidence (map of field to source text), warnings.

    Every document has a row; fields that are not found are NULL.
    """
    return _read(docs, date_order, False).select("document_id", *_typed_fields(), "evidence", "warnings")


def _read(docs: DataFrame, date_order: str, items: bool) -> DataFrame:
    """What ``read_batches`` makes of the documents, whether labelled before or not."""
    tables = F.transform("grids", lambda g: F.struct(g["rows"].alias("rows"))) if "grids" in docs.columns else F.col("tables")
    found = docs.select("document_id", "text_blocks", tables.alias("tables"))
    item = ",".join(f"{f}:{'int' if f == 'line_number' else 'string'}" for f in ITEM_FIELDS)
    kinds = [f"document_id {found.schema['document_id'].dataType.simpleString()}", *(f"{f} string" for f in HEADER_FIELDS), "evidence map<string,string>", "warnings array<string>"]
    kinds += [f"items array<struct<seq:int,{item}>>", "numbers_given boolean"] if items else []
    return found.mapInArrow(read_batches(date_order, items), ", ".join(kinds))


def _typed_fields() -> list[Column]:
    kinds = dict.fromkeys(vocab.DATE_FIELDS, "date") | dict.fromkeys(vocab.MONEY_FIELDS, "decimal(38,10)")
    return [F.col(f).cast(kinds.get(f, "string")).alias(f) for f in HEADER_FIELDS]


def extract(docs: DataFrame, date_order: str = "MDY") -> DataFrame:
    """Header fields with line_items (array of struct in document order) and all warnings."""
    none = F.array().cast("array<string>")
    notes = F.concat(
        F.when(F.col("numbers_given"), F.array(F.lit(vocab.NUMBERS_WARNING))).otherwise(none), "warnings", F.when(F.size("items") == 0, F.array(F.lit(vocab.NO_ITEMS_WARNING))).otherwise(none),
    )
    typed = F.col("items").cast(f"array<{ITEM.replace('struct<', 'struct<seq:int,')}>")
    return _read(docs, date_order, True).select("document_id", *_typed_fields(), "evidence", notes.alias("warnings"), typed.alias("line_items"))
