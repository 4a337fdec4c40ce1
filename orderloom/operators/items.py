"""Line items of parsed documents: headings, continued tables, totals rows, wrapped descriptions.

All of it is local to a document's row: array expressions, no exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import vocab
from orderloom.functions.orders import normalise_header, parse_date, uom_of_quantity
from orderloom.functions.text import blank_to_null, clean_inline, let, parse_decimal, parse_int
from orderloom.operators.documents import labelled

ITEM_FIELDS = tuple(f for f, _ in vocab.ITEM_COLUMNS)
MAPPING = f"struct<{','.join(f'{f}:int' for f in ITEM_FIELDS)}>"
ITEM = (
    "struct<line_number:int,part_number:string,part_name:string,quantity:decimal(38,10),unit_of_measure:string,"
    "unit_price:decimal(38,10),line_total:decimal(38,10),requested_delivery_date:date>"
)
ANY_HEADING = rf"^(?:{'|'.join([vocab.ITEM_HEADING, *(p for _, ps in vocab.ITEM_COLUMNS for p in ps)])})$"


def column_field(header: Column) -> Column:
    """Field that a normalised heading names; ``_item`` for the ambiguous one."""
    whole = F.when(header.rlike(f"^(?:{vocab.ITEM_HEADING})$"), F.lit("_item"))
    return reduce(lambda c, f: c.when(header.rlike(rf"^(?:{'|'.join(f[1])})$"), F.lit(f[0])), vocab.ITEM_COLUMNS, whole)


def row_mapping(row: Column) -> Column:
    """struct(one column number or NULL for each item field and ``_item``) of a row read as a heading: the first column of a field counts."""
    field = lambda x: let(normalise_header(x), lambda h: F.when(h.rlike(ANY_HEADING), column_field(h)))
    named = F.filter(F.transform(row, lambda x, i: F.struct(i.alias("c"), field(x).alias("field"))), lambda s: s["field"].isNotNull())
    place = lambda fields, f: F.get(F.filter(fields, lambda s: s["field"] == f), F.lit(0))["c"].alias(f)
    return let(named, lambda fields: F.struct(*(place(fields, f) for f in (*ITEM_FIELDS, "_item"))))


def heading(rows: Column) -> Column:
    """struct(r, mapping) of the first of the first three rows that is an item heading, else NULL.

    It names a part or description, and a quantity or both prices, in three columns at least.
    """

    def fit(m: Column) -> Column:
        has = lambda f: m[f].isNotNull()
        described = has("part_name") | has("part_number") | has("_item")
        counted = has("quantity") | (has("unit_price") & has("line_total"))
        return described & counted & (sum((has(f).cast("int") for f in (*ITEM_FIELDS, "_item")), F.lit(0)) >= 3)

    tried = F.transform(F.slice(rows, 1, 3), lambda row, r: F.struct(r.alias("r"), row_mapping(row).alias("mapping")))
    return F.get(F.filter(tried, lambda s: fit(s["mapping"])), F.lit(0))


def resolved(mapping: Column, below: Column) -> Column:
    """Mapping of item fields, an ambiguous heading being decided by the values of its column in the rows below."""
    values = F.filter(F.transform(below, lambda row: F.get(row, mapping["_item"])), lambda x: F.coalesce(x, F.lit("")) != "")
    numbers = let(values, lambda v: (F.size(v) > 0) & F.forall(v, lambda x: parse_int(x).isNotNull()))
    has = lambda f: mapping[f].isNotNull()
    meant = F.when(mapping["_item"].isNull(), F.lit("")).when(~has("line_number") & numbers, "line_number").when(~has("part_number"), "part_number").when(~has("part_name"), "part_name").otherwise("")
    return let(meant, lambda m: F.struct(*(F.when(m == f, mapping["_item"]).otherwise(mapping[f]).alias(f) for f in ITEM_FIELDS)))


def chained(grids: Column) -> Column:
    """Array as long as the tables: struct(header_r, mapping), header_r NULL where a table has no items.

    A table without heading continues the item table before it, with header_r -1, if it is as wide
    and holds few labels; any other table breaks the chain.
    """

    def described(g: Column) -> Column:
        width = F.array_max(F.transform(g["rows"], lambda row: F.size(row)))
        pairs = F.size(g["labels"]) >= F.greatest(F.lit(1), F.floor(F.size(g["rows"]) / 2))
        below = lambda h: F.slice(g["rows"], h["r"] + 2, F.greatest(F.size(g["rows"]), F.lit(1)))
        head = let(heading(g["rows"]), lambda h: F.when(h.isNotNull(), F.struct(h["r"].alias("r"), resolved(h["mapping"], below(h)).alias("mapping"))))
        return F.struct(F.coalesce(width, F.lit(0)).alias("width"), pairs.alias("pairs"), head.alias("head"))

    def step(seen: Column, t: Column) -> Column:
        starts = t["head"].isNotNull()
        goes_on = seen["live"] & (t["width"] == seen["width"]) & ~t["pairs"]
        mapping = F.when(starts, t["head"]["mapping"]).when(goes_on, seen["mapping"])
        at = F.when(starts, t["head"]["r"]).when(goes_on, F.lit(-1))
        found = F.concat(seen["found"], F.array(F.struct(at.alias("header_r"), mapping.alias("mapping"))))
        return F.struct(mapping.alias("mapping"), F.when(starts, t["width"]).otherwise(seen["width"]).alias("width"), (starts | goes_on).alias("live"), found.alias("found"))

    none = F.struct(F.lit(None).cast(MAPPING).alias("mapping"), F.lit(0).alias("width"), F.lit(False).alias("live"), F.array().cast(f"array<struct<header_r:int,mapping:{MAPPING}>>").alias("found"))
    return F.aggregate(F.transform(grids, described), none, step, lambda s: s["found"])


def repeats(row: Column, head: Column) -> Column:
    """Whether a row repeats the heading, cell by cell."""
    signature = lambda r: F.transform(r, lambda x: normalise_header(x))
    first = lambda r: F.lower(F.substring(F.coalesce(F.get(r, F.lit(0)), F.lit("")), 1, 1))
    # most rows differ from it in their first letter already
    alike = (F.size(row) == F.size(head)) & ((first(row) == first(head)) | (first(row) == ":") | (first(head) == ":"))
    return F.when(alike, signature(row) == signature(head)).otherwise(False)


def item_tables(docs: DataFrame) -> DataFrame:
    """Adds ``parts``: array as long as the tables of struct(rows, labels, header_r, mapping, totals, repeated).

    header_r is NULL where a table has no items, -1 where it continues the one before. totals are the
    rows below the heading with a cell that labels an amount of the order's header, repeated those
    that repeat the heading.
    """

    def part(g: Column, found: Column) -> Column:
        numbered = lambda: F.transform(g["rows"], lambda row, r: F.struct(r.alias("r"), row.alias("row")))
        again = F.when(found["header_r"] >= 0, F.transform(F.filter(numbered(), lambda s: (s["r"] > found["header_r"]) & repeats(s["row"], F.get(g["rows"], found["header_r"]))), lambda s: s["r"]))
        again = F.coalesce(again, F.array().cast("array<int>"))

        def with_totals(repeated: Column) -> Column:
            amounts = F.filter(g["labels"], lambda x: x["label"]["field"].isin(*vocab.MONEY_FIELDS) & (x["r"] > found["header_r"]) & ~F.array_contains(repeated, x["r"]))
            totals = F.array_distinct(F.transform(amounts, lambda x: x["r"]))
            return F.struct(g["rows"].alias("rows"), g["labels"].alias("labels"), found["header_r"].alias("header_r"), found["mapping"].alias("mapping"), totals.alias("totals"), repeated.alias("repeated"))

        return let(again, with_totals)

    docs = labelled(docs)
    if "parts" in docs.columns:
        return docs
    return docs.withColumn("parts", let(chained(F.col("grids")), lambda found: F.transform("grids", lambda g, t: part(g, F.get(found, t)))))


def typed_row(row: Column, mapping: Column, date_order: str) -> Column:
    """One row as an item."""
    text = lambda f: clean_inline(F.get(row, mapping[f]))
    unit = lambda q: F.coalesce(blank_to_null(F.upper(text("unit_of_measure"))), uom_of_quantity(q))
    typed = lambda q: F.struct(
        parse_int(text("line_number")).alias("line_number"), text("part_number").alias("part_number"), text("part_name").alias("part_name"), parse_decimal(q).alias("quantity"),
        unit(q).alias("unit_of_measure"), parse_decimal(text("unit_price")).alias("unit_price"), parse_decimal(text("line_total")).alias("line_total"),
        F.when(mapping["requested_delivery_date"].isNotNull(), parse_date(text("requested_delivery_date"), date_order)).alias("requested_delivery_date"),
    )
    return let(text("quantity"), typed)


def with_items(docs: DataFrame, date_order: str = "MDY") -> DataFrame:
    """Adds ``items`` (array of struct, in document order) and ``numbers_given``.

    Repeated headings, totals rows and rows without content are left out; a row with a description
    only extends the item before, in whatever table; numbers are given in row order where the
    document has none.
    """

    def rows_of(p: Column) -> Column:
        usable = lambda s: (s["r"] > p["header_r"]) & ~F.array_contains(p["totals"], s["r"]) & ~F.array_contains(p["repeated"], s["r"])
        kept = F.filter(F.transform(p["rows"], lambda row, r: F.struct(r.alias("r"), row.alias("row"))), usable)
        typed = F.transform(kept, lambda s: typed_row(s["row"], p["mapping"], date_order))
        return F.coalesce(F.when(p["header_r"].isNotNull(), typed), F.array().cast(f"array<{ITEM}>"))

    def content(x: Column) -> Column:
        amount = lambda f: F.coalesce(x[f], F.lit(0)) != 0
        return x["part_number"].isNotNull() | x["part_name"].isNotNull() | amount("quantity") | amount("unit_price") | amount("line_total")

    def merged(rows: Column) -> Column:
        only_name = lambda x: x["part_number"].isNull() & x["quantity"].isNull() & x["unit_price"].isNull() & x["line_total"].isNull() & x["part_name"].isNotNull()
        starts = F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | ~only_name(x), i)), lambda i: i.isNotNull())

        def joined(first: Column, rest: Column) -> Column:
            names = F.concat(F.array(first["part_name"]), F.transform(rest, lambda x: x["part_name"]))
            name = F.when(F.size(rest) > 0, clean_inline(F.array_join(names, " "))).otherwise(first["part_name"])
            return F.struct(*(name.alias(f) if f == "part_name" else first[f].alias(f) for f in ("line_number", "part_number", "part_name", "quantity", "unit_of_measure", "unit_price", "line_total", "requested_delivery_date")))

        def gathered(at: Column) -> Column:
            upto = lambda k: F.coalesce(F.get(at, k + 1), F.size(rows))
            return F.transform(at, lambda i, k: joined(F.get(rows, i), F.slice(rows, i + 2, upto(k) - i - 1)))

        return let(starts, gathered)

    docs = item_tables(docs)
    found = let(F.filter(F.flatten(F.transform("parts", rows_of)), content), merged)
    given = lambda items: (F.size(items) > 0) & ~F.exists(items, lambda x: x["line_number"].isNotNull())

    def numbered(items: Column, unnumbered: Column) -> Column:
        fields = lambda x, i: F.struct(
            (i + 1).alias("seq"), F.when(unnumbered, i + 1).otherwise(x["line_number"]).alias("line_number"), *(x[f].alias(f) for f in ITEM_FIELDS if f != "line_number")
        )
        return F.struct(F.transform(items, fields).alias("items"), unnumbered.alias("given"))

    listed = let(found, lambda items: let(given(items), lambda g: numbered(items, g)))
    return docs.withColumn("_listed", listed).withColumns({"items": F.col("_listed.items"), "numbers_given": F.col("_listed.given")}).drop("_listed")


def line_items(docs: DataFrame, date_order: str = "MDY") -> DataFrame:
    """document_id, seq and the typed item fields of all line items, in document order; documents without items have no row."""
    # a plain explode has a filter on the array pushed below its making, which would be done twice
    listed = with_items(docs, date_order).select("document_id", "numbers_given", F.explode_outer("items").alias("i")).where("i is not null")
    return listed.select("document_id", "i.seq", "i.line_number", *(f"i.{f}" for f in ITEM_FIELDS if f != "line_number"), "numbers_given")
