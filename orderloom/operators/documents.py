"""Parsed documents (text blocks and table grids) as relations, and documents rendered from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.orders import match_label
from orderloom.functions.text import let, strip
from orderloom.session import spread

PARSED_SCHEMA = (
    "document_id string, parser string, page_count int, markdown string, text_blocks array<string>, "
    "tables array<struct<page_no:int,rows:array<array<string>>>>"
)


def lines_of(blocks: Column) -> Column:
    """Array of struct(line, label) of the non-blank lines of all text blocks; label is NULL where there is none."""
    every = F.flatten(F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda b: F.split(F.coalesce(b, F.lit("")), "\n")))
    return F.transform(F.filter(every, lambda x: strip(x) != ""), lambda x: F.struct(x.alias("line"), match_label(x).alias("label")))


def grid_of(table: Column) -> Column:
    """struct(rows, labels) of one table: stripped cells, and struct(r, c, cell, label) of those that are labels."""

    def labels(rows: Column) -> Column:
        in_row = lambda row, r: F.filter(F.transform(row, lambda x, c: F.struct(r.alias("r"), c.alias("c"), x.alias("cell"), match_label(x).alias("label"))), lambda s: s["label"].isNotNull())
        return F.flatten(F.transform(rows, in_row))

    rows = F.transform(table["rows"], lambda row: F.transform(F.coalesce(row, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("")))))
    return let(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.struct(r.alias("rows"), labels(r).alias("labels")))


def labelled(docs: DataFrame) -> DataFrame:
    """document_id, text_blocks, lines, grids: the documents with their labels, matched once for all that follows.

    All of it is local to a row: nothing is exchanged or written, whatever is extracted later.
    """
    if "grids" in docs.columns:
        return docs
    tables = F.coalesce("tables", F.array().cast("array<struct<page_no:int,rows:array<array<string>>>>"))
    return docs.select("document_id", F.coalesce("text_blocks", F.array().cast("array<string>")).alias("text_blocks"), lines_of(F.col("text_blocks")).alias("lines"), F.transform(tables, grid_of).alias("grids"))


def table_markdown(rows: Column) -> Column:
    """Pipe table of a grid: ragged rows padded, line feeds as blanks, pipes escaped, a rule below the first row."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    padded = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))
    drawn = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = drawn(F.array_repeat(F.lit("---"), width.cast("int")))
    body = F.transform(rows, lambda r: drawn(padded(r)))
    return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))), "\n")


def render_orders(orders: DataFrame, lines: DataFrame, customers: DataFrame) -> DataFrame:
    """Parsed documents made from order tables, in three layouts by order key: the extraction's test bed.

    Layout 0 states the header in lines of text, layout 1 in a table beside the items, layout 2 in
    bare labels with values below, the items split over two tables and without line numbers.
    """
    key, layout = F.col("o_orderkey"), F.col("o_orderkey") % 3
    money = lambda c: F.format_number(c, 2)
    number = F.concat(F.lit("PO-"), key.cast("string"))
    item = F.struct(
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"), F.col("l_shipdate")
    )
    grouped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(grouped, "o_orderkey", "left")
    # reading the documents is far more work than these few bytes suggest
    joined = spread(joined, "o_orderkey")
    # not the stored name, which reads like a label itself ("Customer#1")
    joined = joined.withColumn("client", F.concat(F.lit("Client "), F.col("c_custkey").cast("string")))
    items = F.coalesce("items", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double,l_shipdate:timestamp_ntz>>"))
    cells = lambda numbered: F.transform(
        items,
        lambda x, i: F.array(
            *([(i + 1).cast("string")] if numbered else []), F.concat(F.lit("P-"), x["l_partkey"].cast("string")), F.concat(F.lit("Part "), x["l_partkey"].cast("string")),
            F.format_string("%d EA", x["l_quantity"].cast("int")), money(x["l_extendedprice"] / x["l_quantity"]), money(x["l_extendedprice"]),
        ),
    )
    words = lambda *xs: F.array(*(F.lit(x) for x in xs))
    head = words("Line", "Part No.", "Description", "Qty", "Unit Price", "Amount")
    total_row = F.array(F.lit("Grand Total"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), money("o_totalprice"))
    day = F.col("o_orderdate").cast("date")
    text0 = F.array(
        F.concat(F.lit("PURCHASE ORDER\nPO Number: "), number, F.lit("\nOrder Date: "), F.date_format(day, "MM/dd/yyyy")),
        F.concat(F.lit("Buyer: "), F.col("client"), F.lit("\nCurrency: USD\nTotal Amount: $"), money("o_totalprice")),
    )
    table0 = F.concat(F.array(head), cells(True), F.array(total_row))
    head_table = F.array(
        F.array(F.lit("P.O. No."), number, F.lit("Date of Order"), F.date_format(day, "d MMM yyyy")),
        F.array(F.lit("Customer"), F.col("client"), F.lit("Currency"), F.lit("EUR")),
        F.array(F.lit("Order Total"), F.concat(money("o_totalprice"), F.lit(" EUR"))),
    )
    text2 = F.array(
        F.concat(F.lit("Order No.\n"), number), F.concat(F.lit("Issue Date\n"), F.date_format(day, "yyyy-MM-dd")),
        F.concat(F.lit("Ordered By\n"), F.col("client")), F.concat(F.lit("Amount Due\n"), money("o_totalprice"), F.lit(" GBP")),
    )
    half = F.ceil(F.size(items) / 2).cast("int")
    body2 = cells(False)
    front = F.slice(body2, F.lit(1), half)
    back = F.slice(body2, half + 1, F.greatest(F.size(items) - half, F.lit(0)))
    head2 = words("SKU", "Product Name", "Quantity", "Price", "Line Total")
    grid = lambda rows: F.struct(F.lit(1).alias("page_no"), rows.alias("rows"))
    tables = (
        F.when(layout == 0, F.array(grid(table0)))
        .when(layout == 1, F.array(grid(head_table), grid(F.concat(F.array(head), cells(True)))))
        .otherwise(F.filter(F.array(grid(F.concat(F.array(head2), front)), grid(back)), lambda x: F.size(x["rows"]) > 0))
    )
    blocks = F.when(layout == 0, text0).when(layout == 1, F.array(F.lit("Purchase Order"))).otherwise(text2)
    return joined.select(
        number.alias("document_id"), F.lit("render").alias("parser"), F.lit(1).alias("page_count"), F.lit(None).cast("string").alias("markdown"),
        blocks.alias("text_blocks"), tables.alias("tables"),
    )


def render_letters(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Parsed documents made from order tables, in two fuller layouts by order key: letters with parties and all header fields.

    Layout 0 has a letterhead instead of a buyer, the supplier in one line, an address of several lines,
    bare dollars, and items under the ambiguous heading, with units, wrapped descriptions, a row of
    zeros and totals in their own rows. Layout 1 has party blocks, an explicit buyer address before
    them, the rest in a table of labels, its currency in a sentence, headings that repeat among the
    items and no line numbers.
    """
    key, buyer, seller = F.col("o_orderkey"), F.col("o_custkey").cast("string"), (F.col("o_custkey") % 100).cast("string")
    number = F.concat(F.lit("PO-"), key.cast("string"))
    goods = F.col("o_totalprice").cast("decimal(18,2)")
    tax, freight = (key % 1000 / 100).cast("decimal(18,2)"), (key % 40).cast("decimal(18,2)")
    money = lambda c, sign="": F.concat(F.lit(sign), F.format_number(c, 2))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    grouped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = spread(orders.join(grouped, "o_orderkey"), "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    due = F.date_add(day, 14)
    words = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    part = lambda x: text("P-", x["l_partkey"].cast("string"))
    name = lambda x: text("Part ", x["l_partkey"].cast("string"))
    count = lambda x: x["l_quantity"].cast("int").cast("string")
    price = lambda x: money(x["l_extendedprice"] / x["l_quantity"])
    none = F.array().cast("array<array<string>>")

    head0 = words("Item", "Part No.", "Description", "Qty", "UOM", "Unit Price", "Amount")
    wrapped = lambda x: F.when(x["l_partkey"] % 3 == 0, F.array(words("", "", text("(lot ", x["l_suppkey"].cast("string"), ")"), "", "", "", ""))).otherwise(none)
    row0 = lambda x, i: words(((i + 1) * 10).cast("string"), part(x), name(x), count(x), "pc", price(x), money(x["l_extendedprice"]))
    body0 = F.flatten(F.transform("items", lambda x, i: F.concat(F.array(row0(x, i)), wrapped(x))))
    total0 = lambda label, value: words("", "", "", "", "", label, money(value, "$"))
    table0 = F.concat(
        F.array(head0), body0, F.array(words("", "", "", "0", "", "0.00", "0.00"), total0("Subtotal", goods), total0("Sales Tax 8%", tax), total0("Freight", freight), total0("Total Due", goods + tax + freight)),
    )
    text0 = F.array(
        text("Client ", buyer, " Trading Inc.\n", buyer, " Industrial Way, Springfield, IL 62701\nPURCHASE ORDER"),
        text("PO No.: ", number, "\nPO Date: ", F.date_format(day, "MM/dd/yyyy"), "\nVendor: Maker ", seller, " Ltd, ", seller, " Quay Road, Leeds\nVendor E-mail: Sales@S", seller, ".example"),
        text("Need By: ", due.cast("string"), "\nPayment Terms: Net 30\nIncoterms: CIF Rotterdam\nShip To:\nDock 3\n", buyer, " Harbour Street\nSpringfield"),
    )
    head1 = words("Item", "Description", "Qty", "Price", "Total Price")
    again = lambda x: F.when(x["l_partkey"] % 5 == 0, F.array(head1)).otherwise(none)
    row1 = lambda x: words(part(x), name(x), text(count(x), " pk"), price(x), money(x["l_extendedprice"]))
    table1 = F.concat(F.array(head1), F.flatten(F.transform("items", lambda x: F.concat(F.array(row1(x)), again(x)))))
    pairs1 = F.array(
        words("Requested Delivery Date", F.date_format(due, "d MMM yyyy"), "Terms of Payment", "Net 45"), words("Freight Terms", "DDP Leeds", "Carriage", money(freight)),
        words("VAT 19%", money(tax), "Net Amount", money(goods)), words("Grand Total", money(goods + tax + freight)),
    )
    text1 = F.array(
        text("Purchase Order\nOrder Number: ", number, "\nIssue Date\n", F.date_format(day, "dd.MM.yyyy"), "\nBuyer Address: ", buyer, " Elm Road, York"),
        text("Buyer:\nClient ", buyer, " Ltd\n1 Other Street\nLondon"), text("Supplier:\nMaker ", seller, " GmbH\nHafenstrasse ", seller, "\n20457 Hamburg\nsales@s", seller, ".example"),
        text("Bill To: Client ", buyer, " Ltd, Box ", buyer, "\nNotes\nAll prices in CHF."),
    )
    first = key % 2 == 0
    grid = lambda rows: F.struct(F.lit(1).alias("page_no"), rows.alias("rows"))
    return joined.select(
        number.alias("document_id"), F.lit("render").alias("parser"), F.lit(1).alias("page_count"), F.lit(None).cast("string").alias("markdown"),
        F.when(first, text0).otherwise(text1).alias("text_blocks"), F.when(first, F.array(grid(table0))).otherwise(F.array(grid(pairs1), grid(table1))).alias("tables"),
    )
