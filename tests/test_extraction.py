from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderloom.operators.documents import PARSED_SCHEMA, render_orders, table_markdown
from orderloom.operators.headers import extract, header_fields
from orderloom.operators.items import line_items

DOC = "document_id string, text_blocks array<string>, tables array<struct<page_no:int,rows:array<array<string>>>>"
LETTER = ["ACME Manufacturing Inc.\n100 Industrial Way, Springfield", "P.O. No: X-77\nNeed By: 02/03/2026\nVendor E-mail: Sales@V.com\nVendor: Best Supply Ltd, 5 Road\nTotal: $ 12.00"]
ITEMS = [["Item", "Description", "Qty", "Unit Price", "Amount"], ["1", "Bolt", "10 EA", "1.00", "10.00"], ["", "long", "", "", ""], ["2", "Nut", "2", "1.00", "2.00"], ["", "", "", "Total", "12.00"]]
HEAD = ["Line", "SKU", "Product", "Qty", "Price", "Line Total"]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_letter_and_wrapped_item(spark):
    r = extract(docs(spark, [("d", LETTER, [(1, ITEMS)])])).first()
    assert (r.purchase_order_number, str(r.requested_delivery_date), r.supplier_name, r.supplier_address, r.supplier_email) == ("X-77", "2026-02-03", "Best Supply Ltd", "5 Road", "sales@v.com")
    assert (r.buyer_name, r.buyer_address, r.currency, r.total_amount) == ("ACME Manufacturing Inc.", "100 Industrial Way, Springfield", None, Decimal(12))
    assert [(i.line_number, i.part_number, i.part_name, i.quantity, i.unit_of_measure) for i in r.line_items] == [(1, None, "Bolt long", 10, "EA"), (2, None, "Nut", 2, None)]
    assert len(r.warnings) == 3 and r.evidence["total_amount"] == "Total: $ 12.00"


def test_nothing_to_find(spark):
    r = extract(docs(spark, [("d", ["nothing here"], []), ("e", [], []), ("f", None, None)])).orderBy("document_id").collect()
    assert [x.line_items for x in r] == [[], [], []] and all(x.purchase_order_number is None for x in r)
    assert "no line items found" in r[0].warnings
    assert extract(docs(spark, [])).count() == 0


def test_explicit_address_and_party_block(spark):
    a = docs(spark, [("party first", ["Vendor: A Ltd, 1 Road\nVendor Address: 2 Road"], []), ("explicit first", ["Vendor Address: 2 Road\nVendor: A Ltd, 1 Road"], [])])
    assert {r.document_id: r.supplier_address for r in header_fields(a).collect()} == {"party first": "1 Road", "explicit first": "2 Road"}


def test_priorities(spark):
    a = docs(spark, [
        ("next line", ["Order Date\n2026-01-02"], []), ("bad inline", ["Order Date: soon\n2026-01-03"], []), ("right before below", [], [(1, [["Order Date", "", "2026-01-04"], ["2026-01-05", "", ""]])]),
        ("below", [], [(1, [["Order Date", "Currency"], ["2026-01-05", "EUR"]])]), ("percent", ["VAT 19%: 1,00\nCurrency: EUR"], []),
    ])
    r = {x.document_id: x for x in header_fields(a).collect()}
    assert [str(r[k].order_date)[-1] for k in ("next line", "bad inline", "right before below", "below")] == ["2", "3", "4", "5"]
    assert r["below"].currency == "EUR"


def test_continued_table(spark):
    first, second, other = [HEAD, ["1", "a", "A", "1", "1", "1"]], [["2", "b", "B", "2", "1", "2"]], [["x", "y"]]
    a = docs(spark, [("goes on", [], [(1, first), (2, second)]), ("broken", [], [(1, first), (1, other), (2, second)]), ("other width", [], [(1, first), (2, other)])])
    found = {}
    for r in line_items(a).orderBy("seq").collect():
        found.setdefault(r.document_id, []).append(r.part_number)
    assert found == {"goes on": ["a", "b"], "broken": ["a"], "other width": ["a"]}


def test_rows_left_out_and_numbers_given(spark):
    rows = [["SKU", "Product", "Quantity", "Price"], ["a", "A", "1", "2"], ["", "", "0", "0"], ["", "", "", ""], ["SKU", "Product", "Quantity", "Price"], ["b", "B", "x"], ["Shipping", "", "", "5.00"]]
    r = line_items(docs(spark, [("d", [], [(1, rows)])])).orderBy("seq").collect()
    assert [(x.line_number, x.part_number, x.quantity, x.numbers_given) for x in r] == [(1, "a", 1, True), (2, "b", None, True)]


def test_ambiguous_item_heading(spark):
    number = [["Item", "Qty", "Description"], ["10", "1", "A"], ["20", "2", "B"]]
    part = [["Item", "Qty", "Description"], ["x1", "1", "A"], ["20", "2", "B"]]
    r = line_items(docs(spark, [("number", [], [(1, number)]), ("part", [], [(1, part)])])).orderBy("document_id", "seq").collect()
    assert [(x.line_number, x.part_number) for x in r] == [(10, None), (20, None), (1, "x1"), (2, "20")]


def test_markdown(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("x\ny")))
    assert spark.range(1).select(table_markdown(rows)).first()[0] == "| a | b\\|c |\n| --- | --- |\n| x y |  |"


@pytest.mark.parametrize("layout", [0, 1, 2])
def test_rendered_layouts(spark, data, layout):
    orders, lines, customers = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("orders", "lineitem", "customer"))
    rendered = render_orders(orders.where(f"o_orderkey < 30 and o_orderkey % 3 = {layout}"), lines, customers)
    assert set(rendered.columns) <= {c.split()[0] for c in PARSED_SCHEMA.split(", ")}
    found = header_fields(rendered)
    assert found.where("purchase_order_number = document_id and order_date is not null and total_amount is not null").count() == rendered.count()


def test_extraction_stays_in_the_row(spark, data):
    """Neither an exchange nor a second evaluation behind a pushed filter."""
    a = docs(spark, [("d", LETTER, [(1, ITEMS)])])
    for df in (header_fields(a), line_items(a), extract(a)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Filter (size" not in plan


def test_rows_with_null_parts(spark):
    a = docs(spark, [(None, [None, "PO No: 77"], [(None, [None, [None, "Total"], ["Total", "3.00"]])]), ("d", [""], [(1, None), (2, [])]), ("long", ["x " * 200_000 + "\nPO No: 88"], None)])
    found = {r.document_id: r for r in extract(a).collect()}
    assert found[None].purchase_order_number == "77" and found[None].total_amount == 3
    assert found["long"].purchase_order_number == "88" and found["d"].line_items == []
