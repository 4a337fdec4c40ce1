import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from orderloom.functions import orders as o

DAY = dt.date(2026, 1, 15)


def test_dates(apply):
    good = ["2026-01-15", "2026/1/15", "01/15/2026", "15.01.2026", "1-15-26", "15 Jan 2026", "15-Jan-26", "January 15, 2026", "Jan. 15th 2026", "due 15 january 2026 at noon"]
    assert apply(o.parse_date, good) == [DAY] * len(good)
    assert apply(o.parse_date, ["31/02/2026", "2026-02-30", "garbage", "", None, "5 Foo 2026"]) == [None] * 6
    assert apply(o.parse_date, ["03/04/2026", "03.04.2026"]) == [dt.date(2026, 3, 4), dt.date(2026, 4, 3)]
    assert apply(lambda c: o.parse_date(c, "DMY"), ["03/04/2026", "04/13/2026"]) == [dt.date(2026, 4, 3), dt.date(2026, 4, 13)]


def test_money_and_numbers(apply):
    assert apply(o.last_money, ["VAT 19% € 1,234.00", "(12.50)", "none", None]) == [Decimal("1234"), Decimal("-12.5"), None, None]
    assert apply(o.po_number, ["PO-123.", "no digits", "X" * 45 + "1", "#A-77/b"]) == ["PO-123", None, None, "A-77/b"]
    assert apply(o.uom_of_quantity, ["100 EA", "5", "1,5kg"]) == ["EA", None, "KG"]


def test_parties(apply):
    found = apply(o.split_party, ["Acme Inc., 1 Main St, Town", "Foo GmbH\nStreet 1\nCity", "Jane, Street 5", "bob@x.com Bob", "", None])
    assert [(r.name, r.address, r.email) if r else None for r in found] == [
        ("Acme Inc.", "1 Main St, Town", None), ("Foo GmbH", "Street 1, City", None), ("Jane", "Street 5", None), ("Bob", None, "bob@x.com"), (None, None, None), (None, None, None),
    ]
    assert apply(o.looks_like_address, ["1 Main St", "A sentence, here.", "Foo"]) == [True, False, False]


def test_labels(apply):
    texts = ["Purchase Order Number: 123", "Vendor Email: a@b.c", "**Total Amount**: 12", "Totals", "Ship To - Here", "Sub-total - 5", "P.O. No. X1", "Vendor", "", None]
    found = apply(o.match_label, texts)
    assert [(r.field, r.rest) if r else None for r in found] == [
        ("purchase_order_number", "123"), ("supplier_email", "a@b.c"), ("total_amount", "12"), None, ("ship_to_address", "Here"), ("subtotal", "5"), ("purchase_order_number", "X1"), ("supplier_name", ""), None, None,
    ]


def test_tolerance_and_matching(spark):
    row = spark.range(1).select(
        o.close(F.lit("100.02"), F.lit("100")).alias("a"), o.close(F.lit("100.06"), F.lit("100")).alias("b"),
        o.values_match(F.lit("total_amount"), F.lit("1.0"), F.lit("1.00")).alias("c"), o.values_match(F.lit("buyer_name"), F.lit("A, b"), F.lit("a B")).alias("d"),
        o.values_match(F.lit("currency"), F.lit("EUR"), F.lit("eur")).alias("e"), o.values_match(F.lit("currency"), F.lit(None), F.lit(None)).alias("f"),
    ).first()
    assert tuple(row) == (True, False, True, True, False, True)
