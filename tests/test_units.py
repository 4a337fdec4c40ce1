from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from orderloom.operators.units import to_base_units, unit_cases, unit_rows

ITEMS = "id string, part_number string, part_name string, quantity string, unit_of_measure string, unit_price string"
PARTS = "part_number string, base_unit string, pack_size decimal(18,4)"
CATALOG = [("P", "pc", Decimal(25)), ("K", "kg", Decimal("12.5")), ("M", "m", Decimal(305)), ("L", "l", Decimal(20)), ("A", "m2", Decimal("6.25"))]

# part, name, quantity, unit, price -> quantity and price in base units, exactly
CASES = [
    (("P", None, "3", "dozen", "12"), (36, 1)), (("P", None, "3 x 12", "PK", "24"), (36, 2)), (("P", None, "2 boxes of 5 pcs", None, "10"), (10, 2)),
    (("P", None, "4", "BX/48", "96"), (192, 2)), (("P", None, "2", "VPE à 60", "6"), (120, Fraction(1, 10))), (("P", None, "2", "PK12", None), (24, None)),
    (("P", None, "2", "carton", "50"), (50, 2)), (("P", None, "5", "100 PC", "100"), (500, 1)), (("P", None, "1 M", "EA", "7.00"), (1000, Fraction(7, 1000))),
    (("P", "Bolt (qty in GRO)", "2", None, "144"), (288, 1)), (("P", "Bolt 3 mm", "2", "", "$ 5 / 100"), (None, Fraction(5, 100))), (("P", None, "36 dozen", "Stk", "1,5/1 Stk"), (432, None)),
    (("K", None, "1.000,5 g", "kg", "0,5"), (Fraction(10005, 10000), 500)), (("K", None, "10", "lb", "1 per lb"), (Fraction(45359237, 10**7), 1 / Fraction(45359237, 10**8))),
    (("M", None, "12", "inch", None), (Fraction(3048, 10000), None)), (("M", None, "2 rolls", "MTR", "610"), (610, 2)), (("L", None, "5", "gal", "3.785411784"), (Fraction("18.92705892"), 1)),
    (("A", None, "2 packs à 5 m²", None, "50 / sheet"), (10, 8)), (("A", None, "144", "sq ft", None), (Fraction("13.37803776"), None)), (("M", None, "TBD", "km", "2000"), (None, 2)),
]


def e4(x):
    if x is None:
        return None
    whole = abs(Fraction(x)) * 10_000
    return int((Decimal(whole.numerator) / Decimal(whole.denominator)).quantize(Decimal(1), ROUND_HALF_UP)) * (1 if x >= 0 else -1)


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, PARTS)


def test_cases(spark, catalog):
    items = spark.createDataFrame([(str(i), *c[0]) for i, c in enumerate(CASES)], ITEMS)
    found = {(r.item_id, r.measure): r.value_e4 for r in unit_cases(items, catalog).collect()}
    expected = {}
    for i, (_, (quantity, price)) in enumerate(CASES):
        expected |= {(str(i), m): e4(v) for m, v in (("quantity", quantity), ("unit_price", price)) if v is not None}
    assert found == expected


def test_base_units_are_no_cases(spark, catalog):
    rows = [("a", "P", None, "5", "EA", "1.5"), ("b", "M", None, "5,5", None, "2 per lfm"), ("c", "K", "x - sold per doz", "3 kg", None, "1/1 kgs"), ("d", "P", None, "-", None, "n/a")]
    assert unit_cases(spark.createDataFrame(rows, ITEMS), catalog).count() == 0


def test_nulls_unknown_parts_and_repeats(spark, catalog):
    rows = [("a", None, None, None, None, None), ("b", "P", None, None, None, None), ("c", "??", "x", "1", "dz", "1"), ("d", "P", None, "2", "dz", None), ("d", "P", None, "2", "dz", None)]
    items = spark.createDataFrame(rows, ITEMS)
    assert sorted(r.id for r in to_base_units(items, catalog).collect()) == ["b", "d", "d"]
    assert [r.value_e4 for r in unit_cases(items, catalog).collect()] == [240_000, 240_000]


def test_empty_huge_and_clashing(spark, catalog):
    empty = spark.createDataFrame([], ITEMS)
    assert unit_cases(empty, catalog).count() == 0
    rows = [("a", "P", "n" * 300_000, "9" * 40, "dz", "1" + "0" * 30), ("b", "P", None, "-2", "dz", "(24)")]
    odd = spark.createDataFrame(rows, ITEMS).withColumns({c: F.lit("z") for c in ("base_unit", "pack_size", "kind", "alias", "_all", "q_text", "num")})
    found = {(r.item_id, r.measure): r.value_e4 for r in unit_cases(odd, catalog.withColumn("id", F.lit("q")).withColumn("quantity", F.lit("q"))).collect()}
    assert found == {("b", "quantity"): -240_000, ("b", "unit_price"): -20_000}


def test_aliases_are_unambiguous():
    keys = [(r[0], r[1]) for r in unit_rows()]
    assert len(keys) == len(set(keys))


def test_line_totals_agree(spark, data):
    """Quantity times price gives the stored total: neither was used to make the other here."""
    items = spark.read.parquet(f"{data}/purchase_order_items.parquet")
    found = to_base_units(items, spark.read.parquet(f"{data}/part_catalog.parquet")).join(items.select("id", "line_total"), "id")
    product = F.col("quantity_e4") / 1e4 * (F.col("price_e4") / 1e4)
    both = found.where("line_total is not null and quantity_e4 is not null and price_e4 is not null")
    off = both.where((F.abs(product - F.col("line_total").cast("double")) > 0.05) & (F.abs(product / F.col("line_total").cast("double") - 1) > 0.02))
    assert both.count() > 400 and off.count() == 0


def test_units_with_an_offset(spark):
    """(value + offset) * numerator / denominator, rounded once; the standard table has no such unit, a caller's may."""
    from decimal import Decimal as D

    units = spark.createDataFrame(
        [("k", "k", "base", D(1), D(1), D(0)), ("c", "k", "unit", D(1), D(1), D("273.15")), ("f", "k", "unit", D(5), D(9), D("459.67"))],
        "alias string, unit_base string, kind string, unit_num decimal(12,0), unit_den decimal(12,0), offset decimal(12,4)",
    )
    catalog = spark.createDataFrame([("P", "k", None)], "part_number string, base_unit string, pack_size decimal(18,4)")
    items = spark.createDataFrame([(str(i), "P", None, q, None, None) for i, q in enumerate(["20 C", "-40 F", "300 K", "0 C"])], "id string, part_number string, part_name string, quantity string, unit_of_measure string, unit_price string")
    got = {r.id: r.quantity_e4 for r in to_base_units(items, catalog, units).collect()}
    assert got == {"0": 2931500, "1": 2331500, "2": 3000000, "3": 2731500}
