"""Quantities and prices in one base unit per part.

The chain is plain relational work: pull number and unit out of the text, look the unit up in an
alias table by join, take the unit that stands with the number, else the unit field, else the
unit named in the description, else the base unit, then apply factor and offset. Factors are kept
as integer fractions, so the only rounding is the final one.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.text import WHITE, ascii_spaces, blank_to_null, parse_decimal, strip
from orderloom.session import broadcast_if_small

# Spellings of units. Each line: base unit, numerator, denominator, spellings.
# A base unit is reached by (spelling + offset) * numerator / denominator; the offset is zero for all of these.
UNIT_LINES = """
pc 1 1 pc pcs pce pces ea each piece pieces unit units st stk stck stück stueck stuck szt sztuk sztuka h87 c62 un und pz pza pzas nos no
pc 2 1 pr pair pairs paar npr para par paire paires paio
pc 12 1 dz dzn doz dozen dozens dtzd dutzend docena tuzin dzp
pc 100 1 c cen hundred hundert hundreds cent
pc 144 1 gro grs gross gros
pc 1000 1 m mil mille tsd tausend thousand kpcs
kg 1 1 kg kgs kgm kilo kilos kilogram kilograms kilogramm
kg 1 1000 g gr grm gram grams gramm
kg 1000 1 t to tne tonne tonnes ton mt
kg 1 1000000 mg mgm
kg 45359237 100000000 lb lbs lbr pound pounds
kg 45359237 1600000000 oz onz ounce ounces
m 1 1 m mtr mtrs metre metres meter meters lfm lm
m 1000 1 km kmt kilometre kilometer
m 1 100 cm cmt centimetre centimeter
m 1 1000 mm mmt millimetre millimeter
m 254 10000 in inh inch inches zoll
m 3048 10000 ft fot foot feet lf lft
m 9144 10000 yd yds yrd yard yards
l 1 1 l ltr lt liter litre liters litres
l 1 1000 ml mlt millilitre milliliter
l 1 100 cl clt centilitre centiliter
l 1 10 dl dlt
l 100 1 hl hlt hectolitre hektoliter
l 1000 1 m3 m³ cbm mtq cum
l 3785411784 1000000000 gal gll gallon gallons
m2 1 1 m2 m² sqm qm mtk
m2 1 10000 cm2 cm² cmk sqcm
m2 1 1000000 mm2 mm² mmk
m2 9290304 100000000 ft2 ft² ftk sqft
m2 83612736 100000000 yd2 ydk sqyd
m2 64516 100000000 in2 ink sqin
"""

# Words for a package, whose content the line or the catalogue states.
PACKAGES = """
box boxes bx bxs ctn ctns ct carton cartons karton kartons pk pks pack packs pkt package packages vpe case cases cs
bag bags bg sack sacks sk roll rolls rl rol rolle rollen ro drum drums dr fass fässer sheet sheets sht tafel tafeln set sets
""".split()

#: Words that mean a package only where a content is stated with them ("8 pcs of 60 l").
LOOSE_PACKAGES = ("pcs", "pc", "ea", "each", "pieces")


def unit_rows() -> list[tuple]:
    """(alias, base_unit, kind, numerator, denominator, offset); kind is 'base', 'unit' or 'package'."""
    rows = []
    for line in UNIT_LINES.strip().splitlines():
        base, num, den, *names = line.split()
        kind = "base" if num == den else "unit"
        rows += [(name, base, kind, Decimal(num), Decimal(den), Decimal(0)) for name in names]
    return rows + [(name, base, "package", Decimal(1), Decimal(1), Decimal(0)) for base in ("pc", "kg", "m", "l", "m2") for name in PACKAGES]


def unit_table(spark: SparkSession) -> DataFrame:
    """The alias table: about 500 rows, fixed, so it is always small enough to broadcast."""
    return spark.createDataFrame(
        unit_rows(), "alias string, unit_base string, kind string, unit_num decimal(12,0), unit_den decimal(12,0), offset decimal(12,4)"
    )


def unit_alias(text: Column) -> Column:
    """Spelling as the table has it: lower case, no points, no inner blanks."""
    return blank_to_null(F.translate(F.lower(text), WHITE + ".", ""))


NUMBER = r"[0-9][0-9.,']*"
LEAD = r"^(\(?\s*[+-]?\s*[.,]?[0-9][0-9.,'\s]*\)?-?)(.*)$"
TIMES = rf"(?i)^(x|×|\*)\s*({NUMBER})\s*(.*?)(?:\s+each)?$"
MULTIPLE = rf"^({NUMBER})\s*(.*)()$"
CONTENT = rf"(?i)^([^0-9]+?)\s*(?:\bof|à|@|/)?\s*({NUMBER})\s*(.*?)(?:\s+each)?$"
NAME_HINT = r"(?i)(?:\(qty in ([^()]+)\)|\[uom ([^\[\]]+)\]|; menge in (.+)|, counted by the (.+)|- sold per (.+))\s*$"
PRICE = r"(?i)^(.*?)(?:\s*/\s*|\s+(?:per|je|pro|por|par|à)\s+)(.*)$"
FRACTION = "struct<num:decimal(18,0),den:decimal(18,0),is_base:boolean,offset:decimal(12,4)>"
TEN_K = 10_000


def _whole(c: Column) -> Column:
    return c.try_cast("decimal(18,0)")


def _named(df: DataFrame, units: DataFrame, prefix: str, phrase: str) -> DataFrame:
    """Adds ``{prefix}_unit``: base units in one of the phrase's unit, as a fraction, or NULL.

    A phrase is a unit ("doz"), a multiple of one ("100 PC"), a package with its content
    ("box of 5", "x 12 pcs") or a bare multiple ("100", of base units).
    """
    text = F.col(phrase)
    shape = F.when(text.rlike(TIMES), "content").when(text.rlike(MULTIPLE), "multiple").when(text.rlike(CONTENT), "package")
    groups = lambda pattern: F.array(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3)))
    found = F.when(F.col("_shape") == "content", groups(TIMES)).when(F.col("_shape") == "multiple", groups(MULTIPLE)).when(F.col("_shape") == "package", groups(CONTENT))
    group = lambda i: F.get("_groups", F.lit(i - 1))
    df = df.withColumn("_shape", shape).withColumn("_groups", found)
    df = df.withColumns({
        "_all": unit_alias(text),
        "_outer": F.when(F.col("_shape") == "package", unit_alias(group(1))),
        "_inner": unit_alias(F.when(F.col("_shape") == "multiple", group(2)).when(F.col("_shape").isNotNull(), group(3))),
        "_count": parse_decimal(F.when(F.col("_shape") == "multiple", group(1)).when(F.col("_shape").isNotNull(), group(2)), "decimal(14,4)"),
    })
    for part in ("_all", "_outer", "_inner"):
        lookup = units.select(
            F.col("alias").alias(part), F.col("unit_base").alias("base_unit"),
            F.struct("kind", "unit_num", "unit_den", "offset").alias(f"{part}_u"),
        )
        df = df.join(F.broadcast(lookup), [part, "base_unit"], "left")
    whole, outer, inner = F.col("_all_u"), F.col("_outer_u"), F.col("_inner_u")
    count = F.col("_count") * TEN_K
    pack = F.col("pack_size") * TEN_K

    def fraction(num: Column, den: Column, is_base: Column, offset: Column | None = None) -> Column:
        return F.struct(_whole(num).alias("num"), _whole(den).alias("den"), is_base.alias("is_base"), (F.lit(0) if offset is None else offset).cast("decimal(12,4)").alias("offset"))

    is_package = F.coalesce(outer["kind"] == "package", F.lit(False)) | F.col("_outer").isin(*LOOSE_PACKAGES)
    content = F.when(
        F.col("_inner").isNull() | inner.isNotNull(),
        fraction(count * F.coalesce(inner["unit_num"], F.lit(1)), F.lit(TEN_K) * F.coalesce(inner["unit_den"], F.lit(1)), F.lit(False)),
    )
    multiple = (
        F.when(F.col("_inner").isNull(), fraction(count, F.lit(TEN_K), F.col("_count") == 1))
        .when(inner["kind"] == "package", fraction(F.col("_count") * pack, F.lit(TEN_K), F.lit(False)))
        .when(inner.isNotNull(), fraction(count * inner["unit_num"], F.lit(TEN_K) * inner["unit_den"], (F.col("_count") == 1) & (inner["kind"] == "base")))
    )
    unit = (
        F.when(whole["kind"] == "package", fraction(pack, F.lit(TEN_K), F.lit(False)))
        .when(whole.isNotNull(), fraction(whole["unit_num"], whole["unit_den"], whole["kind"] == "base", whole["offset"]))
        .when(F.col("_shape") == "content", content)
        .when(F.col("_shape") == "multiple", multiple)
        .when((F.col("_shape") == "package") & is_package, content)
    )
    return df.withColumn(f"{prefix}_unit", unit).drop("_all", "_outer", "_inner", "_count", "_shape", "_groups", "_all_u", "_outer_u", "_inner_u")


def _in_base(value: Column, num: Column, den: Column) -> Column:
    """value * num / den in ten-thousandths, rounded half up once: integers throughout, so exact."""
    top = (F.abs(value) * 100_000_000).cast("decimal(20,0)") * num.cast("decimal(17,0)")
    bottom = den.cast("decimal(18,0)") * F.lit(TEN_K)
    fits = (den > 0) & (num > 0) & (top.cast("double") / bottom.cast("double") < 4e18)
    rounded = F.call_function("div", top * F.lit(2) + bottom, bottom * F.lit(2))
    return F.when(fits, F.when(value < 0, -rounded).otherwise(rounded))


#: Parts up to which the catalogue is broadcast (a few MB); a larger one is joined by shuffle.
MOST_PARTS = 50_000


def to_base_units(items: DataFrame, catalog: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Each line of a known part with quantity and price in the part's base unit.

    Columns: id, quantity_e4, price_e4 (bigint ten-thousandths, NULL where the text is no number
    or beyond 12 digits), quantity_is_base, price_is_base. Lines with a NULL or unknown part are
    left out; blank or unknown units count as not named, so such a line counts base units; rows
    that repeat stay; only the columns named here are read, whatever else the tables hold. A
    package named by a price holds the catalogue's content, one counted by the line holds what the
    line states; a bare "per 100" means base units. A unit with an offset shifts quantities, not prices.
    """
    units = units if units is not None else unit_table(items.sparkSession)
    parts = catalog.where("part_number is not null").select("part_number", "base_unit", "pack_size").dropDuplicates(["part_number"])
    texts = (ascii_spaces(c).alias(c) for c in ("part_name", "quantity", "unit_of_measure", "unit_price"))
    lines = items.select("id", "part_number", *texts)
    lead = lambda i: F.regexp_extract("quantity", LEAD, i)
    counted, priced = F.col("quantity").rlike(LEAD), F.col("unit_price").rlike(PRICE)
    hint = F.coalesce(*(blank_to_null(F.regexp_extract("part_name", NAME_HINT, i)) for i in range(1, 6)))
    amount = F.when(priced, F.regexp_extract("unit_price", PRICE, 1)).otherwise(F.col("unit_price"))
    df = lines.join(broadcast_if_small(parts, MOST_PARTS), "part_number").withColumns({
        "q_number": parse_decimal(F.when(counted, lead(1)), "decimal(20,8)"),
        "q_text": F.when(counted, blank_to_null(strip(lead(2)))),
        "u_text": blank_to_null(strip("unit_of_measure")),
        "n_text": blank_to_null(strip(hint)),
        "p_number": parse_decimal(amount, "decimal(20,8)"),
        "p_text": F.when(priced, blank_to_null(strip(F.regexp_extract("unit_price", PRICE, 2)))),
    })
    for prefix in ("q", "u", "n", "p"):
        df = _named(df, units, prefix, f"{prefix}_text")
    base = F.struct(F.lit(1).alias("num"), F.lit(1).alias("den"), F.lit(True).alias("is_base"), F.lit(0).alias("offset")).cast(FRACTION)
    df = df.withColumn("line_unit", F.coalesce("q_unit", "u_unit", "n_unit", base))
    df = df.withColumn("price_unit", F.coalesce("p_unit", "line_unit"))
    return df.select(
        "id",
        _in_base(F.col("q_number") + F.col("line_unit.offset"), F.col("line_unit.num"), F.col("line_unit.den")).alias("quantity_e4"),
        F.col("line_unit.is_base").alias("quantity_is_base"),
        _in_base(F.col("p_number"), F.col("price_unit.den"), F.col("price_unit.num")).alias("price_e4"),
        F.col("price_unit.is_base").alias("price_is_base"),
    )


def unit_cases(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lines whose quantity or price was not in base units, one row per measure."""
    pairs = F.array(
        F.struct(F.lit("quantity").alias("measure"), F.when(~F.col("quantity_is_base"), F.col("quantity_e4")).alias("value_e4")),
        F.struct(F.lit("unit_price").alias("measure"), F.when(~F.col("price_is_base"), F.col("price_e4")).alias("value_e4")),
    )
    found = to_base_units(items, catalog).select(F.col("id").alias("item_id"), F.explode(pairs).alias("m"))
    return found.select("item_id", "m.measure", "m.value_e4").where("value_e4 is not null")
