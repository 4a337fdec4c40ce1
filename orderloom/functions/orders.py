"""Order-specific Column expressions: dates, amounts, parties, labels, tolerances."""

from __future__ import annotations

import string
from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions import vocab
from orderloom.functions.text import ColumnLike, ascii_spaces, blank_to_null, clean_inline, col, let, norm_key, normalize_email, parse_decimal, strip


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The day, NULL if the calendar has none such."""
    possible = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    return F.when(possible, F.format_string("%04d-%02d-%02d", year, month, day)).try_cast("date")


def full_year(text: Column) -> Column:
    year = text.try_cast("int")
    return F.when(year < 100, year + 2000).otherwise(year)


def _groups(text: Column, pattern: str, count: int) -> Column:
    return F.array(*(F.regexp_extract(text, pattern, i) for i in range(1, count + 1)))


def parse_date(c: ColumnLike, order: str = "MDY") -> Column:
    """Day written in a usual way, NULL if unsure.

    Year-first and numeric forms decide by themselves, even if their day does not exist; a number
    over 12 tells day from month, then points mean day first, then ``order`` decides; names of
    months come last. Two-digit years are 20yy.
    """
    iso = r"(?U)\b([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})\b"
    numeric = r"(?U)\b([0-9]{1,2})([-/.])([0-9]{1,2})([-/.])([0-9]{2,4})\b"
    day_month = r"(?U)\b([0-9]{1,2})[ -]([A-Za-z]{3,9})\.?[ -]([0-9]{2,4})\b"
    month_day = r"(?U)\b([A-Za-z]{3,9})\.? ([0-9]{1,2}) ([0-9]{4})\b"
    months = F.create_map(*(F.lit(x) for pair in vocab.MONTHS.items() for x in pair))
    number = lambda g, i: F.get(g, F.lit(i)).try_cast("int")
    part = lambda g, i: F.get(g, F.lit(i))

    def by_number(g: Column) -> Column:
        a, b, year = number(g, 0), number(g, 2), full_year(part(g, 4))
        pointed = (part(g, 1) == ".") | (part(g, 3) == ".")
        day_first = F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False).otherwise(pointed if order == "MDY" else F.lit(True))
        return F.when(day_first, safe_date(year, b, a)).otherwise(safe_date(year, a, b))

    def by_name(g: Column, m: int, d: int, y: int) -> Column:
        return safe_date(full_year(part(g, y)), F.try_element_at(months, F.lower(part(g, m))), number(g, d))

    def known(text: Column, pattern: str, group: int) -> Column:
        return F.array_contains(F.map_keys(months), F.lower(F.regexp_extract(text, pattern, group)))

    def read(text: Column) -> Column:
        return (
            F.when(text.rlike(iso), let(_groups(text, iso, 3), lambda g: safe_date(number(g, 0), number(g, 1), number(g, 2))))
            .when(text.rlike(numeric), let(_groups(text, numeric, 5), by_number))
            .when(known(text, day_month, 2), let(_groups(text, day_month, 3), lambda g: by_name(g, 1, 0, 2)))
            .when(known(text, month_day, 1), let(_groups(text, month_day, 3), lambda g: by_name(g, 0, 1, 2)))
        )

    plain = F.regexp_replace(clean_inline(c), r"(?iU)([0-9])(st|nd|rd|th)\b", "$1")
    return let(F.trim(F.regexp_replace(F.replace(plain, F.lit(","), F.lit(" ")), " +", " ")), read)


def money_tokens(c: ColumnLike) -> Column:
    """Number-like pieces of a text, percentages left out."""
    bare = F.regexp_replace(col(c), r"(?U)[0-9]+(?:[.,][0-9]+)?\s*%", " ")
    return F.regexp_extract_all(bare, F.lit(r"\(?-?[0-9][0-9.,]*[0-9]\)?|\(?-?[0-9]\)?"), F.lit(0))


def last_money(c: ColumnLike) -> Column:
    """Last amount of a text that is a number."""
    numbers = F.filter(F.transform(money_tokens(c), lambda t: parse_decimal(t)), lambda n: n.isNotNull())
    return F.try_element_at(numbers, F.lit(-1))


def strip_markdown(c: ColumnLike) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\*\*|__|^#+\s*|^[-*]\s+|`", ""))


def normalise_header(c: ColumnLike) -> Column:
    one_line = strip(F.regexp_replace(col(c), r"(?U)\s+", " "))
    return F.lower(strip(F.regexp_replace(one_line, r":+$", "")))


def party_lines(c: ColumnLike) -> Column:
    """Lines without commas, semicolons and blanks at their ends; empty ones are dropped."""
    lines = F.split(F.replace(col(c), F.lit("\r"), F.lit("")), "\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[ ,;]+|[ ,;]+$", "")), lambda x: x != "")


SUFFIX = rf"(?iU)^(.*?\b{vocab.COMPANY_SUFFIX})(?=[\s,;]|$)"


def has_company_suffix(c: ColumnLike) -> Column:
    """Whether a line starts with a company name whose legal ending is capitalised."""
    return F.substring_index(F.regexp_extract(col(c), SUFFIX, 1), " ", -1).rlike(r"^\p{Lu}")


def split_party(c: ColumnLike) -> Column:
    """struct(name, address, email) of a party block."""
    value = col(c)

    def named(lines: Column, email: Column) -> Column:
        single = F.get(lines, F.lit(0))
        found = F.regexp_extract(single, SUFFIX, 1)
        rest = F.regexp_replace(F.substring(single, F.length(found) + 1, F.length(single)), r"^[ ,;]+|[ ,;]+$", "")
        name = (
            F.when(F.size(lines) > 1, single)
            .when(has_company_suffix(single), F.regexp_replace(found, r"^[ ,]+|[ ,]+$", ""))
            .when(F.instr(single, ",") > 0, F.substring_index(single, ",", 1))
            .otherwise(single)
        )
        address = (
            F.when(F.size(lines) > 1, F.array_join(F.slice(lines, F.lit(2), F.size(lines)), ", "))
            .when(has_company_suffix(single), rest)
            .when(F.instr(single, ",") > 0, F.substring(single, F.instr(single, ",") + 1, F.length(single)))
        )
        return F.struct(clean_inline(name).alias("name"), clean_inline(address).alias("address"), email.alias("email"))

    without = lambda email: F.when(email.isNotNull(), F.regexp_replace(value, r"(?U)\S+@\S+", " ")).otherwise(value)
    return let(normalize_email(value), lambda email: let(party_lines(without(email)), lambda lines: named(lines, email)))


def address_line(c: ColumnLike) -> Column:
    return clean_inline(F.array_join(party_lines(c), ", "))


def looks_like_address(c: ColumnLike) -> Column:
    line = strip(c)
    words = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""))
    return (F.length(line) <= 80) & (words <= 10) & line.rlike("[0-9,]") & ~line.rlike("[.!?]$")


def po_number(c: ColumnLike) -> Column:
    """First word with a digit, of at most 40 characters."""
    found = F.regexp_extract(col(c), r"(?i)\b([A-Z0-9][A-Z0-9\-/_.]*[0-9][A-Z0-9\-/_.]*)\b", 1)
    return F.when((found != "") & (F.length(found) <= 40), F.regexp_replace(found, r"^\.+|\.+$", ""))


def uom_of_quantity(c: ColumnLike) -> Column:
    """Unit written behind a number, upper case."""
    return blank_to_null(F.upper(F.regexp_extract(col(c), r"(?U)^[0-9.,]+\s*([A-Za-z]{1,5})$", 1)))


def close(a: ColumnLike, b: ColumnLike) -> Column:
    """Whether an amount equals another within two cents or one part in two thousand of the latter."""
    x, y = col(a).cast("decimal(30,8)"), col(b).cast("decimal(30,8)")
    return F.abs(x - y) <= F.greatest(F.lit("0.02").cast("decimal(30,8)"), (F.abs(y) * F.lit("0.0005").cast("decimal(5,4)")).cast("decimal(30,8)"))


NUMERIC_FIELDS = (*vocab.MONEY_FIELDS, "quantity", "unit_price", "line_total")
EXACT_FIELDS = ("purchase_order_number", "currency", "supplier_email", "unit_of_measure", "part_number", "line_number")


def values_match(field: ColumnLike, expected: ColumnLike, actual: ColumnLike) -> Column:
    """Equality by kind of field: number, day, exact text, else letters and digits only; NULL equals NULL only."""
    f, e, a = col(field), col(expected), col(actual)
    same = (
        F.when(f.isin(*NUMERIC_FIELDS), e.try_cast("decimal(38,10)") == a.try_cast("decimal(38,10)"))
        .when(f.isin(*vocab.DATE_FIELDS), e == a)
        .when(f.isin(*EXACT_FIELDS), strip(e) == strip(a))
        .otherwise(norm_key(e) == norm_key(a))
    )
    return F.when(e.isNull() | a.isNull(), e.isNull() & a.isNull()).otherwise(F.coalesce(same, F.lit(False)))


@cache
def label_patterns() -> tuple[tuple[str, tuple[tuple[int, str, str], ...]], ...]:
    """Label patterns (place, field, pattern) by the letters that they may begin with, for each letter that begins any."""
    patterns = [(i, field, p) for i, (field, p) in enumerate((field, p) for field, ps in vocab.HEADER_LABELS for p in ps)]
    begins = {letter: tuple(x for x in patterns if regex.fullmatch(x[2], letter, regex.IGNORECASE, partial=True)) for letter in string.ascii_lowercase}
    return tuple((letter, found) for letter, found in begins.items() if found)


def match_label(c: ColumnLike) -> Column:
    """struct(field, rest) of the longest label that a text starts with, NULL if there is none.

    Of labels of one length the first in the list counts. Only patterns that may begin with the
    text's first letter are tried.
    """

    def longest(text: Column, patterns: tuple[tuple[int, str, str], ...]) -> Column:
        hits = [F.struct(F.length(F.regexp_extract(text, rf"(?i)^\s*(?:{p})(?=$|[\s:#])", 0)).alias("n"), F.lit(-i).alias("i"), F.lit(field).alias("field")) for i, field, p in patterns]
        return F.greatest(*hits) if len(hits) > 1 else hits[0]

    def found(text: Column, letter: Column) -> Column:
        cases = F.when(~letter.between("a", "z"), None)
        for key, patterns in label_patterns():
            # most texts start with no label: one pattern of all sorts them out before the longest is sought
            of_letter = rf"(?i)^\s*(?:{'|'.join(p for _, _, p in patterns)})(?=$|[\s:#])"
            cases = cases.when(letter == key, F.when(text.rlike(of_letter), longest(text, patterns)))
        return cases

    def labelled(text: Column, best: Column) -> Column:
        rest = strip(F.regexp_replace(F.substring(text, best["n"] + 1, F.length(text)), r"(?U)^\s*(?:[:#]|[-–](?=\s))?\s*", ""))
        return F.when(best["n"] > 0, F.struct(best["field"].alias("field"), rest.alias("rest")))

    text_of = F.when(col(c).rlike("[*_#`-]"), strip_markdown(c)).otherwise(strip(c))
    begin = lambda plain: F.translate(F.substring(F.ltrim(plain), 1, 1), string.ascii_uppercase, string.ascii_lowercase)
    best_of = lambda text: let(ascii_spaces(text), lambda plain: let(begin(plain), lambda letter: found(plain, letter)))
    return let(text_of, lambda text: let(best_of(text), lambda best: labelled(text, best)))
