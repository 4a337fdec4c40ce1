"""Text normalisation as Column expressions (nothing leaves the JVM).

Every function takes a Column (or a column name) and returns a Column; NULL in gives NULL out
unless stated. Patterns use ``(?U)`` wherever white space has to mean Unicode white space.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.vocab import CURRENCY_CODES, CURRENCY_SYMBOLS, EMAIL_PATTERN

ColumnLike = Column | str

#: Unicode white space beyond ASCII, and all of it. Single characters are translated or trimmed: patterns
#: in Unicode mode cost several times as much.
SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = " \t\n\x0b\x0c\r" + SPACES
#: What a number may hold besides its digits and marks.
BESIDE_DIGITS = string.ascii_letters + "$€£₹¥()'+-" + WHITE


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: ColumnLike) -> Column:
    return F.nullif(col(c), F.lit(""))


def strip(c: ColumnLike) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(col(c), F.lit(WHITE))


def ascii_spaces(c: ColumnLike) -> Column:
    """Every Unicode white space as one blank; the length stays."""
    return F.translate(col(c), SPACES, " " * len(SPACES))


def clean_text(c: ColumnLike) -> Column:
    """Collapse blanks, tabs and no-break spaces inside lines, drop empty lines; empty text is NULL."""
    spaced = F.regexp_replace(F.replace(col(c), F.lit("\r"), F.lit("")), "[ \t ]+", " ")
    trimmed = F.regexp_replace(spaced, r"(?Um)^\s+|[\s&&[^\n]]+$", "")
    return blank_to_null(strip(F.regexp_replace(trimmed, r"\n{2,}", "\n")))


def clean_inline(c: ColumnLike) -> Column:
    """Collapse all Unicode white space to single blanks; empty text is NULL."""
    return blank_to_null(F.trim(F.regexp_replace(ascii_spaces(c), r"[\s\x0b]+", " ")))


def normalize_email(c: ColumnLike) -> Column:
    """First e-mail address, lower-cased, else NULL."""
    return F.lower(blank_to_null(F.regexp_extract(col(c), EMAIL_PATTERN, 0)))


def find_emails(c: ColumnLike) -> Column:
    """All e-mail addresses, lower-cased, in order of first appearance; NULL text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(EMAIL_PATTERN), F.lit(0))
    return F.array_distinct(found)


def parse_decimal(c: ColumnLike, kind: str = "decimal(38,10)") -> Column:
    """Number in any usual notation; NULL where the text is no number.

    Letters, currency signs, white space, brackets, quotes and signs are ignored wherever they
    stand; brackets around or a minus at either end negate. With both marks the later one is the
    decimal mark; a lone comma groups thousands only in a full 3-digit grouping; several points
    group thousands.
    """
    return let(strip(c), lambda text: let(F.translate(text, BESIDE_DIGITS, ""), lambda bare: _number(text, bare, kind)))


def _number(text: Column, bare: Column, kind: str) -> Column:
    negative = (text.startswith("(") & text.endswith(")")) | text.startswith("-") | text.endswith("-")
    comma, point = bare.contains(","), bare.contains(".")
    comma_decimal = F.regexp_replace(F.replace(bare, F.lit("."), F.lit("")), ",", ".")
    point_decimal = F.replace(bare, F.lit(","), F.lit(""))
    last_comma = F.regexp_replace(F.regexp_replace(bare, r",(?=.*,)", ""), ",", ".")
    plain = (
        F.when(comma & point, F.when(bare.rlike(r",[^.]*$"), comma_decimal).otherwise(point_decimal))
        .when(comma, F.when(bare.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), point_decimal).otherwise(last_comma))
        .when(bare.rlike(r"\..*\."), F.replace(bare, F.lit("."), F.lit("")))
        .otherwise(bare)
    )
    number = F.when(bare.rlike("[0-9]") & ~bare.rlike("[^0-9.,]"), plain).try_cast(kind)
    return F.when(negative, -number).otherwise(number).cast(kind)


def parse_int(c: ColumnLike) -> Column:
    """Whole number of up to six digits, optionally as ``#7`` or ``7.``."""
    digits = F.regexp_extract(col(c), r"(?U)^\s*#?\s*([0-9]{1,6})\s*\.?\s*$", 1)
    return blank_to_null(digits).try_cast("int")


def detect_currency(c: ColumnLike) -> Column:
    """First ISO code of the known set in text order, else an unambiguous sign."""
    words = F.regexp_extract_all(F.upper(col(c)), F.lit(r"(?U)\b[A-Z]{3}\b"), F.lit(0))
    first = F.try_element_at(F.filter(words, lambda w: w.isin(*CURRENCY_CODES)), F.lit(1))
    signs = [F.when(col(c).contains(sign), F.lit(code)) for sign, code in CURRENCY_SYMBOLS.items()]
    return F.coalesce(first, *signs)


def norm_key(c: ColumnLike) -> Column:
    """Lower case, ASCII letters and digits only; NULL gives the empty key."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]", "")


def dedupe_key(po_number: ColumnLike, supplier: ColumnLike, buyer: ColumnLike) -> Column:
    return F.concat_ws("|", norm_key(po_number), norm_key(supplier), norm_key(buyer))
