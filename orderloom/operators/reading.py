"""Parsed documents read row by row in Arrow batches: labels, header fields, line items.

The same rules as the column expressions of ``headers`` and ``items``, which tests hold against
them; a document costs a small part of what its nested arrays cost there. Nothing is exchanged.
Patterns: ``(?U)`` of Java's has its own classes here, ASCII texts take the faster twin.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import lru_cache
from itertools import chain as chained

import pyarrow as pa
import regex

from orderloom.functions import vocab
from orderloom.functions.orders import label_patterns
from orderloom.functions.text import BESIDE_DIGITS, SPACES

#: Java's white space, word characters and line ends in Unicode mode, and what is left of them in ASCII.
UNICODE = {"S": r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "W": r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]", "E": r"\n\r\x85\u2028\u2029"}
ASCII = {"S": r"\t-\r ", "W": r"[A-Za-z0-9_]", "E": r"\n\r"}
HEADER_FIELDS = tuple(f for f, _ in vocab.HEADER_LABELS)
ITEM_FIELDS = tuple(f for f, _ in vocab.ITEM_COLUMNS)
#: Documents that are held as Python objects at once.
STEP = 1000


def twin(pattern: str, ignore_case: bool = False) -> Callable:
    """The pattern for a text: S, W and E in angle brackets stand for the classes above."""
    put = lambda classes: re.sub("<([SWE])>", lambda m: classes[m[1]], pattern)
    plain, full = re.compile(put(ASCII), re.ASCII | re.IGNORECASE * ignore_case), regex.compile(put(UNICODE), regex.IGNORECASE * ignore_case)
    return lambda text: plain if text.isascii() else full


MARKDOWN = twin(r"\*\*|__|^#+[<S>]*|^[-*][<S>]+|`")
AFTER_LABEL = twin(r"^[<S>]*(?:[:#]|[-–](?=[<S>]))?[<S>]*")
SPACE = twin(r"[<S>]+")
SUFFIX = twin(rf"([^<E>]*?(?<!<W>){vocab.COMPANY_SUFFIX.replace(chr(92) + 's', '[<S>]')})(?=[<S>,;]|\Z)", True)
ADDRESS_WORD = twin(r"[^<S>]+@[^<S>]+")
PARTY_ENDS = twin(r"^[ ,;]+|[ ,;]+(?=[<E>]?\Z)")
NAME_ENDS = twin(r"^[ ,]+|[ ,]+(?=[<E>]?\Z)")
ORDINAL = twin(r"([0-9])(?:st|nd|rd|th)(?!<W>)", True)
ISO = twin(r"(?<!<W>)([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?!<W>)")
NUMERIC = twin(r"(?<!<W>)([0-9]{1,2})([-/.])([0-9]{1,2})([-/.])([0-9]{2,4})(?!<W>)")
DAY_MONTH = twin(r"(?<!<W>)([0-9]{1,2})[ -]([A-Za-z]{3,9})\.?[ -]([0-9]{2,4})(?!<W>)")
MONTH_DAY = twin(r"(?<!<W>)([A-Za-z]{3,9})\.? ([0-9]{1,2}) ([0-9]{4})(?!<W>)")
PERCENT = twin(r"[0-9]+(?:[.,][0-9]+)?[<S>]*%")
WHOLE = twin(r"#?[<S>]*([0-9]{1,6})[<S>]*\.?")
UNIT = twin(r"[0-9.,]+[<S>]*([A-Za-z]{1,5})")
CODE = twin(rf"(?<!<W>)(?:{'|'.join(vocab.CURRENCY_CODES)})(?!<W>)")
ASCII_BLANKS = " \t\n\r\x0b\x0c"
MONEY = re.compile(r"\(?-?[0-9][0-9.,]*[0-9]\)?|\(?-?[0-9]\)?")
PLAIN_NUMBER = re.compile(r"[0-9][0-9,]{0,20}\.[0-9]{1,9}|[0-9]{1,20}")
GROUPED = re.compile(r"[0-9]{1,3}(?:,[0-9]{3})+")
DIGIT = re.compile("[0-9]")
EMAIL = re.compile(vocab.EMAIL_PATTERN)
PO_NUMBER = re.compile(r"\b([A-Z0-9][A-Z0-9\-/_.]*[0-9][A-Z0-9\-/_.]*)\b", re.ASCII | re.IGNORECASE)
PO_NUMBER_FULL = regex.compile(r"(?<![\p{L}\p{Nd}_])([A-Za-z0-9][A-Za-z0-9\-/_.]*[0-9][A-Za-z0-9\-/_.]*)(?:(?<=[A-Za-z0-9_])(?![\p{L}\p{Nd}_])|(?<=[\-/.])(?=[\p{L}\p{Nd}_]))")
DROPPED = str.maketrans("", "", BESIDE_DIGITS)
BLANKS = str.maketrans(SPACES, " " * len(SPACES))
FITS, TENTH = Context(prec=80, rounding=ROUND_HALF_UP), Decimal("1e-10")
#: All that a label may hold, and the character behind it, which ends it.
HEAD = re.compile(r"[A-Za-z\s.#&-]*[^A-Za-z\s.#&-]?", re.ASCII)
LABELS = {letter: [(re.compile(rf"\s*(?:{p})(?=\Z|[\s:#])", re.ASCII | re.IGNORECASE), -i, field) for i, field, p in patterns] for letter, patterns in label_patterns()}
LABELS |= {letter.upper(): patterns for letter, patterns in LABELS.items()}
#: First characters of a stripped text that may be a label.
BEGINS = frozenset("".join(LABELS) + "*_#`-")
COLUMNS = [("_item", re.compile(vocab.ITEM_HEADING, re.ASCII)), *((f, re.compile("|".join(ps), re.ASCII)) for f, ps in vocab.ITEM_COLUMNS)]
ANY_COLUMN = re.compile("|".join(p.pattern for _, p in COLUMNS), re.ASCII)
BLOCK_FIELDS = frozenset((*vocab.PARTY_FIELDS, *vocab.ADDRESS_FIELDS))
MONEY_FIELDS = frozenset(vocab.MONEY_FIELDS)


def inline(text: str | None) -> str | None:
    return " ".join(text.split()) or None if text else None


def strip_markdown(text: str) -> str:
    marked = "*" in text or "_" in text or "`" in text or text[:1] in ("#", "-")
    return (MARKDOWN(text).sub("", text) if marked else text).strip()


def _longest(head: str) -> tuple[int, str] | None:
    best = max(((m.end(), i, field) for p, i, field in LABELS[head[0]] if (m := p.match(head))), default=None)
    return best and (best[0], best[2])


def _by_head(head: str) -> tuple[int, str] | bool | None:
    """(length, field) of the label, None if there is none, False if the head doesn't tell: it may end in a mark or in other white space."""
    return _longest(head) if head[0] in LABELS and head.isascii() and head[-1] not in "*_`\x1c\x1d\x1e\x1f" else False


_kept_by_head = lru_cache(20_000)(_by_head)


def after_label(text: str) -> str:
    """The rest of a text behind its label, without a colon, hash or dash."""
    if not text.isascii():
        return AFTER_LABEL(text).sub("", text, count=1).strip()
    text = text.lstrip(ASCII_BLANKS)
    if text[:1] in (":", "#") or text[:1] == "-" and text[1:2] in ASCII_BLANKS and len(text) > 1:
        text = text[1:]
    return text.strip()


def match_label(text: str, whole: str | None = None) -> tuple[str, str] | None:
    """(field, rest) of the longest label that a text starts with; ``text`` is without outer white space, ``whole`` with it, if it has any."""
    if text[:1] not in BEGINS:
        return None
    head = HEAD.match(text)[0]
    best = _kept_by_head(head) if len(head) < 60 else _by_head(head)
    if best is None:
        return None
    text = strip_markdown(whole or text)
    if best is False:
        if text[:1] not in LABELS:
            return None
        best = _longest(HEAD.match(text.translate(BLANKS))[0])
    if best is None:
        return None
    rest = text[best[0] :]
    return best[1], rest[2:].strip() if rest[:2] == ": " else rest and after_label(rest)


def decimal_text(text: str | None) -> str | None:
    """Number in any usual notation, as text that a cast to decimal(38,10) reads."""
    if not text:
        return None
    if PLAIN_NUMBER.fullmatch(text):
        return text.replace(",", "")
    text = text.strip()
    bare = text.translate(DROPPED)
    if not bare or bare.strip("0123456789.,") or not bare.strip(".,"):
        return None
    comma, point = bare.rfind(","), bare.rfind(".")
    if comma >= 0 and point >= 0:
        number = bare.replace(".", "").replace(",", ".") if comma > point else bare.replace(",", "")
    elif comma >= 0:
        number = bare.replace(",", "") if GROUPED.fullmatch(bare) else bare[:comma].replace(",", "") + "." + bare[comma + 1 :]
    else:
        number = bare.replace(".", "") if bare.count(".") > 1 else bare
    if number.count(".") > 1 or len(whole := number.partition(".")[0].lstrip("0")) > 28 or len(whole) == 28 and FITS.quantize(Decimal(number), TENTH) >= 10**28:
        return None
    return "-" + number if text[0] == "(" and text[-1] == ")" or text[0] == "-" or text[-1] == "-" else number


def last_money(text: str) -> str | None:
    tokens = MONEY.findall(PERCENT(text).sub(" ", text) if "%" in text else text)
    return next((n for t in reversed(tokens) if (n := decimal_text(t)) is not None), None)


def safe_date(year: int, month: int, day: int) -> str | None:
    try:
        return datetime.date(year, month, day).isoformat()
    except ValueError:
        return None


def full_year(text: str) -> int:
    year = int(text)
    return year + 2000 if year < 100 else year


@lru_cache(20_000)
def parse_date(value: str | None, order: str) -> str | None:
    text = inline(value)
    if text is None:
        return None
    text = ORDINAL(text).sub(r"\1", text)
    text = re.sub(" +", " ", text.replace(",", " ")).strip(" ")
    if m := ISO(text).search(text):
        return safe_date(int(m[1]), int(m[2]), int(m[3]))
    if m := NUMERIC(text).search(text):
        a, b, year = int(m[1]), int(m[3]), full_year(m[5])
        day_first = True if a > 12 >= b else False if b > 12 >= a else "." in (m[2], m[4]) if order == "MDY" else True
        return safe_date(year, b, a) if day_first else safe_date(year, a, b)
    if (m := DAY_MONTH(text).search(text)) and m[2].lower() in vocab.MONTHS:
        return safe_date(full_year(m[3]), vocab.MONTHS[m[2].lower()], int(m[1]))
    if (m := MONTH_DAY(text).search(text)) and m[1].lower() in vocab.MONTHS:
        return safe_date(full_year(m[3]), vocab.MONTHS[m[1].lower()], int(m[2]))
    return None


def detect_currency(text: str) -> str | None:
    upper = text.upper()
    # most texts hold none of the codes: told without a search at each place
    if any(code in upper for code in vocab.CURRENCY_CODES) and (m := CODE(upper).search(upper)):
        return m[0]
    return next((code for sign, code in vocab.CURRENCY_SYMBOLS.items() if sign in text), None)


def po_number(text: str) -> str | None:
    m = (PO_NUMBER if text.isascii() else PO_NUMBER_FULL).search(text)
    return m[1].strip(".") if m and len(m[1]) <= 40 else None


def email_of(text: str) -> str | None:
    m = EMAIL.search(text) if "@" in text else None
    return m and m[0].lower()


def party_lines(text: str) -> list[str]:
    ends = lambda x: x.strip(" ,;") if x.isascii() else PARTY_ENDS(x).sub("", x)
    return [x for line in text.replace("\r", "").split("\n") if (x := ends(line))]


def company(line: str) -> str | None:
    """The company that a line starts with, if its legal ending is capitalised."""
    m = SUFFIX(line).match(line)
    last = m and m[1].rpartition(" ")[2][:1]
    return m[1] if last and unicodedata.category(last) == "Lu" else None


def split_party(value: str) -> tuple[str | None, str | None, str | None]:
    """(name, address, email) of a party block."""
    email = email_of(value)
    lines = party_lines(ADDRESS_WORD(value).sub(" ", value) if email else value)
    if not lines:
        return None, None, email
    single = lines[0]
    if len(lines) > 1:
        return inline(single), inline(", ".join(lines[1:])), email
    if found := company(single):
        return inline(NAME_ENDS(found).sub("", found)), inline(PARTY_ENDS(single).sub("", single[len(found) :])), email
    name, _, address = single.partition(",")
    return inline(name), inline(address), email


def address_line(value: str) -> str | None:
    return inline(", ".join(party_lines(value)))


def looks_like_address(line: str) -> bool:
    return len(line) <= 80 and line[-1:] not in (".", "!", "?") and any(c in "0123456789," for c in line) and sum(map(bool, SPACE(line).split(line))) <= 10


def typed_value(field: str, value: str, order: str) -> tuple[str | None, str | None, str | None]:
    """(text, address, email) of a candidate; text None if it is of no use."""
    if field in vocab.PARTY_FIELDS:
        return split_party(value)
    return parse_date(value, order) if field in vocab.DATE_FIELDS else TYPES.get(field, inline)(value), None, None


TYPES = {"purchase_order_number": po_number, "currency": detect_currency, "supplier_email": email_of} | dict.fromkeys(vocab.MONEY_FIELDS, last_money) | dict.fromkeys(vocab.ADDRESS_FIELDS, address_line)


def normalise_header(text: str) -> str:
    return SPACE(text).sub(" ", text).strip().rstrip(":").strip().lower()


@lru_cache(20_000)
def column_field(cell: str) -> str | None:
    header = normalise_header(cell)
    # most cells head no column: one pattern of all sorts them out
    return next(f for f, p in COLUMNS if p.fullmatch(header)) if ANY_COLUMN.fullmatch(header) else None


def row_mapping(row: list[str]) -> dict[str, int]:
    """Item fields (and ``_item``) of a row read as a heading: the first column of a field counts."""
    named: dict[str, int] = {}
    for c, cell in enumerate(row):
        # no heading has a digit
        if DIGIT.search(cell):
            continue
        if len(cell) < 60 and (field := column_field(cell)) or len(cell) >= 60 and (field := column_field.__wrapped__(cell)):
            named.setdefault(field, c)
    return named


def heading(rows: list[list[str]]) -> tuple[int, dict[str, int]] | None:
    """(row, mapping of item fields) of the first of three rows that is an item heading."""
    for r, row in enumerate(rows[:3]):
        if len(row) < 3:
            continue
        m = row_mapping(row)
        if len(m) >= 3 and ("part_name" in m or "part_number" in m or "_item" in m) and ("quantity" in m or "unit_price" in m and "line_total" in m):
            if "_item" in m:
                at = m.pop("_item")
                values = [row[at] for row in rows[r + 1 :] if at < len(row) and row[at]]
                if "line_number" not in m and values and all(WHOLE(x).fullmatch(x) for x in values):
                    m["line_number"] = at
                elif free := next((f for f in ("part_number", "part_name") if f not in m), None):
                    m[free] = at
            return r, m
    return None


class Table:
    """A grid with its labels by row and column; ``chain`` adds header_r, mapping, totals and repeated."""

    __slots__ = ("header_r", "labels", "mapping", "repeated", "rows", "totals")

    def __init__(self, rows: list[list[str]]) -> None:
        self.rows = rows
        self.labels = {(r, c): found for r, row in enumerate(rows) for c, x in enumerate(row) if x[:1] in BEGINS and (found := match_label(x))}


def repeated(rows: list[list[str]], at: int) -> set[int]:
    """Rows below a heading that repeat it, cell by cell."""
    head, found = rows[at], set()
    first = head[0][:1].lower()
    for r in range(at + 1, len(rows)):
        row = rows[r]
        if len(row) == len(head) and ((own := row[0][:1].lower()) == first or own == ":" or first == ":") and all(x == y or normalise_header(x) == normalise_header(y) for x, y in zip(row, head, strict=True)):
            found.add(r)
    return found


def chain(tables: list[Table]) -> None:
    """Headings: a table without one continues the item table before it, with header_r -1, if it is as wide and holds few labels."""
    mapping, width, live = None, 0, False
    for t in tables:
        wide, found = max(map(len, t.rows), default=0), heading(t.rows)
        if found:
            (t.header_r, mapping), width, live = found, wide, True
        elif live and wide == width and len(t.labels) < max(1, len(t.rows) // 2):
            t.header_r = -1
        else:
            t.header_r, mapping, live = None, None, False
        t.mapping, t.repeated, t.totals = mapping, set(), set()
        if live:
            if t.header_r >= 0:
                t.repeated = repeated(t.rows, t.header_r)
            t.totals = {r for (r, _), (field, _) in t.labels.items() if field in MONEY_FIELDS and r > t.header_r and r not in t.repeated}


def text_candidates(lines: list[tuple[str, tuple | None]]) -> Iterator[tuple[str, str | None, str, int]]:
    """(field, value, evidence, priority) on or below label lines, in order of place."""
    for i, (line, found) in enumerate(lines):
        if not found:
            continue
        field, rest = found
        evidence = line.strip()
        if field in BLOCK_FIELDS:
            if not rest:
                following = []
                for ahead, label in lines[i + 1 : i + 5]:
                    if label:
                        break
                    following.append(strip_markdown(ahead))
                rest = "\n".join(following)
            yield field, rest or None, evidence, 0
            continue
        yield field, rest or None, evidence, 0
        if i + 1 < len(lines) and not lines[i + 1][1] and (below := strip_markdown(lines[i + 1][0])):
            yield field, below, f"{evidence} / {below}", 1


def table_candidates(tables: list[Table]) -> Iterator[tuple[str, str | None, str, int]]:
    """The same in, right of or below label cells; of item tables only the totals rows count, if there are any."""
    for t in tables:
        for (r, c), (field, rest) in t.labels.items():
            if t.header_r is not None and t.totals and r not in t.totals:
                continue
            row = t.rows[r]
            cell = row[c]
            if rest:
                yield field, rest, cell, 0
            beside = next((k for k in range(c + 1, len(row)) if row[k]), None)
            if beside is not None and (r, beside) not in t.labels:
                yield field, row[beside], f"{cell} | {row[beside]}", 0
            elif r + 1 < len(t.rows) and c < len(t.rows[r + 1]) and (under := t.rows[r + 1][c]) and (r + 1, c) not in t.labels:
                yield field, under, f"{cell} / {under}", 1


def letterhead(lines: list[tuple[str, tuple | None]]) -> tuple[str | None, str | None, str] | None:
    """(name, address, line): a company in the first six lines, before any labelled value."""
    for n, (line, found) in enumerate(lines[:6]):
        if found and found[1]:
            return None
        line = line.strip()
        if found or not company(line):
            continue
        below = []
        for ahead, label in lines[n + 1 : n + 4]:
            if label or not looks_like_address(ahead.strip()):
                break
            below.append(ahead.strip())
        name, address, _ = split_party(line)
        if address is None and below:
            name, address, _ = split_party("\n".join([line, *below]))
        return name, address, line
    return None


def header(blocks: list[str | None], lines: list, tables: list[Table], order: str) -> tuple[dict, dict, list[str]]:
    """Values and evidence by field, warnings."""
    met, best, beside, later = {}, {}, {}, []

    def use(field: str, value: str, evidence: str) -> None:
        typed = typed_value(field, value, order)
        if typed[0] is not None:
            best[field], beside[field] = (typed[0], evidence), typed

    for at, (field, value, evidence, priority) in enumerate((*text_candidates(lines), *table_candidates(tables))):
        met.setdefault(field, at)
        if value is not None and field not in best:
            if priority:
                later.append((field, value, evidence))
            else:
                use(field, value, evidence)
    for x in later:
        if x[0] not in best:
            use(*x)
    for field, party, part in (("supplier_address", "supplier_name", 1), ("supplier_email", "supplier_name", 2), ("buyer_address", "buyer_name", 1)):
        if party in best and (said := beside[party][part]) is not None and (field not in best or met[party] < met[field]):
            best[field] = said, best[party][1]
    warnings = []
    if "buyer_name" not in beside and (letter := letterhead(lines)):
        name, address, line = letter
        warnings.append(vocab.LETTERHEAD_WARNING)
        if name is not None:
            best["buyer_name"] = name, line
        if address is not None and "buyer_address" not in best:
            best["buyer_address"] = address, None
    if "currency" not in best:
        corpus = "\n".join([*(b for b in blocks if b is not None), *chained.from_iterable(row for t in tables for row in t.rows)])
        if code := detect_currency(corpus):
            best["currency"] = code, vocab.BODY_CURRENCY
        elif "$" in corpus:
            warnings.append(vocab.DOLLAR_WARNING)
    warnings += [f"{f} {vocab.MISSING_WARNING}" for f in ("purchase_order_number", "supplier_name", "order_date", "total_amount") if f not in best]
    return {f: v for f, (v, _) in best.items()}, {f: e for f in HEADER_FIELDS if f in best and (e := best[f][1]) is not None}, warnings


def typed_row(row: list[str], places: list[int], order: str) -> list:
    """One row as an item: values in the order of ITEM_FIELDS, whose columns are ``places`` (-1: none)."""
    number, part, name, quantity, unit, price, total, day = [" ".join(row[c].split()) or None if 0 <= c < len(row) else None for c in places]
    number = number and WHOLE(number).fullmatch(number)
    if unit:
        unit = unit.upper()
    elif quantity and (behind := UNIT(quantity).fullmatch(quantity)):
        unit = behind[1].upper()
    return [int(number[1]) if number else None, part, name, decimal_text(quantity), unit, decimal_text(price), decimal_text(total), parse_date(day, order) if day else None]


def line_items(tables: list[Table], order: str) -> tuple[list[list], bool]:
    """Items in document order, and whether their numbers were given here."""
    items: list[list] = []
    amount = lambda x: x is not None and x.strip("-0.") != "" and FITS.quantize(Decimal(x), TENTH) != 0
    names: list = []
    for t in tables:
        if t.header_r is None:
            continue
        places = [t.mapping.get(f, -1) for f in ITEM_FIELDS]
        for r in range(t.header_r + 1, len(t.rows)):
            if r in t.totals or r in t.repeated:
                continue
            x = typed_row(t.rows[r], places, order)
            _, part, name, quantity, _, price, total, _ = x
            if not (part or name or amount(quantity) or amount(price) or amount(total)):
                continue
            if items and name is not None and part is None and quantity is None and price is None and total is None:
                names[-1].append(name)
            else:
                items.append(x)
                names.append([name] if name is not None else [])
    for x, said in zip(items, names, strict=True):
        x[2] = " ".join(said) or None
    given = bool(items) and all(x[0] is None for x in items)
    if given:
        for n, x in enumerate(items, 1):
            x[0] = n
    return items, given


def _nested(column: pa.Array) -> tuple[list[int], pa.Array]:
    """Lengths of the lists of a column, NULL as 0, and all their values."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).tolist(), column.flatten()


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[list[str | None], list[list[list[str]]]]]:
    """Text blocks and stripped grids of each document."""
    counts, texts = _nested(batch.column("text_blocks"))
    per_document, tables = _nested(batch.column("tables"))
    per_table, rows = _nested(tables.flatten()[tables.type.get_field_index("rows")])
    per_row, cells = _nested(rows)
    texts, cells = (x.to_numpy(zero_copy_only=False).tolist() for x in (texts, cells))
    at = table = row = cell = 0
    for n, of_tables in zip(counts, per_document, strict=True):
        grids = []
        for size in per_table[table : table + of_tables]:
            grid = []
            for width in per_row[row : row + size]:
                grid.append([x.strip() if x else "" for x in cells[cell : cell + width]])
                cell += width
            row += size
            grids.append(grid)
        table += of_tables
        yield texts[at : at + n], grids
        at += n


def read_batches(date_order: str, with_items: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function over batches of (document_id, text_blocks, tables): header fields as text, evidence, warnings, and on demand items and numbers_given."""
    kinds = [pa.int32() if f == "line_number" else pa.string() for f in ITEM_FIELDS]

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        values: list[list] = [[] for _ in HEADER_FIELDS]
        columns = list(zip(HEADER_FIELDS, values, strict=True))
        keys, sources, notes, items, given, ends, note_ends, item_ends = [], [], [], [], [], [0], [0], [0]
        for blocks, grids in _documents(batch):
            lines = [(line, match_label(bare, line)) for b in blocks if b for line in b.split("\n") if (bare := line.strip())]
            tables = [Table(rows) for rows in grids]
            chain(tables)
            found, evidence, warnings = header(blocks, lines, tables, date_order)
            for f, column in columns:
                column.append(found.get(f))
            keys += evidence
            sources += evidence.values()
            ends.append(len(keys))
            notes += warnings
            note_ends.append(len(notes))
            if with_items:
                own, numbered = line_items(tables, date_order)
                items += own
                item_ends.append(len(items))
                given.append(numbered)
        strings = lambda x: pa.array(x, pa.string())
        offsets = lambda x: pa.array(x, pa.int32())
        made = {"document_id": batch.column("document_id")} | {f: strings(v) for f, v in columns}
        made["evidence"] = pa.MapArray.from_arrays(offsets(ends), strings(keys), strings(sources))
        made["warnings"] = pa.ListArray.from_arrays(offsets(note_ends), strings(notes))
        if with_items:
            parts = [pa.array([x[k] for x in items], kind) for k, kind in enumerate(kinds)]
            seq = [n for a, b in zip(item_ends, item_ends[1:], strict=False) for n in range(1, b - a + 1)]
            made["items"] = pa.ListArray.from_arrays(offsets(item_ends), pa.StructArray.from_arrays([pa.array(seq, pa.int32()), *parts], ["seq", *ITEM_FIELDS]))
            made["numbers_given"] = pa.array(given, pa.bool_())
        return pa.RecordBatch.from_pydict(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                yield read(batch.slice(at, STEP))

    return run
