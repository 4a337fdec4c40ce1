"""Dates and instants written in any usual way, brought to one form.

Each value is reduced to a shape mask (its character classes). Values are grouped by mask; a mask
and the kinds of its words are mapped to a parser once, and the parser then converts all values of
the group at once: digits are read from fixed positions of a character matrix, local times go
through versioned zone transition tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.operators.zones import ZoneTable, zone_table
from orderloom.session import broadcast_if_small

# Month names and short forms (English, German, Spanish, Polish, French, Italian, Portuguese, Dutch).
MONTH_LINES = """
jan january januar jänner enero ene stycznia styczeń sty janvier janv gennaio gen janeiro januari
feb february februar febrero lutego luty lut février fevrier févr febbraio fevereiro fev februari
mar march märz maerz mär mrz marzo marca marzec mars março marco maart mrt
apr april abril abr kwietnia kwiecień kwi avril avr aprile
may mai mayo maja maj maggio mag maio mei
jun june juni junio czerwca czerwiec cze juin giugno giu junho
jul july juli julio lipca lipiec lip juillet juil luglio lug julho
aug august agosto ago sierpnia sierpień sie août aout augustus
sep sept september septiembre septembre settembre set setembro września wrzesień wrz
oct october oktober okt octubre octobre ottobre ott outubro out października październik paź
nov november noviembre novembre novembro listopada listopad lis
dec december dezember dez diciembre dic décembre dicembre dezembro grudnia grudzień gru
"""

# Zone abbreviations and their offsets in minutes.
ZONE_MINUTES = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "met": 60, "cest": 120, "mest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "sast": 120, "ist": 330, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

# Weekday names and short forms in the languages of the months.
WEEKDAYS = frozenset("""
mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday saturday sunday
mo di mi do fr sa so montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag
lun mar mié mie jue vie sáb sab dom lunes martes miércoles miercoles jueves viernes sábado sabado domingo
pon wt śr sr czw pt sob niedz nd poniedziałek wtorek środa czwartek piątek sobota niedziela
mer jeu ven sam dim lundi mardi mercredi jeudi vendredi samedi dimanche
gio lunedì lunedi martedì martedi mercoledì mercoledi giovedì giovedi venerdì venerdi domenica
seg ter qua qui sex segunda terça terca quarta quinta sexta feira
ma woe wo vr za zo maandag dinsdag woensdag donderdag vrijdag zaterdag zondag
""".split())
FILLERS = frozenset("at de del of uhr h r um a las alle à".split())
MONTH_OF = {name: i + 1 for i, line in enumerate(MONTH_LINES.strip().splitlines()) for name in line.split()}

#: Word kinds: b month, d weekday, p a.m./p.m., z zone, o ordinal suffix, f filler, T, W as they are, ? any other.
CODES = {"b": 1, "d": 2, "p": 3, "z": 4, "o": 5, "f": 6, "T": 7, "W": 8, "?": 9}


def word_kind(word: str) -> tuple[str, int]:
    """Kind of a word and its value (month, minutes of a zone, hours to add)."""
    low = word.lower()
    if word in ("T", "W"):
        return word, 0
    if low in MONTH_OF:
        return "b", MONTH_OF[low]
    if low in ZONE_MINUTES:
        return "z", ZONE_MINUTES[low]
    if low in ("am", "pm"):
        return "p", 12 if low == "pm" else 0
    if low in ("st", "nd", "rd", "th"):
        return "o", 0
    if low in WEEKDAYS:
        return "d", 0
    return ("f", 0) if low in FILLERS else ("?", 0)


# A shape is a mask with its words replaced by kinds and its white space by one blank; N1..N9 are digit runs.
DATES = (
    (r"N4[-/.]N[12][-/.]N[12]", "ymd"), (r"N8", "ymd8"), (r"N4-?WN2-?N1", "week"),
    (r"N[12][-/.]N[12][-/.]N4", "num"), (r"N[12][-/.]N[12][-/.]N2", "num2"),
    (r"(?:d(?:-d)?\.?,? )?N[12]o?\.?(?: of| f|)[ -]b\.?,?(?: f|)[ -]N4(?: f\.?)?", "dby"), (r"(?:d(?:-d)?\.?,? )?N[12][ -]b\.?[ -]N2", "dby2"),
    (r"(?:d,? )?b\.? N[12]o?,? N4", "bdy"),
)
TIME = r"N[12]:N2(?::N2(?:[.,]N[1-9])?)?(?: ?p)?"
OFFSET = r"(?: ?[+-]N4| ?[+-]N[12](?::N2)?| ?z[+-]N[12](?::N2)?| ?z)"
INSTANTS = tuple((rf"{d}(?:T|,? (?:f )?| f )(?:{TIME}|N[46])(?:{OFFSET})?(?: f\.?)?", name) for d, name in DATES) + (
    (rf"d b N[12] {TIME}(?: z)? N4", "unix"), (r"N10", "epoch"), (r"N13", "epoch_ms"),
)
DATE_SHAPES = tuple((re.compile(f"(?:{p})"), name) for p, name in DATES)
INSTANT_SHAPES = tuple((re.compile(f"(?:{p})"), name) for p, name in INSTANTS)


@dataclass
class Token:
    kind: str
    start: int
    end: int


def tokens_of(mask: str) -> list[Token]:
    """Digit runs, words, white space and single signs of a mask, with their places."""
    return [Token("N" if m[0][0] == "9" else "a" if m[0][0] == "a" else " " if m[0].isspace() else m[0], m.start(), m.end()) for m in re.finditer(r"9+|a+|\s+|.", mask, re.S)]


class Matrix:
    """Characters of equally long values, one row each."""

    def __init__(self, values: np.ndarray, width: int):
        self.chars = np.ascontiguousarray(values.astype(f"<U{width}")).view(np.uint32).reshape(len(values), width)

    def number(self, token: Token) -> np.ndarray:
        out = np.zeros(len(self.chars), dtype=np.int64)
        for i in range(token.start, min(token.end, token.start + 18)):
            out = out * 10 + (self.chars[:, i].astype(np.int64) - 48)
        return out

    def words(self, token: Token) -> np.ndarray:
        part = np.ascontiguousarray(self.chars[:, token.start : token.end])
        return part.view(f"<U{token.end - token.start}").reshape(-1)


def day_number(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the day exists."""
    real = (year >= 1) & (year <= 9999) & (month >= 1) & (month <= 12) & (day >= 1)
    y, m = np.where(real, year, 1970), np.where(real, month, 1)
    first = ((y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1).astype("timedelta64[M]"))
    length = ((first + np.timedelta64(1, "M")).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    real &= day <= length
    return first.astype("datetime64[D]").astype(np.int64) + np.where(real, day, 1) - 1, real


def _swap(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Month, day and whether they are certain: the larger part, else the source's order, decides."""
    day_first = np.where((a > 12) & (b <= 12), True, np.where((b > 12) & (a <= 12), False, order == "DMY"))
    certain = (a == b) | (a > 12) | (b > 12) | np.isin(order, ("DMY", "MDY"))
    return np.where(day_first, b, a), np.where(day_first, a, b), certain


#: Parts (numbers, words, signs) of the longest shape and letters of the longest part, with room to spare.
PARTS, PART_CHARS = 60, 40


class Reader:
    """Converts batches of values; a shape is mapped to its parser once for the life of the reader."""

    def __init__(self, zones: ZoneTable, instants: bool):
        self.zones, self.shapes, self.instants = zones, INSTANT_SHAPES if instants else DATE_SHAPES + INSTANT_SHAPES, instants
        self.known: dict[str, str | None] = {}
        self.kinds: dict[str, tuple[str, int]] = {}

    def parser(self, shape: str) -> str | None:
        if shape not in self.known:
            self.known[shape] = next((name for pattern, name in self.shapes if pattern.fullmatch(shape)), None)
        return self.known[shape]

    def read(self, values: pd.Series, masks: pd.Series, order: np.ndarray, zone: np.ndarray) -> np.ndarray:
        """Normal forms, None where a value denotes nothing."""
        out = np.full(len(values), None, dtype=object)
        codes, distinct = pd.factorize(masks)
        by_code = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[by_code], np.arange(len(distinct) + 1))
        raw = values.to_numpy(dtype=object)
        for k, mask in enumerate(distinct):
            rows = by_code[bounds[k] : bounds[k + 1]]
            if len(mask) > 3 and "9" in mask:
                self._group(mask, rows, raw, order, zone, out)
        return out

    def _group(self, mask: str, rows: np.ndarray, raw: np.ndarray, order: np.ndarray, zone: np.ndarray, out: np.ndarray) -> None:
        tokens = tokens_of(mask)
        # no shape has so many parts or so long ones; other texts, however long, make no character matrix
        if len(tokens) > PARTS or max(t.end - t.start for t in tokens) > PART_CHARS:
            return
        matrix = Matrix(raw[rows], len(mask))
        word_tokens = [t for t in tokens if t.kind == "a"]
        signature = np.zeros(len(rows), dtype=np.int64)
        worth: dict[int, np.ndarray] = {}
        for t in word_tokens:
            names, inverse = np.unique(matrix.words(t), return_inverse=True)
            for name in names:
                if name not in self.kinds:
                    self.kinds[name] = word_kind(str(name))
            signature = signature * 10 + np.array([CODES[self.kinds[n][0]] for n in names])[inverse]
            worth[t.start] = np.array([self.kinds[n][1] for n in names], dtype=np.int64)[inverse]
        letters = {v: k for k, v in CODES.items()}
        for sig in np.unique(signature):
            kinds = iter([letters[int(c)] for c in str(sig)] if word_tokens else [])
            marks = [(next(kinds) if t.kind == "a" else t.kind, t) for t in tokens]
            if marks[0][0] == "b" and sum(k == "b" for k, _ in marks) > 1:
                # "mar. 3 mars": short for a weekday too
                marks[0] = ("d", marks[0][1])
            # a zone name in brackets after an offset says nothing more
            shape = re.sub(r"\[.*\]$", "", "".join(f"N{t.end - t.start}" if k == "N" else k for k, t in marks)).strip()
            if (name := self.parser(shape)) is not None:
                chosen = np.flatnonzero(signature == sig)
                sub = Matrix(raw[rows[chosen]], len(mask))
                self._convert(name, marks, sub, {s: w[chosen] for s, w in worth.items()}, rows[chosen], order, zone, out)

    def _convert(self, name: str, marks: list, m: Matrix, worth: dict, rows: np.ndarray, order: np.ndarray, zone: np.ndarray, out: np.ndarray) -> None:
        cut = next((i for i, (k, _) in enumerate(marks) if k == "["), len(marks))
        marks = marks[:cut]
        digits = [t for k, t in marks if k == "N"]
        of = lambda kind: next((t for k, t in marks if k == kind), None)
        n = len(m.chars)
        certain = np.ones(n, dtype=bool)
        if name in ("epoch", "epoch_ms"):
            self._emit(rows, m.number(digits[0]) // (1 if name == "epoch" else 1000), certain, out)
            return
        if name == "ymd":
            year, month, day, used = m.number(digits[0]), m.number(digits[1]), m.number(digits[2]), 3
        elif name == "ymd8":
            whole = m.number(digits[0])
            year, month, day, used = whole // 10000, whole // 100 % 100, whole % 100, 1
        elif name in ("num", "num2"):
            month, day, certain = _swap(m.number(digits[0]), m.number(digits[1]), order[rows])
            year, used = m.number(digits[2]) + (2000 if name == "num2" else 0), 3
        elif name in ("dby", "dby2"):
            day, month, year, used = m.number(digits[0]), worth[of("b").start], m.number(digits[1]) + (2000 if name == "dby2" else 0), 2
        elif name == "bdy":
            day, month, year, used = m.number(digits[0]), worth[of("b").start], m.number(digits[1]), 2
        elif name == "unix":
            day, month, year, used = m.number(digits[0]), worth[of("b").start], m.number(digits[-1]), 1
            digits = digits[:-1]
        if name == "week":
            days, real = self._week(m.number(digits[0]), m.number(digits[1]), m.number(digits[2]))
            used = 3
        else:
            days, real = day_number(year, month, day)
        real = real & certain
        if not self.instants:
            text = days.astype("datetime64[D]").astype(str)
            out[rows[real]] = text[real]
            return
        clock = digits[used:]
        sign = next((t for i, (k, t) in enumerate(marks) if k in "+-" and clock and t.start > clock[0].start), None)
        parts = [t for t in clock if sign is None or t.start < sign.start]
        if len(parts) == 1 and parts[0].end - parts[0].start >= 4:
            whole, wide = m.number(parts[0]), parts[0].end - parts[0].start == 6
            hour, minute, second = (whole // 10000, whole // 100 % 100, whole % 100) if wide else (whole // 100, whole % 100, whole * 0)
        else:
            hour, minute = m.number(parts[0]), m.number(parts[1])
            second = m.number(parts[2]) if len(parts) > 2 else hour * 0
        if (half := of("p")) is not None:
            real = real & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + worth[half.start]
        real = real & (hour < 24) & (minute < 60) & (second <= 60)
        local = days * 86400 + hour * 3600 + minute * 60 + second
        zone_word = of("z")
        if sign is not None:
            after = [t for t in clock if t.start > sign.start]
            first = m.number(after[0])
            if after[0].end - after[0].start == 4:
                away = first // 100 * 3600 + first % 100 * 60
            else:
                away = first * 3600 + (m.number(after[1]) * 60 if len(after) > 1 else 0)
            direction = np.where(m.chars[:, sign.start] == ord("-"), -1, 1)
            self._emit(rows, local - direction * away, real, out)
        elif zone_word is not None:
            self._emit(rows, local - worth[zone_word.start] * 60, real, out)
        else:
            names = zone[rows]
            for z in pd.unique(names):
                if z in self.zones.zones:
                    at = names == z
                    self._emit(rows[at], self.zones.to_utc(local[at], z), real[at], out)

    @staticmethod
    def _week(year: np.ndarray, week: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fourth, _ = day_number(year, year * 0 + 1, year * 0 + 4)
        monday = fourth - (fourth + 3) % 7
        days = monday + (week - 1) * 7 + day - 1
        following, _ = day_number(year + 1, year * 0 + 1, year * 0 + 4)
        last = (following - (following + 3) % 7 - monday) // 7
        return days, (week >= 1) & (week <= last) & (day >= 1) & (day <= 7)

    @staticmethod
    def _emit(rows: np.ndarray, seconds: np.ndarray, real: np.ndarray, out: np.ndarray) -> None:
        good = real & (seconds > -62_135_596_800) & (seconds < 253_402_300_800)
        text = np.where(good, seconds, 0).astype("datetime64[s]").astype(str)
        out[rows[good]] = np.char.add(text[good], "Z")


#: Days of 1900-01-00 before 1970-01-01 in spreadsheets' day numbers, and the numbers read as such (1982 to 2119).
SERIAL_ZERO, SERIAL_FROM, SERIAL_TO = 25_569, 30_000, 80_000


def shape_mask(value: Column) -> Column:
    """Character classes of a value, equally long: 9 digit, a letter, the rest as it stands."""
    return F.regexp_replace(F.regexp_replace(value, r"[0-9]", "9"), r"\p{L}", "a")


def normal_forms(df: DataFrame, value: str, zones: ZoneTable, instants: bool, zone: str = "time_zone", order: str = "date_order") -> DataFrame:
    """Adds normal_form: UTC second (``instants``) or day of the string column ``value``.

    NULL, blank and unreadable values, days that do not exist, instants without zone whose source
    zone is NULL or unknown, and day-month pairs that neither their size nor ``date_order``
    decides get NULL. Runs of white space count as one blank. Other columns pass unchanged.
    """
    text = F.trim(F.col(value))
    text = F.when(text.rlike(r"\s{2}"), F.regexp_replace(text, r"\s{2,}", " ")).otherwise(text)
    if not instants:
        number = text.try_cast("int")
        serial = F.when(text.rlike("^[0-9]{5}$") & number.between(SERIAL_FROM, SERIAL_TO), F.date_add(F.lit("1970-01-01").cast("date"), number - SERIAL_ZERO).cast("string"))
    else:
        serial = F.lit(None).cast("string")

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        reader = Reader(zones, instants)
        for values, masks, orders, names in batches:
            filled = values.fillna("")
            yield pd.Series(reader.read(filled, masks.fillna(""), orders.to_numpy(dtype=object), names.to_numpy(dtype=object)), dtype=object)

    # else a filter on what it gives is pushed below it and each value is read twice
    reader_udf = F.pandas_udf(run, "string").asNondeterministic()
    read = reader_udf(text, shape_mask(text), F.col(order), F.col(zone))
    return df.withColumn("normal_form", read).withColumn("normal_form", F.coalesce(serial, "normal_form"))


#: Rows of the source table that may be sent to the driver (it has one row per mailbox).
MOST_SOURCES = 10_000


def source_zones(sources: DataFrame) -> ZoneTable:
    """Transition tables of the zones that the mail sources name."""
    names = [r[0] for r in sources.select("time_zone").where("time_zone is not null").distinct().limit(MOST_SOURCES + 1).collect()]
    if len(names) > MOST_SOURCES:
        raise ValueError("the source table names more zones than exist")
    return zone_table(names)


def timestamp_cases(emails: DataFrame, orders: DataFrame, sources: DataFrame) -> DataFrame:
    """Values of received_at, order_date and requested_delivery_date that are not in normal form yet.

    Columns record_id, field, normal_form. Rows whose mail or source is missing are read without a
    zone or order of day and month; repeated source rows count once.
    """
    zones = source_zones(sources)
    known = sources.where("provider is not null").select("provider", "time_zone", "date_order").dropDuplicates(["provider"])
    mails = emails.select("id", "provider", "received_at").join(broadcast_if_small(known, MOST_SOURCES), "provider", "left")
    changed = F.col("normal_form").isNotNull()
    received = normal_forms(mails.where("received_at is not null"), "received_at", zones, True).where(changed & (F.col("normal_form") != F.col("received_at")))
    received = received.select(F.col("id").alias("record_id"), F.lit("received_at").alias("field"), "normal_form")
    dates = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("order_date", "requested_delivery_date"))))
    unread = (F.col("value").isNotNull()) & ~F.col("value").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    rows = orders.select("id", "email_id", dates.alias("d")).select("id", "email_id", "d.field", "d.value").where(unread)
    linked = rows.join(mails.select(F.col("id").alias("email_id"), "date_order", "time_zone").dropDuplicates(["email_id"]), "email_id", "left")
    days = normal_forms(linked, "value", zones, False).where(changed & (F.col("normal_form") != F.col("value")))
    return received.unionByName(days.select(F.col("id").alias("record_id"), "field", "normal_form"))
