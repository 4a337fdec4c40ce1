"""Newly written lines of e-mail bodies, labelled by a linear-chain sequence model.

Each non-blank line is described by features: its type (prefix, wording, marks of earlier mail), the
types of its neighbours, its place in the body and against the first mark of earlier mail, blank
lines around it, punctuation, letters, words and digits. Weights of features and labels, and of
pairs of labels by the blank lines between them, are decoded by Viterbi for a whole batch at once.

History that nothing marks is known by its thread: a block of lines that two mails of a thread both
have as new text is new where less new text stands above it. Such blocks are found by hashes of
neighbouring lines, over all mails, and those mails alone are decoded again with their lines as old.

Weights are fitted on a bounded sample of threads by an averaged structured perceptron. Its labels
are what prefixes, introductions, threads and, where none of these speaks, starting weights of line
types say. Each mail is also learned with its word lists hidden (a formula or notice looks like any
line then), so that place, punctuation and neighbours carry the decision in languages no list knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.session import broadcast_if_small, cut_lineage

LABELS = ("new", "closing", "footer", "warning", "intro", "quoted", "header", "old")
TYPES = ("text", "greet", "prefixed", "wrapped", "intro", "header", "header_quoted", "formula", "rule", "name", "contact", "note", "warning", "postscript", "short", "greet_sender")
T = {name: i for i, name in enumerate(TYPES)}

# Starting score of a line type (row) under each label (column, in the order of LABELS).
EMISSION = np.array([
    [4, -6, 0, 0, -10, -8, -10, 4],          # text
    [4, -8, -8, -10, -10, -8, -10, 4],       # greet
    [-20, -20, -20, -20, -20, 6, -20, 6],    # prefixed
    [-2, -10, -10, -10, -10, 4, -20, 4],     # wrapped
    [-12, -20, -20, -20, 8, -8, -10, 8],     # intro
    [-15, -20, -20, -20, -8, -10, 10, 10],   # header
    [-15, -20, -20, -20, 8, -10, -10, 8],    # header_quoted
    [-2, 6, -6, -10, -10, -8, -10, 6],       # formula
    [-6, 5, 0, -10, -10, -8, -10, 5],        # rule
    [-2, 5, -4, -10, -10, -8, -10, 5],       # name
    [-6, 5, -4, -10, -10, -8, -10, 5],       # contact
    [-8, -4, 7, -5, -10, -8, -10, 7],        # note
    [-8, -10, -2, 7, -10, -8, -10, 7],       # warning
    [13, -10, -10, -10, -10, -8, -10, 2],    # postscript
    [2, 1, -2, -4, -10, -8, -10, 2],         # short
    [-3, -8, -8, -10, -10, -8, -10, 8],      # greet_sender
], dtype=np.float32)

START = np.array([0, -3, -8, 0, 0, -2, 0, -12], dtype=np.float32)

# Starting score of a label (row) followed by another (column), for no, one and more blank lines between.
TRANSITION = np.array([
    [
        [0, 0, -6, -10, 0, -1, 0, -40], [-9, 0, -1, -10, 0, -1, 0, -15], [-10, -4, 0, -10, 0, -1, 0, -15], [-6, -8, -6, 0, 0, -1, 0, -15],
        [-900, -900, -900, -900, 0, 0, -2, -8], [-8, -8, -8, -15, -2, 0, 0, -12], [-900, -900, -900, -900, -900, -900, 0, 0], [-900, -900, -900, -900, -900, -900, -1, 0],
    ],
    [
        [0, 0, -1, -10, 0, 0, 0, -12], [-9, 0, 0, -10, 0, -1, 0, -3], [-10, -4, -3, -10, 0, -1, 0, -3], [0, -4, -3, -6, 0, -1, 0, -8],
        [-900, -900, -900, -900, 0, 0, -2, -8], [0, 0, 0, -15, -2, 0, 0, -12], [-900, -900, -900, -900, -900, -900, 0, 0], [-900, -900, -900, -900, -900, -900, -1, 0],
    ],
    [
        [0, 0, -1, -10, 0, 0, 0, -7], [-9, -1, 0, -10, 0, -1, 0, 0], [-10, -5, -3, -10, 0, -1, 0, -1], [0, -4, -3, -6, 0, -1, 0, -6],
        [-900, -900, -900, -900, 0, 0, -2, -8], [0, 0, 0, -15, -2, 0, 0, -12], [-900, -900, -900, -900, -900, -900, 0, 0], [-900, -900, -900, -900, -900, -900, -1, 0],
    ],
], dtype=np.float32)

#: Mails that the weights are fitted on: whole threads in order of their hash, bodies of at most so many characters.
SAMPLE_MAILS, SAMPLE_CHARS = 3_000, 8_000
#: Passes over the sample, mails in one update, step of an update, and shares of mails learned with hidden lists or unknown senders.
EPOCHS, BATCH, STEP = 12, 64, 0.02
#: Letters that two neighbouring lines have at least to be told again elsewhere.
BLOCK_CHARS = 40
#: What a line repeated from another mail of its thread adds to the label of old text.
REPEATED = 20.0
#: Mails to decode again that are joined by broadcast.
FEW = 200_000
#: Types that rest on word lists, and those that rest on the sender's columns: hidden in further copies of each mail.
WORDED, KNOWN = ("greet", "formula", "postscript"), ("name", "greet_sender", "contact")
#: Types of lines that show that the lists know a body's language.
TELLING = (*WORDED, "greet_sender", "note", "warning")
#: Times that bodies without any listed word are learned as they are, beside the hidden copies of all others.
PLAIN_COPIES = 60

# Feature groups and their numbers of values.
GROUPS = {"type": len(TYPES), "before": len(TYPES) + 1, "after": len(TYPES) + 1, "gap_after": 4, "from_start": 5, "from_end": 5, "shape": 72, "mark": 3}
OFFSETS = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])[:-1].tolist(), strict=True))
N_FEATURES = sum(GROUPS.values())


@dataclass(frozen=True)
class Chain:
    """Weights of features (rows) under labels, of label pairs by gap, and of first labels: for what the word lists know, then for other bodies."""

    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def starting_chain() -> Chain:
    """Only line types and label pairs say something: where a fit begins, and what it keeps where the sample says nothing else."""
    weights = np.zeros((2, N_FEATURES, len(LABELS)), dtype=np.float32)
    weights[:, : len(TYPES)] = EMISSION
    return Chain(weights.reshape(-1, len(LABELS)), np.concatenate([TRANSITION, TRANSITION]), np.stack([START, START]))


PREFIX = re.compile(r"\t|\s{0,3}(?:[>|¦:]|[A-Z]{1,3}>)")
EMPTY_PREFIX = re.compile(r"[\s>|¦:]*$")
GREETING = re.compile(
    r"(?:(?:hi|hello|dear|good (?:morning|afternoon|day)|hallo|guten (?:tag|morgen)|liebe[rs]?|hola|buenos días|buenas tardes|dzień dobry|cześć|bonjour|madame|monsieur"
    r"|chers?|chères?|ciao|buongiorno|olá|bom dia|boa tarde|car[oa]s?|beste|geachte|goedemorgen)\b|sehr geehrte|estimad|szanown|drog[ia]|gentil[ei]|egregi|prezad)[^.!?]{0,60}$", re.I)  # fmt: skip
FORMULAS = frozenset("""
kind regards|regards|best regards|warm regards|best|best wishes|thanks|thank you|many thanks|many thanks and best wishes|thanks and regards|sincerely|yours sincerely|yours faithfully|cheers
mfg|beste grüße|freundliche grüße|mit freundlichen grüßen|viele grüße|vg|lg|herzliche grüße|mit freundlichem gruß
un saludo|saludos|saludos cordiales|atentamente|muchas gracias y un saludo|cordialmente|reciba un cordial saludo
z pozdrowieniami|pozdrawiam|z poważaniem|pozdrowienia|z wyrazami szacunku
met vriendelijke groet|met vriendelijke groeten|groeten|hartelijke groet|hartelijke groeten|vriendelijke groeten|mvg
cumprimentos|com os melhores cumprimentos|atenciosamente|obrigado|melhores cumprimentos
cordialement|bien à vous|meilleures salutations|sincères salutations|bien cordialement|salutations distinguées
distinti saluti|cordiali saluti|un cordiale saluto|saluti|cordialmente
""".strip().replace("\n", "|").split("|"))  # fmt: skip
RULES = frozenset(("--", "__", "***", "– –", "—", "- -", "* * *", "~~"))
CONTACT = re.compile(
    r"(?:tel\b|tel\.|t:|f:|m:|fax|phone|mobile|mobil|handy|cell|telefon|móvil|tél)[\s.:+]|\S+@\S+\.\w+|www\.|https?:|\+?\d[\d\s()/-]{7,}$", re.I)
TITLE = re.compile(
    r"(?:key account|senior buyer|junior buyer|buyer|purchasing|procurement|supply chain|einkauf|vertrieb|sales support|sales|service achats|achats|compras|ventas|acquisti|inkoop|zakupy|logisti)[\w\s/&-]{0,30}$", re.I)
COMPANY = re.compile(r"(?:\b(?:gmbh|ag|kg|ltd|llc|plc|inc|corp|sarl|s\.?a|b\.?v|s\.?l|s\.?p\.?a|s\.?r\.?l|sp\. z o\.o|e\.?k|ohg|limited|corporation|incorporated))\.?$", re.I)
NOTE = re.compile(
    r"this e-?mail and any|this message (?:is|and|may)|confidentiality notice|ce message (?:est|et)|diese e-?mail|diese nachricht (?:kann|ist|enth)|este mensaje (?:va|es|y)|our general terms|geschäftsführung:"
    r"|please consider the environment|sent from (?:my|a)\b|sent via|get outlook|von mein\w+ \w+ gesendet|envoyé de(?:puis)? mon|enviado desde|enviado do meu|inviato da(?:l| )|verzonden vanaf|wysłane? z "
    r"|.{0,60}(?:confidential and|privileged|registered office|registergericht|vertrauliche informationen|información reservada|before printing|terms of purchase)", re.I)  # fmt: skip
NOTE_RULE = re.compile(r"(?:-{4,19}|_{4,15})$")
WARNING = re.compile(r"\[?(?:external|extern)\b\]?|caution:|achtung:|warning:|attention ?:|atención:|uwaga:|let op:|attenzione:|\[ext", re.I)
POSTSCRIPT = re.compile(r"(?:p\.? ?s\.?|n\.?b\.?|ps)\s*[:.\s]", re.I)
SEPARATOR = re.compile(r"-{3,}\s*[^\s-].*[^\s-]\s*-{3,}$|begin forwarded message:?$|={8,}$|_{16,}$|-{20,}$", re.I)
FROM_LINE = re.compile(r"\*?(?:from|von|de|od|van|da)\s?:\*?\s", re.I)
SENT_LINE = re.compile(r"\*?(?:sent|date|gesendet|datum|enviado|enviada|fecha|wysłano|data|verzonden|inviato|envoyé)\s?:", re.I)
SAID = re.compile(r"\b(?:wrote|schrieb|escribió|pisze|napisał(?:\(a\))?|écrit|schreef|scritto|escreveu)(?!\w)", re.I)
NAME_SHAPE = re.compile(r"[^\W\d_][\w'.-]+(?: [^\W\d_]\.)?(?: [^\W\d_][\w'-]+){1,2}$")
SHORT = re.compile(r"[^\W\d_][^\d.!?:;,]{1,38}$")


@lru_cache(maxsize=200_000)
def line_shape(s: str) -> int:
    """Number of the end sign, first letter, words and digits of a stripped line."""
    end = 0 if s[-1] in ".!?…" else 1 if s[-1] in ",;" else 2 if s[-1] == ":" else 3
    first = 0 if s[0].isupper() else 1 if s[0].islower() else 2
    words = s.count(" ") + 1
    return ((end * 3 + first) * 3 + (0 if words <= 2 else 1 if words <= 5 else 2)) * 2 + any(c.isdigit() for c in s)


@lru_cache(maxsize=200_000)
def unlisted_type(s: str) -> int:
    """Type of a line for which no word list counts."""
    return T["short"] if SHORT.match(s) and s[0].isupper() and s.count(" ") < 4 else T["text"]


@lru_cache(maxsize=200_000)
def line_type(s: str) -> int:
    """Type of a stripped line by itself."""
    low = s.rstrip(",.! ").lower()
    if low in FORMULAS:
        return T["formula"]
    if s in RULES:
        return T["rule"]
    if WARNING.match(s):
        return T["warning"]
    if NOTE.match(s) or NOTE_RULE.match(s):
        return T["note"]
    if POSTSCRIPT.match(s):
        return T["postscript"]
    if len(s) <= 70 and GREETING.match(s):
        return T["greet"]
    if CONTACT.match(s) or TITLE.match(s) or COMPANY.search(s) and len(s) < 60:
        return T["contact"]
    return T["short"] if SHORT.match(s) and s[0].isupper() and s.count(" ") < 4 else T["text"]


def intro_length(lines: list[str], at: int) -> int:
    """Number of consecutive lines from ``at`` that together introduce an earlier message, or 0."""
    joined = ""
    for n in range(1, 6):
        if at + n > len(lines) or not lines[at + n - 1]:
            return 0
        joined = f"{joined} {lines[at + n - 1]}".strip()
        if len(joined) > 240:
            return 0
        if joined.endswith(":"):
            return n if SAID.search(joined) and any(c.isdigit() for c in joined) else 0
    return 0


def message_types(body: str, sender_email: str | None, sender_name: str | None) -> tuple[list[int], list[int], list[int], list[int]]:
    """Line numbers, types, blank lines before and shapes of the non-blank lines of one body."""
    raw = body.split("\n")
    lines = [x.strip() for x in raw]
    n = len(lines)
    fixed: dict[int, int] = {}
    prefixed = [bool(s) and PREFIX.match(r) is not None for r, s in zip(raw, lines, strict=True)]
    for i, s in enumerate(lines):
        if not s or prefixed[i] or i in fixed:
            continue
        head = i if FROM_LINE.match(s) and any(SENT_LINE.match(x) for x in lines[i + 1 : i + 4]) else None
        separator = SEPARATOR.match(s) is not None
        if separator and head is None:
            head = next((k for k in range(i + 1, min(i + 3, n)) if FROM_LINE.match(lines[k])), None)
        if separator or head is not None:
            end = i + 1
            if head is not None:
                end = head
                while end < n and lines[end]:
                    end += 1
            following = next((k for k in range(end, n) if lines[k]), None)
            kind = T["header_quoted"] if following is not None and prefixed[following] else T["header"]
            fixed.update((k, kind) for k in range(i, end))
        elif (s[-1] == ":" or s[-1] == "," or s[0] == "<" or i + 1 < n and lines[i + 1] and not prefixed[i + 1]) and (length := intro_length(lines, i)):
            if SAID.search(s) or length == 1 or re.match(r"(?:On|Am|El|Le|W dniu|Op|Il|Em|Dnia)\b|\d|[A-Z][a-z]{2},? \d|.*\b(?:on|am)$", s):
                fixed.update((k, T["intro"]) for k in range(i, i + length))
    last_name = ((sender_email or "").split("@")[0].rsplit(".", 1)[-1]).lower()
    initial = (sender_email or "")[:1].lower()
    own = {w for w in re.split(r"[\s,.]+", (sender_name or "").lower()) if len(w) > 2}
    numbers, types, gaps, shapes = [], [], [], []
    gap, previous, seen = 0, -1, False
    for i, s in enumerate(lines):
        if not s:
            gap += 1
            continue
        if prefixed[i]:
            kind = T["prefixed"]
        elif i in fixed:
            kind = fixed[i]
        elif gap == 0 and i and (prefixed[i - 1] and not EMPTY_PREFIX.match(raw[i - 1]) or previous == T["wrapped"]):
            kind = T["wrapped"]
        else:
            kind = line_type(s)
            if gap == 0 and previous == T["note"] and kind in (T["text"], T["short"], T["contact"]):
                # a notice goes on to the end of its paragraph
                kind = T["note"]
            if kind in (T["short"], T["text"]) and len(s) < 50:
                low = s.lower()
                words = low.split()
                if len(words) <= 4 and len(last_name) > 2 and last_name in words or len(words) == 1 and s.isalpha() and s[0].isupper() and (low in own or words[0][0] == initial and gap > 0):
                    kind = T["name"]
                elif NAME_SHAPE.match(s) and i + 1 < n and lines[i + 1] and line_type(lines[i + 1]) == T["contact"]:
                    kind = T["name"]
            elif kind == T["greet"] and seen and gap:
                called = re.split(r"[\s,.:]+", s.rstrip(",:! ").lower())[-1]
                if called in own or called[:1] == initial and gap > 1:
                    kind = T["greet_sender"]
        if previous >= 0 and gap == 0 and EMPTY_PREFIX.match(raw[i - 1]):
            gap = 1
        numbers.append(i)
        types.append(kind)
        gaps.append(min(gap, 2))
        shapes.append(line_shape(s))
        seen = seen or kind == T["text"]
        gap, previous = 0, kind
    return numbers, types, gaps, shapes


@dataclass
class Bodies:
    """Padded sequences of about equal length: types, blank lines before and shapes of lines, where each ends, and which lines other mails have too."""

    types: np.ndarray
    gaps: np.ndarray
    shapes: np.ndarray
    lengths: np.ndarray
    repeated: np.ndarray | None = None

    def features(self) -> np.ndarray:
        """Feature numbers of each line, one layer a group."""
        rows, steps = self.types.shape
        at = np.arange(steps)[None, :]
        live = at < self.lengths[:, None]
        none = len(TYPES)
        types = np.where(live, self.types, none)
        before = np.concatenate([np.full((rows, 1), none), types[:, :-1]], axis=1)
        after = np.concatenate([types[:, 1:], np.full((rows, 1), none)], axis=1)
        gap_after = np.where(after == none, 3, np.concatenate([self.gaps[:, 1:], np.zeros((rows, 1), dtype=np.int64)], axis=1))
        bucket = lambda k: np.where(k < 3, k, np.where(k < 6, 3, 4))
        marked = np.isin(types, MARKS)
        seen = np.cumsum(marked, axis=1) > 0
        mark = np.where(seen, 2, np.where(marked.any(axis=1)[:, None], 1, 0))
        layers = {
            "type": self.types, "before": before, "after": after, "gap_after": gap_after, "from_start": bucket(np.broadcast_to(at, types.shape)),
            "from_end": bucket(np.maximum(self.lengths[:, None] - 1 - at, 0)), "shape": self.shapes, "mark": mark,
        }
        return np.stack([layers[g] + OFFSETS[g] for g in GROUPS], axis=2) + N_FEATURES * self.unknown()[:, None, None]

    def unknown(self) -> np.ndarray:
        """1 for bodies in which no word list knows a line and nothing marks earlier mail, else 0."""
        live = np.arange(self.types.shape[1])[None, :] < self.lengths[:, None]
        return 1 - (np.isin(self.types, [*(T[x] for x in TELLING), *MARKS]) & live).any(axis=1).astype(np.int64)

    def some(self, rows: np.ndarray) -> Bodies:
        repeated = None if self.repeated is None else self.repeated[rows]
        return Bodies(self.types[rows], self.gaps[rows], self.shapes[rows], self.lengths[rows], repeated)

    def steps(self) -> np.ndarray:
        """Which table of label pairs holds before each line."""
        return self.gaps + 3 * self.unknown()[:, None]


MARKS = [T[x] for x in ("prefixed", "wrapped", "intro", "header", "header_quoted")]


def decode(chain: Chain, bodies: Bodies) -> np.ndarray:
    """Most likely labels of padded sequences (rows): Viterbi over all rows at once."""
    emission = chain.weights[bodies.features()].sum(axis=2)
    if bodies.repeated is not None:
        emission[..., LABELS.index("new")] -= 1e4 * bodies.repeated
        emission[..., LABELS.index("old")] += REPEATED * bodies.repeated
    gaps, lengths = bodies.steps(), bodies.lengths
    rows, steps = gaps.shape
    score = chain.start[bodies.unknown()] + emission[:, 0]
    back = np.zeros((rows, steps, len(LABELS)), dtype=np.int8)
    back[:, 0] = np.arange(len(LABELS))
    for t in range(1, steps):
        paths = score[:, :, None] + chain.transition[gaps[:, t]]
        best = paths.argmax(axis=1)
        new = np.take_along_axis(paths, best[:, None, :], axis=1)[:, 0] + emission[:, t]
        live = (t < lengths)[:, None]
        back[:, t] = np.where(live, best, np.arange(len(LABELS)))
        score = np.where(live, new, score)
    labels = np.zeros((rows, steps), dtype=np.int8)
    at = score.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        labels[:, t] = at
        at = back[np.arange(rows), t, at]
    return labels


Read = tuple[list[int], list[int], list[int], list[int]]


def padded(parts: list[Read], most: int = 60_000) -> Iterator[tuple[list[int], Bodies]]:
    """Places and padded sequences of the non-empty bodies, shortest first; the product bounds memory however long a body is."""
    order = sorted((k for k, p in enumerate(parts) if p[0]), key=lambda k: len(parts[k][0]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * len(parts[order[stop]][0]) <= most:
            stop += 1
        chosen = order[start:stop]
        lengths = np.array([len(parts[k][0]) for k in chosen])
        arrays = [np.zeros((len(chosen), lengths.max()), dtype=np.int64) for _ in range(3)]
        for r, k in enumerate(chosen):
            for a, values in zip(arrays, parts[k][1:], strict=True):
                a[r, : lengths[r]] = values
        yield chosen, Bodies(*arrays, lengths)
        start = stop


def read_bodies(bodies: list[str | None], emails: list[str | None], names: list[str | None]) -> list[Read]:
    return [message_types(b, e, n) if b else ([], [], [], []) for b, e, n in zip(bodies, emails, names, strict=True)]


def with_repeated(block: Bodies, numbers: list[list[int]], repeated: list[set[int]]) -> Bodies:
    """The sequences with the lines that other mails of their threads have too."""
    if not any(repeated):
        return block
    out = np.zeros(block.types.shape, dtype=np.float32)
    for r, (own, found) in enumerate(zip(numbers, repeated, strict=True)):
        if found:
            out[r, : len(own)] = [n in found for n in own]
    return Bodies(block.types, block.gaps, block.shapes, block.lengths, out)


def label_batch(chain: Chain, bodies: list[str | None], emails: list[str | None], names: list[str | None], repeated: list[set[int]] | None = None) -> list[np.ndarray]:
    """Numbers of the new lines of each body."""
    parts = read_bodies(bodies, emails, names)
    out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(parts)
    for chosen, block in padded(parts):
        if repeated is not None:
            block = with_repeated(block, [parts[k][0] for k in chosen], [repeated[k] for k in chosen])
        labels = decode(chain, block)
        for r, k in enumerate(chosen):
            out[k] = np.array(parts[k][0], dtype=np.int32)[labels[r, : block.lengths[r]] == 0]
    return out


def blocks_of(body: str, new: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(hash, line, next line, new lines above) of neighbouring new lines of one body, between which only blank lines stand."""
    if len(new) < 2:
        return []
    lines = body.split("\n")
    out = []
    for k, (a, b) in enumerate(zip(new[:-1].tolist(), new[1:].tolist(), strict=True)):
        if b - a == 1 or all(not x.strip() for x in lines[a + 1 : b]):
            pair = f"{' '.join(lines[a].split())}\n{' '.join(lines[b].split())}"
            if len(pair) > BLOCK_CHARS:
                out.append((xxhash.xxh64_intdigest(pair) - (1 << 63), a, b, k))
    return out


def hidden(part: Read, body: str, kinds: tuple[str, ...]) -> list[int]:
    """Types of a read body's lines as they would be if these kinds were not known."""
    numbers, types, _, _ = part
    listed = {T[x] for x in kinds}
    lines = body.split("\n")
    return [unlisted_type(lines[n].strip()) if t in listed else t for n, t in zip(numbers, types, strict=True)]


def repeated_in_threads(found: DataFrame) -> DataFrame:
    """id and the lines of mails that repeat another mail of their thread.

    ``found`` has id, thread, message, text (hashes), stored and blocks. Of the mails that have one
    block the first is the one with least new text above it, then the one stored first; the same
    message or text again is no repetition.
    """
    blocks = found.where("thread is not null").select("id", "thread", "message", "text", "stored", F.explode("blocks").alias("b")).select("id", "thread", "message", "text", "stored", "b.*")
    rank = F.struct("above", "stored", "message", "text")
    # hot blocks are reduced to their first mail before anything is joined
    firsts = blocks.groupBy("thread", "block").agg(F.min(rank).alias("first"), F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select("thread", "block", "first")
    later = blocks.join(broadcast_if_small(cut_lineage(firsts), FEW), ["thread", "block"]).where("text <> first.text and message <> first.message and struct(above, stored) > struct(first.above, first.stored)")
    return later.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.array("line", "next")))).alias("repeated"))


def repeated_blocks(bodies: list[str], threads: list[str | None], messages: list[str | None], new: list[np.ndarray]) -> list[set[int]]:
    """The same for mails at hand, in their order of storing."""
    first: dict[tuple, tuple[int, int]] = {}
    every = [[(threads[k], h, above, k, a, b) for h, a, b, above in blocks_of(body, new[k])] if threads[k] is not None else [] for k, body in enumerate(bodies)]
    for t, h, above, k, _, _ in (x for own in every for x in own):
        first[t, h] = min(first.get((t, h), (above, k)), (above, k))
    out: list[set[int]] = [set() for _ in bodies]
    for t, h, above, k, a, b in (x for own in every for x in own):
        top = first[t, h]
        if (above, k) > top and messages[k] != messages[top[1]] and bodies[k] != bodies[top[1]]:
            out[k] |= {a, b}
    return out


def fit_chain(sample: pd.DataFrame, chain: Chain | None = None) -> Chain:
    """Weights fitted on mails (columns body, sender_email, sender_name, thread_id, message_id); no mails leave the starting ones."""
    chain = chain or starting_chain()
    text = lambda c: [x if isinstance(x, str) else None for x in sample[c]]
    bodies = [b or "" for b in text("body")]
    parts = read_bodies(bodies, text("sender_email"), text("sender_name"))
    first = label_batch(chain, bodies, text("sender_email"), text("sender_name"))
    repeated = repeated_blocks(bodies, text("thread_id"), text("message_id"), first)
    examples: list[tuple[Bodies, np.ndarray]] = []
    for chosen, block in padded(parts, BATCH * 30):
        block = with_repeated(block, [parts[k][0] for k in chosen], [repeated[k] for k in chosen])
        truth = decode(chain, block)
        examples.append((block, truth))
        if (plain := block.unknown() > 0).any():
            examples += [(block.some(plain), truth[plain])] * PLAIN_COPIES
        # without the lists nothing tells notices and unmarked history: mails that have them are learned as they are only
        live = np.arange(truth.shape[1])[None, :] < block.lengths[:, None]
        marked = np.isin(block.types, [*MARKS, T["note"], T["warning"], T["greet_sender"]]) | (truth == LABELS.index("old"))
        plain = ~(marked & live).any(axis=1)
        for kinds in (WORDED, WORDED + KNOWN) if plain.any() else ():
            types = block.types.copy()
            for r, k in enumerate(chosen):
                types[r, : block.lengths[r]] = hidden(parts[k], bodies[k], kinds)
            examples.append((Bodies(types, block.gaps, block.shapes, block.lengths, block.repeated).some(plain), truth[plain]))
    weights, transition, start = chain.weights.copy(), chain.transition.copy(), chain.start.copy()
    total, updates = [np.zeros_like(x, dtype=np.float64) for x in (weights, transition, start)], 0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for e in order.permutation(len(examples)):
            block, truth = examples[e]
            found = decode(Chain(weights, transition, start), block)
            live = np.arange(truth.shape[1])[None, :] < block.lengths[:, None]
            wrong = (((found == 0) != (truth == 0)) & live).any(axis=1)
            if wrong.any():
                codes, gaps, unknown = block.features()[wrong], block.steps()[wrong], block.unknown()[wrong]
                for labels, sign in ((truth[wrong], STEP), (found[wrong], -STEP)):
                    r, t = np.nonzero(live[wrong])
                    np.add.at(weights, (codes[r, t], labels[r, t][:, None]), sign)
                    r, t = np.nonzero(live[wrong][:, 1:])
                    np.add.at(transition, (gaps[r, t + 1], labels[r, t], labels[r, t + 1]), sign)
                    np.add.at(start, (unknown, labels[:, 0]), sign)
            for t, x in zip(total, (weights, transition, start), strict=True):
                t += x
            updates += 1
    return Chain(*((t / updates).astype(np.float32) for t in total)) if updates else chain


def training_sample(emails: DataFrame, mails: int = SAMPLE_MAILS) -> DataFrame:
    """At most ``mails`` mails of whole threads, those of least hash: the same at each run, found in one scan without an exchange of bodies.

    Only hashes below a bound that about twice as many mails are under are looked at, so that the
    driver gets no more from many partitions than from few.
    """
    known = lambda c: F.col(c) if c in emails.columns else F.lit(None).cast("string")
    space = 1 << 40
    bound = min(space, space * 2 * mails // max(emails.count(), 1) + 1)
    rank = F.pmod(F.xxhash64(F.coalesce("thread_id", "id")), F.lit(space))
    rows = emails.where(F.length("email_body").between(1, SAMPLE_CHARS)).select(
        F.col("email_body").alias("body"), "sender_email", "sender_name", known("thread_id").alias("thread_id"), known("provider_message_id").alias("message_id"), F.col("id").cast("string").alias("id")
    )
    return rows.where(rank < bound).orderBy(rank, "id", "body").limit(mails)


def new_lines(emails: DataFrame, chain: Chain | None = None) -> DataFrame:
    """email_id and line_no (from 0, of the body split at line feeds) of each newly written line.

    NULL and empty bodies have none, nor do blank lines; either line end is allowed; bodies of any
    length are read whole; missing sender columns only cost the hint to the signature, a missing
    thread that to unmarked history. Rows that repeat give their lines once per row. Without a
    ``chain`` one is fitted on the mails themselves. Bodies stay where they are: what is exchanged
    are hashes of lines, and the few mails that repeat others.
    """
    chain = chain or fit_chain(training_sample(emails).toPandas())
    known = lambda c, kind="string": F.col(c) if c in emails.columns else F.lit(None).cast(kind)
    plain = lambda xs: [[v if isinstance(v, str) else None for v in x] for x in xs]

    @F.pandas_udf("struct<lines:array<int>,blocks:array<struct<block:bigint,line:int,next:int,above:int>>>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, senders, names, threads in batches:
            bodies, senders, names, threads = plain((bodies, senders, names, threads))
            lines = label_batch(chain, bodies, senders, names)
            blocks = [[dict(zip(("block", "line", "next", "above"), b, strict=True)) for b in blocks_of(body, own)] if t is not None and body else [] for body, own, t in zip(bodies, lines, threads, strict=True)]
            yield pd.DataFrame({"lines": lines, "blocks": blocks})

    @F.pandas_udf("array<int>")
    def again(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, senders, names, repeated in batches:
            yield pd.Series(label_batch(chain, *plain((bodies, senders, names)), [set(x.tolist()) for x in repeated]), dtype=object)

    bodies = emails.where("email_body is not null").select("id", "email_body", "sender_email", "sender_name", known("thread_id").alias("thread"), known("provider").alias("provider"), known("provider_message_id").alias("number"), known("created_at", "timestamp").alias("stored"))
    found = bodies.select(
        "id", F.when(F.col("thread").isNotNull(), F.xxhash64("thread")).alias("thread"), F.xxhash64("provider", F.coalesce("number", "id")).alias("message"), F.xxhash64("email_body").alias("text"),
        "stored", read("email_body", "sender_email", "sender_name", "thread").alias("r"),
    ).select("id", "thread", "message", "text", "stored", "r.*")
    # written once, without bodies: read for the lines and for the blocks
    found = cut_lineage(found)
    repeating = broadcast_if_small(cut_lineage(repeated_in_threads(found)), FEW)
    kept = found.join(repeating.select("id"), "id", "left_anti").select("id", "lines")
    changed = bodies.join(repeating, "id").select("id", again("email_body", "sender_email", "sender_name", "repeated").alias("lines"))
    return kept.unionByName(changed).select(F.col("id").alias("email_id"), F.explode_outer("lines").alias("line_no")).where("line_no is not null")
