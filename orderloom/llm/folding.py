"""Letter folding shared by the address and name operators."""

from __future__ import annotations

import re
import unicodedata

_LETTERS = str.maketrans({"ß": "ss", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})
_LOOKALIKES = str.maketrans({"0": "o", "1": "l", "5": "s"})


def fold(text: str) -> str:
    """Lower case without marks."""
    text = text.lower().translate(_LETTERS)
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_LETTERS)


def plain(word: str) -> str:
    """A folded word with digits that stand for letters as letters: for comparison only."""
    return word.translate(_LOOKALIKES) if any(c.isdigit() for c in word) else word


def loose(word: str) -> str:
    """Like ``plain``, with rn as m and two-letter umlauts as one letter."""
    return re.sub(r"([aou])e", r"\1", plain(word)).replace("rn", "m")


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance with swaps of neighbours (optimal string alignment) is at most ``most``: banded."""
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return False
    if a == b:
        return True
    far = most + 1
    before, last = [far] * (lb + 1), [j if j <= most else far for j in range(lb + 1)]
    for i in range(1, la + 1):
        low, high = max(1, i - most), min(lb, i + most)
        now = [far] * (lb + 1)
        now[0] = i if i <= most else far
        best = now[0]
        for j in range(low, high + 1):
            same = a[i - 1] == b[j - 1]
            d = min(last[j - 1] + (not same), last[j] + 1, now[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            now[j] = d
            best = min(best, d)
        if best > most:
            return False
        before, last = last, now
    return last[lb] <= most
