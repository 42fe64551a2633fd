"""Letters without diacritics, upper case, punctuation: Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that is removed before tokens are counted.
PUNCTUATION = ".·,;:!?'⁑"


@lru_cache(maxsize=1)
def diacritics() -> tuple[str, str]:
    """Characters and what they are without diacritics, by canonical decomposition; those beyond the second string's end are removed."""
    pairs, gone = [], []
    for cp in range(0xC0, 0x10000):
        if 0xAC00 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if not base:
            gone.append(ch)
        elif base != ch and len(base) == 1:
            pairs.append((ch, base))
    return "".join(a for a, _ in pairs) + "".join(gone), "".join(b for _, b in pairs)


def strip_diacritics(text: Column) -> Column:
    """text without combining marks; letters with marks become their base letters. Null stays null."""
    return F.translate(text, *diacritics())


def normalize_greek(text: Column, case_folding: bool = True) -> Column:
    """text without diacritics, and in upper case unless case_folding is off."""
    plain = strip_diacritics(text)
    return F.upper(plain) if case_folding else plain


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")
