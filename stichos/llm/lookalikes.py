"""Look-alike characters: the fixed pairs, and their transitive classes by union-find.

Two strings belong together when they print alike: a ligature and its letters, a full-width and an ordinary letter, an
accented letter in one or several code points, a Greek and a Latin omicron.  Pairs come from three rules - canonical and
compatibility decompositions of Unicode, the script table below, invisible characters as look-alikes of nothing - and the
classes are their transitive closure.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Letters of four scripts that print alike, one group per entry, in the order Latin, Greek, Cyrillic, Coptic ("-": none).
ALIKE = """
A Α А Ⲁ|B Β В Ⲃ|C Ϲ С Ⲥ|E Ε Е Ⲉ|H Η Н Ⲏ|I Ι І Ⲓ|J - Ј -|K Κ К Ⲕ|M Μ М Ⲙ|N Ν - Ⲛ|O Ο О Ⲟ|P Ρ Р Ⲣ|S - Ѕ -|T Τ Т Ⲧ|X Χ Х Ⲭ|Y Υ Ү Ⲩ|Z Ζ - Ⲍ
- Γ Г Ⲅ|- Π П Ⲡ|- Φ Ф Ⲫ|- Δ - Ⲇ|- Θ - Ⲑ|- Λ - Ⲗ|- Ξ - Ⲝ|- Ψ - Ⲯ|- Ω - Ⲱ
a α а ⲁ|c ϲ с ⲥ|e - е -|h - һ -|i ι і ⲓ|j - ј -|k κ к ⲕ|o ο о ⲟ|p ρ р ⲣ|s - ѕ -|u υ - -|v ν - -|x χ х ⲭ|y - у ⲩ
- β - ⲃ|- ε - ⲉ|- φ ф ⲫ|- ω - ⲱ
"""

#: Letters of further scripts, each with the Latin letter that prints like it.
ALIKE_LATIN = {
    "ARMENIAN": "h հ|n ո|o օ|q զ|u ս|g ց|j յ|O Օ|S Տ|U Ս|L Լ",
    "CHEROKEE": "A Ꭺ|B Ᏼ|C Ꮯ|D Ꭰ|E Ꭼ|G Ꮐ|H Ꮋ|J Ꭻ|K Ꮶ|L Ꮮ|M Ꮇ|P Ꮲ|R Ꭱ|S Ꮪ|T Ꭲ|V Ꮩ|W Ꮃ|Y Ꭹ|Z Ꮓ|i Ꭵ|d Ꮷ|b Ꮟ",
    "LISU": "A ꓮ|B ꓐ|C ꓚ|D ꓓ|E ꓰ|F ꓝ|G ꓖ|H ꓧ|I ꓲ|J ꓙ|K ꓗ|L ꓡ|M ꓟ|N ꓠ|O ꓳ|P ꓑ|R ꓣ|S ꓢ|T ꓔ|U ꓴ|V ꓦ|W ꓪ|X ꓫ|Y ꓬ|Z ꓜ",
}

#: Scripts in the order of ALIKE and ALIKE_LATIN, with their bit.
SCRIPTS = {"LATIN": 1, "GREEK": 2, "CYRILLIC": 4, "COPTIC": 8, "ARMENIAN": 16, "CHEROKEE": 32, "LISU": 64}

#: Characters that may stand in a text although they are marks: the under-dot of a damaged letter.
UNDERDOT = "̣"

#: Number of code points that Unicode has.
LIMIT = 0x110000

#: Invisible characters of other categories than controls and format signs - grapheme joiner, fillers, inherent vowels,
#: and the selectors of variants, as ranges of code points.
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
SELECTORS = ((0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
#: A character without ink that is as wide as a letter, in no category of spaces.
BLANK = "\u2800"


class UnionFind:
    """Union-find over hashable items, with path halving and union by size."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}
        self.size: dict[str, int] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        if self.size.get(a, 1) < self.size.get(b, 1):
            a, b = b, a
        self.parent[b] = a
        self.size[a] = self.size.get(a, 1) + self.size.get(b, 1)

    def classes(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in list(self.parent):
            by.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in by.values() if len(c) > 1]


def script_of(ch: str) -> int:
    """Bit of a letter's script, 0 for other characters and scripts."""
    if ch < "A":
        return 0
    name = unicodedata.name(unicodedata.normalize("NFKC", ch)[0], "")
    return SCRIPTS.get(name.split(" ")[0], 0) if unicodedata.category(ch)[0] == "L" else 0


def is_invisible(ch: str) -> bool:
    """Characters without ink that are no space: zero-width, joiners, soft hyphen, controls, direction marks, tags, variation selectors."""
    if ch in "\n ":
        return False
    cat = unicodedata.category(ch)
    return cat == "Cf" or (cat == "Cc" and ch not in "\t\r\x0b\x0c\x85") or ch in FILLERS or any(a <= ord(ch) <= b for a, b in SELECTORS)


def is_space(ch: str) -> bool:
    """White space, or a character that prints as nothing but room."""
    return ch.isspace() or ch == BLANK or unicodedata.category(ch)[0] == "Z"


def plain_space(ch: str) -> str:
    """The ordinary space or line end that a white-space character looks like."""
    return "\n" if ch in "\r\x0b\x0c\x85\u2028\u2029" else " "


@lru_cache(maxsize=1)
def groups() -> list[dict[int, str]]:
    """The script table: for each group the letter by script bit."""
    bits = list(SCRIPTS.values())
    out = []
    for entry in ALIKE.replace("\n", "|").split("|"):
        letters = entry.split()
        if letters:
            out.append({bit: c for bit, c in zip(bits[:4], letters, strict=True) if c != "-"})
    by_latin = {g[1]: g for g in out if 1 in g}
    for script, pairs in ALIKE_LATIN.items():
        for latin, c in (pair.split(" ") for pair in pairs.split("|")):
            if latin not in by_latin:
                by_latin[latin] = {1: latin}
                out.append(by_latin[latin])
            by_latin[latin][SCRIPTS[script]] = c
    return out


@lru_cache(maxsize=1)
def to_script() -> dict[int, dict[str, str]]:
    """For each script bit, the letters of other scripts that it can replace."""
    out: dict[int, dict[str, str]] = {bit: {} for bit in SCRIPTS.values()}
    for g in groups():
        for bit, target in g.items():
            for other, c in g.items():
                if other != bit:
                    out[bit][c] = target
    return out
