"""Weak labels: whether more than half of a text is listed, tabulated or junk, by rules over its lines.

Lines are looked at one by one - separators, bullets, labels, page numbers, symbols, garbled and repeated stretches - and runs
of the other lines by their share of common words.  The rules are slow, so they label only the sample that a model learns from;
nothing of them is an input of that model.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

CELLS = re.compile(r"\|.*\||\t|\S {3,}\S|^ {3,}\S+ {3,}|(?:\S|^);(?=\S|;|$).*;(?=\S|;|$)|(?:\S|^),(?=[^\s,]|,).*,(?=[^\s,]|,|$)")
LABEL = re.compile(r"^\s*\w[^:;.!?]{0,60}:(?: [^:]{0,60})?$")
BULLET = re.compile(r"\s*(?:[•–—*‣◦▪●○·+>#-]|[\[(]?(?:\d{1,4}|[ivxlIVXL]{1,6}|[a-zA-Zα-ω])[\].)]|[\[(]\d{1,4}[\])]|§\s?\d+[.)]?|(?:no|nr|n)\.\s?\d+)\s+\S", re.IGNORECASE)
PAGES = re.compile(r"[^\W\d_].*?[\s.]\d+f{0,2}\.?(?:, ?\d+f{0,2}\.?)*\s*$")
MISREAD = re.compile("[\\u00c2-\\u00f4][\\u0080-\\u00bf]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Signs of editions, which stand in words without spoiling them.
EDITION = re.compile("[][{}()<>⟦⟧⟨⟩\u0323]")
LETTER_NOISE = re.compile(r"[^\W_]*(?:[^\W\d_][\d!^|~*$%&#@\\=+_\"`][^\W_]*|[\d!^|~*$%&#@\\=+_\"`]+[^\W\d_])[^\W_]*")


#: Lines without any of these characters need no search for cells of a table, numbers, noise or wrong encodings.
UNUSUAL = re.compile(r"[\d|\t~^*@#$%&\\\\=+!_\"`\u0080-\u00bf]|   ")
NUMBER = re.compile(r"(?<!\S)[^\w\s]*\d[\d.,/:-]*f{0,2}[^\w\s]*(?!\S)")
SIGNS = re.compile(r"(?<!\S)[^\w\s.…·,;:!?’'-]{1}[^\w\s]{2,}(?!\S)")
LONG = re.compile(r"\S{41,}")
SINGLE = re.compile(r"(?<!\S)\S[.·,]?(?!\S)")
#: Letters in an order that no writing has: a capital after a small letter.
SOUP = re.compile(r"[a-zà-ÿα-ωά-ώἀ-ᾷ][A-ZΑ-Ω]")
#: Words of a stretch in which running language has more than one common word.
WINDOW = 24
#: Listed shares between which a text gets no label.
UNSURE = (0.4, 0.6)
#: Words that a worker remembers in plain form at most.
MEMORY = 300_000


class Plain(dict):
    """Words in lower case without accents, remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) > MEMORY:
            self.clear()
        new = word.lower()
        if not new.isascii():
            new = "".join(c for c in unicodedata.normalize("NFD", new) if not unicodedata.combining(c)).replace("ς", "σ")
        self[word] = new
        return new


def line_kinds(line: str, bare: str, n: float, ws: list[str], lines: int, labels: dict[str, int], copies: int) -> set[str]:
    """What speaks against running language in a line; bare: it without signs of the edition, n: its characters without spaces, ws: its words."""
    kinds = set()
    if BULLET.match(line):
        kinds.add("bullet")
    if ";" in line or "," in line or "|" in line or "\t" in line or "   " in line:
        if CELLS.search(line):
            kinds.add("cell")
    if ":" in line and len(ws) <= 9 and LABEL.match(line):
        k = labels.get(line.split(":")[0], 0)
        if k > 1 or lines > 3 and len(labels) > lines / 3:
            kinds.add("label")
    if copies > 2 and lines > 3:
        kinds.add("repeated")
    if n > 40 and sum(map(len, LONG.findall(line))) > 0.5 * n:
        kinds.add("long")
    if n >= 8 and (2 * len(ws) > n or "." in line and 3 * len(ws) > n) and len(SINGLE.findall(line)) > 0.6 * len(line.split()):
        kinds.add("spaced")
    if not UNUSUAL.search(line):
        return kinds
    tokens = line.count(" ") + 1
    numbers = len(NUMBER.findall(line))
    if numbers:
        if lines > 2 and len(ws) <= 12 and PAGES.search(line):
            kinds.add("page")
        if numbers >= max(2, 0.3 * tokens):
            kinds.add("number")
    if sum(map(len, LETTER_NOISE.findall(bare))) + sum(map(len, SIGNS.findall(bare))) > 0.3 * n:
        kinds.add("garbled")
    if sum(map(len, MISREAD.findall(line))) > 0.3 * n:
        kinds.add("encoding")
    return kinds


def unlike(ws: list[str], lines: int, marked: bool, common: set[str]) -> tuple[float, float]:
    """Share of a run of words without the common words of running language, and 1 if it is a repetition of few words, else 0."""
    if not ws:
        return 1.0, 0.0
    distinct = len(set(ws))
    if len(ws) >= 20 and distinct < 40 and distinct < (0.25 if len(ws) <= 300 else 0.12) * len(ws):
        return 1.0, 1.0
    if len(ws) > 40 and len(set(zip(ws, ws[1:], ws[2:], strict=False))) < 0.4 * (len(ws) - 2):
        return 1.0, 1.0
    hits = [w in common for w in ws]
    total = sum(hits)
    if len(ws) < 12 and lines <= 2:
        return float(marked and not total), 0.0
    if total < (0.1 if len(ws) >= 30 else 0.06) * len(ws):
        return 1.0, 0.0
    if len(ws) < WINDOW:
        return 0.0, 0.0
    bad = WINDOW * sum(sum(hits[i : i + WINDOW]) <= 1 for i in range(0, len(ws) - WINDOW + 1, WINDOW))
    rest = len(ws) % WINDOW  # judged by the last window, which ends with the run
    return (bad + rest * (sum(hits[-WINDOW:]) <= 1)) / len(ws), 0.0


def listed_share(text: str, common: set[str], plain: Plain) -> float:
    """Share of the characters of a text that are no running language by the rules; common: frequent words, plain."""
    if "<" in text:
        text = text.replace("<gap/>", " … ").replace("<UNK>", " … ")
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    copies = Counter(lines) if len(lines) > 3 else {}
    labels = Counter(x.split(":")[0] for x in lines if ":" in x) if ":" in text else {}
    runs: list[tuple[float, int, list[str]]] = []
    loose = marked = False
    size = listed = 0.0
    n_words = 0
    edited = EDITION.search(text) is not None
    for line in lines:
        n = float(len(line) - line.count(" "))
        size += n
        bare = EDITION.sub("", line) if edited else line
        ws = [plain[w] for w in WORD.findall(bare)]
        n_words += len(ws)
        if line_kinds(line, bare, n, ws, len(lines), labels, copies.get(line, 1)):
            listed += n
            loose, marked = False, True
        elif loose:
            own = runs[-1]
            runs[-1] = (own[0] + n, own[1] + 1, own[2] + ws)
        else:
            runs.append((n, 1, ws))
            loose = True
    soup = bool(runs) and len(SOUP.findall(text)) > 0.05 * n_words
    for n, k, ws in runs:
        bad, repeated = unlike(ws, k, marked, common)
        listed += n * (1.0 if soup and len(ws) >= 5 else max(bad, repeated))
    return min(1.0, listed / (size or 1))


def weak_label(share: float) -> int | None:
    """1 for junk and 0 for prose where the rules are sure, None between."""
    return None if UNSURE[0] <= share <= UNSURE[1] else int(share > UNSURE[1])
