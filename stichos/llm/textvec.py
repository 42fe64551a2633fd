"""Texts as flat code-point arrays: words, their folded letters and hashes, for a whole Arrow batch at a time.

Words are read as they look: look-alike letters of a word are brought to its script, case, accents, under-dots,
punctuation and editorial signs are ignored, a word divided over a line end is one word, and a word with lost or masked
letters is kept but marked as damaged.  All work is NumPy over one array of code points per chunk of texts; chunks are
bounded by characters, so memory does not depend on the batch, except that one text is never divided.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .lookalikes import LIMIT, SCRIPTS, is_invisible, script_of, to_script

SEP, LETTER, SKIP, DOT, LOST = 0, 1, 2, 3, 4
ROW_END = "\x1e"
CHUNK_CHARS = 400_000
U64 = np.uint64
P_CHAR = U64(0x9E3779B97F4A7C15)
P_WORD = U64(0xD6E8FEB86659FD93)

#: Signs of the edition that stand within words and are no part of them.
EDITORIAL = "[](){}<>⟦⟧⟨⟩'’ʼ"


@lru_cache(maxsize=1)
def categories() -> np.ndarray:
    """The two letters of each code point's general category."""
    every = "".join(map(unicodedata.category, map(chr, range(LIMIT))))
    return np.frombuffer(every.encode("ascii"), np.uint8).reshape(LIMIT, 2)


def of_category(*names: str) -> np.ndarray:
    """Whether each code point is of one of the categories, which are given by one letter or both."""
    kind = categories()
    out = np.zeros(LIMIT, bool)
    for name in names:
        out |= (kind[:, : len(name)] == np.frombuffer(name.encode("ascii"), np.uint8)).all(1)
    return out


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray], dict[int, str]]:
    """kind, folded letter and script of each code point; the replacement tables by script; letters that fold to several."""
    kind = np.zeros(LIMIT, np.uint8)
    fold = np.arange(LIMIT, dtype=np.uint32)
    script = np.zeros(LIMIT, np.uint8)
    several: dict[int, str] = {}
    letter = of_category("L", "N")
    kind[letter] = LETTER
    kind[of_category("M")] = SKIP
    kind[[cp for cp in np.flatnonzero(~letter & ~of_category("Z", "Cn", "Co", "Cs")).tolist() if is_invisible(chr(cp)) or chr(cp) in EDITORIAL]] = SKIP
    letter[0x3400:0xA490] = letter[0xAC00:0xD800] = letter[0x20000:] = False  # ideographs and syllables fold to themselves
    for cp in np.flatnonzero(letter).tolist():
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c)[0] in "LN").lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", base) if unicodedata.category(c)[0] in "LN").replace("ς", "σ").replace("ϲ", "σ").replace("ß", "ss")
        fold[cp] = ord(base[0]) if base else cp
        if len(base) > 1:
            several[cp] = base
        script[cp] = script_of(ch)
    kind[ord(".")] = DOT
    kind[0x1E] = SEP
    kind[ord("\n")] = SEP
    turn = {}
    for bit, pairs in to_script().items():
        table = np.arange(LIMIT, dtype=np.uint32)
        # an accented look-alike turns by its base letter
        base_of = {ord(a): b for a, b in pairs.items()}
        for cp in np.flatnonzero((script > 0) & (script != bit)).tolist():
            base = unicodedata.normalize("NFKD", chr(cp))[0]
            if ord(base) in base_of:
                table[cp] = ord(base_of[ord(base)])
        turn[bit] = table
    return kind, fold, script, turn, several


@lru_cache(maxsize=1)
def _several() -> np.ndarray:
    flag = np.zeros(LIMIT, bool)
    flag[list(tables()[4])] = True
    return flag


class Words:
    """The words of a chunk.

    row: text of each word; hash: its 64-bit hash; ok: no letter lost or masked; start, size: its part of letters (folded
    code points) and of place (where they stand in codes(texts)); first: index of each text's first word, with the number of words
    at the end.
    """

    __slots__ = ("first", "hash", "letters", "ok", "place", "row", "size", "start")

    def __init__(self, row, hash_, ok, start, size, letters, place, n_rows):
        self.row, self.hash, self.ok, self.start, self.size, self.letters, self.place = row, hash_, ok, start, size, letters, place
        self.first = np.searchsorted(row, np.arange(n_rows + 1))

    def text(self, i: int) -> str:
        """Word i, folded."""
        return self.letters[self.start[i] : self.start[i] + self.size[i]].astype("<u4").tobytes().decode("utf-32-le")


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of at most so many characters together, or one longer text; with the index of the first. Null counts as empty."""
    at, size, own = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if own and size + len(t) > limit:
            yield at, own
            at, size, own = i, 0, []
        own.append(t)
        size += len(t)
    if own:
        yield at, own


def codes(texts: list[str]) -> np.ndarray:
    """Code points of all texts, each followed by ROW_END."""
    big = ROW_END.join(t.replace(ROW_END, " ") if ROW_END in t else t for t in texts) + ROW_END
    if "ß" in big:
        big = big.replace("ß", "ss")
    cp = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
    grown = cp[_several()[cp]]
    if len(grown):
        for c in np.unique(grown).tolist():
            big = big.replace(chr(c), tables()[4][c])
        cp = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp


def origins(texts: list[str]) -> np.ndarray:
    """For each position of codes(texts) the place of its character in the texts, each of which is followed by one more place."""
    cp = np.frombuffer((ROW_END.join(texts) + ROW_END).encode("utf-32-le", "surrogatepass"), np.uint32)
    grown = np.where(cp == ord("ß"), 2, 1)
    for c in np.unique(cp[_several()[cp]]).tolist():
        grown[cp == c] = len(tables()[4][c])
    return np.repeat(np.arange(len(cp)), grown)


def _followed(cp: np.ndarray, at: np.ndarray, word: str) -> np.ndarray:
    """Those of the positions where word stands."""
    at = at[at + len(word) <= len(cp)]
    for k, ch in enumerate(word):
        at = at[cp[at + k] == ord(ch)]
    return at


def classes(cp: np.ndarray) -> np.ndarray:
    """Kind of each position, by its surroundings: gaps, vacats, lost letters and divided words are resolved."""
    kind = tables()[0][cp]
    at = np.flatnonzero(cp == ord("<"))
    if len(at):
        for sign in ("<gap/>", "<gap />", "<UNK>"):
            hit = _followed(cp, at, sign)
            for k in range(1, len(sign)):
                kind[hit + k] = SKIP
            kind[hit] = LOST
    for sign in ("vac.", "vacat"):
        hit = _followed(cp, np.flatnonzero(cp == ord("v")), sign)
        if len(hit):
            hit = hit[(hit == 0) | (kind[np.maximum(hit - 1, 0)] != LETTER)]
            end = hit + len(sign)
            hit = hit[kind[np.minimum(end, len(cp) - 1)] != LETTER]
            for k in range(len(sign)):
                kind[hit + k] = SEP
    dots = np.flatnonzero((kind == DOT) & (cp == ord(".")))
    if len(dots):
        before, after = np.maximum(dots - 1, 0), np.minimum(dots + 1, len(cp) - 1)
        lost = (kind[before] == DOT) & (dots > 0) | (kind[after] == DOT) & (after > dots) | (cp[before] == ord("[")) | (cp[after] == ord("]")) & (cp[before] == ord("["))
        lost |= (kind[before] == LETTER) & (kind[after] == LETTER)
        kind[dots] = np.where(lost, LOST, SEP)
    hyphen = np.flatnonzero(cp == ord("-"))
    if len(hyphen):
        after = np.minimum(hyphen + 1, len(cp) - 1)
        divided = cp[after] == ord("\n")
        kind[hyphen] = SKIP
        inner = hyphen[~divided]
        spaced = (kind[np.maximum(inner - 1, 0)] == SEP) | (kind[np.minimum(inner + 1, len(cp) - 1)] == SEP)
        kind[inner[spaced]] = SEP
        kind[after[divided]] = SKIP
    return kind


def unify(letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Letters with each word in one script: words of several scripts turn to the one that can print all their letters, the most frequent of those."""
    _, _, script, turn, _ = tables()
    s = script[letters]
    scripts = np.bitwise_or.reduceat(s, start)
    mixed = np.flatnonzero((scripts & (scripts - 1)) != 0)
    if not len(mixed):
        return letters
    # the letters of mixed words as one array, tried in each script at once
    n = size[mixed]
    begin = np.cumsum(n) - n
    at = np.repeat(start[mixed] - begin, n) + np.arange(int(n.sum()))
    own, ws = letters[at], s[at]
    best = np.full(len(mixed), np.iinfo(np.int64).max)
    out = own.copy()
    for bit in SCRIPTS.values():
        turned = np.where((ws == bit) | (ws == 0), own, turn[bit][own])
        left = np.add.reduceat(((script[turned] != bit) & (ws != 0)).astype(np.int64), begin)
        mine = np.add.reduceat((ws == bit).astype(np.int64), begin)
        # fewest letters left, then most of its own, then the first script
        key = np.where(mine > 0, (left << 40) - (mine << 8) + bit, np.iinfo(np.int64).max)
        better = key < best
        best = np.where(better, key, best)
        out = np.where(np.repeat(better, n), turned, out)
    letters = letters.copy()
    letters[at] = out
    return letters


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that each bit depends on all."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(texts: list[str]) -> Words:
    """The words of texts, in order. Texts may be empty."""
    with np.errstate(over="ignore"):
        cp = codes(texts)
        kind = classes(cp)
        keep = np.flatnonzero((kind == LETTER) | (kind == LOST))
        n = len(texts)
        if not len(keep):
            none = np.zeros(0, np.int64)
            return Words(none, none.astype(U64), none.astype(bool), none, none, none.astype(np.uint32), none, n)
        seps = np.cumsum(kind == SEP, dtype=np.int64)[keep]
        start = np.flatnonzero(np.r_[True, seps[1:] != seps[:-1]])
        size = np.diff(np.r_[start, len(keep)])
        row = np.cumsum(cp == 0x1E, dtype=np.int64)[keep[start]]
        lost = kind[keep] == LOST
        ok = ~np.logical_or.reduceat(lost, start)
        letters = unify(np.where(lost, ord("."), cp[keep]), start, size)
        letters = tables()[1][letters]
        position = np.arange(len(letters)) - np.repeat(start, size)
        longest = int(size.max())
        powers = _powers(int(P_CHAR), 1 << max(8, (longest - 1).bit_length()))
        value = (letters.astype(U64) + U64(0x51ED27)) * U64(0xA24BAED4963EE407)
        h = np.add.reduceat((value ^ (value >> U64(29))) * powers[position], start)
        return Words(row, mix(h), ok, start, size, letters, keep, n)


def different(values: np.ndarray) -> np.ndarray:
    """The different values, in order."""
    own = np.sort(values)
    return own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of k undamaged words of one text."""
    n = len(w.row) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    bad = np.r_[0, np.cumsum(~w.ok)]
    at = np.flatnonzero((w.row[:n] == w.row[k - 1 :]) & (bad[k:] == bad[:n]))
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), U64)
        for i in range(k):
            h = h * P_WORD + w.hash[at + i]
        return at, mix(h)
