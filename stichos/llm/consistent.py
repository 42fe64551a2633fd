"""One consistent form for text that looks the same: look-alike classes, representatives, and a multi-pattern rewrite.

Classes of strings that print alike are built by union-find (lookalikes); in each class and script the representative is
the most frequent member of the corpus among those in standard form: composed, of ordinary width, one letter a character,
visible.  All other members are patterns of an Aho-Corasick automaton that rewrites a text greedily, leftmost and longest
first.  A word with letters of several scripts is then rewritten by the automaton of the script that can print all of it.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .lookalikes import LIMIT, SCRIPTS, UNDERDOT, UnionFind, groups, is_invisible, is_space, plain_space, script_of, to_script

#: Decompositions of Unicode that keep the look of a letter.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<font>")
#: Letters with a compatibility decomposition that look different from it.
OWN_LOOK = "ſϐϑϒϓϔϕϖϰϱϲϴϵϹẛ"


def pairs() -> Iterator[tuple[str, str]]:
    """Pairs of strings that print alike, by rule. Syllables and ideographs have no other spelling than NFC finds."""
    own = ~tv.of_category("Cn", "Co", "Cs")
    own[:0x80] = own[0x3400:0xF900] = own[0x20000:] = False
    for cp in np.flatnonzero(own).tolist():
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if not d or ch in OWN_LOOK:
            continue
        if d[0] != "<":
            yield ch, unicodedata.normalize("NFD", ch)
            yield ch, unicodedata.normalize("NFC", ch)
            yield from ((ch, v) for v in variants(unicodedata.normalize("NFD", ch)))
        elif other_width(ch) and unicodedata.category(ch)[0] != "Z":
            yield ch, unicodedata.normalize("NFKC", ch)
    for g in groups():
        yield from itertools.pairwise(g.values())


def variants(nfd: str) -> list[str]:
    """Other spellings of a letter with marks: marks in any order, some of them composed."""
    base, marks = nfd[0], nfd[1:]
    if not marks or len(marks) > 3:
        return []
    orders = {"".join(p) for p in itertools.permutations(marks)}
    out = {base + o for o in orders}
    out |= {unicodedata.normalize("NFC", base + o[:k]) + o[k:] for o in orders for k in range(1, len(marks))}
    return [v for v in out if len(v) > 1 and unicodedata.normalize("NFC", v) == unicodedata.normalize("NFC", nfd)]


def standard(s: str) -> bool:
    """Whether a string is in standard form, apart from the script of its neighbours."""
    return unicodedata.normalize("NFC", s) == s and not any(is_invisible(c) or other_width(c) for c in s)


def other_width(c: str) -> bool:
    """Whether a character is a wide, narrow, styled or joined writing of ordinary ones."""
    kind = unicodedata.decomposition(c).split(" ")[0]
    return c not in OWN_LOOK and (kind in ("<wide>", "<narrow>") or (kind in SAME_LOOK and unicodedata.category(c)[0] in "LN"))


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by ROW_END, and where each text begins."""
    big = tv.ROW_END.join(texts) + tv.ROW_END
    cp = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return cp, np.cumsum(size) - size


class Rewriter:
    """The automata for given code-point frequencies. Frequencies decide between standard members of a class, and between scripts."""

    def __init__(self, frequency: dict[int, int] | None = None):
        frequency = frequency or {}
        rate = lambda s: min((frequency.get(ord(c), 0) for c in s), default=0)
        union = UnionFind()
        for a, b in pairs():
            union.union(a, b)
        change: dict[str, str] = {}
        for members in union.classes():
            best: dict[int, str] = {}
            for m in members:
                if standard(m):
                    s = script_of(m[0])
                    if s not in best or (rate(m), -len(m), m) > (rate(best[s]), -len(best[s]), best[s]):
                        best[s] = m
            for m in members:
                s = script_of(m[0])
                if m not in best.values():
                    change[m] = best.get(s) or unicodedata.normalize("NFC", m)
        for m, to in list(change.items()):
            if len(m) > 1 and unicodedata.combining(m[-1]):  # an under-dot may stand between a letter and its marks
                change.setdefault(m[0] + UNDERDOT + m[1:], unicodedata.normalize("NFC", to + UNDERDOT))
        for cp in np.flatnonzero(tv.of_category("C", "Z", "Mn", "Lo", "So") & ~tv.of_category("Cn", "Co", "Cs")).tolist():
            ch = chr(cp)
            if is_invisible(ch):
                change[ch] = ""
            elif is_space(ch) and ch not in " \n":
                change[ch] = plain_space(ch)
        change["\r\n"] = "\n"
        self.change = {a: b for a, b in change.items() if a != b}
        self.automaton = self._automaton(self.change)
        self.trigger = np.zeros(LIMIT, bool)
        self.trigger[[ord(a[-1]) for a in self.change]] = True
        self.trigger[[ord("\n"), ord(tv.ROW_END)]] = False  # "\r\n" has its "\r"; the end of a row is looked for apart
        self.script_rate = {bit: sum(n for c, n in frequency.items() if script_of(chr(c)) == bit) for bit in SCRIPTS.values()}
        self.by_script = {}
        for bit, table in to_script().items():
            full = dict(table)
            for cp in range(0xC0, 0x2000):  # letters with accents turn by their base letter
                nfd = unicodedata.normalize("NFD", chr(cp))
                if len(nfd) > 1 and nfd[0] in table:
                    full[chr(cp)] = unicodedata.normalize("NFC", table[nfd[0]] + nfd[1:])
            self.by_script[bit] = (full, self._automaton(full))

    @staticmethod
    def _automaton(change: dict[str, str]) -> ahocorasick.Automaton:
        """An automaton over UTF-8 bytes (as Latin-1 characters): its nodes stay narrow, whatever the number of letters."""
        a = ahocorasick.Automaton()
        for old, new in change.items():
            key = old.encode().decode("latin-1")
            a.add_word(key, (len(key), new.encode().decode("latin-1")))
        a.make_automaton()
        return a

    @staticmethod
    def _apply(automaton: ahocorasick.Automaton, text: str) -> str:
        out, done = [], 0
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        for end, (n, new) in automaton.iter_long(raw):
            out += (raw[done : end + 1 - n], new)
            done = end + 1
        return "".join((*out, raw[done:])).encode("latin-1").decode("utf-8", "surrogatepass") if done else text

    def rewrite(self, texts: list[str]) -> list[str]:
        """The texts in consistent form.

        The automaton runs over the texts that are not composed or have a code point that only patterns have (odd spaces, ...), the
        search for mixed words over those with letters of several scripts: no other text can change.
        """
        if not texts:
            return []
        cp, starts = _flat(texts)
        out = list(texts)
        own = np.logical_or.reduceat(self.trigger[cp], starts) | np.fromiter((tv.ROW_END in t or not unicodedata.is_normalized("NFC", t) for t in texts), bool, len(texts))
        for i in np.flatnonzero(own):
            new = self._apply(self.automaton, out[i])
            out[i] = new if unicodedata.is_normalized("NFC", new) else unicodedata.normalize("NFC", new)
        scripts = np.bitwise_or.reduceat(tv.tables()[2][cp], starts)
        several = np.flatnonzero((scripts & (scripts - 1)) != 0).tolist()
        for i, at in self._mixed([out[i] for i in several]).items():
            out[several[i]] = self._one_script(out[several[i]], at)
        return out

    @staticmethod
    def _mixed(texts: list[str]) -> dict[int, list[np.ndarray]]:
        """Positions of the letters of each word with several scripts, by text."""
        cp, starts = _flat(texts)
        kind, script = tv.classes(cp), tv.tables()[2][cp]
        keep = np.flatnonzero((kind == tv.LETTER) & (script > 0))
        found: dict[int, list[np.ndarray]] = {}
        if not len(keep):
            return found
        seps = np.cumsum(kind == tv.SEP, dtype=np.int64)[keep]
        # neighbours of different scripts in one word are rare; only their words are looked at
        odd = np.unique(seps[1:][(script[keep][1:] != script[keep][:-1]) & (seps[1:] == seps[:-1])])
        if not len(odd):
            return found
        for s in odd:
            at = keep[np.searchsorted(seps, s) : np.searchsorted(seps, s, "right")]
            row = int(np.searchsorted(starts, at[0], "right")) - 1
            found.setdefault(row, []).append(at - starts[row])
        return found

    def _one_script(self, text: str, words: list[np.ndarray]) -> str:
        chars = list(text)
        overall = [script_of(c) for c in text]
        for at in words:
            own = [chars[i] for i in at]
            scripts = [script_of(c) for c in own]
            best = min(
                {s for s in scripts if s},
                key=lambda bit: (sum(s != bit and c not in self.by_script[bit][0] for s, c in zip(scripts, own, strict=True)), -scripts.count(bit), -overall.count(bit), -self.script_rate[bit], bit),
            )
            automaton = self.by_script[best][1]
            for i, c, s in zip(at, own, scripts, strict=True):
                if s != best:
                    chars[i] = self._apply(automaton, c)
        return unicodedata.normalize("NFC", "".join(chars))


def frequencies(texts: DataFrame, text: str = "text") -> dict[int, int]:
    """How often each code point occurs in all texts; at most one row per code point reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LIMIT, np.int64)
        for batch in batches:
            for _, part in tv.chunks(batch["t"].tolist(), 4_000_000):
                cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                total += np.bincount(cp, minlength=LIMIT)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cp": at, "n": total[at]})

    rows = texts.filter(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(count, "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n"))
    return {r.cp: r.n for r in rows.collect()}


@lru_cache(maxsize=2)
def _rewriter(frequency: tuple[tuple[int, int], ...]) -> Rewriter:
    """The automata of a worker, built once for all its tasks."""
    return Rewriter(dict(frequency))


def rewritten(texts: DataFrame, keys: list[str], text: str = "text", frequency: dict[int, int] | None = None) -> DataFrame:
    """The key columns, text in consistent form and changed (whether it was not); one row per text that is not null.

    Empty texts stay empty and unchanged; repeated rows give repeated rows.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequencies(texts, text) if frequency is None else frequency)
    schema = ", ".join(f"k{i} {texts.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = _rewriter(tuple(sorted(shared.value.items())))
        for batch in batches:
            own = batch["t"].tolist()
            new = [t for _, part in tv.chunks(own) for t in rewriter.rewrite(part)]
            batch["t"], batch["changed"] = new, [a != b for a, b in zip(own, new, strict=True)]
            yield batch

    packed = texts.filter(F.col(text).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    return packed.mapInPandas(run, f"{schema}, t string, changed boolean").withColumnsRenamed({**{f"k{i}": k for i, k in enumerate(keys)}, "t": text})


def records(ab: DataFrame, dev_case: DataFrame) -> DataFrame:
    """All texts of the two tables: table_name, rec_key, text."""
    a = ab.select(F.lit("ab").alias("table_name"), F.col("id").alias("rec_key"), F.col("training_text").alias("text"))
    return a.unionByName(dev_case.select(F.lit("dev_case").alias("table_name"), F.col("case_id").cast("string").alias("rec_key"), F.col("y").alias("text")))


def found(rewritten_: DataFrame) -> DataFrame:
    """Records whose text was not in consistent form, once each."""
    return rewritten_.filter("changed and rec_key is not null").select("table_name", "rec_key").distinct()
