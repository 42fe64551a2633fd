"""Evaluation records that recur, exactly or almost, in the training texts.

A case and a text overlap where the longest common sequence of their words is at least four fifths of the word number of
the longer one.  Short passages of the cases - three words in a row, and two pairs around one word - are the patterns of
Aho-Corasick automata over words, one for each shard of the cases, whose size is bounded.  A text is scanned only by the shards
with a case that it may overlap (Keys), each of which is built once, in a task that takes the texts as a stream, in the failure-free form
of the automaton: every word of a text starts a walk of its own, which ends where the trie has no way on, so the walks of a whole
batch go in step.  The matched intervals of a case and a text are merged into a coverage of the case, pairs with too little of it
for their lengths are dropped, and the longest common sequence decides.

Where a text may overlap is found without reading it for every shard.  Of the words of a common sequence, take the two that are rarest
in all cases.  At most n - 0.8 n words of a text of n words are not in the sequence, so both of the two stand among its n - 0.8 n + 2 rarest
words, and among those of the case, in the same order: the pairs of these words are keys by which cases and texts are brought
together.  A word that is in no case, or damaged, is not in the sequence and takes up room for others.  Where two keys meet, the places
of their words bound the sequence from above, and so do the words known by the parities of 128 classes of words.  Pairs of which the
longer one has more than LONG words meet by passages, whose number does not grow with the square of theirs.

No pair is lost.  Let N be the longer of the word numbers n (case) and m (text), L >= 0.8 N the common sequence, lying in
b + 1 runs of words that are neighbours in both.  T = L - 2 (b + 1) + o triples stay whole, o being the number of runs of
one word.  Of the breaks, g consist of one extra word of the case alone; all but 2 o of them stand between two whole pairs
of words, which the text has together.  The n - L and m - L words outside L make the breaks: b <= m - L + (n - L + g) / 2.
So T plus half of those places is at least L - 2 (m - L) - 1.5 (n - L) - 2 >= 3.6 N - 2 m - 1.5 n - 2.  A merged interval of k
words counts as k - 2 triples, which is never less than the triples in it.  For texts of up to SHORT words, where the bound may be
nothing, pairs of neighbours are patterns as well: at least 2.4 N - n - m - 1 of them stay whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import textvec as tv

U64 = np.uint64
#: Share of the longer word number that the common sequence has at least, as a fraction of integers.
PART, WHOLE = 4, 5
#: Word number up to which texts are also compared by pairs of neighbours.
SHORT = 31
#: Code points of the cases of a shard, about (some 35 MB of automaton), and shards that one task scans with, one after the other, about.
SHARD_CHARS, SCAN_SHARDS = 3_000_000, 8
#: Code points of the cases whose keys a task holds, about (some 10 MB of keys).
KEY_CHARS = 1_000_000
#: Word number up to which pairs of rare words are keys.
LONG = 128
#: Slots of the counts of words, by which words are rare, and of the texts to be scanned.
WORD_SLOTS, TEXT_SLOTS = 1 << 20, 1 << 24
#: Bytes of the texts' keys that are looked up at once, and meetings of keys that are judged at once.
PIECE, MEETINGS = 4_000_000, 400_000
#: Patterns by kind: places of their words in the case, and the words that the text has in a row.
TRIPLE, AROUND, PAIR, SINGLE = (0, 1, 2), (0, 1, 3, 4), (0, 1), (0,)
FOUND = "c long, t long, case_words int, text_words int, common int"


class Index:
    """Numbers of 64-bit keys, by open addressing; the keys of a level of the trie."""

    def __init__(self, keys: np.ndarray):
        self.keys = tv.different(keys)
        bits = max(4, int(len(self.keys) * 2).bit_length())
        self.shift, self.last = U64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(self.keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = np.flatnonzero(self.table[slot] < 0)
            self.table[slot[free]] = left[free]  # of several for one slot the last stays
            out = self.table[slot] != left
            left, slot = left[out], (slot[out] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for those that are not there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at, slot = np.arange(len(keys)), self._slot(keys)
        while len(at):
            got = self.table[slot]
            hit = (got >= 0) & (self.keys[got] == keys[at])
            out[at[hit]] = got[hit]
            on = (got >= 0) & ~hit
            at, slot = at[on], (slot[on] + 1) & self.last
        return out


class Automaton:
    """The trie of the passages of a shard of cases, level by level, with the cases and places of each passage."""

    def __init__(self, c: np.ndarray, texts: list[str]):
        parts = [tv.words(part) for _, part in tv.chunks(texts)]
        self.c = c
        self.n = np.concatenate([np.diff(w.first) for w in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.r_[0, np.cumsum(self.n)]
        self.hash = np.concatenate([np.where(w.ok, w.hash, U64(0)) for w in parts]) if parts else np.zeros(0, U64)
        case = np.repeat(np.arange(len(self.n)), self.n)
        self.words = Index(self.hash[self.hash > 0])
        symbol = np.where(self.hash > 0, self.words.find(self.hash), -1)
        starts = {p: self._starts(p, case, symbol) for p in (TRIPLE, AROUND, PAIR, SINGLE)}
        near = [at for p, at in starts.items() if p != SINGLE]
        pairs = tv.different(np.concatenate(near))
        self.levels = [Index(self._key(symbol[pairs], symbol[pairs + 1]))]
        node = np.full(len(symbol) + 1, -1, np.int64)
        node[pairs] = self.levels[0].find(self._key(symbol[pairs], symbol[pairs + 1]))
        t, a = starts[TRIPLE], starts[AROUND]
        third = np.r_[self._key(node[t], symbol[t + 2]), self._key(node[a], symbol[a + 3])]
        self.levels.append(Index(third))
        third = self.levels[1].find(third)
        fourth = self._key(third[len(t) :], symbol[a + 4])
        self.levels.append(Index(fourth))
        # passages by the node where they end: its cases and places in a row
        self.ends = {
            TRIPLE: self._ends(third[: len(t)], len(self.levels[1].keys), t),
            AROUND: self._ends(self.levels[2].find(fourth), len(self.levels[2].keys), a),
            PAIR: self._ends(node[starts[PAIR]], len(self.levels[0].keys), starts[PAIR]),
            SINGLE: self._ends(symbol[starts[SINGLE]], len(self.words.keys), starts[SINGLE]),
        }
        self.case = case.astype(np.int32)

    @staticmethod
    def _key(node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return node.astype(U64) << U64(32) | symbol.astype(U64)

    def _starts(self, places: tuple[int, ...], case: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where a passage of this kind begins in the cases: all its words whole, none of another case."""
        n = max(0, len(case) - places[-1])
        good = case[:n] == case[places[-1] : places[-1] + n]
        for k in places:
            good = good & (symbol[k : k + n] >= 0)
        most = {PAIR: SHORT * WHOLE // PART, SINGLE: 1}.get(places)
        return np.flatnonzero(good if most is None else good & (self.n[case[:n]] <= most))

    @staticmethod
    def _ends(node: np.ndarray, nodes: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds by node, and the words of the cases where its passages begin."""
        order = np.argsort(node, kind="stable")
        return np.searchsorted(node[order], np.arange(nodes + 1)).astype(np.int32), at[order].astype(np.int32)

    def walk(self, w: tv.Words) -> dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]]:
        """For each kind of passage the words of the texts where a walk begins that reaches its level, and the node there."""
        symbol = np.where(w.ok, self.words.find(w.hash), -1)
        at = np.flatnonzero(symbol >= 0)
        node, reached = symbol[at], []
        for depth, level in enumerate(self.levels, 1):
            on = at + depth < len(symbol)
            at, node = at[on], node[on]
            on = (symbol[at + depth] >= 0) & (w.row[at + depth] == w.row[at])
            at, node = at[on], node[on]
            node = level.find(self._key(node, symbol[at + depth]))
            at, node = at[node >= 0], node[node >= 0]
            reached.append((at, node))
        one = np.flatnonzero(symbol >= 0)
        return {PAIR: reached[0], TRIPLE: reached[1], AROUND: reached[2], SINGLE: (one, symbol[one])}

    def hits(self, w: tv.Words) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, text, case, place in the case) of the passages that stand in the texts at a place that an overlap allows."""
        m = np.diff(w.first)
        for kind, (at, node) in self.walk(w).items():
            most = {PAIR: SHORT, SINGLE: 1}.get(kind)
            if most is not None:
                short = m[w.row[at]] <= most
                at, node = at[short], node[short]
            bound, begin = self.ends[kind]
            count = bound[node + 1] - bound[node]
            place = np.repeat(bound[node] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            begin = begin[place].astype(np.int64)
            text, case = np.repeat(w.row[at], count), self.case[begin].astype(np.int64)
            p, q = begin - self.first[case], np.repeat(at - w.first[w.row[at]], count)
            n, size = self.n[case], m[text]
            longest = np.maximum(n, size)
            near = (PART * longest <= WHOLE * np.minimum(n, size)) & (WHOLE * (p - q) <= WHOLE * n - PART * longest) & (WHOLE * (q - p) <= WHOLE * size - PART * longest)
            yield kind, text[near], case[near], p[near]

    def likely(self, w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, case) of the pairs whose merged intervals cover enough of the case for their word numbers."""
        m = np.diff(w.first)
        keys, halves, shorts = [], [], []
        bits = int(self.n.max(initial=0)).bit_length()
        for kind, text, case, p in self.hits(w):
            # one number for each text, case and place
            place = tv.different((text * len(self.n) + case) << bits | p)
            pair, p = place >> bits, place & ((1 << bits) - 1)
            same = np.r_[False, pair[1:] == pair[:-1]]
            step = np.diff(p, prepend=0)
            merged = np.where(same & (step < len(TRIPLE)), step, 1) if kind == TRIPLE else np.ones(len(p), np.int64)
            keys.append(pair)
            halves.append({TRIPLE: 2 * merged, AROUND: merged}.get(kind, 0 * merged))
            shorts.append(merged if kind in (PAIR, SINGLE) else 0 * merged)
        pair, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        half, short = np.bincount(inverse, np.concatenate(halves), len(pair)), np.bincount(inverse, np.concatenate(shorts), len(pair))
        text, case = pair // max(1, len(self.n)), pair % max(1, len(self.n))
        n, size = self.n[case], m[text]
        longest = np.maximum(n, size)
        whole = (half > 0) & (10 * half >= 72 * longest - 40 * size - 30 * n - 40)
        brief = (short > 0) & (10 * short >= 24 * longest - 10 * n - 10 * size - 10)
        return text[whole | brief], case[whole | brief]

    def overlaps(self, w: tv.Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, case, words of the case, of the text, of their longest common sequence) of all overlaps with the texts."""
        h = np.where(w.ok, w.hash, U64(0))
        for text, case in zip(*(x.tolist() for x in self.likely(w)), strict=True):
            a, b = self.hash[self.first[case] : self.first[case + 1]], h[w.first[text] : w.first[text + 1]]
            common = common_length(a, b)
            if common and WHOLE * common >= PART * max(len(a), len(b)):
                yield text, case, len(a), len(b), common


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common sequence of two sequences of hashes, 0 standing for a word that agrees with none."""
    mask: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        if x:
            mask[x] = mask.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        m = mask.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Keys:
    """Keys of a chunk of records, by which those that may overlap meet: pairs of rare words, as heads with their tails, and passages.

    A head is the rarer word of its pairs, with all that is known of its record; the tails are the other words.
    """

    HEAD = np.dtype([("word", "<u4"), ("id", "<i8"), ("odd0", "<u8"), ("odd1", "<u8"), ("n", "u1"), ("lost", "u1"), ("rank", "u1"), ("place", "u1"), ("tails", "u1")])
    TAIL = np.dtype([("word", "<u4"), ("place", "u1")])
    PASSAGE = np.dtype([("key", "<u8"), ("id", "<i8"), ("n", "<i4"), ("place", "<i4")])

    def __init__(self, w: tv.Words, ids: np.ndarray, words: np.ndarray, near: np.ndarray, around: bool):
        """words: how often words of a slot occur in the cases; near: lengths that meet any of the other side; around: whether passages skip a word, as those of cases do."""
        n = np.diff(w.first)
        asked = near[np.minimum(n, len(near) - 1)] & (n > 0)
        self._pairs(w, ids, n, np.where(w.ok, words[_slot(w.hash)], 0), asked & (n <= LONG))
        self._passages(w, ids, n, asked & (WHOLE * n > PART * LONG), around)

    def _pairs(self, w: tv.Words, ids: np.ndarray, n: np.ndarray, count: np.ndarray, asked: np.ndarray) -> None:
        lost = np.bincount(w.row[count == 0], minlength=len(n))
        spare = n - _least(n) - lost
        at = np.flatnonzero((count > 0) & (asked & (spare >= 0))[w.row])
        # parities of the classes of a record's words
        odd = np.zeros((len(n), 2), np.uint64)
        np.bitwise_xor.at(odd, (w.row[at], (w.hash[at] >> U64(6) & U64(1)).astype(np.int64)), U64(1) << (w.hash[at] & U64(63)))
        at = at[np.lexsort((at, w.hash[at], count[at], w.row[at]))]
        row = w.row[at]
        size = np.bincount(row, minlength=len(n))
        rank = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        short = rank < spare[row] + 2
        at, row, rank = at[short], row[short], rank[short]
        size = np.bincount(row, minlength=len(n))
        tails = np.where(n[row] == 1, 1, size[row] - 1 - rank)
        head = np.flatnonzero(tails > 0)
        self.heads = np.empty(len(head), self.HEAD)
        h, r = at[head], row[head]
        for name, value in (("word", w.hash[h] >> U64(32)), ("id", ids[r]), ("odd0", odd[r, 0]), ("odd1", odd[r, 1]), ("n", n[r]), ("lost", lost[r]), ("rank", rank[head]), ("place", h - w.first[r]), ("tails", tails[head])):
            self.heads[name] = value
        tail = at[_runs(head + (n[r] > 1), tails[head])]
        self.tails = np.empty(len(tail), self.TAIL)
        self.tails["word"], self.tails["place"] = w.hash[tail] >> U64(32), tail - w.first[w.row[tail]]

    def _passages(self, w: tv.Words, ids: np.ndarray, n: np.ndarray, asked: np.ndarray, around: bool) -> None:
        parts = [np.zeros(0, self.PASSAGE)]
        for places in (TRIPLE, AROUND if around else (0, 1, 2, 3)) if asked.any() else ():
            last = max(0, len(w.row) - places[-1])
            good = asked[w.row[:last]] & (w.row[:last] == w.row[places[-1] : places[-1] + last])
            for k in places:
                good = good & w.ok[k : k + last]
            at = np.flatnonzero(good)
            part = np.empty(len(at), self.PASSAGE)
            with np.errstate(over="ignore"):
                key = np.full(len(at), len(places), np.uint64)
                for k in places:
                    key = key * tv.P_WORD + w.hash[at + k]
                part["key"] = tv.mix(key)
            part["id"], part["n"], part["place"] = ids[w.row[at]], n[w.row[at]], at - w.first[w.row[at]]
            parts.append(part)
        self.passages = np.concatenate(parts)

    @staticmethod
    def by_part(own: list[Keys], parts: int) -> pd.DataFrame:
        """(part, heads, tails, passages): a row of bytes for each part that has keys."""
        heads, tails, passages = (np.concatenate([getattr(k, x) for k in own]) for x in ("heads", "tails", "passages"))
        part = heads["word"].astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        first = np.cumsum(heads["tails"], dtype=np.int64) - heads["tails"]
        heads, tails, part = heads[order], tails[_runs(first[order], heads["tails"][order])], part[order]
        bound = np.searchsorted(part, np.arange(parts + 1))
        at = np.r_[0, np.cumsum(heads["tails"], dtype=np.int64)][bound]
        other = (passages["key"] % U64(parts)).astype(np.int64)
        order = np.argsort(other, kind="stable")
        passages, there = passages[order], np.searchsorted(other[order], np.arange(parts + 1))
        some = np.flatnonzero((np.diff(bound) > 0) | (np.diff(there) > 0)).tolist()
        return pd.DataFrame(
            {
                "part": np.array(some, np.int32),
                "heads": [heads[bound[i] : bound[i + 1]].tobytes() for i in some],
                "tails": [tails[at[i] : at[i + 1]].tobytes() for i in some],
                "passages": [passages[there[i] : there[i + 1]].tobytes() for i in some],
            }
        )


class Met:
    """The keys of a part of the cases, and what meets them.

    Keys are in order of their words, and of the word number, so that only those of lengths that an overlap allows meet.
    """

    FIELDS = ("odd0", "odd1", "id", "n", "lost", "place")

    def __init__(self, rows: pd.DataFrame):
        self.heads, self.tails, self.passages = self._read(rows)
        self.head, self.rank, self.key = self._expand(self.heads, self.tails)
        self.key |= self.heads["n"][self.head]
        order = np.argsort(self.key, kind="stable")
        self.key, self.head, self.rank, self.place = self.key[order], self.head[order], self.rank[order], self.tails["place"][order]
        self.own = {name: np.ascontiguousarray(self.heads[name]) for name in self.FIELDS}
        self.passages = self.passages[np.argsort(self.passages["key"], kind="stable")]

    @staticmethod
    def _read(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(b"".join(rows[name]), kind) for name, kind in (("heads", Keys.HEAD), ("tails", Keys.TAIL), ("passages", Keys.PASSAGE)))

    @staticmethod
    def _expand(heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The head of each tail, how many rarer words the tail's record has, and the key: both words, which of them stands first, and room for a word number."""
        head = np.repeat(np.arange(len(heads)), heads["tails"])
        rank = _runs(heads["rank"].astype(np.int64) + 1, heads["tails"]).astype(np.int16)
        after = (tails["place"] > heads["place"][head]).astype(np.uint64)
        return head, rank, heads["word"][head].astype(np.uint64) << U64(32) | tails["word"].astype(np.uint64) & U64(0xFFFFFE00) | after << U64(8)

    def pairs(self, rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of cases and of texts that may overlap, by the keys of rows."""
        heads, tails, passages = self._read(rows)
        head, rank, key = self._expand(heads, tails)
        order = np.argsort(key, kind="stable")
        key, head, rank, place = key[order], head[order], rank[order], tails["place"][order]
        n = heads["n"].astype(np.int64)
        least, most = _least(n).astype(np.uint64)[head], np.minimum(n * WHOLE // PART, LONG).astype(np.uint64)[head]
        other = {name: np.ascontiguousarray(heads[name]) for name in self.FIELDS}
        for mine, its in _meetings(self.key, key | least, key | most):
            yield self._possible(self.head[mine], self.rank[mine], self.place[mine], other, head[its], rank[its], place[its])
        passages = passages[np.argsort(passages["key"], kind="stable")]
        for mine, its in _meetings(self.passages["key"], passages["key"], passages["key"]):
            a, b = self.passages[mine], passages[its]
            n, m, p, q = (x.astype(np.int64) for x in (a["n"], b["n"], a["place"], b["place"]))
            least = _least(np.maximum(n, m))
            near = (np.maximum(n, m) > LONG) & (np.minimum(p, q) + np.minimum(n - p, m - q) >= least)
            yield a["id"][near], b["id"][near]

    def _possible(self, a: np.ndarray, a_rank: np.ndarray, a_place: np.ndarray, other: dict[str, np.ndarray], b: np.ndarray, b_rank: np.ndarray, b_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of those cases and texts whose sequence may be long enough, by heads, and ranks and places of tails."""
        own = self.own
        n, m = own["n"][a].astype(np.int16), other["n"][b].astype(np.int16)
        least = _least(np.maximum(n, m))
        # known words besides the sequence, at most: those of either side, and those that are rarer than the tail but the head
        spare, room = n - least - own["lost"][a], m - least - other["lost"][b]
        near = np.flatnonzero((a_rank - 1 <= spare) & (b_rank - 1 <= room))
        a, b = a[near], b[near]
        odd = np.bitwise_count(own["odd0"][a] ^ other["odd0"][b]).astype(np.int16) + np.bitwise_count(own["odd1"][a] ^ other["odd1"][b])
        still = np.flatnonzero(odd <= (spare + room)[near])
        a, b, near = a[still], b[still], near[still]
        n, m, least = n[near], m[near], least[near]
        p, r, q, s = (x.astype(np.int16) for x in (own["place"][a], a_place[near], other["place"][b], b_place[near]))
        p, r, q, s = np.minimum(p, r), np.maximum(p, r), np.minimum(q, s), np.maximum(q, s)
        near = np.minimum(p, q) + 1 + np.minimum(r - p, s - q) + np.minimum(n - 1 - r, m - 1 - s) >= least
        return own["id"][a[near]], other["id"][b[near]]


def _least(n: np.ndarray) -> np.ndarray:
    """Words of the common sequence, at least, where the longer one has n words."""
    return -(-PART * n // WHOLE)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(8) & U64(WORD_SLOTS - 1)).astype(np.int64)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of runs of consecutive ones, run by run."""
    size = size.astype(np.int64)
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _meetings(values: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of sorted values and of the bounds, in order too, that they lie between, about MEETINGS at once."""
    low, high = np.searchsorted(values, least, "left"), np.searchsorted(values, most, "right")
    there = np.flatnonzero(high > low)
    low, size = low[there], (high - low)[there]
    end = np.cumsum(size)
    done = 0
    while done < len(there):
        to = max(done + 1, int(np.searchsorted(end, (end[done - 1] if done else 0) + MEETINGS)))
        yield _runs(low[done:to], size[done:to]), np.repeat(there[done:to], size[done:to])
        done = to


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(slot, count): how often the words of a slot occur, and as -1 - n the records of n words, for n up to twice LONG."""
    for batch in batches:
        for _, part in tv.chunks(batch["y"].tolist()):
            w = tv.words(part)
            for slot in (_slot(w.hash[w.ok]), -1 - np.minimum(np.diff(w.first), 2 * LONG)):
                yield pd.DataFrame(dict(zip(("slot", "count"), np.unique(slot, return_counts=True), strict=True)))


def _lengths(there: np.ndarray) -> np.ndarray:
    """Which word numbers meet those that are there: in four fifths of the longer one the shorter one has room; the last stands for all from there on."""
    n = np.arange(len(there))
    long_, short = np.maximum(n[:, None], n), np.minimum(n[:, None], n)
    out = (there & (_least(long_) <= short)).any(1)
    # the last one's may be longer, so those that are near it may be as well
    return out | ((WHOLE * n >= PART * n[-1]) & there[PART * len(n) // WHOLE - 1 :].any())


def _keyed(shared: Broadcast, parts: int, around: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, there = shared.value
        near = there if around else _lengths(there)
        for batch in batches:
            batch = batch.drop_duplicates("id")
            ids, own, size = batch["id"].to_numpy(), [], 0
            for first, part in tv.chunks(batch["y"].tolist()):
                own.append(Keys(tv.words(part), ids[first : first + len(part)], words, near, around))
                size += own[-1].tails.nbytes + own[-1].passages.nbytes
                if size > 4 * PIECE:
                    yield Keys.by_part(own, parts).assign(text=not around)
                    own, size = [], 0
            if own:
                yield Keys.by_part(own, parts).assign(text=not around)

    return run


def _streams(batches: Iterator[pd.DataFrame], part: str) -> Iterator[tuple[list[pd.DataFrame], Iterator[pd.DataFrame]]]:
    """For each part of sorted rows all rows of the cases, and those of the texts as they come."""
    rows = itertools.chain.from_iterable(batch.groupby([part, "text"]) for batch in batches)
    for _, own in itertools.groupby(rows, lambda x: x[0][0]):
        cases: list[pd.DataFrame] = []
        texts: Iterator[pd.DataFrame] = iter(())
        for (_, text), df in own:
            if text:
                texts = itertools.chain([df], (df for _, df in own))
                break
            cases.append(df)
        yield cases, texts


def _meet(shards: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(t, shard): texts and the shards of cases that they may overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cases, texts in _streams(batches, "part"):
            if not cases:
                continue
            met = Met(pd.concat(cases))
            del cases
            for rows in texts:
                size = sum(rows[name].str.len() for name in ("heads", "tails", "passages")).cumsum() // PIECE
                for _, piece in rows.groupby(size):
                    own = [pd.DataFrame({"t": t, "shard": (c % shards).astype(np.int32)}) for c, t in met.pairs(piece) if len(t)]
                    if own:
                        yield pd.concat(own).drop_duplicates()

    return run


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Overlaps of the texts of each shard with its cases."""
    for cases, texts in _streams(batches, "shard"):
        automaton = None
        for rows in texts:
            if automaton is None:
                own = pd.concat(cases)
                automaton = Automaton(own["id"].to_numpy(), own["y"].tolist())
                del own
                cases.clear()
            keys = rows["id"].to_numpy()
            for first, part in tv.chunks(rows["y"].tolist()):
                found_ = [(automaton.c[case], keys[first + text], n, m, common) for text, case, n, m, common in automaton.overlaps(tv.words(part))]
                if found_:
                    yield pd.DataFrame(found_, columns=["c", "t", "case_words", "text_words", "common"])


def _among(routes: DataFrame) -> Callable[[Column], Column]:
    """Whether a text's hash is one of those of routes, by a table of TEXT_SLOTS bits; a few others pass too."""
    slots = routes.select(F.pmod("t", F.lit(TEXT_SLOTS)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    table = np.zeros(TEXT_SLOTS, bool)
    table[slots] = True
    shared = routes.sparkSession.sparkContext.broadcast(np.packbits(table))

    @F.pandas_udf("boolean")
    def among(t: pd.Series) -> pd.Series:
        slot = t.to_numpy() % TEXT_SLOTS
        return pd.Series((shared.value[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool))

    return among


def overlaps(texts: DataFrame, cases: DataFrame, text: str = "training_text", case_text: str = "x") -> DataFrame:
    """Pairs of strings that overlap: c and t (hashes of the case's and the text's string), case_words, text_words, common; once each.

    Equal cases are one; null and empty strings, and strings without an undamaged word, overlap with nothing. The driver holds counts of
    word slots and a bit for each slot of texts, a task the keys or the automaton of a bounded part of the cases, however many there are.
    """
    spark = texts.sparkSession
    cores = spark.sparkContext.defaultParallelism
    own = texts.filter(F.length(text) > 0).select(F.xxhash64(text).alias("id"), F.col(text).alias("y"))
    asked = cut(cases.filter(F.length(case_text) > 0).select(F.xxhash64(case_text).alias("id"), F.col(case_text).alias("y")).dropDuplicates(["id"]))
    size = asked.agg(F.sum(F.length("y").cast("long"))).first()[0] or 0
    shards, parts = max(1, -(-size // SHARD_CHARS)), max(cores, -(-size // KEY_CHARS), own.rdd.getNumPartitions())

    counts_ = asked.select("y").mapInPandas(_statistics, "slot int, count long").groupBy("slot").agg(F.sum("count").alias("count")).toPandas()
    words, there = np.zeros(WORD_SLOTS, np.int64), np.zeros(2 * LONG + 1, bool)
    slot, count = counts_["slot"].to_numpy(), counts_["count"].to_numpy()
    words[slot[slot >= 0]] = count[slot >= 0]
    there[-1 - slot[slot < 0]] = True
    shared = spark.sparkContext.broadcast((words, there))

    def keyed(df: DataFrame, around: bool) -> DataFrame:
        return df.mapInPandas(_keyed(shared, parts, around), "part int, heads binary, tails binary, passages binary, text boolean")

    keys = keyed(asked, True).unionByName(keyed(own, False)).repartition(parts, "part").sortWithinPartitions("part", "text")
    routes = cut(keys.mapInPandas(_meet(shards), "t long, shard int").distinct())

    scanned = own.filter(_among(routes)(F.col("id"))).dropDuplicates(["id"]).join(routes.withColumnRenamed("t", "id"), "id").select("shard", "id", "y", F.lit(True).alias("text"))
    asked = asked.select(F.pmod("id", F.lit(shards)).cast("int").alias("shard"), "id", "y", F.lit(False).alias("text"))
    both = asked.unionByName(scanned).repartition(max(cores, -(-shards // SCAN_SHARDS)), "shard").sortWithinPartitions("shard", "text")
    return both.mapInPandas(_scan, FOUND)


def members(overlaps_: DataFrame, texts: DataFrame, cases: DataFrame, text: str = "training_text", case_text: str = "x") -> DataFrame:
    """The overlapping records: case_id, id, split_name, case and text corpus, words, coverage; once each."""
    a = texts.filter(F.col("id").isNotNull() & (F.length(text) > 0)).select(F.xxhash64(text).alias("t"), "id", F.col("corpus_id").alias("text_corpus_id"))
    b = cases.filter(F.col("case_id").isNotNull() & (F.length(case_text) > 0)).select(F.xxhash64(case_text).alias("c"), "case_id", "split_name", F.col("corpus_id").alias("case_corpus_id"))
    a = a.join(overlaps_.select("t").distinct(), "t", "left_semi").distinct()
    b = b.join(overlaps_.select("c").distinct(), "c", "left_semi").distinct()
    share = F.col("common") / F.greatest("case_words", "text_words")
    return overlaps_.join(a, "t").join(b, "c").select("case_id", "id", "split_name", "case_corpus_id", "text_corpus_id", "case_words", "text_words", "common", share.alias("coverage"))


def found(members_: DataFrame) -> DataFrame:
    return members_.select("case_id", "id").distinct()


def counts(members_: DataFrame) -> DataFrame:
    """Overlapping cases and blocks by split and corpus of the case."""
    return members_.groupBy("split_name", F.col("case_corpus_id").alias("corpus_id")).agg(
        F.countDistinct("case_id").alias("n_cases"), F.countDistinct("id").alias("n_blocks"), F.countDistinct("case_id", "id").alias("n_pairs")
    )
