"""Language of each text and of each stretch of a mixed text, by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds bytes per slot, one bit per language: looking up an n-gram returns at once the set of
languages that use it.  Per word and language the hits are counted and corrected for the filter's false positives; a
Viterbi pass over the words finds the stretches, and stretches too short to be a segment join their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

U64 = np.uint64
#: Lengths of the n-grams; a word's ends count as letters.
ORDERS = (3, 4)
#: Slots of the filter (a power of two) and look-ups per n-gram.
SLOTS, PROBES = 1 << 21, 2
#: At most about so many labelled texts of a language, and code points of them, are used to fill the filters.
SAMPLE, SAMPLE_CHARS = 2000, 1_000_000
#: An n-gram belongs to a language where its rate is at least this part of its highest rate, and it occurs this often.
LEAST_RATE, LEAST_COUNT = 0.15, 3
#: Words that a segment has at least; words at a border that may be of either language; evidence in words that a change of language costs.
SHORTEST, BORDER, SWITCH = 10, 3, 1.6
#: What a text without any known n-gram is, by script bit.
FALLBACK = {1: "la", 2: "grc", 8: "cop"}


def ngrams(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word of each n-gram inside the words, in word order for each n; n-grams with a lost letter are left out."""
    n_words = len(w.row)
    seq = np.ones(len(w.letters) + n_words + 1, np.uint32)
    word = np.zeros(len(seq), np.int64)
    owner = np.repeat(np.arange(n_words), w.size)
    place = np.arange(len(w.letters)) + owner + 1
    seq[place], word[place] = w.letters, owner
    edge, lost = seq == 1, seq == ord(".")
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(seq) - n + 1
            if m <= 0:
                continue
            good = ~lost[:m]
            for k in range(1, n):
                good &= ~lost[k : m + k]
                if k < n - 1:
                    good &= ~edge[k : m + k]
            at = np.flatnonzero(good)
            h = np.full(len(at), n, U64)
            for k in range(n):
                h = h * tv.P_WORD + seq[at + k].astype(U64)
            hashes.append(tv.mix(h))
            owners.append(word[at + 1])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, U64), np.zeros(0, np.int64))


class LanguageFilters:
    """The filters: a slice of bytes, a bit of each being a language, for every eight languages; noise: the chance of a false hit by language.

    numbers: the language of each n-gram of hashes, by its place in languages.
    """

    def __init__(self, languages: list[str], hashes: np.ndarray, numbers: np.ndarray, slots: int = SLOTS):
        self.languages = languages
        self.slices = np.zeros((max(1, -(-len(languages) // 8)), slots), np.uint8)
        for k, own in enumerate(self.slices):
            mine = numbers >> 3 == k
            for at in self._at(hashes[mine]):
                np.bitwise_or.at(own, at, (1 << (numbers[mine] & 7)).astype(np.uint8))
        self.noise = np.array([((self.slices[b >> 3] >> (b & 7)) & 1).mean() ** PROBES for b in range(len(languages))])

    def _at(self, h: np.ndarray) -> list[np.ndarray]:
        top = U64(self.slices.shape[1] - 1)
        return [((h >> U64(32 * i)) & top).astype(np.int64) for i in range(PROBES)]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Bits of the languages that contain each n-gram: slices x n-grams."""
        a, b = self._at(h)
        return self.slices[:, a] & self.slices[:, b]

    def evidence(self, w: tv.Words) -> np.ndarray:
        """Share of each word's n-grams in each language, less false hits, weaker for words with few n-grams: words x languages."""
        out = np.zeros((len(w.row), len(self.languages)))
        h, owner = ngrams(w)
        if not len(h):
            return out
        bits = self.lookup(h)
        n = np.bincount(owner, minlength=len(w.row)).astype(float)
        for b in range(len(self.languages)):
            hits = np.bincount(owner, weights=(bits[b >> 3] >> (b & 7)) & 1, minlength=len(w.row))
            out[:, b] = np.maximum(0, hits - self.noise[b] * n) / (1 - self.noise[b])
        return out / np.maximum(n, 6)[:, None]


def viterbi(score: np.ndarray, first: np.ndarray, k: int, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word, for all texts in step: score is words x languages, first the texts' word bounds."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    path = np.zeros(len(score), np.int16)
    if not len(score):
        return path
    came = np.zeros((len(score), k), np.int16)
    own = np.arange(k, dtype=np.int16)
    value = np.zeros((len(order), k))
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    for t in range(steps):
        a = active[t]
        at = begin[:a] + t
        v = value[:a]
        top = v.argmax(1)
        best = v[np.arange(a), top] - switch
        jump = v < best[:, None]
        came[at] = np.where(jump, top[:, None].astype(np.int16), own) if t else own
        value[:a] = np.maximum(v, best[:, None]) + score[at]
    state = value.argmax(1).astype(np.int64)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        path[at] = state[:a]
        state[:a] = came[at, state[:a]]
    return path


def merge_short(runs: list[list[int]], score: np.ndarray, shortest: int = SHORTEST, border: int = BORDER) -> list[list[int]]:
    """Runs [language, first, end] of one text after the short ones joined a neighbour; score: running sums of evidence.

    A run is long enough if it has `shortest` words together with up to `border` words on each side that fit it as well as their own run.
    """
    gain = lambda a, b, language: score[b, language] - score[a, language]

    def length(i: int) -> int:
        own, first, end = runs[i]
        n = end - first
        if i:
            n += next((k for k in range(border) if first - k - 1 < runs[i - 1][1] or gain(first - k - 1, first - k, own) < gain(first - k - 1, first - k, runs[i - 1][0])), border)
        if i + 1 < len(runs):
            n += next((k for k in range(border) if end + k >= runs[i + 1][2] or gain(end + k, end + k + 1, own) < gain(end + k, end + k + 1, runs[i + 1][0])), border)
        return n

    while True:
        i = 1
        while i < len(runs):
            if runs[i][0] == runs[i - 1][0]:
                runs[i - 1][2] = runs.pop(i)[2]
            else:
                i += 1
        if len(runs) == 1:
            return runs
        short = [i for i in range(len(runs)) if runs[i][2] - runs[i][1] < shortest and length(i) < shortest]
        if not short:
            return runs
        i = min(short, key=lambda i: runs[i][2] - runs[i][1])
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(runs)]
        runs[i][0] = runs[max(near, key=lambda j: (gain(runs[i][1], runs[i][2], runs[j][0]), runs[j][2] - runs[j][1]))][0]


def segments(texts: list[str], filters: LanguageFilters) -> list[tuple]:
    """(text, segment from 1, segments, language, confidence, first word, words) in reading order. Texts without a letter have none."""
    w = tv.words(texts)
    out: list[tuple] = []
    if not len(w.row):
        return out
    alpha = np.logical_or.reduceat((w.letters != ord(".")) & ((w.letters < ord("0")) | (w.letters > ord("9"))), w.start)
    k = len(filters.languages)
    score = filters.evidence(w)
    path = viterbi(score, w.first, k)
    total = np.vstack([np.zeros(k), np.cumsum(score, 0)])
    has = np.r_[0, np.cumsum(alpha)]
    change = np.flatnonzero((path[1:] != path[:-1]) & (w.row[1:] == w.row[:-1])) + 1
    several = set(w.row[change].tolist())
    script = tv.tables()[2]
    for i in np.flatnonzero(has[w.first[1:]] > has[w.first[:-1]]).tolist():
        a, b = int(w.first[i]), int(w.first[i + 1])
        if i in several:
            cuts = [a, *change[(change > a) & (change < b)].tolist(), b]
            runs = merge_short([[int(path[x]), x, y] for x, y in zip(cuts, cuts[1:], strict=False)], total)
        else:
            runs = [[int(path[a]), a, b]]
        for n, (_, x, y) in enumerate(runs, 1):
            sums = total[y] - total[x]
            top = int(sums.argmax())
            if sums[top] <= 0:
                own = script[w.letters[w.start[x] : w.start[y - 1] + w.size[y - 1]]]
                bit = int(np.bincount(own[own > 0], minlength=1).argmax()) if (own > 0).any() else 0
                code, confidence = FALLBACK.get(bit, "und"), 0.0
            else:
                rest = np.partition(sums, -2)[-2] if k > 1 else 0.0
                code, confidence = filters.languages[top], float(sums[top] / (sums[top] + rest))
            out.append((i, n, len(runs), code, confidence, x - a, y - x))
    # neighbouring runs that turn out to be of one language are one segment
    if several:
        out = _joined(out)
    return out


def _joined(rows: list[tuple]) -> list[tuple]:
    by: dict[int, list[tuple]] = {}
    for r in rows:
        own = by.setdefault(r[0], [])
        if own and own[-1][3] == r[3]:
            p = own[-1]
            own[-1] = (*p[:4], (p[4] * p[6] + r[4] * r[6]) / (p[6] + r[6]), p[5], p[6] + r[6])
        else:
            own.append(r)
    return [(i, n, len(own), *r[3:]) for i, own in by.items() for n, r in enumerate(own, 1)]


def learn(texts: DataFrame, common_words: DataFrame, sample: int = SAMPLE) -> LanguageFilters:
    """Filters from texts(id, lang_code, text), labels partly wrong.

    About `sample` texts and SAMPLE_CHARS code points of each language, by a hash of id, are used; a text counts only if its words of common_words speak
    for its label more than for any other. Only n-gram counts of this bounded sample come to the driver.
    Null or empty texts and labels outside common_words are left out; without any usable text the filters are empty.
    """
    spark = texts.sparkSession
    common = [(r.lang_code, r.word) for r in common_words.select("lang_code", "word").distinct().collect() if r.lang_code and r.word]
    languages = sorted({c for c, _ in common})
    known: dict[int, set[int]] = {}
    for code, word in common:
        for h in tv.words([word]).hash.tolist():
            known.setdefault(h, set()).add(languages.index(code))
    keys = np.array(sorted(known), U64)
    speaks = np.zeros((len(keys), len(languages)), bool)
    for i, h in enumerate(keys.tolist()):
        speaks[i, list(known[h])] = True
    texts = texts.filter(F.col("lang_code").isin(languages) & F.col("text").isNotNull())
    sizes = texts.groupBy("lang_code").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()
    share = {r.lang_code: min(1.0, sample / r.n, SAMPLE_CHARS / max(1, r.size)) for r in sizes}
    part = F.coalesce(*[F.when(F.col("lang_code") == c, F.lit(s)) for c, s in share.items()], F.lit(0.0)) if share else F.lit(0.0)
    chosen = texts.filter((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)) < part).select("lang_code", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = batch.lang_code.to_numpy()
            for at, part in tv.chunks(batch.text.tolist()):
                w = tv.words(part)
                if not len(w.row):
                    continue
                place = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
                own = speaks[place] & (keys[place] == w.hash)[:, None]
                votes = np.stack([np.bincount(w.row, weights=own[:, b], minlength=len(part)) for b in range(len(languages))], 1)
                label = np.array([languages.index(c) for c in codes[at : at + len(part)]])
                mine = votes[np.arange(len(part)), label]
                votes[np.arange(len(part)), label] = -1
                sure = mine > np.maximum(votes.max(1), 0)
                h, owner = ngrams(w)
                use = sure[w.row[owner]]
                pair = pd.DataFrame({"lang": label[w.row[owner[use]]].astype(np.int32), "gram": h[use].view(np.int64)})
                yield pair.groupby(["lang", "gram"]).size().rename("n").reset_index()

    counts = chosen.mapInPandas(count, "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return LanguageFilters(languages, np.zeros(0, U64), np.zeros(0, np.int64))
    counts["rate"] = counts.n / counts.groupby("lang").n.transform("sum")
    counts = counts[(counts.rate >= LEAST_RATE * counts.groupby("gram").rate.transform("max")) & (counts.n >= LEAST_COUNT)]
    return LanguageFilters(languages, counts.gram.to_numpy().view(U64), counts.lang.to_numpy())


SEGMENT = "seg_no int, n_segs int, lang_code string, confidence double, first_word int, n_words int"


def identify(texts: DataFrame, filters: LanguageFilters, keys: list[str], text: str = "text") -> DataFrame:
    """One row per segment of each text: the key columns, seg_no, n_segs, lang_code, confidence, first_word, n_words.

    Null and empty texts and texts without letters have no row; repeated rows give repeated rows; columns that are not
    named as keys are not kept, so clashing names do no harm.
    """
    shared = texts.sparkSession.sparkContext.broadcast(filters)
    schema = ", ".join(f"k{i} {texts.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    names = [c.split(" ")[0] for c in SEGMENT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch.drop(columns="t")
            for at, part in tv.chunks(batch["t"].tolist()):
                rows = segments(part, shared.value)
                if rows:
                    out = pd.DataFrame(rows, columns=["i", *names])
                    yield pd.concat([own.iloc[out.pop("i").to_numpy() + at].reset_index(drop=True), out], axis=1)

    packed = texts.filter(F.col(text).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))
    return packed.mapInPandas(run, f"{schema}, {SEGMENT}").withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def blocks(ab: DataFrame, language_codes: DataFrame, common_words: DataFrame) -> DataFrame:
    """All segments of the blocks, with the language that their label names (label_code, null if it names none)."""
    codes = language_codes.filter(F.col("label").isNotNull()).groupBy(F.col("label").alias("own_label")).agg(F.min("lang_code").alias("label_code"))
    labelled = ab.join(F.broadcast(codes), ab["language"] == codes["own_label"], "left").select(ab["id"], "label_code", ab["training_text"].alias("text"))
    filters = learn(labelled.withColumnRenamed("label_code", "lang_code"), common_words)
    return identify(labelled, filters, ["id", "label_code"])


def found(segments_: DataFrame) -> DataFrame:
    """Blocks whose label is not the whole truth: no known label, another language, or several. A segment each."""
    wrong = F.col("label_code").isNull() | (F.col("n_segs") > 1) | (F.col("label_code") != F.col("lang_code"))
    return segments_.filter(F.col("id").isNotNull() & wrong).select("id", "seg_no", "lang_code").distinct()
