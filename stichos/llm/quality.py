"""Statistics of each text, and which texts are no natural prose.

Statistics of characters, lines and words are taken for a whole Arrow batch at a time, over flat arrays.  Gradient-boosted trees
learn from them which texts are lists, tables or junk: on a bounded sample of weakly labelled texts, whose labels come from other
evidence (quality_rules), and on half of a holdout that was labelled by reading.  The other half turns scores into probabilities.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .quality_rules import Plain, listed_share, weak_label

#: Texts that are weakly labelled for the trees, about.
SAMPLE = 10_000
#: Words of a stretch in which running language has more than one common word.
WINDOW = 24
#: Statistics of a text, in the order of the trees' inputs. Shares of lines are weighed by visible characters.
FEATURES = (
    *("n_words", "n_lines", "mean_word_length", "words_per_line", "letter_share", "digit_share", "symbol_share", "capital_share", "line_end_share", "common_share", "unique_share"),
    *("bar_lines", "gap_lines", "separator_lines", "opener_lines", "number_lines", "colon_lines", "bare_lines", "repeated_lines", "single_share", "long_share", "inner_capital_share"),
    *("noise_share", "misread_share", "comma_rate", "stop_rate", "slash_rate", "semicolon_rate", "repeated_triples", "dull_share", "longest_dull", "line_words_spread"),
)

VISIBLE, LETTER, DIGIT, MARK, UPPER, LOWER, ODD, END = (1 << k for k in range(8))
#: Signs that stand in no word of any writing, and signs that end a line of prose.
ODD_SIGNS, END_SIGNS = "^~|\\<>=+*$%&@_#{}!\"`", ".;:!?·,…)]»”"


@lru_cache(maxsize=1)
def _bits() -> np.ndarray:
    """Classes of each code point as bits."""
    out = np.zeros(tv.LIMIT, np.uint8)
    out[~tv.of_category("Z", "C")] |= VISIBLE
    for bit, names in ((LETTER, ("L",)), (DIGIT, ("Nd",)), (MARK, ("M",)), (UPPER, ("Lu",)), (LOWER, ("Ll",))):
        out[tv.of_category(*names)] |= bit
    out[[ord(c) for c in ODD_SIGNS]] |= ODD
    out[[ord(c) for c in END_SIGNS]] |= END
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics_of(texts: list[str], common: np.ndarray) -> np.ndarray:
    """The FEATURES of each text, a row each; common: sorted word hashes."""
    parts = [_statistics(part, common) for _, part in tv.chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _statistics(texts: list[str], common: np.ndarray) -> np.ndarray:
    split = [[x for x in t.replace("<gap/>", " … ").replace("<UNK>", " … ").split("\n") if x and not x.isspace()] or [""] for t in texts]
    n_lines = np.array([len(x) for x in split])
    bound = np.r_[0, np.cumsum(n_lines)]
    lines = [x for own in split for x in own]
    of_text = lambda values: _sums(values, bound)
    # characters by line: each line is followed by its end
    cp = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(x) + 1 for x in lines), np.int64, len(lines))
    edge = np.r_[0, np.cumsum(size)]
    bits = _bits()[cp]
    count = lambda mask: _sums(mask, edge)
    visible, letters, digits = (count((bits & b) > 0) for b in (VISIBLE, LETTER, DIGIT))
    before, after = np.r_[np.uint8(0), bits[:-1]], np.r_[bits[1:], np.uint8(0)]
    seen = np.flatnonzero(bits & VISIBLE)
    place = np.searchsorted(seen, edge)
    full = place[1:] > place[:-1]
    first, last = (np.where(full, cp[seen[np.clip(at, 0, len(seen) - 1)]] if len(seen) else 0, 0) for at in (place[:-1], place[1:] - 1))
    first_bits, last_bits = _bits()[first], _bits()[last]
    bars, tabs, semis, commas, colons, slashes = (count(cp == ord(c)) for c in "|\t;,:/")
    wide = cp == 32
    gaps = count(wide & np.r_[wide[1:], False] & np.r_[wide[2:], False, False][: len(cp)])
    tight = count(((cp == ord(",")) | (cp == ord(";"))) & ((after & VISIBLE) > 0))
    # tokens between white space
    inside = (bits & VISIBLE) > 0
    begins = np.flatnonzero(inside & ((before & VISIBLE) == 0))
    ends = np.flatnonzero(inside & ((after & VISIBLE) == 0)) + 1
    n_tokens = np.searchsorted(begins, edge)
    n_tokens = n_tokens[1:] - n_tokens[:-1]
    token_letters = _sums((bits & LETTER) > 0, np.c_[begins, ends].ravel())[::2] if len(begins) else np.zeros(0, np.int64)
    token_digits = _sums((bits & DIGIT) > 0, np.c_[begins, ends].ravel())[::2] if len(begins) else np.zeros(0, np.int64)
    token_size = ends - begins
    line_of = np.searchsorted(edge, begins, "right") - 1
    by_line = lambda mask, weight=None: np.bincount(line_of[mask], None if weight is None else weight[mask], minlength=len(lines))
    numbers = by_line((token_digits > 0) & (token_letters <= 1))
    single = by_line((token_letters == 1) & (token_size <= 2) & (token_digits == 0))
    long_ = by_line(token_size > 40, token_size)
    joined = ((bits & LETTER) > 0) & (((before & (ODD | DIGIT)) > 0) | ((after & (ODD | DIGIT)) > 0))
    noise = count(joined | ((bits & ODD) > 0))
    inner = count(((bits & UPPER) > 0) & ((before & LOWER) > 0))
    misread = count((cp >= 0xC2) & (cp <= 0xF4) & (np.r_[cp[1:], 0] >= 0x80) & (np.r_[cp[1:], 0] <= 0xBF))
    # words by line
    w = tv.words(lines)
    words_in = np.bincount(w.row, minlength=len(lines))
    at = np.minimum(np.searchsorted(common, w.hash), max(0, len(common) - 1))
    hit = (common[at] == w.hash) if len(common) else np.zeros(len(w.hash), bool)
    hits_in = np.bincount(w.row, hit, minlength=len(lines))
    text_of = np.repeat(np.arange(len(texts)), n_lines)
    word_text = text_of[w.row] if len(w.row) else np.zeros(0, np.int64)
    n_words = np.bincount(word_text, minlength=len(texts))
    weight = visible.astype(float)
    total = np.maximum(np.bincount(text_of, weight, minlength=len(texts)), 1)
    part = lambda mask: np.bincount(text_of, weight * mask, minlength=len(texts)) / total
    chars = lambda values: _share(of_text(values), total)
    rate = lambda values: _share(of_text(values), n_words)
    with np.errstate(over="ignore"):
        own = (word_text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        distinct = _distinct(own + w.hash, word_text, len(texts))
        t_at = np.flatnonzero(word_text[2:] == word_text[:-2]) if len(word_text) > 2 else np.zeros(0, np.int64)
        triple = tv.mix((w.hash[t_at] * tv.P_WORD + w.hash[t_at + 1]) * tv.P_WORD + w.hash[t_at + 2]) + own[t_at] if len(t_at) else np.zeros(0, np.uint64)
        line_hash = tv.mix(np.add.reduceat((cp.astype(np.uint64) + np.uint64(7)) * tv._powers(int(tv.P_CHAR), 1 << int(size.max()).bit_length())[np.arange(len(cp)) - np.repeat(edge[:-1], size)], edge[:-1]))
        line_key = line_hash + (text_of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n_triples = np.bincount(word_text[t_at], minlength=len(texts))
    triples = _distinct(triple, word_text[t_at], len(texts))
    _, inverse, copies = np.unique(line_key, return_inverse=True, return_counts=True)
    dull, longest = _dull(hit, word_text, n_words, len(texts))
    spread = np.sqrt(np.maximum(0, _share(of_text(words_in**2), n_lines) - _share(of_text(words_in), n_lines) ** 2))
    symbols = visible - letters - digits - count((bits & MARK) > 0)
    columns = (
        n_words, n_lines, _share(of_text(count(((bits & LETTER) > 0))), n_words), _share(n_words, n_lines), chars(letters), chars(digits), chars(symbols), _share(of_text(count((bits & UPPER) > 0)), of_text(letters)),
        _share(of_text((last_bits & END) > 0), n_lines), rate(hits_in), _share(distinct, n_words),
        part(bars >= 2), part((gaps > 0) | (tabs > 0)), part(tight >= 2), part(full & ((first_bits & LETTER) == 0) & (first != ord("[")) & (first != ord("("))), part(numbers >= np.maximum(1, 0.25 * n_tokens)),
        part((colons > 0) & (words_in <= 9)), part((hits_in == 0) & (words_in > 0)), part(copies[inverse] > 2), _share(of_text(single), of_text(n_tokens)), chars(long_), _share(of_text(inner), of_text(letters)),
        chars(noise), chars(misread), rate(commas), rate(count((cp == ord(".")) | (cp == ord("·")))), rate(slashes), rate(semis), 1 - _share(triples, n_triples) * (n_triples > 0) - (n_triples == 0), dull, longest, spread,
    )
    return np.stack([np.asarray(c, float) for c in columns], 1)


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Number of different keys of each text."""
    at = np.unique(keys, return_index=True)[1]
    return np.bincount(text[at], minlength=n)


def _dull(hit: np.ndarray, text: np.ndarray, n_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of the windows of WINDOW words with at most one common word, all words being one window in shorter texts; and the share of
    the words in the longest stretch without any."""
    total = np.r_[0, np.cumsum(hit)]
    at = np.flatnonzero(text[WINDOW - 1 :] == text[: len(text) - WINDOW + 1]) if len(text) >= WINDOW else np.zeros(0, np.int64)
    few = total[at + WINDOW] - total[at] <= 1
    dull = np.bincount(text[at], few, minlength=n) / np.maximum(np.bincount(text[at], minlength=n), 1)
    hits = np.bincount(text, hit, minlength=n)
    dull = np.where(n_words >= WINDOW, dull, (hits * WINDOW <= n_words) & (n_words > 0))
    # hits of each text between the word before its first and the word after its last
    end, hits_at = np.cumsum(n_words), np.flatnonzero(hit)
    owner = np.r_[np.arange(n), text[hits_at], np.arange(n)]
    stop = np.r_[end - n_words - 1, hits_at, end]
    order = np.lexsort((stop, owner))
    owner, stop = owner[order], stop[order]
    longest = np.zeros(n)
    np.maximum.at(longest, owner[1:], np.where(owner[1:] == owner[:-1], np.diff(stop) - 1, 0))
    return dull, np.minimum(1.0, longest / np.maximum(n_words, 1))


class Trees:
    """Gradient-boosted regression trees on binned inputs, for the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees, self.edges = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob) + 1e-6
            tree, node = [], np.zeros(len(y), np.int64)
            for level in range(self.depth):
                count = 1 << level
                best = [(1e-3, -1, 0)] * count
                for j, e in enumerate(self.edges):
                    k = len(e) + 1
                    slot = node * k + b[:, j]
                    g = np.bincount(slot, grad, count * k).reshape(count, k).cumsum(1)
                    h = np.bincount(slot, hess, count * k).reshape(count, k).cumsum(1)
                    n = np.bincount(slot, minlength=count * k).reshape(count, k).cumsum(1)
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    gain[(n < self.least) | (n[:, -1:] - n < self.least)] = 0
                    for i, at in enumerate(gain.argmax(1)):
                        if gain[i, at] > best[i][0]:
                            best[i] = (float(gain[i, at]), j, int(at))
                tree.append([(j, at) for _, j, at in best])
                feature, cut = np.array([t[0] for t in tree[-1]]), np.array([t[1] for t in tree[-1]])
                f = feature[node]
                node = node * 2 + ((f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]))
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + 1)
            score += value[node]
            self.trees.append((tree, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        b = self._binned(x)
        rows = np.arange(len(b))
        for tree, value in self.trees:
            node = np.zeros(len(b), np.int64)
            for level in tree:
                feature, cut = np.array([t[0] for t in level]), np.array([t[1] for t in level])
                f = feature[node]
                node = node * 2 + ((f >= 0) & (b[rows, np.maximum(f, 0)] > cut[node]))
            out += value[node]
        return out


def holdout(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """Statistics, labels and rows (doc_id, label, text) of the texts that were labelled by reading them."""
    rows = json.loads(resources.files(__package__).joinpath("quality_holdout.json").read_text("utf-8"))
    return statistics_of([r["text"] for r in rows], common), np.array([r["label"] for r in rows], float), rows


def calibrated(score: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns scores into probabilities, with a mild pull to slope 1 and offset 0."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * score + b)))
        ga, gb = ((label - p) * score).sum() - (a - 1), (label - p).sum() - b
        w = p * (1 - p)
        haa, hab, hbb = (w * score * score).sum() + 1, (w * score).sum(), w.sum() + 1
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + 0.5 * da, b + 0.5 * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def common_hashes(common_words: DataFrame) -> tuple[np.ndarray, set[str]]:
    """Sorted hashes and plain forms of the common words of all languages, a fixed small table."""
    words = sorted({r.word for r in common_words.filter("word is not null").select("word").distinct().collect()})
    plain = Plain()
    return np.unique(tv.words(words).hash) if words else np.zeros(0, np.uint64), {plain[w] for w in words}


def described(texts: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """key, the FEATURES and weak_label of each text with a visible character; null, empty and blank texts have no row.

    weak_label is 1 (junk), 0 (prose) or null; only about `sample` texts, chosen by a hash of the key, are labelled at all.
    """
    own = texts.filter(F.col(text).rlike(r"(?U)[^\s]")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    shared = texts.sparkSession.sparkContext.broadcast(common_hashes(common_words))
    part = min(1.0, sample / max(1, texts.count()))
    own = own.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < part * (1 << 20))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, common = shared.value
        plain = Plain()
        for batch in batches:
            own = batch["t"].tolist()
            out = pd.DataFrame(statistics_of(own, hashes), columns=list(FEATURES))
            out.insert(0, "k", batch["k"].to_numpy())
            out["weak_label"] = pd.array([weak_label(listed_share(t, common, plain)) if s else None for t, s in zip(own, batch["s"], strict=True)], "Int32")
            yield out

    return own.mapInPandas(run, f"k {kind}, " + ", ".join(f"{f} double" for f in FEATURES) + ", weak_label int").withColumnRenamed("k", key)


def fitted(described_: DataFrame, common_words: DataFrame) -> tuple[Trees, float, float]:
    """Trees on the weakly labelled texts and the first half of the holdout, and their calibration on the second half."""
    rows = described_.filter("weak_label is not null").select(*FEATURES, "weak_label").toPandas()
    x, y = rows[list(FEATURES)].to_numpy(float), rows["weak_label"].to_numpy(float)
    hx, hy, _ = holdout(common_hashes(common_words)[0])
    x, y = np.vstack([x, hx[::2]]), np.r_[y, hy[::2]]
    order = np.lexsort((y, *x.T))
    trees = Trees().fit(x[order], y[order])
    return trees, *calibrated(trees.score(hx[1::2]), hy[1::2])


def judged(described_: DataFrame, model: tuple[Trees, float, float]) -> DataFrame:
    """described_ without the weak labels, with junk_probability and is_prose."""
    shared = described_.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        trees, a, b = shared.value
        return pd.Series(1 / (1 + np.exp(-(a * trees.score(np.stack([c.to_numpy(float) for c in columns], 1)) + b))))

    return described_.drop("weak_label").withColumn("junk_probability", probability(*FEATURES)).withColumn("is_prose", F.col("junk_probability") <= 0.5)


def found(judged_: DataFrame, key: str = "doc_id") -> DataFrame:
    return judged_.filter(~F.col("is_prose") & F.col(key).isNotNull()).select(key).distinct()
