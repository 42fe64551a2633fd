"""Evaluation passages inside training texts: a broadcast hash set of word windows, scanned, verified, merged to spans.

A test item leaks into a text where so many of its consecutive words stand as consecutive words of the text, words
compared as textvec reads them.  The test set is taken in shards of bounded size, so what is broadcast never grows with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import textvec as tv

U64 = np.uint64
#: Consecutive words that make a leak.
WINDOW = 10
#: Code points of a shard of test texts, about (some 60 MB of hashes and words), and shards that are broadcast together for one scan.
SHARD_CHARS, SCAN_SHARDS = 4_000_000, 4


class TestSet:
    """Windows of a bounded number of test texts: sorted hashes, and a bit table that most windows of a text fail at once."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        self.ids, self.window = ids, window
        w = tv.words(texts)
        at, h = tv.windows(w, window)
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]
        self.row, self.words = w.row, [w.text(i) for i in range(len(w.row))]
        self.bits = max(16, int(len(h) * 32).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.hashes)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def hits(self, w: tv.Words) -> list[tuple[int, int, int, int, int]]:
        """(text, test item, first word, words, first word in the item), a row per maximal shared stretch, verified word by word."""
        at, h = tv.windows(w, self.window)
        maybe = np.flatnonzero(self.table[self._slot(h)]) if len(h) else at
        if not len(maybe):
            return []
        lo, hi = np.searchsorted(self.hashes, h[maybe], "left"), np.searchsorted(self.hashes, h[maybe], "right")
        spans: dict[tuple[int, int, int], list[list[int]]] = {}
        for i, a, b in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
            own = [w.text(j) for j in range(at[i], at[i] + self.window)]
            for k in range(a, b):
                begin = int(self.at[k])
                if own != self.words[begin : begin + self.window]:
                    continue
                line = spans.setdefault((int(w.row[at[i]]), int(self.row[begin]), int(at[i]) - begin), [])
                if line and line[-1][1] >= int(at[i]):
                    line[-1][1] = int(at[i]) + self.window
                else:
                    line.append([int(at[i]), int(at[i]) + self.window])
        return [(r, t, a - int(w.first[r]), b - a, a - shift - int(np.searchsorted(self.row, t))) for (r, t, shift), line in spans.items() for a, b in line]


def test_sets(tests: DataFrame, key: str, text: str, window: int) -> Iterator[tuple[Broadcast, bool]]:
    """The test set as broadcast lists of at most SCAN_SHARDS shards of about SHARD_CHARS code points, and whether there are several lists.

    The driver holds one list at a time: of several, each is destroyed when the next one is asked for, so its scan must be cut before.
    Null ids and empty texts are left out.
    """
    spark = tests.sparkSession
    own = tests.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    size = own.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    shards = -(-size // SHARD_CHARS)
    own = own.withColumn("shard", F.pmod(F.xxhash64("k", "t"), F.lit(max(1, shards))))
    own = cut(own) if shards > SCAN_SHARDS else own
    for k in range(0, shards, SCAN_SHARDS):
        rows = own.filter(F.col("shard").between(k, k + SCAN_SHARDS - 1)).orderBy("k", "t").toPandas()
        shared = spark.sparkContext.broadcast([TestSet(g["k"].tolist(), g["t"].tolist(), window) for _, g in rows.groupby("shard")])
        del rows
        yield shared, shards > SCAN_SHARDS
        if shards > SCAN_SHARDS:
            shared.destroy()


def leaks(texts: DataFrame, tests: DataFrame, key: str = "id", text: str = "training_text", test_key: str = "id", test_text: str = "training_text", window: int = WINDOW) -> DataFrame:
    """(key, test_id, first_word, n_words, test_first_word), a row per maximal stretch that a text shares with a test item.

    Null and empty texts and items share nothing; a repeated text gives repeated rows; an item that occurs under two ids gives
    rows for both; an empty test set gives no rows. A test set of more than SCAN_SHARDS shards is scanned for in several passes,
    each of them checkpointed.
    """
    spark = texts.sparkSession
    schema = f"k {texts.schema[key].dataType.simpleString()}, test_id string, first_word int, n_words int, test_first_word int"
    own = texts.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = spark.createDataFrame([], schema)
    for shared, several in test_sets(tests, test_key, test_text, window):
        found_ = own.mapInPandas(_scanner(shared), schema)
        out = out.unionByName(cut(found_)) if several else found_
    return out.withColumnRenamed("k", key)


def _scanner(shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["k", "test_id", "first_word", "n_words", "test_first_word"]
        for batch in batches:
            keys = batch["k"].to_numpy()
            for at, part in tv.chunks(batch["t"].tolist()):
                w = tv.words(part)
                for tests in shared.value:
                    rows = [(keys[at + r], tests.ids[t], a, n, b) for r, t, a, n, b in tests.hits(w)]
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    return scan


def without_leaked_texts(texts: DataFrame, leaks_: DataFrame, key: str = "id") -> DataFrame:
    """The texts without any leak, all columns; rows without a key stay."""
    return texts.join(leaks_.select(key).distinct(), key, "left_anti").select(texts.columns)


def leaked_letters(texts: list[str], tests: list[TestSet]) -> list[list[tuple[int, int]]]:
    """For each text the first letter and the end of each stretch that it shares with test items."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    w = tv.words(texts)
    hits = [h for own in tests for h in own.hits(w)]
    if hits:
        origin = tv.origins(texts)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for r, _, a, n, _ in hits:
            first, last = w.first[r] + a, w.first[r] + a + n - 1
            letters = origin[w.place[[w.start[first], w.start[last] + w.size[last] - 1]]] - begin[r]
            out[r].append((int(letters[0]), int(letters[1]) + 1))
    return out


def without(text: str, spans: list) -> str:
    """text without the letters of the spans."""
    out, done = [], 0
    for a, b in sorted(spans):
        out.append(text[done : max(done, a)])
        done = max(done, b)
    return "".join((*out, text[done:]))


def _finder(shared: Broadcast, kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def find(column: pd.Series) -> pd.Series:
        found = [own for _, part in tv.chunks(column.tolist()) for own in leaked_letters(part, shared.value)]
        return pd.Series([[{"a": a, "b": b} for a, b in own] for own in found])

    return find


def without_leaked_spans(texts: DataFrame, tests: DataFrame, text: str = "training_text", test_key: str = "id", test_text: str = "training_text", window: int = WINDOW) -> DataFrame:
    """The texts with leaked stretches removed in place, all columns and rows; null and empty texts stay as they are.

    The stretches come from the scan of leaks; a test set of more than SCAN_SHARDS shards takes several passes, each checkpointed.
    """
    span = "array<struct<a:int,b:int>>"
    own = texts.withColumn("_leaked", F.array().cast(span))
    for shared, several in test_sets(tests, test_key, test_text, window):
        own = own.withColumn("_leaked", F.concat("_leaked", _finder(shared, span)(F.col(text))))
        own = cut(own) if several else own

    @F.pandas_udf("string")
    def remove(column: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, [(s["a"], s["b"]) for s in own]) if t and len(own) else t for t, own in zip(column, spans, strict=True)])

    clean = F.when(F.size("_leaked") > 0, remove(F.col(text), F.col("_leaked"))).otherwise(F.col(text))
    return own.withColumn(text, clean).drop("_leaked")


def found(leaks_: DataFrame) -> DataFrame:
    """Each text with each test item that it contains, once."""
    return leaks_.filter(F.col("id").isNotNull()).select("id", "test_id").distinct()
