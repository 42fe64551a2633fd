"""Token counts of texts under a byte-pair vocabulary, and their totals by source, language and domain.

Texts are split into pieces by the tokenizer's pattern.  The distinct pieces of a chunk become symbol arrays, joined into
one; adjacent pairs are looked up in the table of merges, and in each piece the pair of the lowest rank is merged wherever
it stands, again and again, until no pair has a rank.  Pieces that have converged leave the array.  A few very long pieces,
which would keep it busy, are merged one by one with a heap.  The numbers are the tokenizer's own.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: Default vocabulary file, and the pattern (a fixed value) that splits text before its merges.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers at most.
CACHE = 400_000
#: Bytes beyond which a piece is merged by itself: a round over the array costs as much as its longest piece has merges. Both ways
#: apply the merges in the same order and give the same symbols.
LONG = 256
NONE = np.int64(1) << 40


class Merges:
    """The merges of a rank file: left and right symbol to merged symbol, whose number is its rank."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.pattern = pattern
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self._prepare()

    def _prepare(self) -> None:
        bits = max(10, int(len(self.keys) * 8).bit_length())
        self.mask = (1 << bits) - 1
        slot = self._slot(self.keys)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.rest = np.zeros(0, np.int64)
        # one key per slot; keys whose slot is taken are searched in a sorted rest
        first = np.unique(slot, return_index=True)[1]
        self.slots[slot[first]] = first
        other = np.setdiff1d(np.arange(len(self.keys)), first)
        self.rest_keys, self.rest_at = self.keys[other], other

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(40)) & np.uint64(self.mask)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged symbol of each pair, NONE where it is not merged."""
        keys = left << 20 | right
        at = self.slots[self._slot(keys)]
        out = np.where((at >= 0) & (self.keys[at] == keys), self.merged[at], NONE)
        if len(self.rest_keys):
            place = np.minimum(np.searchsorted(self.rest_keys, keys), len(self.rest_keys) - 1)
            out = np.where(self.rest_keys[place] == keys, self.merged[self.rest_at[place]], out)
        return out

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        """Symbols of each piece after the merges."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        out: list[np.ndarray | None] = [self._one(r) if len(r) > LONG else None for r in raw]
        own = np.array([i for i, r in enumerate(raw) if len(r) <= LONG], np.int64)
        symbol = self.byte[np.frombuffer(b"".join(raw[i] for i in own), np.uint8)]
        piece = np.repeat(own, [len(raw[i]) for i in own])
        while len(symbol):
            rank = np.r_[np.where(piece[1:] == piece[:-1], self.rank(symbol[:-1], symbol[1:]), NONE), NONE]
            start = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            size = np.diff(np.r_[start, len(symbol)])
            least = np.minimum.reduceat(rank, start)
            for i, a, n in zip(piece[start[least == NONE]], start[least == NONE], size[least == NONE], strict=True):
                out[i] = symbol[a : a + n]
            goes = (rank == np.repeat(least, size)) & (rank < NONE)
            at = np.flatnonzero(goes)
            # of overlapping occurrences every other one goes, from the left
            run = np.r_[True, np.diff(at) > 1]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0] if len(at) else at
            symbol[at] = rank[at]
            keep = np.repeat(least < NONE, size)
            keep[at + 1] = False
            symbol, piece = symbol[keep], piece[keep]
        return [np.zeros(0, np.int64) if o is None else o for o in out]

    def _one(self, raw: bytes) -> np.ndarray:
        """Symbols of one long piece: a heap of ranked pairs over a linked list."""
        symbol = self.byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        known = {}

        def rank(i: int) -> int:
            j = after[i]
            if j >= n:
                return int(NONE)
            pair = (symbol[i], symbol[j])
            if pair not in known:
                known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            return known[pair]

        heap = [(r, i) for i in range(n - 1) if (r := rank(i)) < NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if symbol[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            symbol[i], symbol[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := rank(k)) < NONE:
                    heapq.heappush(heap, (x, k))
        return np.array([x for x in symbol if x >= 0], np.int64)


class Counter:
    """Token counts with a bounded memory of pieces."""

    def __init__(self, merges: Merges):
        self.merges, self.split, self.known = merges, regex.compile(merges.pattern).findall, {}

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; 0 for null and empty ones."""
        out = np.zeros(len(texts), np.int64)
        for at, part in tv.chunks(texts):
            pieces = [self.split(t) for t in part]
            flat = [p for own in pieces for p in own]
            new = list(set(flat) - self.known.keys())
            if new:
                if len(self.known) + len(new) > CACHE:
                    self.known = {}
                    new = list(set(flat))
                self.known.update(zip(new, map(len, self.merges.encode(new)), strict=True))
            n = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            total = np.r_[0, np.cumsum(n)]
            end = np.cumsum(sizes)
            out[at : at + len(part)] = total[end] - total[end - sizes]
        return out


def counted(texts: DataFrame, text: str, keys: dict[str, Column], vocabulary: str = VOCABULARY) -> DataFrame:
    """The given columns, n_chars and n_tokens of each row; null and empty texts have 0 tokens and 0 characters. Rows are kept as they are."""
    shared = texts.sparkSession.sparkContext.broadcast(Merges(vocabulary))
    packed = texts.select(*[c.alias(f"k{i}") for i, c in enumerate(keys.values())], F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), F.col(text).alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema.fields[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(shared.value)
        for batch in batches:
            batch["n_tokens"] = counter.count(batch.pop("t").tolist())
            yield batch

    return packed.mapInPandas(run, f"{schema}, n_tokens long").withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def language_of(label: Column, language_codes: DataFrame) -> Column:
    """The language that a label names, `und` where it names none; the labels are a fixed table."""
    known = {r.label: r.lang_code for r in language_codes.filter("label is not null and lang_code is not null").orderBy("lang_code").collect()}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.lit(None)
    return F.coalesce(F.try_element_at(table, label), F.lit("und")) if known else F.lit("und")


RECORD = ["table_name", "rec_key", "source", "lang_code", "domain"]


def records(ab: DataFrame, documents: DataFrame, corpora: DataFrame, language_codes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per block (id) and document (doc_id): table_name, rec_key, source, lang_code, domain, n_chars, n_tokens, n_copies.

    A block that is repeated or exported again counts once. Unnamed sources and domains are empty, unknown languages `und`.
    """
    domains = corpora.filter("corpus_id is not null").groupBy(F.col("corpus_id").alias("source")).agg(F.min("domain").alias("own_domain"))
    a = counted(ab, "training_text", {"rec_key": F.col("id"), "source": F.col("corpus_id"), "lang_code": language_of(F.col("language"), language_codes)}, vocabulary)
    a = a.join(F.broadcast(domains), "source", "left").withColumn("domain", F.col("own_domain"))
    b = counted(documents, "text", {"rec_key": F.col("doc_id").cast("string"), "source": F.col("source"), "lang_code": language_of(F.col("lang"), language_codes), "domain": F.col("domain")}, vocabulary)
    both = a.withColumn("table_name", F.lit("ab")).select(*RECORD, "n_chars", "n_tokens").unionByName(b.withColumn("table_name", F.lit("documents")).select(*RECORD, "n_chars", "n_tokens"))
    best = F.max(F.struct("n_tokens", "n_chars", F.coalesce("source", F.lit("")).alias("source"), "lang_code", F.coalesce("domain", F.lit("")).alias("domain"))).alias("r")
    grouped = both.filter("rec_key is not null").groupBy("table_name", "rec_key").agg(best, F.count("*").alias("n_copies"))
    return grouped.select("table_name", "rec_key", "r.source", "r.lang_code", "r.domain", "r.n_chars", "r.n_tokens", "n_copies")


def totals(records_: DataFrame) -> DataFrame:
    """Texts, characters and tokens of every slice of source, language and domain of each table, with sub-totals (null: all)."""
    return records_.groupBy("table_name", "source", "lang_code", "domain").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"), F.sum("n_tokens").alias("t")).cube("table_name", "source", "lang_code", "domain").agg(
        F.sum("n").alias("n_texts"), F.sum("c").alias("n_chars"), F.sum("t").alias("n_tokens"), F.grouping_id().alias("level")
    ).filter("table_name is not null")


def tokenizer(vocabulary: str = VOCABULARY) -> Counter:
    """A counter for single texts on the driver."""
    return Counter(Merges(vocabulary))
