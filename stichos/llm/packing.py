"""Texts in containers of fixed capacity, neighbours of similar content together, with little unused space.

Each text gets a point in a few dimensions - the mean of pseudo-random vectors that the hashes of its words give - and the
point's place on a Hilbert curve.  Texts are range-sorted along the curve; each range is packed in one sweep that keeps a
bounded number of open containers and puts a run of neighbours, largest first, where each fits best.  A text longer than
a container fills whole ones of its own and sends only its rest into the sweep; no other text is cut.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .tokens import VOCABULARY, Counter, Merges

#: Dimensions of the points and bits of each coordinate.
DIMENSIONS, BITS = 4, 8
#: Neighbours that are placed together, and containers that may stay open behind them.
RUN, OPEN = 2048, 1024
#: Tokens that a range of the curve holds about; ranges are packed apart from each other, in one sweep, so larger ranges of data that
#: would have more than MOST_RANGES take more time, not memory.
RANGE_TOKENS, MOST_RANGES = 8_000_000, 100_000


def points(w: tv.Words, n: int) -> np.ndarray:
    """Coordinates of n texts, 0 to 2**BITS - 1; texts without words lie in the middle."""
    out = np.empty((n, DIMENSIONS), np.uint32)
    count = np.maximum(np.bincount(w.row, minlength=n), 1)
    for k in range(DIMENSIONS):
        x = ((w.hash >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(float) / 32767.5 - 1
        mean = np.bincount(w.row, weights=x, minlength=n) / count
        # few words scatter more; the square root brings long and short texts to one spread
        out[:, k] = np.clip((0.5 + 0.5 * np.tanh(mean * np.sqrt(np.minimum(count, 60)) * 0.6)) * (1 << BITS), 0, (1 << BITS) - 1)
    return out


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each point (rows of unsigned coordinates), by the transposition method of Skilling."""
    x = x.astype(np.uint32).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(n):
            high = (x[:, i] & q) != 0
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p).astype(np.uint32)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ np.uint32(q - 1), t)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[:, i] >> np.uint32(b)) & 1)
    return out


def sized(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, n_tokens and place on the curve of each text with at least one token."""
    shared = texts.sparkSession.sparkContext.broadcast(Merges(vocabulary))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(shared.value)
        for batch in batches:
            own = batch["t"].tolist()
            n = counter.count(own)
            places = [hilbert(points(tv.words(part), len(part))) for _, part in tv.chunks(own)]
            out = pd.DataFrame({"k": batch["k"], "n_tokens": n, "place": np.concatenate(places) if places else []})
            yield out[out.n_tokens > 0]

    return texts.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, n_tokens long, place long").withColumnRenamed("k", key)


class Sweep:
    """Best fit into open containers, run by run along the curve."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.made = capacity, [], 0
        self.items: dict[int, list] = {}

    def put(self, run: list[tuple]) -> None:
        """Place a run of (size, item), largest first."""
        for size, item in sorted(run, key=lambda r: (-r[0], r[1])):
            i = bisect.bisect_left(self.free, (size, -1))
            if i < len(self.free):
                room, c = self.free.pop(i)
            else:
                room, c = self.capacity, self.made
                self.made += 1
                self.items[c] = []
            self.items[c].append((size, item))
            bisect.insort(self.free, (room - size, c))

    def close(self, most_open: int) -> Iterator[tuple[int, int, list]]:
        """(container, unused, its items) of full containers, and of the fullest beyond so many."""
        n = max(0, len(self.free) - most_open)
        while n < len(self.free) and self.free[n][0] == 0:
            n += 1
        done, self.free = self.free[:n], self.free[n:]
        for room, c in done:
            yield c, room, self.items.pop(c)


def packed(sized_: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(pack_name, container_id, key, piece_no, first_token, n_tokens, unused), a row per piece of a text, for each container size.

    unused is the free space of the piece's container. Sizes that are null or not positive are left out; of sizes with one name
    each counts by itself; repeated texts are packed each time. Container numbers are unique within a pack_name.
    """
    spark = sized_.sparkSession
    options = sorted({(r.pack_name, int(r.capacity_tokens)) for r in sizes.select("pack_name", "capacity_tokens").collect() if r.pack_name is not None and r.capacity_tokens and r.capacity_tokens > 0})
    schema = f"pack_name string, container_id long, k {sized_.schema[key].dataType.simpleString()}, piece_no int, first_token long, n_tokens long, unused long"
    if not options:
        return spark.createDataFrame([], schema).withColumnRenamed("k", key)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pack"), F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for i, (n, c) in enumerate(options)])).alias("o")
    items = sized_.select(F.col(key).alias("k"), "n_tokens", "place", each).select("k", "n_tokens", "place", "o.*")
    total = sized_.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, round(total * len(options) / RANGE_TOKENS)))
    ordered = items.repartitionByRange(ranges, "pack", "place", "k").sortWithinPartitions("pack", "place", "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        serial, rows = 0, []
        sweep, pack, name, waiting, numbers = None, None, None, [], {}

        def emit(closed: Iterator[tuple[int, int, list]]) -> None:
            nonlocal serial
            for _, unused, own in closed:
                for size, (k, piece, first) in own:
                    rows.append((name, part << 33 | serial, k, piece, first, size, unused))
                serial += 1

        for batch in batches:
            for k, n, p, p_name, capacity in zip(batch["k"].tolist(), batch["n_tokens"].tolist(), batch["pack"].tolist(), batch["pack_name"].tolist(), batch["capacity"].tolist(), strict=True):
                if p != pack:
                    if sweep:
                        sweep.put(waiting)
                        emit(sweep.close(0))
                    sweep, pack, name, waiting, numbers = Sweep(capacity), p, p_name, [], {}
                whole = n // capacity
                for i in range(whole):
                    rows.append((name, part << 33 | serial, k, i + 1, i * capacity, capacity, 0))
                    serial += 1
                if n % capacity:
                    waiting.append((n % capacity, (k, whole + 1, whole * capacity)))
                if len(waiting) >= RUN:
                    sweep.put(waiting)
                    waiting = []
                    emit(sweep.close(OPEN))
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])
                rows = []
        if sweep:
            sweep.put(waiting)
            emit(sweep.close(0))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return ordered.mapInPandas(run, schema).withColumnRenamed("k", key)


def unused(packed_: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per pack_name: capacity, containers, tokens, unused space and its share."""
    per = packed_.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.max("unused").alias("unused"))
    out = per.groupBy("pack_name").agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.sum("unused").alias("unused"))
    return out.join(F.broadcast(sizes.select("pack_name", "capacity_tokens")), "pack_name").withColumn("unused_share", F.col("unused") / (F.col("unused") + F.col("n_tokens")))
