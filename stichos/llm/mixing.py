"""A mixture of sources in given shares of the total size, small sources repeated at most so often.

Each source gets an exact quota of tokens: its share of the total, or all it may give, what is missing going to the
others in proportion.  A quota is a number of whole passes over the source and a part of a random order of its texts.
Copies fall into blocks; a splitting tree of multivariate hypergeometric draws divides the blocks of all sources exactly
among the output shards, each then draws its own blocks of a random order and shuffles them locally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a source's random order whose totals reach the driver.
BUCKETS = 4096
#: Tokens of an output shard and of a block, about; of mixtures that would have more of them than the other two numbers, shards and
#: blocks are larger, so that the plan stays as small. Rows are texts' keys and sizes, so a large shard is sorted, not held.
SHARD_TOKENS, BLOCK_TOKENS, MOST_SHARDS, MOST_BLOCKS = 1_000_000, 50_000, 20_000, 400_000


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens that each source gives. targets: share and most repeats. total: tokens of the mixture, by default all of the listed sources once."""
    cap = {s: tokens.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    left = sum(tokens.get(s, 0) for s in targets) if total is None else total
    left = min(left, sum(c for s, c in cap.items() if targets[s][0] > 0))
    out = dict.fromkeys(targets, 0)
    open_ = {s for s, (share, _) in targets.items() if share > 0 and cap[s] > 0}
    while open_ and left > 0:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if left * targets[s][0] / weight >= cap[s]}
        for s in full or open_:
            out[s] = cap[s] if full else round(left * targets[s][0] / weight)
        if not full:
            break
        left -= sum(cap[s] for s in full)
        open_ -= full
    return out


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Block counts by source of each shard in turn: an exact, random division of counts, shards of equal size as far as it goes."""
    if shards == 1:
        yield counts
        return
    left = shards // 2
    n = int(counts.sum())
    part = rng.multivariate_hypergeometric(counts, n * left // shards, method="marginals")
    yield from split_tree(part, left, rng)
    yield from split_tree(counts - part, shards - left, rng)


def targets_of(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and repeats by source, of a table that names the sources of a mixture; of two rows for a source the larger share counts."""
    rows = mix_targets.filter("source is not null").orderBy("source", F.desc("target_share"), F.desc("max_repeats")).collect()
    out: dict[str, tuple[float, int]] = {}
    for r in rows:
        out.setdefault(r.source, (float(r.target_share or 0), int(r.max_repeats or 0)))
    return out


def _tokens(sized: DataFrame, targets: dict) -> DataFrame:
    return sized.filter(F.col("source").isin(*targets) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens")


def mixture(sized: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 42) -> DataFrame:
    """(shard, position, source, doc_id, repeat_no, n_tokens) of sized(doc_id, source, n_tokens): the chosen texts in their order.

    Texts without tokens and of sources that are not listed are not used; repeated rows count as texts of their own only in size,
    not in identity.  A source without texts gives nothing.  No task holds more than a shard or a bucket of a source's order.
    """
    spark = sized.sparkSession
    targets = targets_of(mix_targets)
    order = F.xxhash64(F.lit(seed), "source", "doc_id")
    texts = _tokens(sized, targets).withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int"))
    sums: dict[str, np.ndarray] = {}
    for r in texts.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).collect():
        sums.setdefault(r.source, np.zeros(BUCKETS, np.int64))[r.bucket] = r.n
    tokens = {s: int(v.sum()) for s, v in sums.items()}
    quota = quotas(tokens, targets, total)
    plan, blocks = [], {}
    whole = sum(quota.values())
    shards = int(min(MOST_SHARDS, max(1, round(whole / SHARD_TOKENS))))
    size = max(BLOCK_TOKENS, -(-whole // MOST_BLOCKS))
    for s, n in tokens.items():
        passes, rest = divmod(quota[s], n)
        before = np.concatenate([[0], np.cumsum(sums[s])])
        at = int(np.searchsorted(before, rest, "right")) - 1
        blocks[s] = max(1, round(quota[s] / size)) if quota[s] else 0
        plan.append((s, passes, min(at, BUCKETS), int(rest - before[min(at, BUCKETS)]), blocks[s]))
    plan_ = spark.createDataFrame(plan, "source string, passes int, last int, left long, blocks int")
    known = texts.join(F.broadcast(plan_), "source")
    # the last bucket of a source's part gives its first texts, as long as they are more inside the quota than beyond it
    running = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = known.filter(F.col("bucket") == F.col("last")).withColumn("running", running).withColumn("more", (F.col("running") - F.col("n_tokens") / 2 <= F.col("left")).cast("int")).drop("running")
    other = known.filter(F.col("bucket") != F.col("last")).withColumn("more", (F.col("bucket") < F.col("last")).cast("int"))
    chosen = edge.unionByName(other).withColumn("copies", F.col("passes") + F.col("more")).filter("copies > 0")
    copies = chosen.select("source", "doc_id", "n_tokens", "blocks", F.explode(F.sequence(F.lit(1), "copies")).alias("repeat_no"))
    copies = copies.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "source", "doc_id", "repeat_no"), F.greatest("blocks", F.lit(1))).cast("int"))
    names = sorted(s for s in blocks if blocks[s])
    rng = np.random.default_rng(seed)
    drawn: list[tuple[str, int, int]] = []
    if names:
        permuted = {s: rng.permutation(blocks[s]) for s in names}
        used = dict.fromkeys(names, 0)
        for shard, part in enumerate(split_tree(np.array([blocks[s] for s in names], np.int64), shards, rng)):
            for s, k in zip(names, part.tolist(), strict=True):
                drawn += [(s, int(b), shard) for b in permuted[s][used[s] : used[s] + k]]
                used[s] += k
    where = spark.createDataFrame(drawn, "source string, block int, shard int")
    placed = copies.join(F.broadcast(where), ["source", "block"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "doc_id", "repeat_no"), "source", "doc_id", "repeat_no")
    return placed.withColumn("position", F.row_number().over(local)).select("shard", "position", "source", "doc_id", "repeat_no", "n_tokens")


def shares(mixture_: DataFrame, sized: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Per listed source: target and actual share, tokens available and used, texts, the most repeats allowed and made."""
    used = mixture_.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("n_texts"), F.max("repeat_no").alias("repeats"))
    have = _tokens(sized, targets_of(mix_targets)).groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"))
    all_ = used.agg(F.sum("tokens").alias("all_tokens"))
    out = mix_targets.filter("source is not null").join(F.broadcast(used), "source", "left").join(F.broadcast(have), "source", "left").join(F.broadcast(all_), how="left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("tokens_available"), zero("n_texts"), "max_repeats", zero("repeats"))
