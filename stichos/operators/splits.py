"""Samples and train/dev splits of exact size, the same wherever they run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..settings import DOMAIN_TITLE, LANGUAGE, RANDOM_SEED, TEST_SIZE

#: Buckets of the hash order; each is sorted by itself.
BUCKETS = 1024


def order_of(key: Column, seed: int = RANDOM_SEED) -> Column:
    """A pseudo-random number below 2**32 for an integer key, by arithmetic that any engine has."""
    return F.pmod((key + seed) * 2654435761, F.lit(1 << 32))


def number_of(id_: Column) -> Column:
    """A number below 2**28 for a string, the same in any engine: the first seven hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(id_.cast("binary")), 1, 7), 16, 10).cast("long")


def first(df: DataFrame, order: str, ties: str, n: int, top: int = 1 << 32) -> DataFrame:
    """The n rows that come first by order (below top), then ties.

    Rows are counted by bucket of the order; whole buckets before the n-th row are taken, only the bucket of the n-th is sorted.
    """
    bucketed = df.withColumn("_b", F.floor(F.col(order) * BUCKETS / top).cast("int"))
    sizes = {r["_b"]: r["n"] for r in bucketed.groupBy("_b").agg(F.count("*").alias("n")).collect()}
    left, edge = n, BUCKETS
    for b in sorted(sizes):
        if sizes[b] > left:
            edge = b
            break
        left -= sizes[b]
    cut = bucketed.filter(F.col("_b") == edge).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order, ties))).filter(F.col("_r") <= left).drop("_r")
    return bucketed.filter(F.col("_b") < edge).unionByName(cut).drop("_b")


def _ordered(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with the hash order of an integer or string key in _o."""
    own = F.col(key) if isinstance(df.schema[key].dataType, IntegralType) else number_of(F.col(key))
    return df.withColumn("_o", order_of(own, seed))


def budget_sample(df: DataFrame, key: str, percent: float, seed: int = RANDOM_SEED) -> DataFrame:
    """int(n x percent / 100) rows of df, chosen by the hash order of a key."""
    return first(_ordered(df, key, seed), "_o", key, int(df.count() * percent / 100)).drop("_o")


def split(df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = RANDOM_SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ceil(n x test_size) rows in test, chosen by the hash order of a key."""
    test = first(_ordered(df, key, seed), "_o", key, math.ceil(df.count() * test_size)).drop("_o")
    return without(df, test, key), test


def without(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows of df whose key is not in other."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def usable(blocks: DataFrame, corpora: tuple[str, ...] | None = None, language: str = LANGUAGE) -> DataFrame:
    """Blocks of a language, of the given corpora or of none or an unknown one."""
    own = blocks.filter(F.col("language") == language)
    return own if corpora is None else own.filter(F.col("corpus_id").isNull() | F.col("corpus_id").isin(*corpora, "unknown"))


def in_domain(blocks: DataFrame, title: str = DOMAIN_TITLE, language: str = LANGUAGE) -> DataFrame:
    """Blocks of a language whose title names the domain. Null titles don't."""
    return blocks.filter((F.col("language") == language) & F.col("title").contains(title))


def train_and_dev(blocks: DataFrame, key: str, title: str = DOMAIN_TITLE, test_size: float = TEST_SIZE) -> tuple[DataFrame, DataFrame]:
    """(train, dev): dev drawn from the domain alone, train everything else."""
    domain = in_domain(blocks, title)
    train, dev = split(domain, key, test_size)
    return without(blocks, domain, key).unionByName(train), dev
