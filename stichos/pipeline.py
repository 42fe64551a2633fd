"""Training from end to end: blocks of the corpora, the domain set apart, two models of counts, and their place in a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lacuna import sentence_tokens
from .operators import ngram, splits
from .registry import Registry
from .session import cut
from .settings import DOMAIN_TITLE, GAMMA, LM_TYPE, MIN_FREQ, N
from .sources import corpus

#: Fixed value: share of the domain that is kept for development.
DEV_SIZE = 0.2


def parts(blocks: DataFrame, title: str = DOMAIN_TITLE, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(general, domain, dev): all blocks but those kept for development, those of the domain among them, and the kept ones.

    The domain is divided by a hash of the key; blocks of one key are never on both sides.
    """
    domain, dev = splits.split(splits.in_domain(blocks, title), key, DEV_SIZE)
    dev = cut(dev)
    return splits.without(blocks, dev, key), domain, dev


def sentences(blocks: DataFrame) -> DataFrame:
    """tokens of each sentence of the blocks."""
    return blocks.select(F.explode(sentence_tokens(F.col("training_text"))).alias("tokens"))


def train(blocks: DataFrame, title: str = DOMAIN_TITLE, n: int = N, min_freq: int = MIN_FREQ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts of the general model, of the domain's model, the domain's blocks for development)."""
    general, domain, dev = parts(blocks, title)
    return cut(ngram.train(sentences(general), n, min_freq=min_freq)), cut(ngram.train(sentences(domain), n, min_freq=min_freq)), dev


def train_folder(spark: SparkSession, folder: str, registry: Registry, corpora: tuple[str, ...] | None = None, budget: float | None = None, lm_type: str = LM_TYPE, gamma: float | None = GAMMA, n: int = N, min_freq: int = MIN_FREQ, title: str = DOMAIN_TITLE) -> tuple[str, DataFrame]:
    """A model trained on the JSON corpora of a folder, or so many percent of them, and added to a registry: its id, and the blocks for development."""
    general, domain, dev = parts(corpus.load(spark, folder, corpora, budget), title)
    return registry.add_ngrams(sentences(general), sentences(domain), lm_type, gamma, n, list(corpora) if corpora else None, min_freq), dev
