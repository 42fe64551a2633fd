"""Corpora that grow: new files transpiled and counted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lacuna import sentence_tokens, transpile
from ..operators.ngram import ngram_rows
from ..schemas import BLOCK


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of blocks from JSON-lines files; a block that arrives again counts once, whenever it was exported.

    No watermark: exports come in any order, and a watermark would discard the older ones. The ids seen so far are the query's state.
    Blocks without an id are repeats only where all columns are equal.
    """
    raw = spark.readStream.schema(f"{BLOCK}, exported_at timestamp").json(folder)
    keyed = raw.withColumn("_id", F.when(F.col("id").isNull(), F.to_json(F.struct(*raw.columns))).otherwise(F.col("id")))
    return keyed.dropDuplicates(["_id"]).drop("_id")


def transpiled(stream: DataFrame) -> DataFrame:
    return stream.withColumn("plain", transpile(F.col("training_text")))


def counts(stream: DataFrame, n: int = 2) -> DataFrame:
    """Running n-gram counts of a stream of blocks."""
    sentences = stream.select(F.explode(sentence_tokens(F.col("training_text"))).alias("tokens"))
    return ngram_rows(sentences, n).groupBy("order", "ctx", "word").agg(F.count("*").alias("cnt"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of blocks to Parquet, by corpus, each exactly once."""
    return stream.writeStream.format("parquet").partitionBy("corpus_id").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
