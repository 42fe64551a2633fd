"""Accuracy and similarity of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_accuracy(predictions: DataFrame, gold: DataFrame, k: int, ndigits: int = 5) -> DataFrame:
    """One row: hits, cases and accuracy, the share of gold(case_id, word) among the first k of predictions(case_id, rank, word).

    Cases without a prediction count as missed; accuracy is null without a case.
    """
    hit = predictions.filter(F.col("rank") <= k).join(gold, ["case_id", "word"], "left_semi").select("case_id").distinct().withColumn("hit", F.lit(1))
    per = gold.select("case_id").distinct().join(hit, "case_id", "left")
    return per.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("cases"), F.round(F.try_divide(F.coalesce(F.sum("hit"), F.lit(0)), F.count("*")), ndigits).alias("accuracy"))


def gold_ranked(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """predictions ranked anew by their edit distance to the gold word: the way of counting in which a hit means that the gold word is in the beam."""
    joined = predictions.drop("rank").join(gold.select("case_id", F.col("word").alias("gold")), "case_id")
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.levenshtein("word", "gold"), "score", "word"))).drop("gold")


def text_topk(predictions: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: top_1, top_3, ... in percent, words compared without case and spaces."""
    plain = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    p, g = predictions.select("case_id", "rank", plain(F.col("word")).alias("w")), gold.select("case_id", plain(F.col("word")).alias("w"))
    first = p.join(g, ["case_id", "w"]).groupBy("case_id").agg(F.min("rank").alias("first"))
    per = gold.select("case_id").distinct().join(first, "case_id", "left")
    return per.agg(*[F.avg(F.when(F.col("first") <= k, 100.0).otherwise(0.0)).alias(f"top_{k}") for k in ks])


def bleu1(reference: Column, hypothesis: Column) -> Column:
    """Unigram BLEU of two token arrays: clipped precision times brevity penalty; 0 for an empty hypothesis."""
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    clipped = F.aggregate(F.array_distinct(hypothesis), F.lit(0), lambda a, w: a + F.least(count(hypothesis, w), count(reference, w)))
    n, m = F.size(hypothesis), F.size(reference)
    brevity = F.when(n >= m, 1.0).otherwise(F.exp(1 - m / n))
    return F.when(n > 0, brevity * clipped / n).otherwise(0.0)


def softmax(scores: DataFrame, key: str = "case_id", score: str = "score") -> DataFrame:
    """scores with probability: exp(score - max) over its sum, in each case."""
    w = Window.partitionBy(key)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return scores.withColumn("_e", e).withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def keep_best(candidates: DataFrame, plain: Column, k: int, key: str = "case_id", score: str = "score") -> DataFrame:
    """The k best of each case after candidates that are equal in their plain form are cut to the best."""
    own = candidates.withColumn("_p", plain)
    one = own.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_p").orderBy(F.desc(score), "_p"))).filter("_r = 1").drop("_r")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "_p"))).filter(F.col("rank") <= k).drop("_p")


def nucleus(scores: DataFrame, p: float = 0.9, key: str = "case_id", probability: str = "probability", item: str = "token") -> DataFrame:
    """Items of each case whose running sum of probabilities, from the likeliest, stays within p; the likeliest always."""
    order = Window.partitionBy(key).orderBy(F.desc(probability), item)
    mass = F.sum(probability).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return scores.withColumn("mass", mass).withColumn("_r", F.row_number().over(order)).filter((F.col("mass") <= p) | (F.col("_r") == 1)).drop("_r")


def masked_topk(logits: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: share of rows whose label is among the k largest of logits(logits array, label int); rows labelled -100 are left out."""
    own = logits.filter("label <> -100")
    above = F.size(F.filter("logits", lambda x: x > F.get(F.col("logits"), F.col("label"))))
    return own.agg(*[F.avg((above < k).cast("double")).alias(f"top_{k}") for k in ks])


def id_topk(suggestions: DataFrame, gold: DataFrame, pad_id: int, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: top_1, top_3, ... in percent of the cases of gold(case_id, ids array) whose ids are the k-th best of suggestions(case_id, score, ids).

    Cases with the pad among their ids are left out; without any case all are 0. Of equal suggestions the best counts, ties by ids.
    """
    cases = gold.filter(~F.array_contains("ids", pad_id))
    ranked = suggestions.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "ids")))
    first = ranked.join(cases, ["case_id", "ids"]).groupBy("case_id").agg(F.min("_r").alias("first"))
    per = cases.select("case_id").distinct().join(first, "case_id", "left")
    return per.agg(*[F.coalesce(F.avg(F.when(F.col("first") <= k, 100.0).otherwise(0.0)), F.lit(0.0)).alias(f"top_{k}") for k in ks])


def mode_length(text: Column) -> Column:
    """The most frequent length, of equally frequent ones the least."""
    return F.mode(F.length(text), True)


def perplexity_of_loss(loss: Column) -> Column:
    return F.exp(loss)
