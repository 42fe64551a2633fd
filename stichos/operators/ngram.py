"""N-gram language models as count tables, and their probabilities.

A model is the table (order, ctx, word, cnt): ctx holds the tokens before word, joined by SEP.  Counts of all orders come
from one pass with sums before the shuffle; totals and vocabularies are further sums over that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lacuna import padded
from ..session import cut
from ..settings import FALLBACK_LOSS, GAMMA, LAMBDA, LM_TYPE, UNK, N, check_training

SEP = "\u0001"
#: What log2 of probability zero is; Spark's own log2 gives null.
NO_CHANCE = float("-inf")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of one length: structs of order, ctx and word."""
    at = F.sequence(F.lit(0), F.size(tokens) - n)
    each = lambda i: F.struct(F.lit(n).alias("order"), F.array_join(F.slice(tokens, i + 1, n - 1), SEP).alias("ctx"), F.get(tokens, i + n - 1).alias("word"))
    return F.when(F.size(tokens) >= n, F.transform(at, each)).otherwise(F.array().cast("array<struct<order:int,ctx:string,word:string>>"))


def ngram_rows(sentences: DataFrame, n: int = N, tokens: str = "tokens", orders: list[int] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per n-gram of the padded sentences: order, ctx, word and the columns of keep. Null token lists give none."""
    own = sentences.filter(F.col(tokens).isNotNull()).select(*keep, padded(F.col(tokens), n).alias("_t"))
    grams = F.concat(*[ngrams(F.col("_t"), k) for k in orders or range(1, n + 1)])
    return own.select(*keep, F.explode(grams).alias("_g")).select(*keep, "_g.*")


def train(sentences: DataFrame, n: int = N, tokens: str = "tokens", min_freq: int = 1) -> DataFrame:
    """Counts of all n-grams up to order n: order, ctx, word, cnt.

    Words that occur fewer than min_freq times in the padded sentences count as unknown, in words and contexts.
    """
    check_training(n=n, min_freq=min_freq)
    if min_freq > 1:
        words = ngram_rows(sentences, n, tokens, [1]).groupBy("word").agg(F.count("*").alias("c")).filter(F.col("c") < min_freq).select("word")
        sentences = masked(sentences.select(F.col(tokens).alias("tokens")), words)
        tokens = "tokens"
    return ngram_rows(sentences, n, tokens).groupBy("order", "ctx", "word").agg(F.count("*").alias("cnt"))


def masked(sentences: DataFrame, rare: DataFrame) -> DataFrame:
    """sentences(tokens) with the words of rare replaced by the unknown word; order of tokens kept, order of rows not."""
    numbered = sentences.withColumn("_s", F.monotonically_increasing_id())
    each = numbered.select("_s", F.posexplode_outer("tokens").alias("_p", "word"))
    joined = each.join(rare.select("word", F.lit(True).alias("_rare")), "word", "left").withColumn("word", F.when(F.col("_rare"), F.lit(UNK)).otherwise(F.col("word")))
    return joined.groupBy("_s").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "word"))), lambda x: x["word"]).alias("tokens")).select("tokens")


def vocabulary(model: DataFrame) -> DataFrame:
    """Distinct words of a model, padding included."""
    return model.filter("order = 1").select("word")


def vocabulary_size(model: DataFrame) -> DataFrame:
    """One row: v, the number of distinct words plus one for the unknown word."""
    return vocabulary(model).agg((F.count("*") + 1).alias("v"))


def totals(model: DataFrame) -> DataFrame:
    """order, ctx and the sum of its counts."""
    return model.groupBy("order", "ctx").agg(F.sum("cnt").alias("total"))


def mle(cnt: Column, total: Column) -> Column:
    """Share of a count; 0 where the context is unseen."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.coalesce(cnt, F.lit(0)) / total).otherwise(0.0)


def lidstone(cnt: Column, total: Column, v: Column, gamma: float = GAMMA) -> Column:
    """Share of a count with gamma added to each of v words."""
    return (F.coalesce(cnt, F.lit(0)) + gamma) / (F.coalesce(total, F.lit(0)) + v * gamma)


def known_contexts(contexts: DataFrame, model: DataFrame) -> DataFrame:
    """(ctx, k_ctx) once for each of contexts(ctx): k_ctx has the words that the model doesn't know turned to the unknown word."""
    words = vocabulary(model)
    ctx = contexts.select("ctx").distinct().select("ctx", F.posexplode(F.split("ctx", SEP)).alias("p", "w"))
    ctx = ctx.join(words.select(F.col("word").alias("w"), F.lit(True).alias("k")), "w", "left").withColumn("w", F.when(F.col("k") | (F.col("w") == ""), F.col("w")).otherwise(F.lit(UNK)))
    return ctx.groupBy("ctx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]), SEP).alias("k_ctx"))


def known(queries: DataFrame, model: DataFrame) -> DataFrame:
    """queries(order, ctx, word) with words and contexts that the model doesn't know turned to the unknown word, in columns k_ctx and k_word."""
    words = vocabulary(model)
    pairs = queries.select("ctx", "word").distinct()
    ctx = known_contexts(pairs, model)
    own = pairs.select("word").distinct().join(words.select("word", F.lit(True).alias("k")), "word", "left").select("word", F.when(F.col("k"), F.col("word")).otherwise(F.lit(UNK)).alias("k_word"))
    return queries.join(ctx, "ctx").join(own, "word")


def scored(queries: DataFrame, model: DataFrame, name: str, lm_type: str = LM_TYPE, gamma: float = GAMMA, only: int | None = None) -> DataFrame:
    """queries(order, ctx, word, ...) with the model's probability of word after ctx in a new column.

    N-grams of the model are met as they stand; only the others have their unknown words mapped and are looked up again.
    only: the order of all queries, where it is one; then nothing else of the model is shuffled.
    """
    own = model if only is None else model.filter(F.col("order") == only)
    rates = own.join(totals(own), ["order", "ctx"]).select("order", "ctx", "word", "cnt", "total")
    met = queries.join(rates, ["order", "ctx", "word"], "left")
    asked = known(met.filter("cnt is null").drop("cnt", "total"), model)
    key = [F.col("ctx").alias("k_ctx"), F.col("word").alias("k_word")]
    other = asked.join(own.select("order", *key, "cnt"), ["order", "k_ctx", "k_word"], "left").join(totals(own).select("order", key[0], "total"), ["order", "k_ctx"], "left")
    found = met.filter("cnt is not null").unionByName(other.drop("k_ctx", "k_word"))
    if lm_type == "MLE":
        return found.withColumn(name, mle(F.col("cnt"), F.col("total"))).drop("cnt", "total")
    v = vocabulary_size(model)
    return found.join(F.broadcast(v), how="left").withColumn(name, lidstone(F.col("cnt"), F.col("total"), F.col("v"), gamma)).drop("cnt", "total", "v")


def log_score(domain: Column, general: Column, weight: float = LAMBDA) -> Column:
    """log2 of the interpolated probability, minus infinity for none."""
    p = weight * domain + (1 - weight) * general
    return F.when(p > 0, F.log2(p)).otherwise(F.lit(NO_CHANCE))


def interpolated(queries: DataFrame, general: DataFrame, domain: DataFrame, weight: float = LAMBDA, lm_type: str = LM_TYPE, gamma: float = GAMMA, only: int | None = None) -> DataFrame:
    """queries with p_general, p_domain and log_score."""
    both = scored(scored(queries, general, "p_general", lm_type, gamma, only), domain, "p_domain", lm_type, gamma, only)
    return both.withColumn("log_score", log_score(F.col("p_domain"), F.col("p_general"), weight))


def entropy(scored_: DataFrame) -> DataFrame:
    """One row: entropy and perplexity of the n-grams; null for no n-gram."""
    e = -F.avg("log_score")
    return scored_.agg(e.alias("entropy"), F.pow(F.lit(2.0), e).alias("perplexity"))


def sequence_loss(scored_: DataFrame, key: str, lm_type: str = LM_TYPE) -> DataFrame:
    """key and nll: the sum of negative log scores of a sequence's n-grams; by MLE their mean, and FALLBACK_LOSS for an impossible one."""
    total = -F.sum("log_score")
    if lm_type == "MLE":
        mean = total / F.count("*")
        total = F.when(F.max((F.col("log_score") == NO_CHANCE).cast("int")) == 1, F.lit(FALLBACK_LOSS)).otherwise(mean)
    return scored_.groupBy(key).agg(total.alias("nll"))


def flagged(sentences: DataFrame, n: int = N, tokens: str = "tokens", domain: str = "in_domain") -> tuple[DataFrame, DataFrame]:
    """The models of all sentences and of those with a true `domain`, counted in one pass."""
    rows = ngram_rows(sentences.withColumn("_d", F.col(domain).cast("long")), n, tokens, keep=("_d",))
    both = cut(rows.groupBy("order", "ctx", "word").agg(F.count("*").alias("cnt"), F.sum("_d").alias("d")))
    return both.drop("d"), both.filter("d > 0").select("order", "ctx", "word", F.col("d").alias("cnt"))


def merged(general: DataFrame, domain: DataFrame) -> DataFrame:
    """Counts of two models summed."""
    return general.unionByName(domain).groupBy("order", "ctx", "word").agg(F.sum("cnt").alias("cnt"))
