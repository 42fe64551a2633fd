"""Words that can fill a gap: looked up for all cases at once, ranked, scored, cut to a beam and to the first k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..settings import ALPHA, BETA, DELTA, GAMMA, LAMBDA, LM_TYPE, MAX_BEAM_SIZE, MIN_BEAM_SIZE, SPECIALS, UNK, N
from .ngram import SEP, known_contexts, log_score, merged, scored

#: Rows that one context may give in one task, about.
HOT = 2_000_000


def beam_size(k: int, multiplier: int = 4) -> int:
    return min(max(multiplier * k, MIN_BEAM_SIZE), MAX_BEAM_SIZE)


def last(tokens: Column, k: int) -> Column:
    """The last k tokens as a context."""
    return F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - (k - 1), F.lit(1)), k), SEP) if k else F.lit("")


def known_counts(cases: DataFrame, general: DataFrame, domain: DataFrame, n: int = N) -> DataFrame:
    """(order, ctx, word, cnt) after the contexts of cases: words of a context that a model doesn't know are the unknown word for that
    model; both are looked up apart, then the counts of a context and word are summed."""
    asked = [cases.filter(F.size("context") >= order - 1).select(F.lit(order).alias("order"), last(F.col("context"), order - 1).alias("ctx")) for order in range(n, 1, -1)]
    every = asked[0]
    for a in asked[1:]:
        every = every.unionByName(a)
    every = cut(every.distinct())
    found = [
        every.join(known_contexts(every, m), "ctx").join(m.select("order", F.col("ctx").alias("k_ctx"), "word", "cnt"), ["order", "k_ctx"]).select("order", "ctx", "word", "cnt")
        for m in (general, domain)
    ]
    return merged(*found)


def successors(cases: DataFrame, counts: DataFrame, boundary: int, n: int = N) -> DataFrame:
    """Words seen after each case's context: the columns of cases, word, cnt and order.

    cases: case_id, context (tokens). The longest context comes first; the next shorter one is added, whole, only as long as a case
    has fewer than `boundary` words; contexts of one word are the shortest. A word keeps its longest context.
    """
    keyed = cases.withColumn("_c", F.array_join("context", SEP))
    return _product(keyed, context_words(cases.select("context"), counts, boundary, n), _most_words(cases.select("context"), counts, n)).drop("_c")


def _most_words(contexts: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(_c, _b): how many words a context can have at most, all its orders together; from sums by context, not from the words."""
    own = contexts.select("context").distinct()
    keys = F.array(*[F.when(F.size("context") >= order - 1, F.struct(F.lit(order).alias("order"), last(F.col("context"), order - 1).alias("ctx"))) for order in range(n, 1, -1)])
    asked = own.select(F.array_join("context", SEP).alias("_c"), F.explode(keys).alias("_k")).select("_c", "_k.order", "_k.ctx")
    return asked.join(counts.groupBy("order", "ctx").agg(F.count("*").alias("_n")), ["order", "ctx"]).groupBy("_c").agg(F.sum("_n").alias("_b"))


def context_words(contexts: DataFrame, counts: DataFrame, boundary: int, n: int = N) -> DataFrame:
    """(_c, word, cnt, order) of the different contexts(context), each looked up once; _c is the context as one string.

    Only contexts that are still short of words go on to the next order, with the fewer than `boundary` words that they have.
    """
    usable = counts.filter(~F.col("word").isin(*SPECIALS)).select("order", "ctx", "word", "cnt")
    left = cut(contexts.select("context").distinct().select("context", F.array_join("context", SEP).alias("_c"), F.array().cast("array<string>").alias("_has")))
    parts = []
    for order in range(n, 1, -1):
        keyed = left.withColumn("ctx", F.when(F.size("context") >= order - 1, last(F.col("context"), order - 1)))
        met = keyed.join(usable.filter(F.col("order") == order).drop("order"), "ctx")
        parts.append(met.filter(~F.array_contains("_has", F.col("word"))).select("_c", "word", "cnt", F.lit(order).alias("order")))
        if order > 2:
            few = usable.filter(F.col("order") == order).groupBy("ctx").agg(F.count("*").alias("_k"))
            short = keyed.join(few, "ctx", "left").filter(F.coalesce("_k", F.lit(0)) < boundary).drop("_k")
            words = short.join(usable.filter(F.col("order") == order).select("ctx", "word"), "ctx").groupBy("_c").agg(F.collect_set("word").alias("_new"))
            grown = short.join(words, "_c", "left").withColumn("_has", F.array_union("_has", F.coalesce("_new", F.array().cast("array<string>"))))
            left = cut(grown.filter(F.size("_has") < boundary).select("context", "_c", "_has"))
    return reduce(DataFrame.unionByName, parts)


def _product(cases: DataFrame, found: DataFrame, has: DataFrame) -> DataFrame:
    """cases(_c, ...) with the words of their contexts; contexts that may give more than HOT rows, by has(_c, _b), are divided by a hash of the word."""
    asked = cases.groupBy("_c").agg(F.count("*").alias("_a"))
    parts = F.ceil(F.col("_a") * F.col("_b") / HOT).cast("int")
    # as few as the rows of the result divided by HOT
    hot = F.broadcast(asked.join(has, "_c").select("_c", parts.alias("_parts")).filter("_parts > 1"))
    one = F.coalesce("_parts", F.lit(1))
    a = cases.join(hot, "_c", "left").withColumn("_p", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    b = found.join(hot, "_c", "left").withColumn("_p", F.pmod(F.xxhash64("word"), one).cast("int")).drop("_parts")
    return a.join(b, ["_c", "_p"]).drop("_p")


def distance(word: Column, part: Column, front: bool) -> Column:
    """Edit distance between a part of the gap's word and the same end of a candidate; 0 without a part."""
    size = F.length(part)
    end = F.substr(word, F.lit(1), size) if front else F.substr(word, F.greatest(F.length(word) - size + 1, F.lit(1)), size)
    return F.when(F.coalesce(size, F.lit(0)) == 0, 0).otherwise(F.levenshtein(end, part))


def ranked(found: DataFrame) -> DataFrame:
    """found(case_id, head, tail, gap_len, word, cnt, ...) with place: first the words of the right length and ends, then by edit
    distance of the ends, or by rising count where the gap is a whole word; ties by word."""
    head, tail, word = F.coalesce("head", F.lit("")), F.coalesce("tail", F.lit("")), F.col("word")
    fits_head, fits_tail = (head != "") & word.startswith(head), (tail != "") & word.endswith(tail)
    fits = (F.length(word) == F.length(head) + F.length(tail) + F.col("gap_len")) & (((head == "") & (tail == "")) | fits_head | fits_tail)
    key = F.when((head == "") & (tail == ""), F.col("cnt")).otherwise(distance(word, head, True) + distance(word, tail, False))
    order = Window.partitionBy("case_id").orderBy(fits.cast("int").desc(), key, "word")
    return found.withColumn("fits", fits).withColumn("place", F.row_number().over(order))


def length_penalty(word: Column) -> Column:
    return F.abs(F.length(word) - (F.col("gap_len") + F.length(F.coalesce("head", F.lit(""))) + F.length(F.coalesce("tail", F.lit("")))))


def scores(found: DataFrame, alpha: float = ALPHA, beta: float = BETA, delta: float = DELTA) -> DataFrame:
    """found with score, lower being better: alpha x nll (a column that is needed only for alpha > 0) + beta x distances of the ends + delta x difference of length."""
    ends = distance(F.col("word"), F.col("head"), True) + distance(F.col("word"), F.col("tail"), False)
    loss = alpha * F.col("nll") if alpha > 0 else F.lit(0.0)
    return found.withColumn("score", F.round(loss + beta * ends + delta * length_penalty(F.col("word")), 9))


def beam(scored_: DataFrame, size: int) -> DataFrame:
    """The best words of each case, by score, then word; with rank."""
    return scored_.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("score", "word"))).filter(F.col("rank") <= size)


def losses(found: DataFrame, general: DataFrame, domain: DataFrame, n: int = N, weight: float = LAMBDA, lm_type: str = LM_TYPE, gamma: float | None = GAMMA) -> DataFrame:
    """found with nll: the negative log score of word after the last n - 1 tokens of context."""
    asked = found.withColumn("ctx", last(F.col("context"), n - 1))
    unique = asked.select(F.lit(n).alias("order"), "ctx", "word").distinct()
    unique = cut(unique)  # few n-grams, asked for four times
    both = scored(scored(unique, general, "p_general", lm_type, gamma, n), domain, "p_domain", lm_type, gamma, n)
    nll = both.select("ctx", "word", (-log_score(F.col("p_domain"), F.col("p_general"), weight)).alias("nll"))
    return asked.join(nll, ["ctx", "word"]).drop("ctx")


def predictions(cases: DataFrame, general: DataFrame, domain: DataFrame, k: int, n: int = N, weight: float = LAMBDA, lm_type: str = LM_TYPE, alpha: float = ALPHA, beta: float = BETA, delta: float = DELTA, gamma: float | None = GAMMA) -> DataFrame:
    """The first k words for each case(case_id, context, head, tail, gap_len): case_id, rank, word, score, probability.

    Words of a context that a model doesn't know are the unknown word for it. Cases without any known successor have no row.
    """
    asked, requests = distinct_requests(cases)
    best = cut(beams(requests, general, domain, beam_size(k), n, weight, lm_type, alpha, beta, delta, gamma).filter(F.col("rank") <= k))
    with_loss = best if alpha > 0 else losses(best, general, domain, n, weight, lm_type, gamma)
    answered = with_loss.select(F.col("case_id").alias("_q"), "rank", "word", "score", F.pow(F.lit(2.0), -F.col("nll")).alias("probability"))
    return asked.join(answered, "_q").drop("_q")


def distinct_requests(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case_id, _q) of all cases, and the different requests(case_id: _q, context, head, tail, gap_len): equal ones are answered once."""
    keyed = cases.withColumn("_q", F.to_json(F.struct("context", "head", "tail", "gap_len")))
    requests = keyed.groupBy(F.col("_q").alias("case_id")).agg(*[F.first(c).alias(c) for c in ("context", "head", "tail", "gap_len")])
    return keyed.select("case_id", "_q"), cut(requests)


def beams(cases: DataFrame, general: DataFrame, domain: DataFrame, size: int, n: int = N, weight: float = LAMBDA, lm_type: str = LM_TYPE, alpha: float = ALPHA, beta: float = BETA, delta: float = DELTA, gamma: float | None = GAMMA) -> DataFrame:
    """The best `size` words of each case with score and rank; each task keeps no more of a case than that before the rows are shuffled."""
    found = successors(cases, cut(known_counts(cases, general, domain, n)), size, n)
    if alpha > 0:
        found = losses(found, general, domain, n, weight, lm_type, gamma)
    return beam(scores(found, alpha, beta, delta), size)


def check_supplement(tokens: Column) -> Column:
    """Whether the tokens of a supplement can be a right answer: exactly one, neither empty nor unknown. Null counts as no."""
    return F.coalesce((F.size(tokens) == 1) & ~F.array_contains(tokens, "") & ~F.array_contains(tokens, UNK), F.lit(False))


def extended(beam_: DataFrame, counts: DataFrame, size: int, n: int = N) -> DataFrame:
    """Beams grown by a word: each of beam_(case_id, words array, context, nll) with every word that follows it, the best `size` of a case kept.

    counts: (order, ctx, word, cnt) with `total`, the sum of its context. The order n - 1 words back is asked first, then shorter ones
    where nothing follows. A hypothesis without any successor ends there and is left out.
    """
    own = cut(beam_.withColumn("_h", F.to_json(F.struct("case_id", "words"))))
    usable = counts.filter(~F.col("word").isin(*SPECIALS))
    parts, left = [], own
    for order in range(n, 1, -1):
        grown = left.withColumn("ctx", F.when(F.size("context") >= order - 1, last(F.col("context"), order - 1))).join(usable.filter(F.col("order") == order).select("ctx", "word", "cnt", "total"), "ctx").drop("ctx")
        parts.append(grown)
        left = left.join(grown.select("_h").distinct(), "_h", "left_anti")
    every = reduce(DataFrame.unionByName, parts)
    nll = F.col("nll") - F.log2(F.col("cnt") / F.col("total"))
    new = every.select("case_id", F.array_append("words", F.col("word")).alias("words"), F.array_append("context", F.col("word")).alias("context"), nll.alias("nll"))
    order = Window.partitionBy("case_id").orderBy("nll", "words")
    return new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def word_sequences(cases: DataFrame, model: DataFrame, num_tokens: int, size: int, n: int = N) -> DataFrame:
    """(case_id, rank, words, nll): the likeliest fillings of cases(case_id, context) by num_tokens words, by local beam search.

    The context decides the first word, each word the next ones; nll is the negative log2 of the product of the shares of the counts.
    """
    totals_ = model.groupBy("order", "ctx").agg(F.sum("cnt").alias("total"))
    counts = cut(model.filter("order > 1").join(totals_, ["order", "ctx"]))
    now = cases.select("case_id", F.array().cast("array<string>").alias("words"), "context", F.lit(0.0).alias("nll"))
    for _ in range(num_tokens):
        now = extended(now.select("case_id", "words", "context", "nll"), counts, size, n)
    return now.select("case_id", "rank", "words", "nll")
