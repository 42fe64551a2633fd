"""Training sentences, chunks and dev cases for masked models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.editorial import words
from ..functions.lacuna import SUPPLEMENT, sentence_tokens, supplements, transpile
from ..functions.normalize import normalize_greek, remove_punctuation
from ..settings import CHUNK_WORDS, MASKED_UNK, MAX_INPUT, MAX_SUBWORDS, MAX_UNK_RATIO, MIN_SENTENCE_WORDS, UNK, checkpoint_config

#: What stands for the masked supplement while a text is made plain: letters, so that no rule sees more in it than a word.
SENTINEL = "QXZGAPZXQ"


def cast_unknown(text: Column) -> Column:
    return F.replace(text, F.lit(UNK), F.lit(MASKED_UNK))


def count_unknown(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: (t == MASKED_UNK) | (t == UNK)))


def is_quality(tokens: Column, ratio: float = MAX_UNK_RATIO, least: int = MIN_SENTENCE_WORDS) -> Column:
    """At least so many tokens, and fewer unknown ones than the ratio."""
    return (F.size(tokens) >= least) & (count_unknown(tokens) < ratio * F.size(tokens))


def train_sentences(blocks: DataFrame, text: str = "training_text") -> DataFrame:
    """text of each sentence good enough for training, unknown words in the masked model's form."""
    own = blocks.select(F.explode(sentence_tokens(F.col(text), remove_punct=False, case_folding=False)).alias("tokens"))
    return own.filter(is_quality(F.col("tokens"))).select(cast_unknown(F.array_join("tokens", " ")).alias("text"))


def chunks(tokens: Column, size: int = CHUNK_WORDS) -> Column:
    """Runs of exactly so many tokens; a shorter rest is left out."""
    n = F.floor(F.size(tokens) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def packed(sentences: DataFrame, key: str, order: str, text: str, tokenize: Callable[[str], list], most: int = MAX_SUBWORDS, join: Callable[[list], str] = " ".join) -> DataFrame:
    """(key, chunk_no, text): sentences of each key joined in order, as many as fit in `most` tokens; a longer one is cut and stands alone.

    tokenize and join turn a text to the masked model's tokens and back. A key's sentences are those of one text.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, now, used = [], [], 0
        for s in rows.sort_values("o")["t"]:
            tokens = tokenize(s)
            if len(tokens) > most:
                out += [" ".join(now)] * bool(now) + [join(tokens[:most])]
                now, used = [], 0
            elif used + len(tokens) > most:
                out.append(" ".join(now))
                now, used = [s], len(tokens)
            else:
                now.append(s)
                used += len(tokens)
        out += [" ".join(now)] * bool(now)
        return pd.DataFrame({"k": rows["k"].iloc[0], "chunk_no": range(len(out)), "text": out})

    own = sentences.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"))
    return own.groupBy("k").applyInPandas(run, f"k {sentences.schema[key].dataType.simpleString()}, chunk_no long, text string").withColumnRenamed("k", key)


def code_points(text: Column) -> Column:
    """The code points of a text, the token ids of models over characters."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def grouped_ids(ids: DataFrame, batch: str, order: str, column: str, size: int = 128, pad: int = 0) -> DataFrame:
    """(batch, piece, input_ids, attention_mask, labels): the token ids of the rows of each batch in one line, in the order of a column,
    filled up with pad and cut to equal pieces. A batch is what the caller bounds, some thousand rows; null ids are left out."""
    rows = ids.filter(F.col(column).isNotNull()).groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("ids")))).alias("r"))
    line = rows.select(batch, F.flatten(F.transform("r", lambda x: x["ids"])).alias("line")).filter(F.size("line") > 0)
    piece = line.select(batch, "line", F.explode(F.sequence(F.lit(0), F.floor((F.size("line") - 1) / size).cast("int"))).alias("piece"))
    own = piece.select(batch, "piece", F.slice("line", F.col("piece") * size + 1, size).alias("own"))
    fill = lambda values, x: F.concat(values, F.array_repeat(F.lit(x), size - F.size("own")))
    padded = fill(F.col("own"), pad)
    return own.select(batch, "piece", padded.alias("input_ids"), fill(F.transform("own", lambda _: F.lit(1)), 0).alias("attention_mask"), padded.alias("labels"))


def normalized_for(text: Column, checkpoint: str) -> Column:
    """text in the form that a masked model was trained on."""
    config = checkpoint_config(checkpoint)
    out = normalize_greek(text, case_folding=False)
    out = out if config["punctuation"] else remove_punctuation(out)
    out = F.upper(out) if config["case"] == "upper" else F.lower(out)
    return F.regexp_replace(out, f"(?i){UNK}", MASKED_UNK)


class Tokenizer(Protocol):
    """What a masked model's tokenizer must offer."""

    unk_token: str

    def tokenize(self, text: str) -> list[str]:
        """Sub-words of a text."""

    def encode(self, text: str, most: int) -> list[int]:
        """Token ids of a text, at most so many, with the signs of begin and end."""


def prepared(texts: DataFrame, checkpoint: str, tokenizer: Callable[[], Tokenizer], text: str = "text", most: int = MAX_INPUT) -> DataFrame:
    """(input_ids, attention_mask) of the texts that are good enough in a masked model's own sub-words, in the form that it wants.

    tokenizer builds the tokenizer once in each worker. Texts with fewer than MIN_SENTENCE_WORDS sub-words, or too many unknown ones,
    and nulls have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer()
        for batch in batches:
            kept = []
            for t in batch["t"]:
                pieces = own.tokenize(t)
                if len(pieces) >= MIN_SENTENCE_WORDS and pieces.count(own.unk_token) < MAX_UNK_RATIO * len(pieces):
                    kept.append(own.encode(t, most))
            if kept:
                yield pd.DataFrame({"input_ids": kept, "attention_mask": [[1] * len(ids) for ids in kept]})

    plain = texts.filter(F.col(text).isNotNull()).select(normalized_for(F.col(text), checkpoint).alias("t"))
    return plain.mapInPandas(run, "input_ids array<int>, attention_mask array<int>")


def dev_cases(blocks: DataFrame, text: str = "training_text", least: int = 1, most: int | None = None, normalize: bool = False, case_folding: bool = False) -> DataFrame:
    """(x, y, gap_length, corpus_id, file_id): one case per supplement of a single word.

    x: the plain text with that supplement as dots in brackets, where its token has no other gap; y: the supplement without brackets.
    """
    each = blocks.select("corpus_id", "file_id", F.col(text).alias("_t"), F.posexplode(F.arrays_zip(supplements(F.col(text)).alias("s"), F.regexp_extract_all(F.col(text), F.lit(SUPPLEMENT), 0).alias("raw"))).alias("_i", "_z"))
    rest = F.split("_t", SUPPLEMENT)
    raw = F.regexp_extract_all("_t", F.lit(SUPPLEMENT), 0)
    joined = F.array_join(F.flatten(F.transform(rest, lambda r, i: F.array(r, F.when(i == F.col("_i"), F.lit(SENTINEL)).otherwise(F.coalesce(F.get(raw, i), F.lit("")))))), "")
    gap = F.col("_z.s.gap_len")
    plain = F.replace(transpile(joined, case_folding, normalize), F.lit(SENTINEL), F.concat(F.lit("["), F.repeat(F.lit("."), gap), F.lit("]")))
    own = each.filter((F.size("_z.s.tokens") > 0) & (gap >= least) & (gap <= (1 << 30 if most is None else most)))
    return own.select(plain.alias("x"), F.translate("_z.raw", "[]", "").alias("y"), gap.alias("gap_length"), "corpus_id", "file_id")


def usable_cases(cases: DataFrame, most: int = 100, least_gap: int = 1, most_gap: int = 5) -> DataFrame:
    """The first cases, in the order of their text, whose gap is visible and of the wanted length."""
    return cases.filter(F.col("gap_length").between(least_gap, most_gap) & F.col("x").rlike(r"\[\.+\]")).orderBy("x", "y").limit(most)


def cropped(text: Column, window: int) -> Column:
    """text with at most so many tokens on each side of its gap; all of it for a window that is not positive."""
    if window <= 0:
        return text
    left, gap, right = (F.regexp_extract(text, r"(?s)^(.*?)(\S*\[\.+\]\S*)(.*)$", i) for i in (1, 2, 3))
    before = words(left)
    kept = F.slice(before, F.greatest(F.size(before) - window + 1, F.lit(1)), window)
    return F.when(gap == "", text).otherwise(F.concat_ws(" ", F.array_join(kept, " "), gap, F.array_join(F.slice(words(right), 1, window), " ")))
