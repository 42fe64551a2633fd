"""Masked-model infilling: beam search over masks with any scorer, sampling, and ranked fillings of gaps of unknown token number.

A scorer gives, for token sequences and one position each, the log-probabilities of all tokens there.  The search is NumPy
inside a worker, a case at a time; ranking, dropping of equal fillings and softmax are relational (operators.metrics).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalize_greek
from .metrics import keep_best, softmax

#: The most masks tried, and what keeps the logarithm of the prior finite.
MOST_MASKS, TINY = 3, 1e-12


class Scorer(Protocol):
    """What a masked model must offer."""

    mask_id: int

    def score(self, sequences: list[list[int]], positions: list[int]) -> np.ndarray:
        """Log-probabilities of all tokens at one position of each sequence."""

    def encode(self, text: str, masks: int) -> list[int]:
        """Token ids of a text whose gap `[...]` is replaced by so many masks."""

    def decode(self, ids: list[int]) -> str:
        """Text of token ids, without spaces."""


def masked_positions(ids: list[int], mask_id: int) -> list[int]:
    return [i for i, t in enumerate(ids) if t == mask_id]


def mask_tokens(ids: list[int], at: list[int], mask_id: int, pad_id: int = 0) -> tuple[list[int], list[int]]:
    """(ids with masks, the tokens that stood there); masking a pad raises ValueError."""
    true = [ids[i] for i in at]
    if pad_id in true:
        raise ValueError("a pad can't be masked")
    chosen = set(at)
    return [mask_id if i in chosen else t for i, t in enumerate(ids)], true


def decode(ids: list[int], scorer: Scorer, beam: int = 10, modified: bool = True, best_first: bool = True, pivot: int | None = None) -> list[tuple[list[int], float]]:
    """(tokens for the masks in their order, score), best first.

    modified: a token counts by its log-probability less that of the pivot (by default the mask) at the same place.
    best_first: of the open places the one with the most certain token is filled next; else they are filled from the left.
    Ties go to the smaller tokens.
    """
    places = masked_positions(ids, scorer.mask_id)
    pivot = scorer.mask_id if pivot is None else pivot
    pool: list[tuple[list[int], float, list[int]]] = [(list(ids), 0.0, places)]
    for _ in places:
        if best_first:
            asked = [(c, p) for c, (_, _, open_) in enumerate(pool) for p in open_]
            logp = scorer.score([pool[c][0] for c, _ in asked], [p for _, p in asked])
            best: dict[int, tuple[float, int, np.ndarray]] = {}
            for (c, p), row in zip(asked, logp, strict=True):
                if c not in best or row.max() > best[c][0]:
                    best[c] = (float(row.max()), p, row)
            chosen = [(best[c][1], best[c][2]) for c in range(len(pool))]
        else:
            logp = scorer.score([s for s, _, _ in pool], [open_[0] for _, _, open_ in pool])
            chosen = [(open_[0], row) for (_, _, open_), row in zip(pool, logp, strict=True)]
        grown = []
        for (seq, total, open_), (place, row) in zip(pool, chosen, strict=True):
            for token in np.lexsort((np.arange(len(row)), -row))[:beam]:
                gain = float(row[token]) - (float(row[pivot]) if modified else 0.0)
                grown.append(([*seq[:place], int(token), *seq[place + 1 :]], total + gain, [p for p in open_ if p != place]))
        grown.sort(key=lambda g: (-g[1], g[0]))
        pool = grown[:beam]
    return [([seq[p] for p in places], total) for seq, total, _ in pool]


def sample(ids: list[int], scorer: Scorer, suggestions: int, nucleus: float | None = None, seed: int = 42) -> list[tuple[list[int], float]]:
    """Fillings drawn from the model, from the left: different first tokens, then one token each; with their log-probabilities.

    nucleus: only the likeliest tokens up to this mass are drawn, the likeliest always.
    """
    rng = np.random.default_rng(seed)
    places = masked_positions(ids, scorer.mask_id)

    def weights(row: np.ndarray) -> np.ndarray:
        p = np.exp(row)
        if nucleus is not None:
            order = np.argsort(-p, kind="stable")
            out = order[(np.cumsum(p[order]) > nucleus) & (np.arange(len(p)) > 0)]
            p[out] = 0
        return p / p.sum()

    pool = [(list(ids), 0.0)]
    for n, place in enumerate(places):
        logp = scorer.score([s for s, _ in pool], [place] * len(pool))
        grown = []
        for (seq, total), row in zip(pool, logp, strict=True):
            p = weights(row)
            k = min(suggestions, int((p > 0).sum())) if n == 0 else 1
            for token in rng.choice(len(p), k, replace=False, p=p):
                grown.append(([*seq[:place], int(token), *seq[place + 1 :]], total + float(row[token])))
        pool = grown
    return sorted((([s[p] for p in places], t) for s, t in pool), key=lambda x: (-x[1], x[0]))


def gap_dots(text: str) -> int | None:
    found = re.search(r"\[(\.+)\]", text)
    return len(found[1]) if found else None


def fillings(text: str, scorer: Scorer, n_chars: int | None = None, beam: int = 10, modified: bool = True, best_first: bool = True) -> list[tuple[str, float]]:
    """(filling, score) of a gap for each number of masks from one on: the search's score plus the logarithm of a uniform prior.

    ValueError without a gap `[...]` and without n_chars.
    """
    n = n_chars if n_chars is not None else gap_dots(text)
    if n is None:
        raise ValueError("the text has no gap of known length")
    most = math.ceil(n / 2) + 1
    out = []
    for k in range(1, min(most, MOST_MASKS) + 1):
        ids = scorer.encode(text, k)
        if len(masked_positions(ids, scorer.mask_id)) == k:
            out += [(scorer.decode(tokens), score + math.log(1 / most + TINY)) for tokens, score in decode(ids, scorer, beam, modified, best_first)]
    return out


def infill(cases: DataFrame, scorer: Callable[[], Scorer], k: int = 10, beam: int = 10, modified: bool = True, best_first: bool = True) -> DataFrame:
    """(case_id, rank, token_str, score, probability) of the k best different fillings of cases(case_id, text).

    scorer builds the model once in each worker. Fillings that are equal without case and diacritics count once. Cases without a gap have no row.
    """
    kind = cases.schema["case_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for batch in batches:
            rows = [(c, s, x) for c, t in zip(batch["case_id"], batch["text"], strict=True) if t and gap_dots(t) for s, x in fillings(t, model, None, beam, modified, best_first)]
            yield pd.DataFrame(rows, columns=["case_id", "token_str", "score"])

    found = cases.select("case_id", "text").mapInPandas(run, f"case_id {kind}, token_str string, score double")
    return softmax(keep_best(found, normalize_greek(F.col("token_str")), k)).select("case_id", "rank", "token_str", "score", "probability")


def best_position(logits: DataFrame) -> DataFrame:
    """Per case the position whose most certain token is the most certain of all; logits(case_id, position, logp array)."""
    order = Window.partitionBy("case_id").orderBy(F.desc(F.array_max("logp")), "position")
    return logits.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("case_id", "position")
