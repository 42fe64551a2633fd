"""Whole evaluations: infilling scored by text, by a similarity model, over context sizes; a search for good weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .datasets import cropped
from .infill import Scorer, infill
from .metrics import text_topk

#: Tokens kept on each side of a gap in the ablation, from all to few.
WINDOWS = (-1, 256, 128, 64, 32, 16, 8)


def infilled_topk(cases: DataFrame, gold: DataFrame, scorer: Callable[[], Scorer], k: int = 10, **options) -> DataFrame:
    """One row: top_1, top_3, ... of the fillings of cases(case_id, text) against gold(case_id, word)."""
    found = infill(cases, scorer, k, **options).withColumnRenamed("token_str", "word")
    return text_topk(found, gold)


def ablation(cases: DataFrame, gold: DataFrame, scorer: Callable[[], Scorer], windows: tuple[int, ...] = WINDOWS, k: int = 10) -> DataFrame:
    """infilled_topk for each number of tokens kept around the gap, with the column window."""
    rows = [infilled_topk(cases.select("case_id", cropped(F.col("text"), w).alias("text")), gold, scorer, k).withColumn("window", F.lit(w)) for w in windows]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def similarity(pairs: DataFrame, model: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> DataFrame:
    """pairs(case_id, word, gold) with similarity, by a model that is built once in each worker and compares two lists of texts."""
    kind = pairs.schema["case_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compare = model()
        for batch in batches:
            batch["similarity"] = np.asarray(compare(batch["word"].tolist(), batch["gold"].tolist()), float)
            yield batch

    own = pairs.filter("word is not null and gold is not null").select("case_id", "word", "gold")
    return own.mapInPandas(run, f"case_id {kind}, word string, gold string, similarity double")


def mean_best_similarity(scored: DataFrame) -> DataFrame:
    """One row: the mean over cases of their most similar filling."""
    return scored.groupBy("case_id").agg(F.max("similarity").alias("s")).agg(F.avg("s").alias("similarity"))


def search(objective: Callable[..., float], bounds: dict[str, tuple[float, float]], first: int = 5, rounds: int = 20, seed: int = 42) -> list[tuple[float, dict[str, float]]]:
    """(value, weights) of every trial, best first: random trials, then trials around the best ones, ever closer."""
    rng = np.random.default_rng(seed)
    trials: list[tuple[float, dict[str, float]]] = []
    for i in range(first + rounds):
        if i < first:
            w = {k: float(rng.uniform(a, b)) for k, (a, b) in bounds.items()}
        else:
            centre = max(trials, key=lambda t: t[0])[1]
            spread = 0.5 * 0.85 ** (i - first)
            w = {k: float(np.clip(rng.normal(centre[k], spread * (b - a) / 2), a, b)) for k, (a, b) in bounds.items()}
        trials.append((float(objective(**w)), w))
    return sorted(trials, key=lambda t: -t[0])
