"""Defaults of the language models, the rankings and the data sets."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the reference's configuration.
RANDOM_SEED = 42
LM_TYPES = ("MLE", "LIDSTONE")
LM_TYPE, GAMMA, N, LAMBDA, MIN_FREQ, TEST_SIZE = "LIDSTONE", 0.001, 3, 0.2, 1, 0.05
GAMMAS, K_PREDICTIONS, MIN_FREQS, TEST_SIZES, DIMENSIONS = (0.0001, 0.001, 0.01, 0.1), (1, 5, 10, 20), (1, 2, 3), (0.05, 0.1, 0.2), (2, 3)
K_PRED, ALPHA, BETA, DELTA = 20, 0.0, 1.0, 1.0
CORPUS_NAMES = ("DDbDP", "DCLP", "EDH")
FALLBACK_LOSS, MIN_BEAM_SIZE, MAX_BEAM_SIZE = 10000.0, 10, 100
GAP, UNK, BOS, EOS = "<gap/>", "<UNK>", "<s>", "</s>"
SPECIALS = (BOS, EOS, UNK)
LANGUAGE = "grc"
DOMAIN_TITLE = "P.Herc."
FILE_LIMIT_MB = 50
MASKED_UNK, CHUNK_WORDS, MAX_SUBWORDS, MAX_INPUT, MIN_SENTENCE_WORDS, MAX_UNK_RATIO = "[UNK]", 50, 510, 512, 10, 0.1

#: How each masked model wants its text (without punctuation, case).
CHECKPOINTS = {
    "aristoBERTo": {"punctuation": False, "case": "upper"},
    "GreBerta": {"punctuation": True, "case": "upper"},
    "Logion": {"punctuation": True, "case": "lower"},
}
#: The masked models of a new registry, by name.
CHECKPOINT_NAMES = tuple(CHECKPOINTS)


@dataclass(frozen=True)
class Compat:
    """Choices where the reference's behaviour and its documentation differ; the defaults follow the documentation.

    next_word_tail: a gap before a space takes the following word as its tail.
    upper_tokens: tokens are put in upper case even where case folding is off.
    """

    next_word_tail: bool = False
    upper_tokens: bool = False


def checkpoint_config(name: str) -> dict:
    """The settings of a masked model; ValueError for an unknown one."""
    for key, value in CHECKPOINTS.items():
        if key.lower() in name.lower():
            return value
    raise ValueError(f"unknown checkpoint: {name}")


def check_training(lm_type: str = LM_TYPE, n: int = N, min_freq: int = MIN_FREQ, gamma: float | None = GAMMA, test_size: float = TEST_SIZE, corpus_names: tuple[str, ...] | None = None) -> None:
    """ValueError unless all training parameters are in their allowed sets."""
    if lm_type not in LM_TYPES:
        raise ValueError(f"lm_type must be one of {LM_TYPES}")
    if n not in DIMENSIONS:
        raise ValueError(f"n must be one of {DIMENSIONS}")
    if min_freq not in MIN_FREQS:
        raise ValueError(f"min_freq must be one of {MIN_FREQS}")
    if lm_type == "LIDSTONE" and (gamma is None or gamma <= 0):
        raise ValueError("gamma must be positive")
    if test_size not in TEST_SIZES:
        raise ValueError(f"test_size must be one of {TEST_SIZES}")
    if corpus_names and set(corpus_names) - set(CORPUS_NAMES):
        raise ValueError(f"corpora must be among {CORPUS_NAMES}")
