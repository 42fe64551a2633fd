"""Trained models in a folder, and predictions with them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lacuna import context, gap_length, head, single_supplement, splice, tail
from .operators import candidates, ngram
from .schemas import MODEL
from .settings import CHECKPOINT_NAMES, GAMMA, LM_TYPE, LM_TYPES, N, check_training
from .storage import Folder

#: Bounds of a request.
MOST_CONTEXT, TOKEN_RANGE, COUNTS = 512, range(1, 11), (1, 5, 10, 20)


class StichosError(Exception):
    """Any error of a request."""


class ModelNotFoundError(StichosError):
    pass


class InvalidContextError(StichosError):
    pass


class ModelAlreadyExistsError(StichosError):
    pass


class Registry:
    """Models below a folder of any file system: a JSON file of settings each, and Parquet tables of counts of n-gram models."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    def table(self) -> DataFrame:
        """All models, in the order of their ids."""
        rows = [json.loads(self.folder.read(f)) for f in self.folder.names(".json")]
        names = [c.split(" ")[0] for c in MODEL.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MODEL)

    def get(self, model_id: str) -> dict:
        if not self.folder.exists(f"{model_id}.json"):
            raise ModelNotFoundError(model_id)
        return json.loads(self.folder.read(f"{model_id}.json"))

    def exists(self, settings: dict) -> bool:
        """Whether a model with the same settings is there, nulls being equal."""
        asked = self.spark.createDataFrame([(settings.get("TYPE"), settings.get("LM_SCORE"), settings.get("GAMMA"), settings.get("N"), settings.get("CORPUS_NAMES"), settings.get("CHECKPOINT"))], "t string, s string, g double, n int, c array<string>, p string")
        m = self.table()
        same = m["TYPE"].eqNullSafe(asked.t) & m["LM_SCORE"].eqNullSafe(asked.s) & m["GAMMA"].eqNullSafe(asked.g) & m["N"].eqNullSafe(asked.n) & m["CORPUS_NAMES"].eqNullSafe(asked.c) & m["CHECKPOINT"].eqNullSafe(asked.p)
        return not m.join(asked, same, "left_semi").isEmpty()

    def _save(self, settings: dict) -> str:
        self.folder.write(f"{settings['id']}.json", json.dumps(settings, ensure_ascii=False))
        return settings["id"]

    def add_ngrams(self, general: DataFrame, domain: DataFrame, lm_type: str = LM_TYPE, gamma: float | None = GAMMA, n: int = N, corpus_names: list[str] | None = None, min_freq: int = 1) -> str:
        """Train on sentences(tokens) of all texts and of the domain; the new model's id. ModelAlreadyExistsError for known settings."""
        check_training(lm_type, n, min_freq, gamma)
        settings = {"TYPE": "Ngrams", "LM_SCORE": lm_type, "GAMMA": gamma if lm_type == "LIDSTONE" else None, "N": n, "CORPUS_NAMES": corpus_names}
        if self.exists(settings):
            raise ModelAlreadyExistsError(str(settings))
        settings |= {"id": uuid.uuid4().hex}
        for part, sentences in (("GLOBAL", general), ("DOMAIN", domain)):
            name = f"{settings['id']}_{part.lower()}"
            ngram.train(sentences, n, min_freq=min_freq).write.mode("overwrite").parquet(self.folder.of(name))
            settings[f"{part}_MODEL_FILE_ID"] = name
        return self._save(settings)

    def add_masked(self, checkpoint: str) -> str:
        settings = {"TYPE": "BERT", "CHECKPOINT": checkpoint}
        if self.exists(settings):
            raise ModelAlreadyExistsError(checkpoint)
        return self._save(settings | {"id": uuid.uuid4().hex})

    def init(self, general: DataFrame, domain: DataFrame, n: int = N) -> list[str]:
        """The default models: one for each kind of score, with the default gamma, and one for each masked checkpoint. Nothing is made if one is there.

        The counts are the same for all kinds of score, so they are taken once.
        """
        wanted = [{"TYPE": "Ngrams", "LM_SCORE": t, "GAMMA": GAMMA if t == "LIDSTONE" else None, "N": n} for t in LM_TYPES]
        wanted += [{"TYPE": "BERT", "CHECKPOINT": c} for c in CHECKPOINT_NAMES]
        for settings in wanted:
            if self.exists(settings):
                raise ModelAlreadyExistsError(str(settings))
        first = self.add_ngrams(general, domain, LM_TYPES[0], GAMMA, n)
        files = {k: v for k, v in self.get(first).items() if k.endswith("_FILE_ID")}
        other = [self._save(s | files | {"id": uuid.uuid4().hex}) for s in wanted[1:] if s["TYPE"] == "Ngrams"]
        return [first, *other, *(self.add_masked(c) for c in CHECKPOINT_NAMES)]

    def delete(self, model_id: str) -> None:
        """Remove a model, and its counts unless another model has the same."""
        settings = self.get(model_id)
        self.folder.delete(f"{model_id}.json")
        used = {v for f in self.folder.names(".json") for k, v in json.loads(self.folder.read(f)).items() if k.endswith("_FILE_ID")}
        for part in ("GLOBAL", "DOMAIN"):
            name = settings.get(f"{part}_MODEL_FILE_ID")
            if name and name not in used:
                self.folder.delete(name)

    def counts(self, model_id: str) -> tuple[dict, DataFrame, DataFrame]:
        """(settings, counts of all texts, counts of the domain)."""
        s = self.get(model_id)
        return s, *(self.spark.read.parquet(self.folder.of(s[f"{p}_MODEL_FILE_ID"])) for p in ("GLOBAL", "DOMAIN"))

    def predict(self, model_id: str, cases: DataFrame, k: int = 10) -> DataFrame:
        """(case_id, rank, sentence, token_str, score) for cases(case_id, text), a gap `[...]` each. Texts without exactly one gap have no row."""
        settings, general, domain = self.counts(model_id)
        own = asked(cases, settings["N"])
        found = candidates.predictions(own, general, domain, k, settings["N"], lm_type=settings["LM_SCORE"], gamma=settings["GAMMA"])
        out = found.join(cases, "case_id").withColumn("token_str", F.lower("word"))
        return out.select("case_id", "rank", splice(F.col("text"), F.col("token_str")).alias("sentence"), "token_str", F.col("probability").alias("score"))

    def predict_words(self, model_id: str, cases: DataFrame, num_tokens: int, k: int = 10) -> DataFrame:
        """As predict, with fillings of num_tokens words each, by local beam search in the general model; score is their probability."""
        settings, general, _ = self.counts(model_id)
        own = asked(cases, settings["N"]).select("case_id", "context")
        found = candidates.word_sequences(own, general, num_tokens, candidates.beam_size(k), settings["N"]).filter(F.col("rank") <= k)
        out = found.join(cases, "case_id").withColumn("token_str", F.lower(F.array_join("words", " ")))
        return out.select("case_id", "rank", splice(F.col("text"), F.col("token_str")).alias("sentence"), "token_str", F.pow(F.lit(2.0), -F.col("nll")).alias("score"))

    def suggest(self, model_id: str, text: str, k: int = 10, num_tokens: int = 1) -> list[dict]:
        """The k best fillings of one text, of so many words, checked as a request."""
        if not text or len(text) > MOST_CONTEXT or text.count("[") != 1 or gap_missing(text):
            raise InvalidContextError(text)
        if k not in COUNTS or num_tokens not in TOKEN_RANGE:
            raise ValueError(f"counts are {COUNTS}, tokens {TOKEN_RANGE}")
        cases = self.spark.createDataFrame([(1, text)], "case_id int, text string")
        found = self.predict(model_id, cases, k) if num_tokens == 1 else self.predict_words(model_id, cases, num_tokens, k)
        return [r.asDict() for r in found.orderBy("rank").drop("case_id", "rank").collect()]


def gap_missing(text: str) -> bool:
    at = text.find("[")
    end = text.find("]", at)
    return at < 0 or end < 0 or not text[at + 1 : end] or set(text[at + 1 : end]) != {"."}


def asked(cases: DataFrame, n: int) -> DataFrame:
    """case_id, context, head, tail and gap_len of masked texts."""
    t = F.col("text")
    own = cases.filter(single_supplement(t).isNotNull())
    return own.select("case_id", context(t, n).alias("context"), head(t).alias("head"), tail(t).alias("tail"), gap_length(t).alias("gap_len"))
