"""Corpora, test sets and results in files: JSON, CSV, Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lacuna import SUPPLEMENT, mask_cases
from ..operators.splits import budget_sample, usable
from ..schemas import BLOCK, EVALUATION
from ..settings import FILE_LIMIT_MB, LANGUAGE, RANDOM_SEED
from ..session import cut
from ..storage import Folder


def read_corpus(spark: SparkSession, folder: str, test_file: str = "test_abs.json") -> tuple[DataFrame, DataFrame]:
    """(blocks, bad): all JSON arrays of a folder but the test set; bad has the names of files that can't be read."""
    raw = spark.read.option("wholetext", True).text(f"{folder.rstrip('/')}/*.json")
    raw = raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", f"array<struct<{_nested(BLOCK)}>>").alias("rows"))
    raw = raw.filter(F.col("file") != test_file)
    return raw.select(F.explode("rows").alias("r")).select("r.*"), raw.filter(F.col("rows").isNull()).select("file")


def load(spark: SparkSession, folder: str, corpora: tuple[str, ...] | None = None, budget: float | None = None, language: str = LANGUAGE, seed: int = RANDOM_SEED) -> DataFrame:
    """The training blocks of a folder: those of a language, of the given corpora or of none, and so many percent of those with an id, chosen by its hash."""
    own = usable(read_corpus(spark, folder)[0], corpora, language)
    return own if budget is None else budget_sample(own.filter(F.col("id").isNotNull()), "id", budget, seed)


def _nested(schema: str) -> str:
    """The columns of a schema as fields of a struct."""
    return T.StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).option("multiLine", True).json(path)


def write_lines(blocks: DataFrame, path: str) -> None:
    """One JSON object a line."""
    blocks.write.mode("overwrite").json(path)


def file_numbers(blocks: DataFrame, limit_mb: float = FILE_LIMIT_MB, key: str = "corpus_id", order: str = "id") -> DataFrame:
    """(key, order, file_no): files of each corpus cut before the row that would pass the limit, in the order of `order`.

    Rows of one key and order stay together. The fold over sizes is exact; only key, order and size of each row enter it, not the texts.
    """
    sizes = blocks.groupBy(F.col(key).alias("k"), F.col(order).alias("o")).agg(F.sum(F.octet_length(F.to_json(F.struct(*blocks.columns))).cast("long")).alias("n"))
    limit = int(limit_mb * 1024 * 1024)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_, used, number = None, 0, 0
        for batch in batches:
            numbers = []
            for k, n in zip(batch["k"], batch["n"], strict=True):
                if k != key_:
                    key_, used, number = k, 0, 0
                if used and used + n > limit:
                    used, number = 0, number + 1
                used += n
                numbers.append(number)
            yield pd.DataFrame({"k": batch["k"], "o": batch["o"], "file_no": numbers})

    schema = f"k {blocks.schema[key].dataType.simpleString()}, o {blocks.schema[order].dataType.simpleString()}, file_no int"
    return sizes.repartition("k").sortWithinPartitions("k", "o").mapInPandas(fold, schema).withColumnsRenamed({"k": key, "o": order})


def write_arrays(blocks: DataFrame, folder: str, prefix: str = "", limit_mb: float = FILE_LIMIT_MB, key: str = "corpus_id", order: str = "id") -> list[str]:
    """JSON arrays {prefix}{corpus}_{number}.json of limited size in a folder of any file system; their names.

    Spark's own writer commits each array once, however often its task runs; then the files get their names.
    """
    spark, place = blocks.sparkSession, Folder(blocks.sparkSession, folder)
    numbers = file_numbers(blocks, limit_mb, key, order).select(F.col(key).alias("_k"), F.col(order).alias("_o"), "file_no")
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col(order).eqNullSafe(F.col("_o"))
    rows = blocks.withColumn("_j", F.to_json(F.struct(*blocks.columns))).join(numbers, same)
    each = rows.groupBy("_k", "file_no").agg(F.array_sort(F.collect_list(F.struct("_o", "_j"))).alias("r"))
    arrays = cut(each.select(F.concat(F.lit(prefix), F.coalesce("_k", F.lit("unknown")), F.lit("_"), F.col("file_no").cast("string"), F.lit(".json")).alias("name"), F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["_j"]), ", "), F.lit("]")).alias("value")))
    named = arrays.withColumn("_f", F.abs(F.xxhash64("name")).cast("string"))
    named.select("_f", "value").write.mode("overwrite").partitionBy("_f").text(place.of("_arrays"))
    names = {r["_f"]: r["name"] for r in named.select("_f", "name").collect()}
    for f, name in names.items():
        for part in Folder(spark, place.of(f"_arrays/_f={f}")).names(".txt"):
            place.move(f"_arrays/_f={f}/{part}", name)
    place.delete("_arrays")
    return sorted(names.values())


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation sheet: a row per test case."""
    return spark.read.schema(EVALUATION).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def grouped_cases(rows: DataFrame, key: str, order: str, case: str, *first: str) -> DataFrame:
    """Per key: the first value, by order, of the named columns, and the cases in order, numbered from 0."""
    cases = F.transform(F.array_sort(F.collect_list(F.struct(order, case))), lambda c: c[case])
    return rows.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first], F.transform(cases, lambda c, i: F.struct(i.alias("case_index"), c.alias("test_case"))).alias("test_cases"))


def bracketed_context(context: DataFrame, text: str, wide: str, out: str = "training_text") -> DataFrame:
    """context with `out`: the wide text in which each supplement of `text` has its brackets again, where its words stand unbracketed."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"\S*{SUPPLEMENT}\S*"), 0)
    put = F.aggregate(found, F.col(wide), lambda acc, s: F.replace(acc, F.translate(s, "[]", ""), s))
    return context.withColumn(out, put)


def with_cases(blocks: DataFrame, text: str = "training_text", id_: str = "id") -> DataFrame:
    """blocks with test_cases: one masked text per supplement."""
    cases = F.transform(mask_cases(F.col(text)), lambda c: F.struct(c["case_index"].alias("case_index"), F.concat_ws("/", F.col(id_), c["case_index"].cast("string")).alias("id"), c["test_case"].alias("test_case")))
    return blocks.withColumn("test_cases", cases)


def write_results(results: DataFrame, path: str) -> None:
    """One CSV folder with a header."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The last row of each key by time, of those at one time the first by their other columns: repeated exports leave one."""
    order = [F.desc(time), *[F.to_json(F.struct(c)) for c in rows.columns if c not in (key, time)]]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def write_errors(errors: DataFrame, path: str) -> None:
    """The error log: one JSON object a line."""
    errors.write.mode("append").json(path)
