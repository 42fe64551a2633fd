"""Queries of the training-data operators, each over its whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table, text_table
from . import consistent, contamination, language, mixing, overlap, packing, quality, splits, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(p1_segments(spark, d))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.blocks(text_table(spark, d, "ab"), table(spark, d, "language_codes"), table(spark, d, "common_words"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.found(p2_leaks(spark, d))


def p2_leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(text_table(spark, d, "ab"), table(spark, d, "test_abs"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return contamination.without_leaked_spans(text_table(spark, d, "ab"), table(spark, d, "test_abs")).select("id", "training_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consistent.found(p3_texts(spark, d))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    return consistent.rewritten(consistent.records(text_table(spark, d, "ab"), table(spark, d, "dev_case")), ["table_name", "rec_key"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(p5_overlaps(spark, d))


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    ab, dev = text_table(spark, d, "ab"), table(spark, d, "dev_case")
    return overlap.members(cut(overlap.overlaps(ab, dev)), ab, dev)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.counts(p5_overlaps(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.found(p6_groups(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.classes(splits.grouped(splits.file_names(table(spark, d, "ab"), table(spark, d, "dev_case")), "file", table(spark, d, "file_links")))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    records = splits.records(table(spark, d, "ab"), table(spark, d, "dev_case"), table(spark, d, "file_links"))
    return splits.assign(records, table(spark, d, "split_shares")).select("kind", "rec_key", "corpus_id", "file", "component", "split_name")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.achieved(p6_splits(spark, d), table(spark, d, "split_shares"))


def p4_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.records(text_table(spark, d, "ab"), text_table(spark, d, "documents"), table(spark, d, "corpora"), table(spark, d, "language_codes"))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    return tokens.totals(p4_tokens(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(cut(packing.sized(text_table(spark, d, "documents"))), table(spark, d, "pack_sizes"))


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused(p7_containers(spark, d), table(spark, d, "pack_sizes"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(tokens.counted(text_table(spark, d, "documents"), "text", {"doc_id": F.col("doc_id"), "source": F.col("source")}))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixture(sized, targets), sized, targets)


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    common_words = table(spark, d, "common_words")
    described = cut(quality.described(text_table(spark, d, "documents"), common_words))
    return quality.judged(described, quality.fitted(described, common_words))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(p9_statistics(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        *(p1_found, p1_segments, p2_found, p2_leaks, p2_clean, p3_found, p3_texts, p4_tokens, p4_totals, p5_found, p5_overlaps, p5_counts),
        *(p6_found, p6_groups, p6_splits, p6_shares, p7_containers, p7_unused, p8_mixture, p8_shares, p9_found, p9_statistics),
    )
}

#: What is timed.
HEADLINE = ("p1_found", "p2_found", "p3_found", "p4_tokens", "p5_found", "p6_found", "p7_containers", "p8_mixture", "p9_found")


def _key(name: str) -> str:
    """SQL of a file's series, volume and number, whatever the writing."""
    parts = f"list_filter(string_split_regex(regexp_replace(lower(trim({name})), '\\.xml$', ''), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    # Roman numbers by their letters: a pair whose first letter is smaller counts once less than twice the first
    signs = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}
    pairs = {"cm": 200, "cd": 200, "xc": 20, "xl": 20, "ix": 2, "iv": 2}
    count = lambda sign: f"(length(p[-2]) - length(replace(p[-2], '{sign}', ''))) / {len(sign)}"
    roman = " + ".join(f"{v} * ({count(s)})" for s, v in signs.items()) + "".join(f" - {v} * ({count(s)})" for s, v in pairs.items())
    shape = "m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})"
    volume = f"CASE WHEN regexp_full_match(p[-2], '\\d+') THEN p[-2]::BIGINT WHEN p[-2] <> '' AND regexp_full_match(p[-2], '{shape}') THEN ({roman})::BIGINT END"
    number = "regexp_extract(p[-1], '^0*(\\d+)', 1) || regexp_extract(p[-1], '\\p{L}*$')"
    shaped = f"len(p) >= 3 AND regexp_full_match(p[-1], '\\d+\\p{{L}}*') AND ({volume}) > 0"
    plain = f"regexp_replace(lower(trim({name})), '\\.xml$', '')"
    return f"(SELECT CASE WHEN {shaped} THEN array_to_string(p[1:-3], '.') || '.' || ({volume}) || '.' || {number} WHEN len(p) > 0 THEN {plain} END FROM (SELECT {parts} AS p))"


GROUPS = (
    "WITH RECURSIVE files AS (SELECT DISTINCT f FROM (SELECT split_part(id, '/', 2) AS f FROM ab UNION ALL SELECT file_id FROM dev_case) WHERE length(f) > 0), "
    f"keyed AS (SELECT f, {_key('f')} AS k FROM files), "
    f"links AS (SELECT {_key('from_file')} AS a, {_key('to_file')} AS b FROM file_links WHERE link_type IN ('reprint-of', 'joins', 'duplicate-of')), "
    "e AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b), "
    "r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a), "
    "g AS (SELECT f, coalesce(c, k) AS c FROM keyed LEFT JOIN c ON k = a WHERE k IS NOT NULL) "
)
SQL: dict[str, str] = {
    "p6_found": GROUPS + "SELECT x.f AS file_a, y.f AS file_b FROM g x JOIN g y USING (c) WHERE x.f < y.f",
    "p6_groups": GROUPS + "SELECT f AS file, c AS component, count(*) OVER (PARTITION BY c) AS n_files FROM g",
}
