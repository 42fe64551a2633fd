"""Queries by name, each over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import pipeline
from ..functions import editorial, lacuna, normalize
from ..operators import candidates, datasets, infill, metrics, ngram, splits
from ..session import cut, table, text_table
from ..sources import corpus, tei
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Title words of the domain, rank and size of the models in these queries.
DOMAIN, SIZE, GAMMA, WEIGHT = "Petition", 3, 0.1, 0.2


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(k, x): every text of ab once for each id."""
    ab = text_table(spark, d, "ab").filter("training_text is not null and id is not null")
    return ab.groupBy(F.col("id").alias("k")).agg(F.min("training_text").alias("x"))


TEXTS = "texts AS (SELECT id AS k, min(training_text) AS x FROM ab WHERE training_text IS NOT NULL AND id IS NOT NULL GROUP BY id)"
GREEK = "greek AS (SELECT id AS k, min(training_text) AS x FROM ab WHERE training_text IS NOT NULL AND id IS NOT NULL AND language = 'grc' GROUP BY id)"


# filters and projections


@query("SELECT id, corpus_id, title FROM ab WHERE language = 'grc'")
def lang_filter(spark, d):
    return splits.usable(table(spark, d, "ab")).select("id", "corpus_id", "title")


@query("SELECT id, corpus_id FROM ab WHERE language = 'grc' AND (corpus_id IS NULL OR corpus_id IN ('OKP', 'LIB', 'unknown'))")
def corpus_filter(spark, d):
    return splits.usable(table(spark, d, "ab"), ("OKP", "LIB")).select("id", "corpus_id")


@query(f"SELECT id, title FROM ab WHERE language = 'grc' AND contains(title, '{DOMAIN}')")
def domain_filter(spark, d):
    return splits.in_domain(table(spark, d, "ab"), DOMAIN).select("id", "title")


@query("SELECT id, length(training_text) AS n FROM ab WHERE language IN ('grc', 'la', 'cop') AND length(training_text) >= 10")
def length_filter(spark, d):
    n = F.length("training_text")
    return table(spark, d, "ab").filter(F.col("language").isin(*tei.EDITION_LANGUAGES) & (n >= tei.SHORTEST_EDITION)).select("id", n.alias("n"))


@query("SELECT corpus_id, count(*) AS n FROM ab WHERE contains(title, 'Treatise') GROUP BY corpus_id")
def title_contains(spark, d):
    return table(spark, d, "ab").filter(F.col("title").contains("Treatise")).groupBy("corpus_id").agg(F.count("*").alias("n"))


@query("SELECT file_id, CASE WHEN regexp_matches(split_part(split_part(file_id, '/', -1), '.', 1), '^tlg\\d+') THEN 'tlg' ELSE split_part(split_part(file_id, '/', -1), '.', 1) END AS corpus, count(*) AS n FROM ab GROUP BY ALL")
def corpus_case(spark, d):
    return table(spark, d, "ab").groupBy("file_id").agg(F.count("*").alias("n")).select("file_id", tei.file_corpus(F.col("file_id")).alias("corpus"), "n")


@query(
    "SELECT id, lower(coalesce(CASE WHEN material NOT IN ('', 'unknown') THEN material END, m, 'unknown')) AS material FROM ab LEFT JOIN "
    "(SELECT file_id AS f, min(lower(material)) AS m FROM ab WHERE material NOT IN ('', 'unknown') GROUP BY file_id) ON file_id = f"
)
def material_coalesce(spark, d):
    own = table(spark, d, "ab").select("id", F.col("file_id").alias("hgv"), F.when(~F.col("material").isin("", "unknown"), F.col("material")).alias("material"))
    known = own.filter("material is not null").groupBy("hgv").agg(F.min(F.lower("material")).alias("hgv_material"))
    return tei.with_material(own, known).select("id", F.lower("material").alias("material"))


@query("SELECT id, language, title, exported_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exported_at DESC) AS r FROM (SELECT DISTINCT id, language, title, exported_at FROM ab)) WHERE r = 1")
def latest_export(spark, d):
    return corpus.latest(table(spark, d, "ab").select("id", "language", "title", "exported_at").distinct(), "id", "exported_at")


# editorial rules, letters, gaps


def _rule(name: str, rule: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return texts(spark, d).select("k", rule(F.col("x")).alias("y"))

    QUERIES[f"editorial_{name}"] = run
    SQL[f"editorial_{name}"] = f"WITH {TEXTS} SELECT k, {O.RULES[name] if name in O.RULES else O.dashes()} AS y FROM texts"


for _name in (*O.RULES, "dashes"):
    _rule(_name, getattr(editorial, _name))


@query(f"WITH {TEXTS} SELECT k, {O.stripped('x')} AS y FROM texts")
def strip_diacritics(spark, d):
    return texts(spark, d).select("k", normalize.strip_diacritics(F.col("x")).alias("y"))


@query(f"WITH {TEXTS} SELECT k, {O.upper(O.stripped('x'))} AS y FROM texts")
def normalize_upper(spark, d):
    return texts(spark, d).select("k", normalize.normalize_greek(F.col("x")).alias("y"))


@query(f"WITH {TEXTS} SELECT k, {O.bare('x')} AS y FROM texts")
def remove_punct(spark, d):
    return texts(spark, d).select("k", normalize.remove_punctuation(F.col("x")).alias("y"))


@query(f"WITH {TEXTS}, {O.plain('p', 'texts')} SELECT k, x AS plain FROM p")
def transpile(spark, d):
    return texts(spark, d).select("k", lacuna.transpile(F.col("x")).alias("plain"))


@query(f"WITH docs AS (SELECT doc_id AS k, text AS x FROM documents WHERE text IS NOT NULL), {O.plain('p', 'docs')} SELECT k, x AS plain FROM p")
def transpile_documents(spark, d):
    docs = text_table(spark, d, "documents").filter("text is not null")
    return docs.select(F.col("doc_id").alias("k"), lacuna.transpile(F.col("text")).alias("plain"))


@query(f"WITH {TEXTS}, e AS (SELECT k, unnest({O.words('x')}) AS t FROM texts) SELECT t AS token, count(*) AS n, bool_and({O.has_gap('t')}) AS gap FROM e GROUP BY t")
def contains_lacunae(spark, d):
    tokens = texts(spark, d).select(F.explode(editorial.words(F.col("x"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.select("token", "n", lacuna.contains_lacunae(F.col("token")).alias("gap"))


@query(f"WITH {TEXTS}, e AS (SELECT DISTINCT unnest({O.words('x')}) AS t FROM texts) SELECT t AS token, {O.mended('t')} AS words FROM e WHERE {O.has_gap('t')}")
def lacuna_tokens(spark, d):
    tokens = texts(spark, d).select(F.explode(editorial.words(F.col("x"))).alias("token")).distinct()
    return tokens.filter(lacuna.contains_lacunae(F.col("token"))).select("token", F.array_join(lacuna.clean_lacunae(F.col("token")), " ").alias("words"))


def greek(spark: SparkSession, d: str, domain: bool = False) -> DataFrame:
    """(k, x) of the Greek texts, or of those of the domain, once for each id."""
    ab = text_table(spark, d, "ab").filter("training_text is not null and id is not null and language = 'grc'")
    own = ab.filter(F.col("title").contains(DOMAIN)) if domain else ab
    return own.groupBy(F.col("id").alias("k")).agg(F.min("training_text").alias("x"))


def sentences_of(source: DataFrame) -> DataFrame:
    return source.select("k", F.posexplode(lacuna.sentence_tokens(F.col("x"))).alias("i", "tokens")).withColumn("i", F.col("i") + 1)


GREEK_SENTENCES = f"{GREEK}, {O.plain('p', 'greek')}, {O.sentences('st', 'p')}"
DOMAIN_SENTENCES = f"{GREEK.replace('greek AS', 'dom AS').replace('GROUP BY', f'AND contains(title, {O.quoted(DOMAIN)}) GROUP BY')}, {O.plain('q', 'dom')}, {O.sentences('sd', 'q')}"


@query(f"WITH {GREEK_SENTENCES} SELECT k, array_to_string(tokens, ' ') AS sentence, len(tokens) AS n FROM st")
def sentences(spark, d):
    return sentences_of(greek(spark, d)).select("k", F.array_join("tokens", " ").alias("sentence"), F.size("tokens").cast("long").alias("n"))


# language models


def model(spark: SparkSession, d: str, domain: bool = False, n: int = SIZE) -> DataFrame:
    return ngram.train(sentences_of(greek(spark, d, domain)), n)


def models(spark: SparkSession, d: str, n: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """The models of all Greek texts and of those of the domain, from one reading of the texts."""
    ab = text_table(spark, d, "ab").filter("training_text is not null and id is not null and language = 'grc'")
    own = ab.groupBy(F.col("id").alias("k")).agg(F.min("training_text").alias("x"), F.coalesce(F.max(F.col("title").contains(DOMAIN)), F.lit(False)).alias("in_domain"))
    return ngram.flagged(own.select("in_domain", F.explode(lacuna.sentence_tokens(F.col("x"))).alias("tokens")), n)


def spaced(ctx: str = "ctx") -> Column:
    return F.replace(ctx, F.lit(ngram.SEP), F.lit(" ")).alias("ctx")


def _counts(n: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = ngram.ngram_rows(sentences_of(greek(spark, d)), n, orders=[n])
        return rows.groupBy("ctx", "word").agg(F.count("*").alias("cnt")).select(spaced(), "word", "cnt")

    QUERIES[f"ngram_counts_{n}"] = run
    SQL[f"ngram_counts_{n}"] = f"WITH {GREEK_SENTENCES}, {O.grams('g', 'st', n, [n])} SELECT ctx, word, count(*) AS cnt FROM g GROUP BY ctx, word"


for _n in (1, 2, 3):
    _counts(_n)

MODEL = f"{GREEK_SENTENCES}, {O.grams('g', 'st', SIZE, [1, 2, 3])}, m AS (SELECT o, ctx, word, count(*) AS cnt FROM g GROUP BY ALL), tot AS (SELECT o, ctx, sum(cnt)::BIGINT AS total FROM m GROUP BY ALL), vs AS (SELECT count(*) + 1 AS v FROM m WHERE o = 1)"
MODEL_D = f"{DOMAIN_SENTENCES}, {O.grams('gd', 'sd', SIZE, [1, 2, 3])}, md AS (SELECT o, ctx, word, count(*) AS cnt FROM gd GROUP BY ALL), totd AS (SELECT o, ctx, sum(cnt)::BIGINT AS total FROM md GROUP BY ALL), vd AS (SELECT count(*) + 1 AS v FROM md WHERE o = 1)"


@query(f"WITH {MODEL} SELECT word FROM m WHERE o = 1")
def vocab(spark, d):
    return ngram.vocabulary(model(spark, d))


@query(f"WITH {MODEL} SELECT o AS \"order\", ctx, total FROM tot")
def context_totals(spark, d):
    return ngram.totals(model(spark, d)).select("order", spaced(), "total")


@query(f"WITH {MODEL} SELECT m.ctx, word, round(cnt / total, 9) AS p FROM m JOIN tot USING (o, ctx) WHERE o = 3")
def mle_score(spark, d):
    m = cut(model(spark, d))
    asked = m.filter("order = 3").select("order", "ctx", "word")
    return ngram.scored(asked, m, "p", "MLE", only=3).select(spaced(), "word", F.round("p", 9).alias("p"))


@query(f"WITH {MODEL} SELECT m.ctx, word, round((cnt + {GAMMA}) / (total + v * {GAMMA}), 9) AS p FROM m JOIN tot USING (o, ctx), vs WHERE o = 3")
def lidstone_score(spark, d):
    m = cut(model(spark, d))
    asked = m.filter("order = 3").select("order", "ctx", "word")
    return ngram.scored(asked, m, "p", "LIDSTONE", GAMMA, 3).select(spaced(), "word", F.round("p", 9).alias("p"))


#: Interpolated scores of every n-gram of the domain's sentences.
INTERPOLATED = (
    f"{MODEL}, {MODEL_D}, gs AS (SELECT k, i, ctx, word FROM gd WHERE o = 3), u AS (SELECT DISTINCT ctx, word FROM gs), "
    f"sc AS (SELECT u.ctx, u.word, (coalesce(m.cnt, 0) + {GAMMA}) / (coalesce(tot.total, 0) + vs.v * {GAMMA}) AS pg, (coalesce(md.cnt, 0) + {GAMMA}) / (coalesce(totd.total, 0) + vd.v * {GAMMA}) AS pd "
    "FROM u LEFT JOIN m ON m.o = 3 AND m.ctx = u.ctx AND m.word = u.word LEFT JOIN tot ON tot.o = 3 AND tot.ctx = u.ctx LEFT JOIN md ON md.o = 3 AND md.ctx = u.ctx AND md.word = u.word "
    f"LEFT JOIN totd ON totd.o = 3 AND totd.ctx = u.ctx, vs, vd), ls AS (SELECT gs.*, log2({WEIGHT} * pd + {1 - WEIGHT} * pg) AS s FROM gs JOIN sc USING (ctx, word))"
)


def interpolated(spark: SparkSession, d: str) -> DataFrame:
    rows = ngram.ngram_rows(sentences_of(greek(spark, d, True)), SIZE, orders=[SIZE], keep=("k", "i"))
    return ngram.interpolated(rows, *models(spark, d), WEIGHT, "LIDSTONE", GAMMA, SIZE)


@query(f"WITH {INTERPOLATED} SELECT DISTINCT ctx, word, round(s, 6) AS s FROM ls")
def interpolated_score(spark, d):
    return interpolated(spark, d).select(spaced(), "word", F.round("log_score", 6).alias("s")).distinct()


@query(f"WITH {INTERPOLATED} SELECT round(-avg(s), 6) AS entropy, round(pow(2, -avg(s)), 4) AS perplexity FROM ls")
def perplexity(spark, d):
    return ngram.entropy(interpolated(spark, d)).select(F.round("entropy", 6).alias("entropy"), F.round("perplexity", 4).alias("perplexity"))


@query(f"WITH {INTERPOLATED} SELECT k || '/' || i AS k, round(-sum(s), 5) AS nll FROM ls GROUP BY ALL")
def sequence_nll(spark, d):
    own = interpolated(spark, d).withColumn("k", F.concat_ws("/", "k", F.col("i").cast("string")))
    return ngram.sequence_loss(own, "k").select("k", F.round("nll", 5).alias("nll"))


@query(f"WITH {MODEL}, {MODEL_D} SELECT o AS \"order\", ctx, word, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM m UNION ALL SELECT * FROM md) GROUP BY ALL")
def merged_counts(spark, d):
    return ngram.merged(*models(spark, d)).select("order", spaced(), "word", "cnt")


# gaps and candidates


@query(
    f"WITH {TEXTS}, f AS (SELECT k, regexp_extract_all(x, {O.quoted(O.SUPPLEMENT)}) AS f, string_split_regex(x, {O.quoted(O.SUPPLEMENT)}) AS r FROM texts), e AS (SELECT k, f, r, unnest(range(1, len(f) + 1)) AS i FROM f) "
    "SELECT k, i AS case_index, array_to_string(list_transform(range(1, len(r) + 1), lambda j: translate(r[j], '[]', '') || CASE WHEN j > len(f) THEN '' WHEN j = i THEN '[' || repeat('.', length(f[j]) - 2) || ']' ELSE translate(f[j], '[]', '') END), '') AS test_case FROM e"
)
def mask_cases(spark, d):
    return texts(spark, d).select("k", F.explode(lacuna.mask_cases(F.col("x"))).alias("c")).select("k", F.col("c.case_index").cast("long").alias("case_index"), "c.test_case")


def cases(spark: SparkSession, d: str) -> DataFrame:
    """(k, text) of the masked cases of Greek texts."""
    ab = table(spark, d, "ab").filter("language = 'grc'").select(F.explode("test_cases").alias("c"))
    return ab.groupBy(F.col("c.id").alias("k")).agg(F.min("c.test_case").alias("text"))


ONE = f"len(regexp_extract_all(x, {O.quoted(O.SUPPLEMENT)})) = 1"
CASES = "cs AS (SELECT c.id AS k, min(c.test_case) AS x FROM (SELECT unnest(test_cases) AS c FROM ab WHERE language = 'grc') GROUP BY c.id)"
HEADS = (
    f"h0 AS (SELECT k, regexp_extract(x, {O.quoted('([^ \n\\[]*)' + O.SUPPLEMENT)}, 1) AS x FROM cs WHERE {ONE}), {O.plain('hp', 'h0')}, "
    f"t0 AS (SELECT k, trim(regexp_extract(x, {O.quoted(O.SUPPLEMENT + '([^ \n]*)')}, 1)) AS x FROM cs WHERE {ONE}), {O.plain('tp', 't0')}, "
    f"ht AS (SELECT cs.k, CASE WHEN {O.has_gap('h0.x')} THEN NULL ELSE {O.bare('hp.x')} END AS head, CASE WHEN {O.has_gap('t0.x')} THEN NULL ELSE {O.bare('tp.x')} END AS tail, "
    f"length(regexp_replace(regexp_extract(cs.x, {O.quoted(O.SUPPLEMENT)}), '[^.]', '', 'g')) AS gap_len FROM cs JOIN h0 USING (k) JOIN hp USING (k) JOIN t0 USING (k) JOIN tp USING (k))"
)
CONTEXTS = (
    f"l0 AS (SELECT k, regexp_extract(x, '(?s)^(.*?)[^\\s\\[]*\\[', 1) AS x FROM cs WHERE {ONE}), {O.plain('lp', 'l0')}, {O.sentences('ls0', 'lp')}, "
    f"lt AS (SELECT k, flatten(list(['<s>', '<s>'] || tokens || ['</s>', '</s>'] ORDER BY i)) AS t FROM ls0 GROUP BY k), "
    "ctxs AS (SELECT l0.k, CASE WHEN t IS NULL THEN ['<s>', '<s>'] ELSE t[greatest(len(t) - 3, 1):len(t) - 2] END AS c FROM l0 LEFT JOIN lt USING (k))"
)


@query(f"WITH {CASES}, {HEADS} SELECT k, head, tail, gap_len FROM ht")
def head_tail(spark, d):
    t = F.col("text")
    own = cases(spark, d).filter(lacuna.single_supplement(t).isNotNull())
    return own.select("k", lacuna.head(t).alias("head"), lacuna.tail(t).alias("tail"), lacuna.gap_length(t).cast("long").alias("gap_len"))


@query(f"WITH {CASES}, {CONTEXTS} SELECT k, array_to_string(c, ' ') AS context FROM ctxs")
def context_tokens(spark, d):
    own = cases(spark, d).filter(lacuna.single_supplement(F.col("text")).isNotNull())
    return own.select("k", F.array_join(lacuna.context(F.col("text"), SIZE), " ").alias("context"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The cases with one gap, cut from the long expressions that read them."""
    t = F.col("text")
    own = cases(spark, d).filter(lacuna.single_supplement(t).isNotNull())
    return cut(own.select(F.col("k").alias("case_id"), lacuna.context(t, SIZE).alias("context"), lacuna.head(t).alias("head"), lacuna.tail(t).alias("tail"), lacuna.gap_length(t).alias("gap_len")))


BOUNDARY = candidates.beam_size(10)
SUCCESSORS = (
    f"{MODEL}, {MODEL_D}, mm AS (SELECT o, ctx, word, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM m UNION ALL SELECT * FROM md) GROUP BY ALL), {CASES}, {HEADS}, {CONTEXTS}, "
    "s3 AS (SELECT k, 3 AS o, word, cnt FROM ctxs JOIN mm ON mm.o = 3 AND mm.ctx = c[1] || ' ' || c[2] WHERE word NOT IN ('<s>', '</s>', '<UNK>')), "
    "s2 AS (SELECT k, 2 AS o, word, cnt FROM ctxs JOIN mm ON mm.o = 2 AND mm.ctx = c[2] WHERE word NOT IN ('<s>', '</s>', '<UNK>')), "
    f"few AS (SELECT ctxs.k FROM ctxs LEFT JOIN (SELECT k, count(*) AS n FROM s3 GROUP BY k) USING (k) WHERE coalesce(n, 0) < {O.BEAM}), "
    "suc AS (SELECT * FROM s3 UNION ALL SELECT s2.* FROM s2 JOIN few USING (k) WHERE NOT EXISTS (SELECT 1 FROM s3 WHERE s3.k = s2.k AND s3.word = s2.word))"
)


#: As SUCCESSORS, with the words of a context that a model doesn't know turned to the unknown word, for each model apart.
KNOWN_SUCCESSORS = (
    f"{MODEL}, {MODEL_D}, {CASES}, {HEADS}, {CONTEXTS}, gw AS (SELECT word FROM m WHERE o = 1), dw AS (SELECT word FROM md WHERE o = 1), "
    "kc AS (SELECT k, coalesce(g1.word, '<UNK>') AS ga, coalesce(g2.word, '<UNK>') AS gb, coalesce(d1.word, '<UNK>') AS da, coalesce(d2.word, '<UNK>') AS db FROM ctxs "
    "LEFT JOIN gw g1 ON g1.word = c[1] LEFT JOIN gw g2 ON g2.word = c[2] LEFT JOIN dw d1 ON d1.word = c[1] LEFT JOIN dw d2 ON d2.word = c[2]), "
    "s3 AS (SELECT k, 3 AS o, word, sum(cnt)::BIGINT AS cnt FROM (SELECT k, word, cnt FROM kc JOIN m ON o = 3 AND ctx = ga || ' ' || gb UNION ALL SELECT k, word, cnt FROM kc JOIN md ON o = 3 AND ctx = da || ' ' || db) WHERE word NOT IN ('<s>', '</s>', '<UNK>') GROUP BY k, word), "
    "s2 AS (SELECT k, 2 AS o, word, sum(cnt)::BIGINT AS cnt FROM (SELECT k, word, cnt FROM kc JOIN m ON o = 2 AND ctx = gb UNION ALL SELECT k, word, cnt FROM kc JOIN md ON o = 2 AND ctx = db) WHERE word NOT IN ('<s>', '</s>', '<UNK>') GROUP BY k, word), "
    f"few AS (SELECT ctxs.k FROM ctxs LEFT JOIN (SELECT k, count(*) AS n FROM s3 GROUP BY k) USING (k) WHERE coalesce(n, 0) < {O.BEAM}), "
    "suc AS (SELECT * FROM s3 UNION ALL SELECT s2.* FROM s2 JOIN few USING (k) WHERE NOT EXISTS (SELECT 1 FROM s3 WHERE s3.k = s2.k AND s3.word = s2.word)), "
    "w AS (SELECT suc.k, word, cnt, gap_len, coalesce(head, '') AS h, coalesce(tail, '') AS t FROM suc JOIN ht USING (k)), "
    f"e AS (SELECT *, {O.distance('left(word, length(h))', 'h')} AS dh, {O.distance('right(word, length(t))', 't')} AS dt, abs(length(word) - gap_len - length(h) - length(t)) AS dl FROM w)"
)
BEAM = f"{KNOWN_SUCCESSORS}, bm AS (SELECT * FROM (SELECT k, word, (dh + dt + dl)::DOUBLE AS score, row_number() OVER (PARTITION BY k ORDER BY dh + dt + dl, word) AS rank FROM e) WHERE rank <= {O.BEAM})"
#: The words that were masked, of supplements of one word.
GOLD = f"{O.SUPPLEMENTS}, gold AS (SELECT DISTINCT c.id AS k, tokens[1] AS word FROM (SELECT id AS k, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM each_) JOIN sup USING (k, i) WHERE len(tokens) = 1 AND tokens[1] <> '<UNK>')"
FIRST_TEN = f"{BEAM}, ten AS (SELECT * FROM bm WHERE rank <= 10), {GOLD}"


def found_as_read(spark: SparkSession, d: str) -> DataFrame:
    """Successors of the contexts as they stand, unknown words not mapped, as the SQL of the queries that use it."""
    return candidates.successors(asked(spark, d), cut(ngram.merged(*models(spark, d))), BOUNDARY, SIZE)


def found(spark: SparkSession, d: str) -> DataFrame:
    own = asked(spark, d)
    return candidates.successors(own, cut(candidates.known_counts(own, *models(spark, d), SIZE)), BOUNDARY, SIZE)


@query(f"WITH {SUCCESSORS} SELECT k, word, cnt, o AS \"order\" FROM suc")
def backoff_candidates(spark, d):
    return found_as_read(spark, d).select(F.col("case_id").alias("k"), "word", "cnt", "order")


@query(f"WITH {SUCCESSORS} SELECT k, word, abs(length(word) - (gap_len + length(coalesce(head, '')) + length(coalesce(tail, '')))) AS penalty FROM suc JOIN ht USING (k)")
def length_penalty(spark, d):
    return found_as_read(spark, d).select(F.col("case_id").alias("k"), "word", candidates.length_penalty(F.col("word")).cast("long").alias("penalty"))


@query(
    f"WITH {KNOWN_SUCCESSORS}, f AS (SELECT *, length(word) = length(h) + length(t) + gap_len AND ((h = '' AND t = '') OR (h <> '' AND starts_with(word, h)) OR (t <> '' AND suffix(word, t))) AS fits FROM e) "
    "SELECT k, word, fits, row_number() OVER (PARTITION BY k ORDER BY fits DESC, CASE WHEN h = '' AND t = '' THEN cnt ELSE dh + dt END, word) AS place FROM f"
)
def candidate_order(spark, d):
    return candidates.ranked(found(spark, d)).select(F.col("case_id").alias("k"), "word", "fits", F.col("place").cast("long").alias("place"))


@query(f"WITH {KNOWN_SUCCESSORS} SELECT k, word, (dh + dt + dl)::DOUBLE AS score FROM e")
def candidate_score(spark, d):
    return candidates.scores(found(spark, d)).select(F.col("case_id").alias("k"), "word", "score")


@query(f"WITH {BEAM} SELECT k, word, score, rank FROM bm")
def beam_topk(spark, d):
    return requested(spark, d, lambda own: candidates.beams(own, *models(spark, d), BOUNDARY, SIZE)).select(F.col("case_id").alias("k"), "word", "score", F.col("rank").cast("long").alias("rank"))


def requested(spark: SparkSession, d: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of answer(requests) for every case, equal requests being answered once."""
    every, requests = candidates.distinct_requests(asked(spark, d))
    return every.join(answer(requests).withColumnRenamed("case_id", "_q").drop("context", "head", "tail", "gap_len"), "_q").drop("_q")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return candidates.predictions(asked(spark, d), *models(spark, d), 10, SIZE)


#: Probabilities of the first ten by the default gamma and weight.
PREDICTIONS = (
    f"{BEAM}, ten AS (SELECT k, word, score, rank, ga || ' ' || gb AS gc, da || ' ' || db AS dc, coalesce(gw.word, '<UNK>') AS wg, coalesce(dw.word, '<UNK>') AS wd FROM bm JOIN kc USING (k) LEFT JOIN gw USING (word) LEFT JOIN dw USING (word) WHERE rank <= 10) "
    "SELECT ten.k AS case_id, ten.rank, ten.word, ten.score, round(0.2 * (coalesce(md.cnt, 0) + 0.001) / (coalesce(totd.total, 0) + vd.v * 0.001) + 0.8 * (coalesce(m.cnt, 0) + 0.001) / (coalesce(tot.total, 0) + vs.v * 0.001), 9) AS probability "
    "FROM ten LEFT JOIN m ON m.o = 3 AND m.ctx = gc AND m.word = wg LEFT JOIN tot ON tot.o = 3 AND tot.ctx = gc LEFT JOIN md ON md.o = 3 AND md.ctx = dc AND md.word = wd LEFT JOIN totd ON totd.o = 3 AND totd.ctx = dc, vs, vd"
)


@query(f"WITH {PREDICTIONS}")
def predictions(spark, d):
    return predicted(spark, d).select("case_id", F.col("rank").cast("long").alias("rank"), "word", "score", F.round("probability", 9).alias("probability"))


@query(f"WITH {BEAM} SELECT k, regexp_replace(x, {O.quoted(r'\S*\[.*?\]\S*')}, {O.lowered('word')}) AS sentence FROM bm JOIN cs USING (k) WHERE rank = 1")
def sentence_splice(spark, d):
    best = predicted(spark, d).filter("rank = 1").select(F.col("case_id").alias("k"), F.lower("word").alias("word"))
    return best.join(cases(spark, d), "k").select("k", lacuna.splice(F.col("text"), F.col("word")).alias("sentence"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, word): the single words that were masked."""
    ab = table(spark, d, "ab").filter("language = 'grc' and training_text is not null")
    each = ab.groupBy("id").agg(F.min("training_text").alias("t"), F.min_by("test_cases", "training_text").alias("c"))
    pairs = each.select(F.explode(F.arrays_zip(F.col("c").alias("c"), lacuna.supplements(F.col("t")).alias("s"))).alias("z")).filter(F.col("z.c").isNotNull() & candidates.check_supplement(F.col("z.s.tokens")))
    return pairs.select(F.col("z.c.id").alias("case_id"), F.get("z.s.tokens", F.lit(0)).alias("word")).distinct()


HITS = "SELECT count(*) FILTER (first <= {k}) AS hits, count(*) AS cases, round(count(*) FILTER (first <= {k}) / count(*), 5) AS accuracy FROM (SELECT k, min(rank) AS first FROM (SELECT gold.k, rank FROM gold LEFT JOIN {b} b ON b.k = gold.k AND b.word = gold.word) GROUP BY k)"


@query(f"WITH {FIRST_TEN} " + HITS.format(k=10, b="ten"))
def topk_accuracy(spark, d):
    return metrics.topk_accuracy(predicted(spark, d), gold(spark, d), 10)


@query(f"WITH {FIRST_TEN} " + HITS.format(k=O.BEAM, b="bm"))
def hit_in_beam(spark, d):
    own = gold(spark, d)
    whole = requested(spark, d, lambda r: candidates.beams(r, *models(spark, d), BOUNDARY, SIZE))
    return metrics.topk_accuracy(metrics.gold_ranked(whole, own), own, 1)


@query(f"WITH {FIRST_TEN} SELECT " + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 100.0 ELSE 0.0 END)::DOUBLE, 6) AS top_{k}" for k in (1, 3, 5, 10)) + " FROM (SELECT k, min(rank) AS first FROM (SELECT gold.k, rank FROM gold LEFT JOIN ten b ON b.k = gold.k AND b.word = gold.word) GROUP BY k)")
def topk_text_metrics(spark, d):
    own = metrics.text_topk(predicted(spark, d), gold(spark, d))
    return own.select(*[F.round(c, 6).alias(c) for c in own.columns])


@query(
    f"WITH {TEXTS}, e AS (SELECT k, {O.words('x')} AS h, {O.words('translate(x, ' + O.quoted('[](){}<>') + ', ' + O.quoted('') + ')')} AS r FROM texts), c AS (SELECT k, len(h) AS n, len(r) AS m, "
    "list_sum(list_transform(list_distinct(h), lambda w: least(len(list_filter(h, lambda y: y = w)), len(list_filter(r, lambda y: y = w))))) AS hits FROM e) "
    "SELECT k, round(CASE WHEN n = 0 THEN 0 ELSE (CASE WHEN n >= m THEN 1.0 ELSE exp(1 - m / n) END) * hits / n END, 9) AS bleu FROM c"
)
def bleu1(spark, d):
    own = texts(spark, d).select("k", editorial.words(F.col("x")).alias("h"), editorial.words(F.translate("x", "[](){}<>", "")).alias("r"))
    return own.select("k", F.round(metrics.bleu1(F.col("r"), F.col("h")), 9).alias("bleu"))


# samples, data sets


HASH = "((doc_id + 42) * 2654435761) % 4294967296"


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 10 / 100)")
def budget_sample(spark, d):
    return splits.budget_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 10)


@query(f"SELECT doc_id, CASE WHEN r <= ceil(n * 0.05) THEN 'test' ELSE 'train' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY {HASH}, doc_id) AS r, count(*) OVER () AS n FROM documents)")
def train_test_split(spark, d):
    train, test = splits.split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.05)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


#: A number for an id that any engine finds: the first seven hexadecimal digits of its MD5.
NUMBER = "('0x' || substr(md5(id), 1, 7))::BIGINT"


@query(
    f"WITH b AS (SELECT id, min(training_text) AS t, bool_or(coalesce(contains(title, '{DOMAIN}'), false)) AS dom FROM ab WHERE language = 'grc' AND id IS NOT NULL AND training_text IS NOT NULL GROUP BY id), "
    f"r AS (SELECT id, row_number() OVER (ORDER BY (({NUMBER} + 42) * 2654435761) % 4294967296, id) <= ceil(count(*) OVER () * 0.2) AS dev FROM b WHERE dom), u AS (SELECT b.*, coalesce(dev, false) AS dev FROM b LEFT JOIN r USING (id)), "
    f"greek AS (SELECT id AS k, t AS x FROM u WHERE NOT dev), {O.plain('p', 'greek')}, {O.sentences('st', 'p')}, {O.grams('g', 'st', SIZE, [1, 2, 3])}, w AS (SELECT o, ctx, word, count(*) AS n, count(*) FILTER (dom) AS d FROM g JOIN u ON u.id = g.k GROUP BY ALL), "
    "e AS (SELECT 'general' AS model, o, n FROM w UNION ALL SELECT 'domain', o, d FROM w WHERE d > 0) SELECT model, o AS \"order\", count(*) AS ngrams, sum(n)::BIGINT AS cnt FROM e GROUP BY ALL UNION ALL SELECT 'dev', 0, count(*), 0 FROM u WHERE dev"
)
def train_pipeline(spark, d):
    ab = text_table(spark, d, "ab").filter("language = 'grc' and id is not null and training_text is not null")
    flag = F.when(F.coalesce(F.max(F.col("title").contains(DOMAIN)), F.lit(False)), DOMAIN).alias("title")
    general, domain, dev = pipeline.train(ab.groupBy("id", "language").agg(F.min("training_text").alias("training_text"), flag), DOMAIN, SIZE)
    sums = [m.groupBy("order").agg(F.count("*").alias("ngrams"), F.sum("cnt").alias("cnt")).select(F.lit(name).alias("model"), "order", "ngrams", "cnt") for name, m in (("general", general), ("domain", domain))]
    held = dev.agg(F.count("*").alias("ngrams")).select(F.lit("dev").alias("model"), F.lit(0).alias("order"), "ngrams", F.lit(0).cast("long").alias("cnt"))
    return sums[0].unionByName(sums[1]).unionByName(held)


@query("SELECT DISTINCT id FROM ab WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM test_abs) AND split_part(id, '/', 2) NOT IN (SELECT file_id FROM dev_case WHERE file_id IS NOT NULL)")
def dev_anti_join(spark, d):
    ab = table(spark, d, "ab").select("id", F.get(F.split("id", "/"), F.lit(1)).alias("file_id")).filter("id is not null").distinct()
    held = splits.without(ab, table(spark, d, "test_abs"), "id")
    return splits.without(held, table(spark, d, "dev_case").filter("file_id is not null"), "file_id").select("id")


@query(f"WITH {GREEK_SENTENCES}, w AS (SELECT tokens, len(list_filter(tokens, lambda t: t = '<UNK>')) AS u FROM st) SELECT replace(array_to_string(tokens, ' '), '<UNK>', '[UNK]') AS text, u AS unknown FROM w WHERE len(tokens) >= 10 AND u < 0.1 * len(tokens)")
def quality_sentences(spark, d):
    own = sentences_of(greek(spark, d)).filter(datasets.is_quality(F.col("tokens")))
    return own.select(datasets.cast_unknown(F.array_join("tokens", " ")).alias("text"), datasets.count_unknown(F.col("tokens")).cast("long").alias("unknown"))


@query(f"WITH docs AS (SELECT doc_id, {O.words('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(list_transform(range(0, len(w) // 50), lambda i: array_to_string(w[i * 50 + 1:i * 50 + 50], ' '))) AS chunk FROM docs")
def chunk_sentences(spark, d):
    docs = text_table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.explode(datasets.chunks(editorial.words(F.col("text")))).alias("c")).select("doc_id", F.array_join("c", " ").alias("chunk"))


@query(f"WITH {GREEK_SENTENCES} SELECT k, i, len(tokens) AS n, len(list_filter(tokens, lambda t: t = '<UNK>')) AS unknown, round(len(list_filter(tokens, lambda t: t = '<UNK>')) / len(tokens), 9) AS ratio FROM st WHERE len(tokens) > 0")
def unk_ratio(spark, d):
    own = sentences_of(greek(spark, d)).filter(F.size("tokens") > 0).select("k", F.col("i").cast("long").alias("i"), F.size("tokens").cast("long").alias("n"), datasets.count_unknown(F.col("tokens")).cast("long").alias("unknown"))
    return own.withColumn("ratio", F.round(F.col("unknown") / F.col("n"), 9))


#: Sentences packed by a fold: o holds the finished chunks, c the open one and u its tokens; a token is a code point.
FOLD = (
    "list_reduce(list_transform(ss, lambda s: {'o': []::VARCHAR[], 'c': '', 'u': 0, 't': s}), lambda a, b: CASE "
    "WHEN length(b.t) > 510 THEN {'o': a.o || (CASE WHEN a.c = '' THEN [] ELSE [a.c] END) || [left(b.t, 510)], 'c': '', 'u': 0, 't': ''} "
    "WHEN a.u + length(b.t) > 510 THEN {'o': a.o || [a.c], 'c': b.t, 'u': length(b.t)::INTEGER, 't': ''} "
    "ELSE {'o': a.o, 'c': CASE WHEN a.c = '' THEN b.t ELSE a.c || ' ' || b.t END, 'u': (a.u + length(b.t))::INTEGER, 't': ''} END, {'o': []::VARCHAR[], 'c': '', 'u': 0, 't': ''})"
)


@query(
    f"WITH {GREEK_SENTENCES}, own AS (SELECT k, list(array_to_string(tokens, ' ') ORDER BY i) AS ss FROM st WHERE len(tokens) > 0 GROUP BY k), f AS (SELECT k, {FOLD} AS f FROM own), "
    "o AS (SELECT k, f.o || (CASE WHEN f.c = '' THEN [] ELSE [f.c] END) AS o FROM f) SELECT k, unnest(range(0, len(o))) AS chunk_no, unnest(o) AS text FROM o"
)
def chunk_for_bert(spark, d):
    own = sentences_of(greek(spark, d)).filter(F.size("tokens") > 0).select("k", "i", F.array_join("tokens", " ").alias("t"))
    return datasets.packed(own, "k", "i", "t", list, join="".join)


@query(
    "WITH docs AS (SELECT doc_id // 1000 AS g, doc_id, text FROM documents WHERE length(text) > 0), l AS (SELECT g, string_agg(text, '' ORDER BY doc_id) AS x FROM docs GROUP BY g), "
    "p AS (SELECT g, x, unnest(range(0, (length(x) + 127) // 128)) AS piece FROM l) SELECT g AS batch, piece, "
    "array_to_string(list_transform(string_split(substr(x, piece * 128 + 1, 128), ''), lambda c: unicode(c)) || list_transform(range(0, greatest(0, (piece + 1) * 128 - length(x))), lambda i: 0), ' ') AS ids, least(128, length(x) - piece * 128) AS n FROM p"
)
def group_texts(spark, d):
    """Code points as token ids, as models over characters take them, a thousand documents at a time."""
    docs = text_table(spark, d, "documents").filter(F.length("text") > 0).select(F.floor(F.col("doc_id") / 1000).alias("batch"), "doc_id", datasets.code_points(F.col("text")).alias("ids"))
    own = datasets.grouped_ids(docs, "batch", "doc_id", "ids")
    return own.select("batch", F.col("piece").cast("long").alias("piece"), F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n"))


@query(f"WITH {O.DEV_CASES} SELECT x, y, gap_length, corpus_id, file_id FROM dc")
def dev_cases(spark, d):
    ab = table(spark, d, "ab").filter("language = 'grc' and training_text is not null")
    return datasets.dev_cases(ab).withColumn("gap_length", F.col("gap_length").cast("long"))


@query("SELECT corpus_id, count(*) AS n, avg(gap_length) AS mean_gap FROM (SELECT DISTINCT case_id, corpus_id, gap_length FROM dev_case) WHERE gap_length BETWEEN 1 AND 5 GROUP BY corpus_id")
def gap_range(spark, d):
    own = table(spark, d, "dev_case").select("case_id", "corpus_id", "gap_length").distinct().filter(F.col("gap_length").between(1, 5))
    return own.groupBy("corpus_id").agg(F.count("*").alias("n"), F.avg("gap_length").alias("mean_gap"))


@query("SELECT corpus_id, min_by(x, case_id) AS x, to_json(list(split_name ORDER BY case_id))::VARCHAR AS splits FROM (SELECT case_id, min(corpus_id) AS corpus_id, min(x) AS x, min(split_name) AS split_name FROM dev_case GROUP BY case_id) GROUP BY corpus_id")
def grouped_cases(spark, d):
    own = table(spark, d, "dev_case").groupBy("case_id").agg(F.min("corpus_id").alias("corpus_id"), F.min("x").alias("x"), F.min("split_name").alias("split_name"))
    g = corpus.grouped_cases(own, "corpus_id", "case_id", "split_name", "x")
    return g.select("corpus_id", "x", F.to_json(F.transform("test_cases", lambda c: c["test_case"])).alias("splits"))


@query("SELECT l_returnflag, l_linestatus, mode(l_linenumber ORDER BY l_linenumber) AS m FROM lineitem GROUP BY ALL")
def mode_value(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.mode("l_linenumber", True).alias("m"))


LOGITS = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS score, generate_subscripts(embedding, 1) AS token FROM embeddings)"


def logits(spark: SparkSession, d: str) -> DataFrame:
    """Components of the embeddings taken as scores of tokens."""
    own = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "score"))
    return own.select("vec_id", (F.col("token") + 1).cast("long").alias("token"), F.col("score").cast("double").alias("score"))


@query(f"WITH {LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token) AS rank FROM e), x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS w FROM r WHERE rank <= 5) SELECT vec_id, token, rank, round(w / sum(w) OVER (PARTITION BY vec_id), 7) AS probability FROM x")
def softmax_topk(spark, d):
    from pyspark.sql import Window

    ranked = logits(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "token")).cast("long")).filter("rank <= 5")
    return metrics.softmax(ranked, "vec_id").select("vec_id", "token", "rank", F.round("probability", 7).alias("probability"))


@query(f"WITH {LOGITS}, p AS (SELECT *, exp(score) AS x FROM e), q AS (SELECT vec_id, token, x / sum(x) OVER (PARTITION BY vec_id) AS pr FROM p), c AS (SELECT *, sum(pr) OVER (PARTITION BY vec_id ORDER BY pr DESC, token ROWS UNBOUNDED PRECEDING) AS mass, row_number() OVER (PARTITION BY vec_id ORDER BY pr DESC, token) AS r FROM q) SELECT vec_id, count(*) AS n FROM c WHERE mass <= 0.5 OR r = 1 GROUP BY vec_id")
def nucleus_mass(spark, d):
    own = metrics.softmax(logits(spark, d), "vec_id")
    return metrics.nucleus(own, 0.5, "vec_id").groupBy("vec_id").agg(F.count("*").alias("n"))


@query(f"WITH {LOGITS} SELECT vec_id, arg_max(token, score) AS position FROM e GROUP BY vec_id")
def argmax_position(spark, d):
    rows = logits(spark, d).select(F.col("vec_id").alias("case_id"), F.col("token").alias("position"), F.array("score").alias("logp"))
    return infill.best_position(rows).select(F.col("case_id").alias("vec_id"), "position")


@query("SELECT avg(CASE WHEN len(list_filter(embedding, lambda x: x > embedding[label + 1])) < 1 THEN 1.0 ELSE 0 END) AS top_1, avg(CASE WHEN len(list_filter(embedding, lambda x: x > embedding[label + 1])) < 5 THEN 1.0 ELSE 0 END) AS top_5, avg(CASE WHEN len(list_filter(embedding, lambda x: x > embedding[label + 1])) < 10 THEN 1.0 ELSE 0 END) AS top_10 FROM embeddings")
def masked_topk(spark, d):
    return metrics.masked_topk(table(spark, d, "embeddings").select(F.col("embedding").alias("logits"), "label"))


@query("SELECT title, material, language, count(*) AS n FROM ab a WHERE EXISTS (SELECT 1 FROM test_abs t WHERE t.title IS NOT DISTINCT FROM a.title AND t.material IS NOT DISTINCT FROM a.material AND t.language IS NOT DISTINCT FROM a.language) GROUP BY ALL")
def model_duplicate_check(spark, d):
    a, t = table(spark, d, "ab"), table(spark, d, "test_abs").select("title", "material", "language").distinct()
    same = a["title"].eqNullSafe(t["title"]) & a["material"].eqNullSafe(t["material"]) & a["language"].eqNullSafe(t["language"])
    return a.join(t, same, "left_semi").groupBy("title", "material", "language").agg(F.count("*").alias("n"))


@query(
    "WITH ab_ AS (SELECT corpus_id, id, min(training_text) AS t FROM ab WHERE id IS NOT NULL GROUP BY ALL), "
    "j AS (SELECT corpus_id, id, strlen('{' || CASE WHEN corpus_id IS NULL THEN '' ELSE '\"corpus_id\":' || to_json(corpus_id)::VARCHAR || ',' END || '\"id\":' || to_json(id)::VARCHAR || CASE WHEN t IS NULL THEN '' ELSE ',\"training_text\":' || to_json(t)::VARCHAR END || '}') AS n FROM ab_), "
    "l AS (SELECT corpus_id, list(n ORDER BY id) AS ns FROM j GROUP BY corpus_id), "
    "f AS (SELECT corpus_id, list_reduce(list_transform(ns, lambda n: {'u': n::BIGINT, 'k': [1::BIGINT]}), lambda a, b: CASE WHEN a.u + b.u > 104857 THEN {'u': b.u, 'k': a.k || [1::BIGINT]} ELSE {'u': a.u + b.u, 'k': a.k[:-2] || [a.k[-1] + 1]} END).k AS k FROM l) "
    "SELECT corpus_id, unnest(range(0, len(k)))::INTEGER AS file_no, unnest(k) AS n FROM f"
)
def file_numbers(spark, d):
    ab = table(spark, d, "ab").filter("id is not null").groupBy("corpus_id", "id").agg(F.min("training_text").alias("training_text"))
    return corpus.file_numbers(ab, 0.1).groupBy("corpus_id", "file_no").agg(F.count("*").alias("n"))


@query()
def letter_fillings(spark, d):
    """Fillings of the cases' gaps by a model of letters: how often one letter follows another in the training texts."""
    plain = texts(spark, d).select(F.lower(normalize.strip_diacritics(F.col("x"))).alias("x"))
    count = lambda pattern: plain.select(F.explode(F.regexp_extract_all("x", F.lit(pattern), 1)).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    letters = [(r.c, r.n) for r in count(r"(\p{L})").orderBy(F.desc("n"), "c").collect()]
    pairs = {r.c: r.n for r in count(r"(?=(\p{L}\p{L}))").collect()}
    return infill.infill(cases(spark, d).select(F.col("k").alias("case_id"), "text"), _Letters.of(letters, pairs), 5)


class _Letters:
    """A scorer of letters by how often each follows the letter before it, or by how often it occurs where no known letter stands there.

    letters: with their counts; pairs: counts of two letters. A pair counts once more than seen; the mask has a fixed share.
    """

    MASK_SHARE = 0.01

    def __init__(self, letters: list[tuple[str, int]], pairs: dict[str, int]):
        import numpy as np

        self.letters, self.mask_id = [c for c, _ in letters], len(letters)
        self.at = {c: i for i, c in enumerate(self.letters)}
        counts = np.ones((len(letters) + 1, len(letters)))  # the last row: after no letter
        counts[-1] += [n for _, n in letters]
        for (a, b), n in pairs.items():
            counts[self.at[a], self.at[b]] += n
        share = (1 - self.MASK_SHARE) * counts / counts.sum(1, keepdims=True)
        self.rows = np.log(np.hstack([share, np.full((len(share), 1), self.MASK_SHARE)]))

    @classmethod
    def of(cls, letters: list[tuple[str, int]], pairs: dict[str, int]) -> Callable[[], _Letters]:
        return lambda: cls(letters, pairs)

    def score(self, sequences, positions):
        return self.rows[[min(s[p - 1], self.mask_id) if p else self.mask_id for s, p in zip(sequences, positions, strict=True)]]

    def encode(self, text: str, masks: int) -> list[int]:
        import unicodedata

        left = "".join(c for c in unicodedata.normalize("NFD", text.split("[")[0][-8:].lower()) if not unicodedata.combining(c))[-1:]
        return [self.at.get(left, self.mask_id + 1), *[self.mask_id] * masks]

    def decode(self, ids: list[int]) -> str:
        return "".join((*self.letters, "?")[i] for i in ids)
