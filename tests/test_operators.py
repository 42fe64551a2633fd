"""Language models, candidates, metrics, splits, data sets: small cases worked by hand or by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stichos.operators import candidates as C
from stichos.operators import components, datasets, evaluation, infill, metrics, ngram, splits
from stichos.plans import catalogue

SENTENCES = [["A", "B", "A"], ["A", "C"], ["B"]]


@pytest.fixture(scope="module")
def sentences(spark):
    return spark.createDataFrame([(s,) for s in SENTENCES], "tokens array<string>").cache()


def by_hand(n):
    out = {}
    for s in SENTENCES:
        p = ["<s>"] * (n - 1) + s + ["</s>"] * (n - 1)
        for k in range(1, n + 1):
            for i in range(len(p) - k + 1):
                key = (k, "\x01".join(p[i : i + k - 1]), p[i + k - 1])
                out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("n", [2, 3])
def test_counts(sentences, n):
    got = {(r.order, r.ctx, r.word): r.cnt for r in ngram.train(sentences, n).collect()}
    assert got == by_hand(n)


def test_counts_of_nothing(spark):
    none = spark.createDataFrame([], "tokens array<string>")
    assert ngram.train(none).collect() == []
    nulls = spark.createDataFrame([(None,), ([],)], "tokens array<string>")
    assert {(r.order, r.ctx, r.word): r.cnt for r in ngram.train(nulls, 2).collect()} == {(1, "", "<s>"): 1, (1, "", "</s>"): 1, (2, "<s>", "</s>"): 1}


def test_rare_words_are_unknown(sentences):
    got = {(r.order, r.ctx, r.word): r.cnt for r in ngram.train(sentences, 2, min_freq=2).collect()}
    assert got[(2, "A", "<UNK>")] == 1
    assert not any(w == "C" for _, _, w in got)


def test_probabilities(spark, sentences):
    model = ngram.train(sentences, 2)
    v = len({w for k, _, w in by_hand(2) if k == 1}) + 1
    asked = spark.createDataFrame([(2, "A", "B"), (2, "A", "X"), (2, "X", "B"), (2, "<s>", "A")], "order int, ctx string, word string")
    mle = {(r.ctx, r.word): r.p for r in ngram.scored(asked, model, "p", "MLE").collect()}
    assert mle == {("A", "B"): 1 / 3, ("A", "X"): 0.0, ("X", "B"): 0.0, ("<s>", "A"): 2 / 3}
    lid = {(r.ctx, r.word): r.p for r in ngram.scored(asked, model, "p", "LIDSTONE", 0.1).collect()}
    assert lid[("A", "B")] == pytest.approx(1.1 / (3 + 0.1 * v))
    assert lid[("X", "B")] == pytest.approx(1 / v)


def test_entropy_and_loss(spark, sentences):
    model = ngram.train(sentences, 2)
    rows = ngram.ngram_rows(sentences.withColumn("s", F.monotonically_increasing_id()), 2, orders=[2], keep=("s",))
    scored = ngram.interpolated(rows, model, model, 0.2, "MLE")
    r = ngram.entropy(scored).first()
    want = [math.log2(by_hand(2)[(2, c, w)] / sum(n for (k, cc, _), n in by_hand(2).items() if k == 2 and cc == c)) for s in SENTENCES for c, w in zip(["<s>", *s], [*s, "</s>"], strict=True)]
    assert r.entropy == pytest.approx(-sum(want) / len(want))
    assert r.perplexity == pytest.approx(2 ** r.entropy)
    impossible = ngram.interpolated(spark.createDataFrame([(1, 2, "A", "X")], "s int, order int, ctx string, word string"), model, model, 0.2, "MLE")
    assert ngram.sequence_loss(impossible, "s", "MLE").first().nll == 10000.0
    assert ngram.entropy(scored.limit(0)).first().entropy is None


def test_backoff_and_ranking(spark):
    counts = [(3, "x\x01y", "AB", 2), (3, "x\x01y", "CD", 1), (3, "x\x01y", "<UNK>", 9), (2, "y", "EF", 5), (2, "y", "AB", 7), (2, "y", "ABCD", 1)]
    counts = spark.createDataFrame(counts, "order int, ctx string, word string, cnt long")
    cases = spark.createDataFrame([(1, ["w", "x", "y"], "A", "", 1)], "case_id int, context array<string>, head string, tail string, gap_len int")
    assert sorted((r.word, r.order) for r in C.successors(cases, counts, 2).collect()) == [("AB", 3), ("CD", 3)]
    found = C.successors(cases, counts, 3)
    assert sorted((r.word, r.order) for r in found.collect()) == [("AB", 3), ("ABCD", 2), ("CD", 3), ("EF", 2)]
    assert [r.word for r in C.ranked(found).orderBy("place").collect()] == ["AB", "ABCD", "CD", "EF"]
    assert [(r.word, r.score) for r in C.beam(C.scores(found), 3).orderBy("rank").collect()] == [("AB", 0.0), ("CD", 1.0), ("EF", 1.0)]
    assert [C.beam_size(k) for k in (1, 10, 50)] == [10, 40, 100]


def test_unknown_context_words(spark):
    schema = "order int, ctx string, word string, cnt long"
    general = spark.createDataFrame([(1, "", "X", 1), (1, "", "Y", 1), (1, "", "AB", 1), (3, "X\x01Y", "AB", 2), (2, "Y", "AB", 2)], schema)
    domain = spark.createDataFrame([(1, "", "Y", 1), (1, "", "<UNK>", 1), (3, "<UNK>\x01Y", "AB", 5), (3, "<UNK>\x01Y", "CD", 1), (2, "<UNK>", "EF", 4)], schema)
    cases = spark.createDataFrame([(1, ["X", "Y"], "", "", 2), (2, ["Q", "Z"], "", "", 2)], "case_id int, context array<string>, head string, tail string, gap_len int")
    found = C.successors(cases, C.known_counts(cases, general, domain), 10)
    assert sorted((r.case_id, r.word, r.cnt, r.order) for r in found.collect()) == [(1, "AB", 7, 3), (1, "CD", 1, 3), (2, "EF", 4, 2)]
    assert sorted((r.case_id, r.word) for r in C.predictions(cases, general, domain, 5).collect()) == [(1, "AB"), (1, "CD"), (2, "EF")]


def test_metrics(spark):
    p = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d e")], "case_id int, rank int, word string")
    g = spark.createDataFrame([(1, "b"), (2, "x"), (3, "DE"), (4, "y")], "case_id int, word string")
    assert tuple(metrics.topk_accuracy(p, g, 2).first()) == (1, 4, 0.25)
    assert metrics.topk_accuracy(p, g.limit(0), 2).first().accuracy is None
    assert tuple(metrics.text_topk(p, g, (1, 2)).first()) == (25.0, 50.0)
    t = spark.createDataFrame([(["a", "b", "c"], ["a", "a", "b"]), (["a"], []), (["a", "b", "c", "d"], ["a", "b"])], "r array<string>, h array<string>")
    assert [round(r[0], 6) for r in t.select(metrics.bleu1(F.col("r"), F.col("h"))).collect()] == [round(2 / 3, 6), 0.0, round(math.exp(-1), 6)]
    s = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0), (1, "X", 0.5)], "case_id int, word string, score double")
    kept = metrics.softmax(metrics.keep_best(s, F.lower("word"), 5)).orderBy("rank").collect()
    assert [r.word for r in kept] == ["x", "y"]
    assert kept[0].probability == pytest.approx(1 / (1 + math.exp(-1)))
    n = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.3), (1, "c", 0.1)], "case_id int, token string, probability double")
    assert [r.token for r in metrics.nucleus(n, 0.5).collect()] == ["a"]


def test_gold_word_far_down_in_the_beam(spark, monkeypatch):
    counts = spark.createDataFrame([(3, "x\x01y", chr(65 + i) * 3, 1) for i in range(20)], "order int, ctx string, word string, cnt long")
    cases = spark.createDataFrame([(1, ["x", "y"], "", "", 3), (2, ["x", "y"], "", "", 3)], "case_id int, context array<string>, head string, tail string, gap_len int")
    own = spark.createDataFrame([(1, "OOO"), (2, "ZZZ")], "case_id int, word string")
    monkeypatch.setattr(catalogue, "requested", lambda spark, d, answer: C.beam(C.scores(C.successors(cases, counts, catalogue.BOUNDARY)), catalogue.BOUNDARY))
    monkeypatch.setattr(catalogue, "predicted", lambda spark, d: C.beam(C.scores(C.successors(cases, counts, catalogue.BOUNDARY)), 10))
    monkeypatch.setattr(catalogue, "gold", lambda spark, d: own)
    assert tuple(catalogue.QUERIES["topk_accuracy"](spark, "").first()) == (0, 2, 0.0)
    assert tuple(catalogue.QUERIES["hit_in_beam"](spark, "").first()) == (1, 2, 0.5)


def test_splits(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert splits.budget_sample(df, "k", 12.3).count() == 123
    train, test = splits.split(df, "k", 0.0501)
    assert test.count() == 51
    assert train.count() == 949
    want = sorted(range(1000), key=lambda k: (((k + 42) * 2654435761) % 2**32, k))[:51]
    assert sorted(r.k for r in test.collect()) == sorted(want)
    assert splits.budget_sample(df.limit(0), "k", 50).count() == 0


def test_datasets(spark):
    t = spark.createDataFrame([(list("abcdefg"),), ([],)], "t array<string>")
    assert [r[0] for r in t.select(datasets.chunks(F.col("t"), 3)).collect()] == [[list("abc"), list("def")], []]
    s = spark.createDataFrame([(1, 1, "a b"), (1, 2, "c"), (1, 3, "d e f g h"), (1, 4, "i")], "k int, o int, t string")
    assert [r.text for r in datasets.packed(s, "k", "o", "t", str.split, 4).orderBy("chunk_no").collect()] == ["a b c", "d e f g", "i"]
    ids = spark.createDataFrame([(0, 2, [4]), (0, 1, [1, 2, 3]), (1, 1, None), (1, 2, []), (2, 1, [7, 8, 9])], "b int, o int, i array<int>").repartition(3)
    got = datasets.grouped_ids(ids, "b", "o", "i", 3).orderBy("b", "piece").collect()
    assert [(r.b, r.piece, r.input_ids, r.attention_mask) for r in got] == [(0, 0, [1, 2, 3], [1, 1, 1]), (0, 1, [4, 0, 0], [1, 0, 0]), (2, 0, [7, 8, 9], [1, 1, 1])]
    points = spark.createDataFrame([("aὕ\U0001f600",), ("",)], "t string")
    assert [r[0] for r in points.select(datasets.code_points(F.col("t"))).collect()] == [[97, 0x1F55, 0x1F600], []]
    long_ = spark.createDataFrame([(1, 1, "abcdef"), (1, 2, "gh"), (1, 3, "i")], "k int, o int, t string")
    assert [r.text for r in datasets.packed(long_, "k", "o", "t", list, 4, "".join).orderBy("chunk_no").collect()] == ["abcd", "gh i"]


class Words:
    """A tokenizer of words, for tests."""

    unk_token = "[UNK]"

    def tokenize(self, text):
        return text.split()

    def encode(self, text, most):
        return [len(w) for w in text.split()][:most]


def test_prepared(spark):
    rows = [("Ὁ λόγος " * 6,), ("λόγος " * 5,), (None,), ("",), ("<UNK> " + "α " * 10,), ("<UNK> <UNK> " + "α " * 10,)]
    texts = spark.createDataFrame(rows, "text string").withColumn("t", F.lit("clash"))
    got = sorted(tuple(map(tuple, r)) for r in datasets.prepared(texts, "Logion", Words, most=11).collect())
    assert got == [((1, 5) * 5 + (1,), (1,) * 11), ((5,) + (1,) * 10, (1,) * 11)]
    assert datasets.prepared(texts.limit(0), "GreBerta", Words).collect() == []
    with pytest.raises(ValueError, match="checkpoint"):
        datasets.prepared(texts, "other", Words)


def test_id_topk(spark):
    gold = spark.createDataFrame([(1, [5, 6]), (2, [7]), (3, [0, 7]), (4, [9])], "case_id int, ids array<int>")
    found = spark.createDataFrame([(1, 0.1, [5, 6]), (1, 0.9, [5]), (2, 0.5, [7]), (2, 0.4, [7]), (3, 0.9, [0, 7])], "case_id int, score double, ids array<int>")
    assert tuple(round(x, 3) for x in metrics.id_topk(found, gold, 0).first()) == (33.333, 66.667, 66.667, 66.667)
    assert tuple(metrics.id_topk(found, gold.limit(0), 0).first()) == (0.0,) * 4
    words = spark.createDataFrame([("ab",), ("cd",), ("x",), (None,)], "t string")
    assert words.agg(metrics.mode_length(F.col("t"))).first()[0] == 2


def test_check_supplement(spark):
    rows = [(["A"],), ([],), ([""],), (["A", "B"],), (["<UNK>"],), (None,)]
    df = spark.createDataFrame(rows, "t array<string>")
    assert [r[0] for r in df.select(C.check_supplement(F.col("t"))).collect()] == [True, False, False, False, False, False]


def test_word_sequences(spark):
    rows = [(2, "x", "a", 3), (2, "x", "b", 1), (2, "a", "c", 1), (2, "b", "d", 4), (2, "c", "</s>", 1), (3, "x\x01a", "e", 1), (3, "x\x01a", "f", 3), (1, "", "a", 9)]
    model = spark.createDataFrame(rows, "order int, ctx string, word string, cnt long")
    cases = spark.createDataFrame([(1, ["x"]), (2, ["nichts"])], "case_id int, context array<string>")
    got = C.word_sequences(cases, model, 2, 10).orderBy("rank").collect()
    assert [(r.case_id, r.words, round(2**-r.nll, 6)) for r in got] == [(1, ["a", "f"], 0.5625), (1, ["b", "d"], 0.25), (1, ["a", "e"], 0.1875)]
    assert [r.words for r in C.word_sequences(cases, model, 2, 1).collect()] == [["a", "f"]]
    assert C.word_sequences(cases.limit(0), model, 2, 5).collect() == []


def test_hot_contexts_are_divided(spark, monkeypatch):
    counts = spark.createDataFrame([(3, "x\x01y", f"w{i}", i + 1) for i in range(50)] + [(2, "y", f"v{i}", 1) for i in range(5)], "order int, ctx string, word string, cnt long")
    cases = spark.createDataFrame([(i, ["x", "y"]) for i in range(30)] + [(99, ["z", "y"])], "case_id int, context array<string>")
    want = sorted(map(str, C.successors(cases, counts, 10).collect()))
    monkeypatch.setattr(C, "HOT", 100)
    assert sorted(map(str, C.successors(cases, counts, 10).collect())) == want
    assert len(want) == 30 * 50 + 5


def test_scored_meets_the_slow_way(spark):
    m = ngram.train(spark.createDataFrame([("a b a c".split(),), ("b a".split(),)], "tokens array<string>"), 2)
    asked = spark.createDataFrame([(2, "a", "b"), (2, "a", "zz"), (2, "zz", "a"), (2, "b", "c"), (1, "", "a"), (1, "", "zz")], "order int, ctx string, word string")
    v = m.filter("order = 1").count() + 1
    counts = {(r.order, r.ctx, r.word): r.cnt for r in m.collect()}
    total = {}
    for (o, c, _), n in counts.items():
        total[o, c] = total.get((o, c), 0) + n
    known = lambda x: x if x == "" or (1, "", x) in counts else "<UNK>"
    for r in ngram.scored(asked, m, "p", "LIDSTONE", 0.1).collect():
        key = (r.order, known(r.ctx), known(r.word))
        assert r.p == pytest.approx((counts.get(key, 0) + 0.1) / (total.get(key[:2], 0) + v * 0.1))
    assert ngram.scored(asked, m, "p", "MLE").count() == 6
    with pytest.raises(ValueError, match="n must be"):
        ngram.train(spark.createDataFrame([(["a"],)], "tokens array<string>"), 5)
    b = spark.createDataFrame([("c", "f", "τὸν [πωλοῦ]ντα λόγον [καὶ τὸν] ἄλλον <gap/>[ο]υ")], "corpus_id string, file_id string, training_text string")
    got = [tuple(r) for r in datasets.dev_cases(b).collect()]
    assert ("τὸν [.....]ντα λόγον καὶ τὸν ἄλλον <UNK>", "πωλοῦ", 5, "c", "f") in [(r[0].replace("<UNK>υ", "<UNK>"), *r[1:]) for r in got]
    crop = spark.createDataFrame([("a b c[..]d e f",), ("no gap",)], "t string")
    assert [r[0] for r in crop.select(datasets.cropped(F.col("t"), 1)).collect()] == ["b c[..]d e", "no gap"]


def test_dev_cases_of_any_length(spark, tmp_path):
    rows = [("c", "f", "grc", "τὸν [πωλοῦντα] λόγον [στρατηγοῦντος] ἄλλον")]
    spark.createDataFrame(rows, "corpus_id string, file_id string, language string, training_text string").write.parquet(str(tmp_path / "ab.parquet"))
    got = catalogue.QUERIES["dev_cases"](spark, str(tmp_path)).collect()
    assert sorted((r.y, r.gap_length) for r in got) == [("πωλοῦντα", 8), ("στρατηγοῦντος", 13)]


class Toy:
    """A model of four tokens and a mask: each token likes certain followers."""

    mask_id = 4
    table = np.log(np.array([[0.1, 0.6, 0.2, 0.05, 0.05], [0.5, 0.1, 0.1, 0.25, 0.05], [0.3, 0.3, 0.2, 0.1, 0.1], [0.25, 0.25, 0.2, 0.2, 0.1], [0.2, 0.3, 0.3, 0.1, 0.1]]))

    def score(self, sequences, positions):
        return np.array([self.table[s[p - 1]] for s, p in zip(sequences, positions, strict=True)])

    def encode(self, text, masks):
        return [0, *[self.mask_id] * masks, 1]

    def decode(self, ids):
        return "".join("αβγδ?"[i] for i in ids)


def test_wide_beam_is_exhaustive():
    toy = Toy()
    got = infill.decode([0, 4, 4, 1], toy, beam=25, modified=False, best_first=False)
    want = sorted((([a, b], toy.table[0][a] + toy.table[a][b]) for a in range(5) for b in range(5)), key=lambda x: (-x[1], x[0]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_pivot_and_sampling():
    toy = Toy()
    (tokens, score), *_ = infill.decode([0, 4, 1], toy, beam=3)
    assert tokens == [1]
    assert score == pytest.approx(toy.table[0][1] - toy.table[0][4])
    drawn = infill.sample([0, 4, 4], toy, 4, nucleus=0.9)
    assert len({t[0][0] for t in drawn}) == len(drawn)
    assert infill.sample([0, 4, 4], toy, 4) == infill.sample([0, 4, 4], toy, 4)
    assert infill.mask_tokens([5, 6, 7], [1], 4) == ([5, 4, 7], [6])


def test_letters_follow_letters(spark, tmp_path):
    rows = [("a/b/1", "grc", "εεε εεε κακακα", [("a/b/1/1", "κ[.]")])]
    spark.createDataFrame(rows, "id string, language string, training_text string, test_cases array<struct<id: string, test_case: string>>").write.parquet(str(tmp_path / "ab.parquet"))
    got = catalogue.QUERIES["letter_fillings"](spark, str(tmp_path)).orderBy("rank").collect()
    assert got[0].token_str == "ακ"


def test_infill(spark):
    cases = spark.createDataFrame([(1, "α [...] β"), (2, "nichts"), (3, None)], "case_id int, text string")
    got = infill.infill(cases, Toy, k=5).orderBy("rank").collect()
    assert {r.case_id for r in got} == {1}
    assert len(got) == 5
    assert sum(r.probability for r in got) == pytest.approx(1)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (45, 2)).tolist()] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(None, "x"), ("y", None), ("z", "z")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "αβ γδ [.] αβ"), (2, "nichts")], "case_id int, text string")
    gold = spark.createDataFrame([(1, "β"), (2, "x")], "case_id int, word string")
    rows = {r.window: r.top_10 for r in evaluation.ablation(cases, gold, Toy, (-1, 1)).collect()}
    assert rows == {-1: 50.0, 1: 50.0}
    pairs = spark.createDataFrame([(1, "ab", "ab"), (1, "x", "ab"), (2, "a", "b"), (3, None, "b")], "case_id int, word string, gold string")
    scored = evaluation.similarity(pairs, lambda: lambda a, b: np.array([float(x == y) for x, y in zip(a, b, strict=True)]))
    assert evaluation.mean_best_similarity(scored).first()[0] == 0.5
    best = evaluation.search(lambda x, y: -((x - 0.3) ** 2) - (y - 2) ** 2, {"x": (0, 1), "y": (0, 4)}, rounds=40)[0]
    assert best[0] > -0.05


def test_works_without_the_training_data_folder():
    import subprocess
    import sys

    code = "import sys; sys.modules['stichos.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'transpile' in q and not any(n[:2] == 'p1' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
