"""Token counts, splits, containers, mixtures, quality: round trips, brute force and bounds."""

import base64
import os
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import tiktoken
from pyspark.sql import functions as F

from stichos.llm import mixing, packing, quality, quality_rules, splits, tokens
from stichos.llm import textvec as tv

COMMON = "/root/testdata/sf0.001/common_words.parquet"


@pytest.fixture(scope="module")
def merges():
    return tokens.Merges()


def test_tokens_are_the_tokenizers(merges):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(tokens.VOCABULARY, "rb"))}  # noqa: SIM115
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", "Hello, world!  It's 1234 o'clock\n\n ok", "καὶ τὸν λόγον ἀπέδωκεν", "ⲁⲩⲱ ϩⲛ", "a" * 700, "ab" * 300, "̣ ​<gap/>"]
    texts += ["".join(rng.choice("abthe αβγ\n1.") for _ in range(rng.randrange(400))) for _ in range(80)]
    own = tokens.Counter(merges)
    for _ in range(2):
        assert own.count(texts).tolist() == [len(enc.encode_ordinary(t)) for t in texts]
    assert own.count([None]).tolist() == [0]
    pieces = [p for t in texts for p in own.split(t)]
    assert [s.tolist() for s in merges.encode(pieces)] == [enc.encode_ordinary(p) for p in pieces]


def test_token_records(spark):
    ab = spark.createDataFrame([("a", "c", "grc", "λόγος"), ("a", "c", "grc", "λόγος"), ("b", "c", "??", None), (None, "c", "grc", "x")], "id string, corpus_id string, language string, training_text string")
    docs = spark.createDataFrame([(1, "hello world", None, "en", None)], "doc_id long, text string, source string, lang string, domain string")
    corpora = spark.createDataFrame([("c", "literary")], "corpus_id string, domain string")
    codes = spark.createDataFrame([("grc", "grc"), ("en", "en")], "label string, lang_code string")
    r = tokens.records(ab, docs, corpora, codes)
    one, two = tokens.tokenizer().count(["λόγος", "hello world"])
    assert sorted(tuple(x) for x in r.collect()) == [("ab", "a", "c", "grc", "literary", 5, one, 2), ("ab", "b", "c", "und", "literary", 0, 0, 1), ("documents", "1", "", "en", "", 11, two, 1)]
    whole = tokens.totals(r).filter("source is null and lang_code is null and domain is null").collect()
    assert {(x.table_name, x.n_texts) for x in whole} == {("ab", 2), ("documents", 1)}


def test_file_keys(spark):
    romans = {"c": 100, "CXX": 120, "mmxxiv": 2024, "xlix": 49, "iiii": None, "vx": None}
    names = spark.createDataFrame([(f"p.x.{r}.7",) for r in romans], "f string")
    assert [r[0] for r in names.select(splits.file_key(F.col("f"))).collect()] == [f"p.x.{n or r.lower()}.7" for r, n in romans.items()]
    same = ["p.lysa.5.94", "P.LYSA.5.94", "p.lysa.5.94.xml", "p.lysa.V.94", "p.lysa;5;94", "p.lysa_5_94", "P.Lysa 5 94", "p.lysa.5.00094", " p.lysa.5.94 "]
    other = ["p.lysa.5.94b", "p.lysa.6.94", "o.lysa.5.94", "bkp.5.94", "x", "", " ", None]
    df = spark.createDataFrame([(s,) for s in same + other], "f string")
    keys = [r[0] for r in df.select(splits.file_key(F.col("f"))).collect()]
    assert set(keys[: len(same)]) == {"p.lysa.5.94"}
    assert keys[len(same) :] == ["p.lysa.5.94b", "p.lysa.6.94", "o.lysa.5.94", "bkp.5.94", "x", None, None, None]


def tables(spark):
    ab = spark.createDataFrame([("A", f"A/p.x.1.{i}/{k}") for i in range(60) for k in range(i % 4 + 1)] + [("B", "B/P.X.1.7/1"), ("B", "B/P.X.1.7/1"), ("A", None)], "corpus_id string, id string")
    dev = spark.createDataFrame([(i, "B", f"p.x.I.{i % 30}", "x") for i in range(50)] + [(90, "B", None, "x"), (91, "B", "", "x"), (91, "B", "", "x"), (None, "B", "p.x.1.1", "x")], "case_id long, corpus_id string, file_id string, key string")
    links = spark.createDataFrame([("p.x.1.1", "P.X 1 2", "joins"), ("z.z.1.1", "p.x.1.2", "reprint-of"), ("z.z.1.1", "p.x.1.3", "duplicate-of"), ("p.x.1.4", "p.x.1.5", "cf"), (None, "p.x.1.5", "joins"), ("p.x.1.6", "p.x.1.6", "joins")], "from_file string, to_file string, link_type string")
    return ab, dev, links


def test_groups(spark):
    ab, dev, links = tables(spark)
    classes = splits.classes(splits.grouped(splits.file_names(ab, dev), "file", links))
    by = {r.file: (r.component, r.n_files) for r in classes.collect()}
    assert by["p.x.1.1"][0] == by["p.x.1.3"][0]
    assert by["P.X.1.7"] == ("p.x.1.7", 3)
    found = {tuple(r) for r in splits.found(classes).collect()}
    assert ("p.x.1.1", "p.x.1.3") in found
    assert ("P.X.1.7", "p.x.1.7") in found
    assert ("p.x.1.4", "p.x.1.5") not in found
    assert not any(x.startswith("z") for pair in found for x in pair)
    assert all(a < b for a, b in found)


def test_splits_keep_groups(spark):
    ab, dev, links = tables(spark)
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    rows = splits.assign(splits.records(ab, dev, links), shares).collect()
    assert len(rows) == 60 // 4 * 10 + 1 + 52
    by = defaultdict(set)
    for r in rows:
        by[r.component].add(r.split_name)
    assert all(len(s) == 1 for s in by.values())
    for kind in ("ab", "dev_case"):
        own = [r.split_name for r in rows if r.kind == kind]
        assert own.count("train") / len(own) == pytest.approx(0.8, abs=0.03)
    assert splits.assign(splits.records(ab.limit(0), dev.limit(0), links), shares).collect() == []
    with pytest.raises(ValueError, match="share"):
        splits.assign(splits.records(ab, dev, links), shares.limit(0))


def test_place():
    rng = np.random.default_rng(4)
    kinds = {}
    for _ in range(300):
        kind = tuple((f"l{i}", int(n)) for i, n in enumerate(rng.integers(0, 5, 6)) if n)
        if kind:
            kinds[kind] = kinds.get(kind, 0) + int(rng.integers(1, 40))
    kinds[(("l0", 500), ("l1", 90))] = 1  # a hot group
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = splits.place(kinds, shares)
    assert {k: sum(v.values()) for k, v in got.items()} == kinds
    assert min(n for v in got.values() for n in v.values()) > 0
    total, own = defaultdict(int), defaultdict(int)
    for kind, by in got.items():
        for label, n in kind:
            total[label] += n * kinds[kind]
            for s, k in by.items():
                own[s, label] += n * k
    for s, share in shares.items():
        for label, n in total.items():
            assert own[s, label] / n == pytest.approx(share, abs=0.005)
    assert splits.place({}, shares) == {}
    # as many at once as one by one
    for n in (1, 5, 100, 1001):
        need, room = rng.random(3) * 300, rng.random(3)
        one, given = need.copy(), np.zeros(3, int)
        for _ in range(n):
            k = int(one.argmax())
            one[k] -= 2.5
            given[k] += 1
        assert splits._filled(need, room, 2.5, n).tolist() == given.tolist()


def test_hilbert_is_a_curve():
    n = 8
    grid = np.array([(x, y) for x in range(n) for y in range(n)], np.uint32)
    order = grid[np.argsort(packing.hilbert(grid, 3))].astype(int)
    assert sorted(packing.hilbert(grid, 3).tolist()) == list(range(n * n))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 5, 30, 60, 99, 100, 101, 250, 1000]), rng.randrange(1 << 20)) for i in range(800)]
    sized = spark.createDataFrame(rows, "doc_id long, n_tokens long, place long")
    sizes = spark.createDataFrame([("a", 100), ("b", 256), ("none", 0), (None, 5)], "pack_name string, capacity_tokens int")
    got = packing.packed(sized, sizes).collect()
    for name, capacity in (("a", 100), ("b", 256)):
        pieces, used, free = defaultdict(list), defaultdict(int), {}
        for r in got:
            if r.pack_name == name:
                pieces[r.doc_id].append((r.first_token, r.n_tokens))
                used[r.container_id] += r.n_tokens
                free[r.container_id] = r.unused
        assert all(used[c] + free[c] == capacity for c in used)
        for i, n, _ in rows:
            own = sorted(pieces[i])
            assert [a for a, _ in own] == list(range(0, n, capacity)) if n > capacity else own == [(0, n)]
            assert sum(k for _, k in own) == n
        bins: list[int] = []
        for n in sorted((n % capacity for _, n, _ in rows if n % capacity), reverse=True):
            k = next((k for k, room in enumerate(bins) if room >= n), None)
            if k is None:
                bins.append(capacity)
                k = len(bins) - 1
            bins[k] -= n
        assert len(used) <= 1.03 * len(bins) + sum(n // capacity for _, n, _ in rows) + 2
    assert {r.pack_name for r in got} == {"a", "b"}
    assert packing.packed(sized.limit(0), sizes).collect() == []
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.n_tokens) for r in packing.sized(docs).collect()] == [(1, tokens.tokenizer().count(["hello world"])[0])]


def test_quotas():
    q = mixing.quotas({"a": 100, "b": 1000, "c": 10}, {"a": (0.5, 2), "b": (0.3, 1), "c": (0.1, 4), "d": (0.1, 3)}, 500)
    assert q == {"a": 200, "b": 260, "c": 40, "d": 0}
    assert mixing.quotas({}, {"a": (1.0, 1)}) == {"a": 0}


def test_split_tree():
    counts = np.array([1000, 37, 3])
    parts = list(mixing.split_tree(counts, 7, np.random.default_rng(0)))
    assert (sum(parts) == counts).all()
    assert max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 3


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randrange(1, 400)) for i, s in enumerate(["big"] * 1500 + ["small"] * 100 + ["off"] * 50)] + [(9999, "big", 0), (9998, None, 5)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mixture(sized, targets).collect()
    assert len({(r.doc_id, r.repeat_no) for r in got}) == len(got)
    assert {r.source for r in got} == {"big", "small"}
    assert max(r.repeat_no for r in got if r.source == "small") <= 3
    assert max(r.repeat_no for r in got if r.source == "big") == 1
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by.values())
    tokens_ = {s: sum(n for _, x, n in rows if x == s) for s in ("big", "small")}
    quota = mixing.quotas(tokens_, mixing.targets_of(targets))
    for s in ("big", "small"):
        assert sum(r.n_tokens for r in got if r.source == s) == pytest.approx(quota[s], abs=400)
    shares = {r.source: r for r in mixing.shares(mixing.mixture(sized, targets), sized, targets).collect()}
    assert shares["absent"].actual_share == 0
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    assert mixing.mixture(sized.limit(0), targets).collect() == []


PROSE = "Der Schreiber hat das Getreide in das Dorf gebracht und die Urkunde für den Priester gesiegelt, weil es so im Vertrag steht."

MORE = "Im Herbst hat die Witwe das Feld von dem Bruder zu dem alten Preis in Pacht für ein Jahr."


def test_quality(spark):
    common = spark.createDataFrame([("de", w) for w in "der die und das in den von zu für es so hat im".split()], "lang_code string, word string")
    table = "\n".join(f"| Boot | {i} | - |" for i in range(12))
    rows = [
        (1, f"{PROSE} {MORE}"),
        (2, PROSE.replace(" ", "\n", 4)),
        (3, PROSE.upper()),
        (4, table),
        (5, "\n".join(f"{i}. Boot Dorf" for i in range(1, 15))),
        (6, "Boot hat\n" * 30),
        (7, f"{PROSE}\n{PROSE}\n| a | 1 |"),
        (8, f"{PROSE}\n{table}\n{table}"),
        (9, "tgkU7mc2Zp0aQ8xLwE5r1YvB3nHs9DfJ6iOoKq4GlRtX" * 5),
        (10, None),
        (11, " \n\t"),
        (12, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    d = quality.described(docs, common)
    judged = quality.judged(d, quality.fitted(d, common))
    assert sorted(r.doc_id for r in d.filter("weak_label = 1").collect()) == [4, 5, 6, 8, 9]
    assert not {1, 2, 3, 7} & {r.doc_id for r in quality.found(judged).collect()}
    assert d.count() == 9
    assert quality.described(docs.limit(0), common).collect() == []
    assert quality.found(quality.judged(quality.described(docs.limit(0), common), quality.fitted(d, common))).collect() == []
    assert quality.described(docs, common, sample=0).filter("weak_label is not null").count() == 0
    one = {r.doc_id: r for r in d.collect()}[1]
    assert one.n_words == 41
    assert one.line_end_share == 1


def test_end_of_a_run_is_judged():
    prose = [f"w{i}" if i % 3 else "the" for i in range(24)]
    junk = [f"x{i}" for i in range(47)]
    assert quality_rules.unlike(prose + junk, 5, False, {"the"}) == (pytest.approx(47 / 71), 0.0)
    assert quality_rules.unlike(prose + prose[:12], 5, False, {"the"}) == (0.0, 0.0)


def test_statistics_do_not_depend_on_neighbours():
    common = np.unique(tv.words(["the", "of", "and"]).hash)
    texts = [PROSE, "the of\n\n| a | 12 |\n| b | - |", "a", "…", "1. x\n2. y\n2. y\n2. y", "the " * 60, f"{PROSE} {MORE}\n" * 3, "ſﬁ½ ß"]
    together = quality.statistics_of(texts, common)
    assert together.shape == (len(texts), len(quality.FEATURES))
    assert np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert together[i].tolist() == pytest.approx(quality.statistics_of([t], common)[0].tolist())
    of = dict(zip(quality.FEATURES, together.T.tolist(), strict=True))
    assert of["n_words"][:3] == [len(PROSE.split()), 5, 1]
    assert of["n_lines"][1] == 3
    assert of["bar_lines"][1] == pytest.approx(11 / 16)
    assert of["opener_lines"][4] == 1
    assert of["repeated_lines"][4] == pytest.approx(9 / 12)
    assert of["dull_share"][5] == 0
    assert of["common_share"][5] == 1
    assert quality.statistics_of([], common).shape == (0, len(quality.FEATURES))


def test_holdout_and_trees():
    common = pd.read_parquet(COMMON).word.dropna() if os.path.exists(COMMON) else pd.Series(["και", "et", "the", "und"])
    x, y, rows = quality.holdout(np.unique(tv.words(sorted(set(common))).hash))
    assert len(x) >= 200
    assert len({r["doc_id"] for r in rows}) == len(rows)
    rng = np.random.default_rng(0)
    part = rng.permutation(len(x))
    train, test = part[: len(x) // 2], part[len(x) // 2 :]
    trees = quality.Trees(rounds=30).fit(x[train], y[train])
    assert ((trees.score(x[test]) > 0) == y[test]).mean() > 0.9
    # no input says by itself what is junk
    best = max(max(((x[:, j] > c) == y).mean(), ((x[:, j] <= c) == y).mean()) for j in range(x.shape[1]) for c in np.unique(x[:, j]))
    assert best < 0.97
    a, b = quality.calibrated(trees.score(x[test]), y[test])
    assert a > 0
    grid = rng.random((2000, 3))
    want = ((grid[:, 0] > 0.5) ^ (grid[:, 1] > 0.3)).astype(float)
    fitted = quality.Trees().fit(grid[:1000], want[:1000])
    assert ((fitted.score(grid[1000:]) > 0) == want[1000:]).mean() > 0.95
