"""Words, consistent form, languages, leaks, overlaps: held against plain versions of themselves."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stichos.llm import consistent, contamination, language, overlap
from stichos.llm import textvec as tv


def words(text):
    w = tv.words([text])
    return [(w.text(i), bool(w.ok[i])) for i in range(len(w.row))]


def test_words():
    got = words("Σι[γ]η κα-\nὶ πρ̣ὸς .... ὡς... τῷ <gap/> λόγον.")
    assert [w for w, ok in got if ok] == ["σιγη", "και", "προσ", "τω", "λογον"]
    assert [ok for _, ok in got] == [True, True, True, False, False, True, False, True]
    assert words("a\U000e0041b x\ufe0fy \U0002f800")[:2] == [("ab", True), ("xy", True)]
    assert [w for w, _ in words("Straße vac. кαταφέρωv ὕδατóυ ﬁn ｆｏ")] == ["strasse", "καταφερων", "υδατου", "fin", "fo"]
    assert words("[....] κ[..] x") [0][1] is False
    assert [ok for _, ok in words("[....] κ[..] x")] == [False, False, True]
    assert words("") == []
    assert words("…, !") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aβ. -\n<gap/>[](){}vc.ßά̣́​\x1e", max_size=30), max_size=6))
def test_words_do_not_depend_on_neighbours(texts):
    together = tv.words(texts)
    for i, t in enumerate(texts):
        alone = tv.words([t])
        part = slice(together.first[i], together.first[i + 1])
        assert together.hash[part].tolist() == alone.hash.tolist()
        assert together.ok[part].tolist() == alone.ok.tolist()


def test_windows():
    w = tv.words(["a b c d", "a b", "b c d . a .. b c d"])
    at, h = tv.windows(w, 3)
    assert [(int(w.row[i]), w.text(i)) for i in at] == [(0, "a"), (0, "b"), (2, "b"), (2, "c"), (2, "b")]
    assert h[1] == h[2] == h[4]


REWRITER = consistent.Rewriter()


@pytest.mark.parametrize(
    ("old", "new"),
    [
        ("кαταφέρωv", "καταφέρων"),
        ("ὕδατóυ", "ὕδατόυ"),
        ("µέτρον", "μέτρον"),
        ("λóγος", "λόγος"),
        ("ⲭⲉⲓⲡ<gap/> ⲇⲉсⲉιⲛ", "ⲭⲉⲓⲡ<gap/> ⲇⲉⲥⲉⲓⲛ"),
        ("ｆｏ，ﬁn", "fo,fin"),
        ("a b​c­\r\nd e", "a bc\nd\ne"),
        ("κά̣", "κά̣"),
        ("ạ", "ạ"),
        ("ΩΩ", "ΩΩ"),
        ("[ὕ]δωρ (vac.) λόγ(ος) TON ϲῆμα l’été", "[ὕ]δωρ (vac.) λόγ(ος) TON ϲῆμα l’été"),
        ("", ""),
        ("a\U000e0041b\U000e0100", "ab"),
        ("x\ufe0fy\u180bz", "xyz"),
        ("\u1112\u1161\u11ab \u1100\u1161", "\ud55c \uac00"),
        ("\U0002f800", "\u4e3d"),
        ("ոo Ꭺbc ꓮbc", "no Abc Abc"),
        ("ԱՕ ᎠᎡ", "ԱՕ ᎠᎡ"),
        ("a\u2800b", "a b"),
    ],
)
def test_rewrite(old, new):
    assert REWRITER.rewrite([old]) == [new]
    assert REWRITER.rewrite([new]) == [new]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=[*"aoeάὕᾴΩκ", "́", "̈", "̣", "ͅ", "̓", "о", "ｏ", "ﬂ", " ", " ", "​", "\n", "\r", "\x1e"], max_size=12), max_size=4))
def test_rewrite_settles(texts):
    out = REWRITER.rewrite(texts)
    assert REWRITER.rewrite(out) == out
    for t in out:
        assert unicodedata.is_normalized("NFC", t)
        assert not set(t) & set(" ​\r\x1eｏﬂ")


def test_consistent_records(spark):
    ab = spark.createDataFrame([("a", "λόγος"), ("b", "λóγος"), ("b", "λóγος"), (None, "ｘ"), ("c", None), ("d", "")], "id string, training_text string")
    dev = spark.createDataFrame([(1, "[ｘ]"), (2, None)], "case_id long, y string")
    r = consistent.rewritten(consistent.records(ab, dev), ["table_name", "rec_key"])
    assert sorted(tuple(x) for x in consistent.found(r).collect()) == [("ab", "b"), ("dev_case", "1")]
    assert consistent.rewritten(ab.limit(0), ["id"], "training_text").collect() == []


TEXT = {
    "en": "the boat was delivered to the village with all of the grain that had been measured by the scribe and it was sealed",
    "de": "das Boot wurde mit dem ganzen Getreide in das Dorf gebracht und der Schreiber hat die Urkunde für ihn gesiegelt",
    "fr": "le bateau est arrivé dans le village avec tout le grain que le scribe a mesuré pour la veuve et les prêtres",
}


def shuffled(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(TEXT[lang].split()) for _ in range(n))


def test_languages(spark):
    common = spark.createDataFrame([(lang, w) for lang, own in (("en", "the of and to was"), ("de", "das der und die mit"), ("fr", "le la les et que")) for w in own.split()], "lang_code string, word string")
    codes = spark.createDataFrame([("en", "en"), ("English", "en"), ("de", "de"), ("fr", "fr")], "label string, lang_code string")
    rows = [(f"{lang}{i}", lang, shuffled(lang, 40, i)) for lang in TEXT for i in range(30)]
    rows += [
        ("wrong", "de", shuffled("en", 30, 99)),
        ("none", None, shuffled("fr", 30, 98)),
        ("odd", "eng", shuffled("en", 30, 97)),
        ("mixed", "en", f"{shuffled('en', 20, 1)} {shuffled('de', 15, 2)} {shuffled('en', 20, 3)}"),
        ("phrase", "en", f"{shuffled('en', 20, 4)} das Boot der {shuffled('en', 20, 5)}"),
        ("mixed", "en", f"{shuffled('en', 20, 1)} {shuffled('de', 15, 2)} {shuffled('en', 20, 3)}"),
        ("nothing", "und", "... <gap/>"),
        ("null", "und", None),
        (None, "und", shuffled("en", 30, 96)),
    ]
    ab = spark.createDataFrame(rows, "id string, language string, training_text string").withColumn("lang_code", F.lit("clash")).withColumn("text", F.lit("clash"))
    seg = language.blocks(ab, codes, common)
    got = sorted(tuple(r) for r in language.found(seg).collect())
    assert got == [("mixed", 1, "en"), ("mixed", 2, "de"), ("mixed", 3, "en"), ("none", 1, "fr"), ("odd", 1, "en"), ("wrong", 1, "en")]
    assert all(0.5 <= r.confidence <= 1 for r in seg.collect())
    assert language.found(language.blocks(ab.limit(0), codes, common)).collect() == []


def test_bloom_filter_is_corrected():
    rng = np.random.default_rng(0)
    known = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    f = language.LanguageFilters(list("abcdefghijk"), known, np.where(np.arange(5000) < 2500, 0, 9), slots=1 << 14)
    assert (f.lookup(known[:2500])[0] & 1).all()
    assert (f.lookup(known[2500:])[1] & 2).all()
    other = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    assert (f.lookup(other)[0] & 1).mean() == pytest.approx(f.noise[0], rel=0.1)
    assert not (f.lookup(other)[0] & 2).any()
    assert [b for b in range(11) if f.noise[b]] == [0, 9]


def test_more_languages_than_a_byte_has_bits(spark):
    letters = "abcdefghijklmnop"
    alphabet = {f"l{i:02d}": letters[i : i + 5] for i in range(11)}
    rng = random.Random(8)
    word = lambda lang: "".join(rng.choice(alphabet[lang]) for _ in range(6)) + lang[1:].translate(str.maketrans("0123456789", "qrstuvwxyz"))
    common = {lang: [word(lang) for _ in range(5)] for lang in alphabet}
    text = lambda lang, n: " ".join(rng.choice(common[lang]) if k % 3 == 0 else word(lang) for k in range(n))
    rows = [(f"{lang}{i}", lang, text(lang, 40)) for lang in alphabet for i in range(12)] + [("odd", "l00", text("l10", 40))]
    ab = spark.createDataFrame(rows, "id string, language string, training_text string")
    codes = spark.createDataFrame([(lang, lang) for lang in alphabet], "label string, lang_code string")
    words_ = spark.createDataFrame([(lang, w) for lang, own in common.items() for w in own], "lang_code string, word string")
    assert [tuple(r) for r in language.found(language.blocks(ab, codes, words_)).collect()] == [("odd", 1, "l10")]


def test_short_segments_join_their_neighbours():
    def score(path):
        one = np.zeros((len(path), 2))
        one[np.arange(len(path)), path] = 1
        return np.vstack([np.zeros(2), one.cumsum(0)])

    path = np.r_[np.zeros(15, int), np.ones(9, int), np.zeros(15, int)]
    runs = lambda: [[0, 0, 15], [1, 15, 24], [0, 24, 39]]
    assert language.merge_short(runs(), score(path)) == [[0, 0, 39]]
    unclear = score(path)
    unclear[15:] += np.array([0, 1])  # the word before the stretch fits both languages
    assert language.merge_short(runs(), unclear) == runs()
    ten = np.r_[np.zeros(15, int), np.ones(10, int)]
    assert language.merge_short([[0, 0, 15], [1, 15, 25]], score(ten)) == [[0, 0, 15], [1, 15, 25]]


def test_leaks(spark, monkeypatch):
    item = "τὸν λόγον ἀπέδωκεν ὁ γραμματεὺς τῷ στρατηγῷ ἐν τῇ κώμῃ καὶ ἐσφράγισεν αὐτόν"
    caps = "ΤΟΝ ΛΟΓΟΝ ΑΠΕΔΩΚΕΝ Ο ΓΡΑΜΜΑΤΕΥΣ ΤΩ ΣΤΡΑΤΗ-\nΓΩ, [ΕΝ] ΤΗ ΚΩ(ΜΗ) ΚΑΙ ἄλλα"
    nine = "τὸν λόγον ἀπέδωκεν ὁ γραμματεὺς τῷ στρατηγῷ ἐν τῇ ἄλλα"
    broken = item.replace("στρατηγῷ", "στρα....")
    rows = [("whole", f"ἄλλα {item} ἄλλα"), ("caps", caps), ("nine", nine), ("broken", broken), ("whole", f"ἄλλα {item} ἄλλα"), ("null", None), ("empty", ""), (None, item)]
    texts = spark.createDataFrame(rows, "id string, training_text string").withColumn("test_id", F.lit("clash"))
    tests = spark.createDataFrame([("t1", item), ("t2", f"x {item}"), ("t3", "ganz anderes"), ("t4", None)], "id string, training_text string")
    found = contamination.found(contamination.leaks(texts, tests))
    assert sorted(tuple(r) for r in found.collect()) == [("caps", "t1"), ("caps", "t2"), ("whole", "t1"), ("whole", "t2")]
    spans = {(r.id, r.test_id): (r.first_word, r.n_words, r.test_first_word) for r in contamination.leaks(texts, tests).collect() if r.id}
    assert spans[("whole", "t2")] == (1, 13, 1)
    assert spans[("caps", "t1")] == (0, 11, 0)
    clean = {r.id: r.training_text for r in contamination.without_leaked_spans(texts, tests).collect()}
    assert clean["whole"] == "ἄλλα  ἄλλα"
    assert clean["nine"] == nine
    assert {r.id for r in contamination.without_leaked_texts(texts, contamination.leaks(texts, tests)).collect()} == {"nine", "broken", "null", "empty", None}
    assert contamination.leaks(texts, tests.limit(0)).collect() == []
    whole = sorted(map(str, contamination.leaks(texts, tests).collect()))
    monkeypatch.setattr(contamination, "SHARD_CHARS", 40)
    monkeypatch.setattr(contamination, "SCAN_SHARDS", 2)
    assert sorted(map(str, contamination.leaks(texts, tests).collect())) == whole
    assert {r.id: r.training_text for r in contamination.without_leaked_spans(texts, tests).collect()} == clean


def test_leaked_letters_by_brute_force():
    item = "τὸν λόγον ἀπέδωκεν ὁ γραμματεὺς τῷ ﬁn ß½ στρατηγῷ ἐν τῇ κώμῃ"
    tests = [contamination.TestSet(["t"], [item])]
    texts = ["", "ß ½ ﬁ\x1e", f"½ ß {item} ﬁ ἄλλα", item, f"x\n{item}. y {item}"]
    spans = contamination.leaked_letters(texts, tests)
    assert spans[:2] == [[], []]
    assert [texts[2][a:b] for a, b in spans[2]] == [item]
    assert spans[3] == [(0, len(item))]
    assert [texts[4][a:b] for a, b in sorted(spans[4])] == [item, item]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y and x else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_common_length(a, b):
    assert overlap.common_length(np.array(a, np.uint64), np.array(b, np.uint64)) == lcs(a, b)


def test_overlaps_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "klmnp" for b in "aeiou" for c in "rst"]
    cases, texts = [], []
    for i in range(60):
        n = rng.choice([1, 2, 3, 4, 5, 7, 10, 15, 20, 25, 30, 40, 60])
        x = [rng.choice(vocabulary) for _ in range(n)]
        cases.append((i, " ".join(w if rng.random() > 0.03 else "[...]" for w in x)))
        for _ in range(4):
            rate, y = rng.choice([0.0, 0.05, 0.1, 0.15, 0.2, 0.25]), []
            for w in x:
                r = rng.random()
                y += [] if r < rate / 3 else [rng.choice(vocabulary)] if r < 2 * rate / 3 else [w, rng.choice(vocabulary)] if r < rate else [w]
            texts.append((f"t{len(texts)}", " ".join(y).upper()))
        # pairs of words with one extra word in turn on either side: no three words in a row are shared
        if n >= 20:
            y = [w for k in range(0, n - 4, 5) for w in (x[k], x[k + 1], x[k + 3], x[k + 4], "zzz")]
            texts.append((f"t{len(texts)}", " ".join(y)))
    texts += [(None, cases[0][1]), ("n", None), ("e", ""), ("t0", texts[0][1])]
    ab = spark.createDataFrame([(i, t, "c") for i, t in texts], "id string, training_text string, corpus_id string")
    dev = spark.createDataFrame([(i, x, "s", "c") for i, x in cases] + [(3, cases[3][1], "s", "c"), (None, "a b c", "s", "c"), (99, None, "s", "c")], "case_id long, x string, split_name string, corpus_id string")
    own = overlap.members(overlap.overlaps(ab, dev), ab, dev)
    got = {tuple(r) for r in overlap.found(own).collect()}

    def read(t):
        w = tv.words([t])
        return [int(h) if ok else 0 for h, ok in zip(w.hash, w.ok, strict=True)]

    a, b = {i: read(x) for i, x in cases}, {i: read(t) for i, t in texts if i and t}
    want = {(i, j) for i, x in a.items() for j, y in b.items() if (k := lcs(x, y)) and 5 * k >= 4 * max(len(x), len(y))}
    assert len(want) > 60
    assert got == want
    assert overlap.counts(own).first().n_pairs == len(want)
    monkeypatch.setattr(overlap, "SHARD_CHARS", 1500)
    monkeypatch.setattr(overlap, "SCAN_SHARDS", 2)
    assert {tuple(r) for r in overlap.found(overlap.members(overlap.overlaps(ab, dev), ab, dev)).collect()} == want
    assert overlap.overlaps(ab.limit(0), dev).collect() == []
    assert overlap.overlaps(ab, dev.limit(0)).collect() == []


def _overlapping(spark, cases, texts):
    ab = spark.createDataFrame([(f"t{i}", t, "c") for i, t in enumerate(texts)], "id string, training_text string, corpus_id string")
    dev = spark.createDataFrame([(i, x, "s", "c") for i, x in enumerate(cases)], "case_id long, x string, split_name string, corpus_id string")
    return ab, dev


def _edited(rng, x, rate, vocabulary):
    y = []
    for w in x:
        r = rng.random()
        y += [] if r < rate / 3 else [rng.choice(vocabulary)] if r < 2 * rate / 3 else [w, rng.choice(vocabulary)] if r < rate else [w]
    return y


@pytest.mark.parametrize(("size", "lengths", "most"), [(4, range(1, 13), 90), (400, (95, 103, 110, 126, 128, 129, 131, 150, 160, 200, 255, 257, 300, 320), 14)])
def test_overlaps_of_few_words_and_of_long_texts(spark, size, lengths, most):
    rng = random.Random(size)
    vocabulary = [f"{a}{b}{c}" for a in "klmnpstvz" for b in "aeiou" for c in "klmnpstvz"][:size]
    cases = [[rng.choice(vocabulary) for _ in range(n)] for n in itertools.islice(itertools.cycle(lengths), most)]
    texts = [_edited(rng, x, rate, [*vocabulary, "qqq"]) for x in cases for rate in (0.0, 0.1, 0.2, 0.25)]
    cases, texts = ([" ".join(x if rng.random() > 0.02 else "[..]" for x in own) for own in side] for side in (cases, texts))
    ab, dev = _overlapping(spark, cases, texts)
    read = [[[int(h) if ok else 0 for h, ok in zip(w.hash, w.ok, strict=True)] for w in (tv.words([t]) for t in side)] for side in (cases, texts)]
    near = ((i, j, x, y) for i, x in enumerate(read[0]) for j, y in enumerate(read[1]) if 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)))
    want = {(i, f"t{j}") for i, j, x, y in near if (k := lcs(x, y)) and 5 * k >= 4 * max(len(x), len(y))}
    assert len(want) > 2 * most
    assert {tuple(r) for r in overlap.found(overlap.members(overlap.overlaps(ab, dev), ab, dev)).collect()} == want


def test_overlaps_read_texts_as_often_for_many_shards_as_for_few(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in "klmnp" for b in "aeiou" for c in "rst"]
    cases = [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(60)]
    ab, dev = _overlapping(spark, cases, cases[:30] + [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(70)])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    monkeypatch.setattr(overlap, "SHARD_CHARS", 200)
    monkeypatch.setattr(overlap, "SCAN_SHARDS", 2)
    assert overlap.overlaps(ab.mapInPandas(count, ab.schema), dev).count() == 30
    assert seen.value <= 3 * 100
