"""Editorial marks, gaps, supplements: worked pairs."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from stichos.functions import editorial as E
from stichos.functions import lacuna as L
from stichos.functions import normalize as N

G, U = "<gap/>", "<UNK>"

PLAIN = [
    (f"sibi et {G} uxo[ri]", f"SIBI ET {U} UXORI"),
    (f"sibi et {G} uxo[..]", f"SIBI ET {U} {U}"),
    ("κ[ώμη]ς Σεκνεπαί\nου Νήσου ἃ ἐπεστά\nλη[σαν δ]ι' ἡμῶν", "ΚΩΜΗΣ ΣΕΚΝΕΠΑΙ ΟΥ ΝΗΣΟΥ Α ΕΠΕΣΤΑ ΛΗΣΑΝ ΔΙ' ΗΜΩΝ"),
    ("τὸν [πωλοῦντα] ‒⏑⏑‒", f"ΤΟΝ ΠΩΛΟΥΝΤΑ {U}"),
    ("ἄρτους &lt;τοὺς&gt; {καλούς} ε‡12", "ΑΡΤΟΥΣ ΤΟΥΣ Ε"),
    (G, U),
    ("...", U),
    ("στρατηγ(ός)", "ΣΤΡΑΤΗΓΟΣ"),
    ("πρῶτος vac. δεύτερος", "ΠΡΩΤΟΣ ΔΕΥΤΕΡΟΣ"),
    ("a || b", "A B"),
    ("abc‡123", "ABC"),
    ("a{bc}d", "AD"),
    ("a{{bc}}d", "AD"),
    ("a†bc†d", "AD"),
    ("x_y", "XY"),
    ("α+β*γ", "ΑΒΓ"),
    ("λόγος?", "ΛΟΓΟΣ"),
    ("πρῶτος⟦---⟧δεύτερος", "ΠΡΩΤΟΣΔΕΥΤΕΡΟΣ"),
    (f".{G}. testo", ". TESTO"),
    ("αρχη|τελος", "ΑΡΧΗ ΤΕΛΟΣ"),
    ("None", U),
    (f"{G} ... {G}", f"{U} {U} {U}"),
    ("", ""),
    (f"[τοῦ] {G} vac. τ(ῆ)ς", f"ΤΟΥ {U} ΤΗΣ"),
    ("a || [bc] ‖ d", "A BC D"),
    ("a{bc}[de]f", "ADEF"),
    (f"&lt;abc&gt; {G} def", f"ABC {U} DEF"),
    ("[πωλοῦντα] ‒⏑⏑‒ [τινα]", f"ΠΩΛΟΥΝΤΑ {U} ΤΙΝΑ"),
    ("πα[ρα]-\nλαμβάνω", "ΠΑΡΑΛΑΜΒΑΝΩ"),
    ("[στρατηγ(ός)]", "ΣΤΡΑΤΗΓΟΣ"),
    (None, None),
]


def one(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [tuple(r) for r in df.select("i", *columns).orderBy("i").select(*[c for c in df.select("i", *columns).columns if c != "i"]).collect()]


def test_transpile(spark):
    got = one(spark, [a for a, _ in PLAIN], L.transpile(F.col("x")).alias("y"))
    assert [r[0] for r in got] == [b for _, b in PLAIN]


def test_transpile_again_changes_nothing(spark):
    again = [b for _, b in PLAIN if b]
    assert [r[0] for r in one(spark, again, L.transpile(F.col("x")).alias("y"))] == again


def test_no_case_folding(spark):
    assert one(spark, ["κ[ώμη]ς"], L.transpile(F.col("x"), case_folding=False).alias("y")) == [("κωμης",)]


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_normalize(spark, form):
    words = [unicodedata.normalize(form, w) for w in ("ἄνθρωπος", "ὅτι", "α̣λλα κατ̣[.]ς̣κευ")]
    assert [r[0] for r in one(spark, words, N.normalize_greek(F.col("x")).alias("y"))] == ["ΑΝΘΡΩΠΟΣ", "ΟΤΙ", "ΑΛΛΑ ΚΑΤ[.]ΣΚΕΥ"]


def test_tokens_with_gaps(spark):
    tokens = ["text", "test.", "NONE_tag", "a.b", "...", G]
    assert [r[0] for r in one(spark, tokens, L.contains_lacunae(F.col("x")).alias("y"))] == [False, False, True, True, True, True]
    pieces = ["γέ.δουσιν", "....", f"{G}.λέγειν"]
    assert [r[0] for r in one(spark, pieces, L.clean_lacunae(F.col("x")).alias("y"))] == [[U], [U], [U, ".λέγειν"]]
    assert [r[0] for r in one(spark, [".", ".a", G], L.is_part_of_lacuna(F.col("x")).alias("y"))] == [True, False, True]


@pytest.mark.parametrize(
    ("rule", "given", "expected"),
    [
        (E.dashes, "hello - world", "hello world"),
        (E.dashes, "start -end", "startend"),
        (E.dashes, "start- end", "startend"),
        (E.dashes, "start-end", "startend"),
        (E.dashes, "a- b- c", "c"),
        (E.dashes, "a b-", "a b"),
        (E.brackets, "isolated [ and ]", "isolated  and"),
        (E.line_ends, "line\n123", "line "),
        (E.line_ends, "line\n text", "line  text"),
        (E.metre, "test ⏑⏑‒", "test <gap/>"),
        (E.vacats, "abcvac.def", "abcdef"),
        (N.remove_punctuation, "hello, world. How: are! you?", "hello world How are you"),
    ],
)
def test_rules(spark, rule, given, expected):
    assert one(spark, [given], rule(F.col("x")).alias("y")) == [(expected,)]


def test_supplements(spark):
    got = one(spark, ["κ[ώμη]ς [τοῦ λόγου] α[β]γ α[β]δ", None, "ohne"], L.supplements(F.col("x")).alias("y"))
    assert [[(list(s.tokens), s.gap_len) for s in r[0]] if r[0] is not None else None for r in got] == [[(["ΚΩΜΗΣ"], 3), (["ΤΟΥ", "ΛΟΓΟΥ"], 0), (["ΑΒΓ"], 1), (["ΑΒΔ"], 1)], None, []]


def test_masked_cases(spark):
    got = one(spark, ["κ[ώμη]ς καὶ [τοῦ] ε"], L.mask_cases(F.col("x")).alias("y"))
    assert [tuple(c) for c in got[0][0]] == [(1, "κ[...]ς καὶ τοῦ ε"), (2, "κώμης καὶ [...] ε")]


def test_heads_tails_contexts(spark):
    cases = ["καὶ τ[..]ν λόγον", "[..] λόγον", "α. β γ[.]", "α [.] β [.]", "x <gap/>α[.]"]
    rows = one(spark, cases, L.head(F.col("x")).alias("h"), L.tail(F.col("x")).alias("t"), L.gap_length(F.col("x")).alias("n"), L.context(F.col("x"), 3).alias("c"))
    assert rows[0] == ("Τ", "Ν", 2, ["<s>", "ΚΑΙ"])
    assert rows[1] == ("", "", 2, ["<s>", "<s>"])
    assert rows[2] == ("Γ", "", 1, ["<s>", "Β"])
    assert rows[3][3] is None
    assert rows[4][0] is None


def test_splice(spark):
    df = spark.createDataFrame([("α β[..]γ [.]", "w"), ("α", "w"), (None, "w")], "s string, w string")
    assert [r[0] for r in df.select(L.splice(F.col("s"), F.col("w"))).collect()] == ["α w [.]", "α", None]
