"""TEI and EpiDoc files, corpora in files, the registry, streams."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from stichos import pipeline, registry, storage
from stichos.functions import lacuna
from stichos.sources import corpus, tei
from stichos.streaming import ingest

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'
EPIDOC = f"""<TEI {NS} xml:lang="en"><teiHeader><title>Letter</title><idno type="filename">p.test.1</idno><idno type="HGV">1234 5</idno></teiHeader>
<text><body><div type="edition" xml:lang="grc"><ab>κ<supplied reason="lost">ώμ.η</supplied>ς <gap reason="lost" quantity="3" unit="character"/> <expan>στρ<ex>ατηγός</ex></expan>
<lb n="2"/><choice><reg>neu</reg><orig>alt</orig></choice> &lt;x&gt; <gap unit="line" quantity="2"/><supplied reason="omitted">weg</supplied><note>N</note></ab><ab>kurz</ab></div>
<div type="translation"><ab>Not part of the edition at all</ab></div></body></text></TEI>"""
PLAIN = f"""<TEI {NS}><teiHeader><title>Test Title</title><material>Papyrus</material><idno type="filename">test_file.xml</idno></teiHeader>
<text><body><p>Some <gap quantity="3"/> text <gap/> with <hi>nested</hi> elements.<!-- no --></p><p>a</p><l>second line</l></body></text></TEI>"""


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("[abd.efg]", "[abd].[efg]"),
        ("[abd....efg.....hij]", "[abd]....[efg].....[hij]"),
        ("[...abd...efg...hij...]", "...[abd]...[efg]...[hij]..."),
        ("[]", ""),
        ("[.]", "."),
        ("[a]", "[a]"),
        ("[a<gap/>b]", "[a]<gap/>[b]"),
    ],
)
def test_brackets(given, expected):
    assert tei.bracketed(given) == expected


def test_nested_brackets():
    with pytest.raises(ValueError, match="brackets"):
        tei.bracketed("[a[b]")


def test_elements():
    e = tei.Editions()
    assert e.one(ET.fromstring("<ab><milestone/>Text<handShift/></ab>")) == "Text"
    assert e.errors == []
    assert e.one(ET.fromstring("<app><lem>a</lem></app>")) == ""
    assert e.one(ET.fromstring("<app type='alternative'><lem>a</lem><rdg>b</rdg></app>")) == "a"
    assert e.one(ET.fromstring("<ab><odd>x</odd></ab>")) == "x"
    assert e.errors == ["no rule for odd"]
    e.register("odd", lambda el: "!")
    assert e.one(ET.fromstring("<ab><odd>x</odd></ab>")) == "!"


def test_epidoc(spark, tmp_path):
    d = tmp_path / "idp.data" / "DDB_EpiDoc_XML"
    d.mkdir(parents=True)
    (d / "a.xml").write_text(EPIDOC, "utf-8")
    (d / "bad.xml").write_text("<TEI><un", "utf-8")
    h = tmp_path / "hgv"
    h.mkdir()
    (h / "1234.xml").write_text(f"<TEI {NS}><material>Ostrakon</material></TEI>", "utf-8")
    blocks, errors = tei.read_epidoc(spark, str(d), str(h))
    (row,) = blocks.collect()
    assert (row.corpus_id, row.id, row.title, row.material, row.language) == ("DDbDP", "DDbDP/p.test.1/1", "Letter", "ostrakon", "grc")
    assert row.training_text == "κ[ώμ].[η]ς ... στρ\nalt &lt;x&gt; <gap/>"
    assert [(c.id, c.test_case) for c in row.test_cases] == [
        ("DDbDP/p.test.1/1/1", "κ[..].ης ... στρ\nalt &lt;x&gt; <gap/>"),
        ("DDbDP/p.test.1/1/2", "κώμ.[.]ς ... στρ\nalt &lt;x&gt; <gap/>"),
    ]
    assert [r.pathname.endswith("bad.xml") for r in errors.collect()] == [True]


def test_tei(spark, tmp_path):
    (tmp_path / "tlg0001.x.xml").write_text(PLAIN, "utf-8")
    blocks, _ = tei.read_tei(spark, str(tmp_path))
    rows = blocks.orderBy("block_index").collect()
    assert [(r.id, r.material, r.language, r.training_text) for r in rows] == [
        ("tlg/test_file.xml/1", "papyrus", "grc", "Some ... text <gap/> with nested elements."),
        ("tlg/test_file.xml/3", "papyrus", "grc", "second line"),
    ]
    assert rows[0].test_cases == []


def test_paths(spark):
    df = spark.createDataFrame([("1234",), ("2000",), ("17a",), (None,)], "h string")
    assert [r[0] for r in df.select(tei.hgv_path(F.col("h"), F.lit("r"))).collect()] == ["r/HGV_meta_EpiDoc/HGV2/1234.xml", "r/HGV_meta_EpiDoc/HGV2/2000.xml", "r/HGV_meta_EpiDoc/HGV1/17a.xml", None]


def test_files(spark, tmp_path):
    rows = [("c", "f", i, f"c/f/{i}", "t", "m", "grc", "x" * 500, []) for i in range(10)]
    blocks = spark.createDataFrame(rows, corpus.BLOCK)
    assert corpus.write_arrays(blocks, str(tmp_path / "a"), limit_mb=10) == ["c_0.json"]
    names = corpus.write_arrays(blocks, str(tmp_path / "b"), limit_mb=0.002)
    assert len(names) > 1
    assert sum(len(json.loads((tmp_path / "b" / n).read_text())) for n in names) == 10
    (tmp_path / "b" / "test_abs.json").write_text("[]")
    (tmp_path / "b" / "broken.json").write_text("[{")
    good, bad = corpus.read_corpus(spark, str(tmp_path / "b"))
    assert good.count() == 10
    assert [r.file for r in bad.collect()] == ["broken.json"]


def test_evaluation_sheet(spark, tmp_path):
    (tmp_path / "t.csv").write_text('ID,papiro herc,testo con supplemento,testo,contesto ampio,luogo\n1,P,"α [β]\nγ",α,α β γ δ,x\n1,P,δ [ε],δ,z,y\n', "utf-8")
    rows = corpus.read_evaluation(spark, str(tmp_path / "t.csv")).withColumn("n", F.monotonically_increasing_id())
    g = corpus.grouped_cases(rows, "ID", "n", "testo", "papiro herc").first()
    assert [tuple(c) for c in g.test_cases] == [(0, "α"), (1, "δ")]
    put = corpus.bracketed_context(rows.filter("n = 0"), "testo con supplemento", "contesto ampio").first()
    assert put.training_text == "α [β] γ δ"


def test_registry(spark, tmp_path):
    s = spark.createDataFrame([("ΤΟΝ ΛΟΓΟΝ ΚΑΙ".split(),), ("ΤΟΝ ΛΟΓΟΥ".split(),)], "tokens array<string>")
    r = registry.Registry(spark, str(tmp_path / "models"))
    m = r.add_ngrams(s, s, "LIDSTONE", 0.1, 2)
    with pytest.raises(registry.ModelAlreadyExistsError):
        r.add_ngrams(s, s, "LIDSTONE", 0.1, 2)
    got = r.suggest(m, "τὸν λόγο[.]", 5)
    assert [g["token_str"] for g in got] == ["λογον", "λογου"]
    assert got[0]["sentence"] == "τὸν λογον"
    with pytest.raises(registry.InvalidContextError):
        r.suggest(m, "no gap", 5)
    with pytest.raises(registry.ModelNotFoundError):
        r.get("x")
    b = r.add_masked("Logion")
    assert r.table().count() == 2
    r.delete(b)
    r.delete(m)
    assert r.table().count() == 0


def test_registry_takes_unknown_context(spark, tmp_path):
    s = spark.createDataFrame([("<UNK> ΛΟΓΟΝ ΚΑΙ".split(),), ("ΤΟΝ ΛΟΓΟΥ".split(),)], "tokens array<string>")
    r = registry.Registry(spark, str(tmp_path / "models"))
    m = r.add_ngrams(s, s, "LIDSTONE", 0.1, 2)
    assert [g["token_str"] for g in r.suggest(m, "ξένον λόγο[.]", 5)] == ["λογον"]


def test_registry_scores_with_the_models_gamma(spark, tmp_path):
    s = spark.createDataFrame([("ΤΟΝ ΛΟΓΟΝ ΚΑΙ".split(),), ("ΤΟΝ ΛΟΓΟΥ".split(),)], "tokens array<string>")
    r = registry.Registry(spark, str(tmp_path / "models"))
    words = 7  # <s>, </s>, four words, unknown
    for gamma in (0.1, 0.001):
        got = r.suggest(r.add_ngrams(s, s, "LIDSTONE", gamma, 2), "τὸν λόγο[.]", 5)
        assert [g["score"] for g in got] == pytest.approx([(1 + gamma) / (2 + words * gamma)] * 2)
    assert [g["score"] for g in r.suggest(r.add_ngrams(s, s, "MLE", None, 2), "τὸν λόγο[.]", 5)] == pytest.approx([0.5, 0.5])


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"corpus_id": "c", "id": "c/f/1", "training_text": "τὸν [λό]γον.", "exported_at": "2022-01-01T00:00:00"}
    (src / "1.json").write_text("\n".join(json.dumps(r) for r in (row, row, row | {"id": "c/f/2"})), "utf-8")
    q = ingest.write(ingest.transpiled(ingest.blocks(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [(r.id, r.plain) for r in got] == [("c/f/1", "ΤΟΝ ΛΟΓΟΝ."), ("c/f/2", "ΤΟΝ ΛΟΓΟΝ.")]


def test_stream_keeps_late_blocks(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    batches = ([("c/f/1", "2022-01-01"), ("c/f/2", "2022-06-01")], [("c/f/1", "2022-01-01"), ("c/f/3", "2022-01-02"), ("c/f/4", "2022-06-02")], [("c/f/5", "2021-03-01"), (None, "2021-03-01"), (None, "2021-03-02"), ("c/f/3", "2023-01-01")])
    for i, batch in enumerate(batches):
        rows = [{"corpus_id": "c", "id": k, "training_text": "τὸν λόγον.", "exported_at": f"{day}T00:00:00"} for k, day in batch]
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows), "utf-8")
        ingest.write(ingest.blocks(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == [None, None, "c/f/1", "c/f/2", "c/f/3", "c/f/4", "c/f/5"]


def test_stream_counts_late_blocks(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, (k, day) in enumerate([("c/f/1", "2022-06-01"), ("c/f/2", "2022-01-01"), ("c/f/1", "2022-06-01")]):
        (src / f"{i}.json").write_text(json.dumps({"corpus_id": "c", "id": k, "training_text": "τὸν λόγον.", "exported_at": f"{day}T00:00:00"}), "utf-8")
        q = ingest.counts(ingest.blocks(spark, str(src)), 2).writeStream.format("memory").queryName(f"late_{i}").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.word: r.cnt for r in spark.table("late_2").filter("order = 1").collect()}["ΛΟΓΟΝ"] == 2


def test_registry_fills_by_several_words(spark, tmp_path):
    s = spark.createDataFrame([("ΤΟΝ ΛΟΓΟΝ ΚΑΙ".split(),), ("ΤΟΝ ΛΟΓΟΝ ΕΙΠΕΝ".split(),)], "tokens array<string>")
    r = registry.Registry(spark, str(tmp_path / "models"))
    m = r.add_ngrams(s, s, "LIDSTONE", 0.1, 2)
    got = r.suggest(m, "τὸν [..........]", 5, 2)
    assert [(g["token_str"], g["score"]) for g in got] == [("λογον ειπεν", 0.5), ("λογον και", 0.5)]
    assert got[0]["sentence"] == "τὸν λογον ειπεν"


def test_registry_init(spark, tmp_path):
    s = spark.createDataFrame([("ΤΟΝ ΛΟΓΟΝ ΚΑΙ".split(),)], "tokens array<string>")
    r = registry.Registry(spark, f"file://{tmp_path}/models")
    ids = r.init(s, s, 2)
    rows = r.table().collect()
    assert sorted((x.TYPE, x.LM_SCORE, x.CHECKPOINT) for x in rows if x.TYPE == "Ngrams") == [("Ngrams", "LIDSTONE", None), ("Ngrams", "MLE", None)]
    assert sorted(x.CHECKPOINT for x in rows if x.TYPE == "BERT") == ["GreBerta", "Logion", "aristoBERTo"]
    with pytest.raises(registry.ModelAlreadyExistsError):
        r.init(s, s, 2)
    r.delete(ids[0])
    assert r.suggest(ids[1], "τὸν λόγο[.]", 5)[0]["token_str"] == "λογον"
    r.delete(ids[1])
    assert [n for n in r.folder.names() if not n.endswith(".json")] == []


def test_pipeline(spark, tmp_path):
    blocks = [{"corpus_id": "DCLP" if i % 2 else "other", "id": f"b{i}", "language": "grc", "title": "P.Herc. 1" if i % 4 == 1 else "x", "training_text": f"τὸν λόγον α{chr(945 + i % 20)}."} for i in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(blocks), "utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"corpus_id": "DCLP", "id": "la", "language": "la", "training_text": "et"}]), "utf-8")
    assert corpus.load(spark, str(tmp_path)).count() == 40
    assert corpus.load(spark, str(tmp_path), ("DCLP",)).count() == 20
    assert corpus.load(spark, str(tmp_path), ("DCLP",), 25).count() == 5
    general, domain, dev = pipeline.parts(corpus.load(spark, str(tmp_path)))
    assert (general.count(), domain.count(), dev.count()) == (38, 8, 2)
    assert not {r.id for r in dev.collect()} & {r.id for r in general.unionByName(domain).collect()}
    r = registry.Registry(spark, str(tmp_path / "models"))
    model, held = pipeline.train_folder(spark, str(tmp_path), r, ("DCLP",), None, "MLE", None, 2)
    assert held.count() == 2
    assert r.get(model)["CORPUS_NAMES"] == ["DCLP"]
    counts = {(x.word): x.cnt for x in r.counts(model)[1].filter("order = 1").collect()}
    assert counts["ΛΟΓΟΝ"] == 18


def test_broken_files_are_mended(spark):
    good = "<TEI xmlns='http://www.tei-c.org/ns/1.0'><text><body><div type='edition' xml:lang='grc'><ab>τὸν λόγον ἀπέδωκεν</ab></div></body></text></TEI>"
    bad = {
        "byte": good.replace("λόγον", "λόγ\x01ον").encode(),
        "sign": good.replace("λόγον", "λόγον & 3 < 4").encode(),
        "end": good.split("</ab>")[0].encode(),
        "stray": good.replace("λόγον", "<hi>λόγον</unclear>").encode(),
        "attribute": good.replace("<ab>", "<ab n=1 n='2' n='3'>").encode(),
        "utf": good.encode().replace("λόγον".encode(), b"\xff\xfe"),
    }
    for name, content in bad.items():
        root, error = tei.tree(content)
        assert error.startswith("mended"), name
        (ab,) = tei.find_all(root, "ab")
        assert "ἀπέδωκεν" in "".join(ab.itertext()) or name == "end", name
    assert tei.tree(good.encode())[1] is None
    assert tei.tree(b"")[0] is None
    assert tei.tree(b"no markup")[0] is None
    files = spark.createDataFrame([("/x/a.xml", bytearray(bad["stray"])), ("/x/b.xml", bytearray(b"??"))], "path string, content binary")
    raw = tei.parsed(files, tei.editions)
    assert [r.training_text for r in raw.filter("training_text is not null").collect()] == ["τὸν λόγον ἀπέδωκεν"]
    assert {r.pathname for r in tei.errors(raw).collect()} == {"/x/a.xml", "/x/b.xml"}


def test_alternatives_in_supplied_text():
    e = lambda inner: tei.Editions().convert(ET.fromstring(f"<ab>{inner}</ab>"))
    assert e("α<supplied reason='lost'><app type='alternative'><lem>βγ</lem><rdg>δε</rdg></app></supplied>ζ") == "α[βγ]ζ"
    assert e("<supplied reason='lost'>α<choice><sic>β</sic></choice></supplied>") == "[αβ]"
    assert e("<app type='alternative'><lem>βγ</lem><rdg>δε</rdg></app>") == "βγ"
    assert e("<supplied reason='lost'><app type='alternative'/>α</supplied>") == "[α]"


def test_paths_of_the_data(spark):
    paths = spark.createDataFrame([("/a/b/idp.data/DCLP/1/2.xml",), ("idp.data/x.xml",), ("/a/x.xml",), (None,)], "p string")
    assert [r[0] for r in paths.select(tei.data_root(F.col("p"))).collect()] == ["/a/b/idp.data/", "idp.data/", "", None]


def test_latest_is_decided_by_all_columns(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 2, "x"), ("a", 1, "z")], "id string, t int, v string")
    assert [r.v for r in corpus.latest(rows.repartition(3), "id", "t").collect()] == ["x"]


def test_storage(spark, tmp_path):
    f = storage.Folder(spark, str(tmp_path / "new"))
    assert f.names() == []
    f.write("a.json", "λόγος")
    f.move("a.json", "sub/b.json")
    f.write("c.txt", "")
    f.write("c.txt", "2")
    assert (f.read("sub/b.json"), f.read("c.txt"), f.names(".txt"), f.exists("a.json")) == ("λόγος", "2", ["c.txt"], False)
    f.delete("sub")
    f.delete("nothing")
    assert f.names() == ["c.txt"]


def test_widened_supplement_stops_at_a_line_end(spark):
    df = spark.createDataFrame([("λόγος\n[καὶ] τό",), ("λό\nγ[ος]",)], "x string")
    assert [[s.tokens for s in r[0]] for r in df.select(lacuna.supplements(F.col("x"))).collect()] == [[["ΚΑΙ"]], [["ΓΟΣ"]]]
