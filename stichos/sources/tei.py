"""TEI and EpiDoc files to anonymous blocks.

Files are read as rows (path, content); each is parsed and walked in a Python worker, as mixed content has no relational
form, and yields its blocks or an error row.  Everything after that - identifiers, HGV materials, filters - is relational.
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lacuna import mask_cases
from ..settings import GAP, LANGUAGE

XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
#: Elements whose children's text is kept, and elements that vanish with their children.
KEPT = ("ab", "abbr", "add", "expan", "foreign", "hi", "lem", "num", "orig", "q", "rdg", "seg", "sic", "subst", "surplus", "unclear")
DROPPED = ("certainty", "del", "ex", "figure", "g", "handShift", "milestone", "note")
#: What may be chosen in an alternative and in a choice; languages that are kept; where a corpus lies.
ALTERNATIVES, CHOICES = ("lem", "rdg"), ("abbr", "choice", "orig", "sic", "unclear")
EDITION_LANGUAGES = ("grc", "la", "cop")
CORPUS_PATHS = {"idp.data/APD": "APD", "idp.data/DCLP": "DCLP", "idp.data/DDB_EpiDoc_XML": "DDbDP", "edhEpidocDump_": "EDH"}
SHORTEST_EDITION, SHORTEST_BLOCK = 10, 5

RAW = "path string, file_id string, title string, material string, hgv string, language string, block_index int, training_text string, error string"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all .xml files below a folder; an empty folder gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(folder)
    return files.select("path", "content")


def local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def find_all(element: ET.Element, *names: str) -> list[ET.Element]:
    """Descendants with one of the names, in document order."""
    return [e for e in element.iter() if e is not element and local(e) in names]


def first(element: ET.Element, name: str) -> ET.Element | None:
    return next(iter(find_all(element, name)), None)


class Editions:
    """Text of an EpiDoc block, with supplements in square brackets, lost letters as dots and other gaps as signs.

    handlers: functions (editions, element) -> text by element name; register() adds or replaces one.
    """

    def __init__(self) -> None:
        self.errors: list[str] = []
        self.supplied_depth = 0
        self.handlers: dict[str, Callable[[ET.Element], str]] = dict.fromkeys(KEPT, self.inner) | dict.fromkeys(DROPPED, lambda e: "")
        self.handlers |= {
            "app": lambda e: self.choose(e, ALTERNATIVES) if e.get("type") == "alternative" else "",
            "choice": lambda e: self.choose(e, CHOICES),
            "gap": self.gap,
            "lb": lambda e: "\n",
            "supplied": self.supplied,
        }

    def register(self, name: str, handler: Callable[[ET.Element], str]) -> None:
        self.handlers[name] = handler

    def one(self, element: ET.Element) -> str:
        name = local(element)
        if not name:  # a comment or an instruction
            return ""
        if name not in self.handlers:
            self.errors.append(f"no rule for {name}")
        return self.handlers.get(name, self.inner)(element)

    def inner(self, element: ET.Element) -> str:
        return escape(element.text or "") + "".join(self.one(c) + escape(c.tail or "") for c in element)

    def choose(self, element: ET.Element, names: tuple[str, ...]) -> str:
        """The first of the children to choose from; within supplied text all of them, as alternatives."""
        found = [c for c in element if local(c) in names]
        if self.supplied_depth:
            texts = [self.one(c) for c in found]
            return texts[0] if len(texts) == 1 else "".join(f"<alt>{t}</alt>" for t in texts or [""])
        if not found:
            self.errors.append(f"nothing to choose in {local(element)}")
            return ""
        return self.one(found[0])

    def gap(self, element: ET.Element) -> str:
        quantity = element.get("quantity", "")
        if element.get("unit") == "line" or not quantity:
            return GAP
        if not re.fullmatch(r"\s*[+-]?\d+\s*", quantity):
            self.errors.append(f"quantity {quantity}")
            return GAP
        return "." * int(quantity)

    def supplied(self, element: ET.Element) -> str:
        if element.get("reason") not in ("lost", "illegible"):
            return ""
        self.supplied_depth += 1
        text = self.inner(element)
        self.supplied_depth -= 1
        return bracketed(text)

    def convert(self, element: ET.Element) -> str:
        """Training text of a block: without empty lines and lines of dashes, without dots at its ends, the first of alternatives."""
        text = re.sub(r"(?s)<alt>(.*?)</alt>(?:<alt>.*?</alt>)*", r"\1", self.one(element))
        lines = [x for x in text.split("\n") if x and not x.isspace() and not x.startswith("-- ")]
        return re.sub(r"\[\s*\]", "", "\n".join(lines).strip("."))


def bracketed(text: str) -> str:
    """text in square brackets, lost letters and gaps outside of them; brackets within raise ValueError."""
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    if "[" in text or "]" in text:
        raise ValueError(f"brackets within brackets: {text}")
    return "".join(p if not p or p == GAP or set(p) == {"."} else f"[{p}]" for p in re.split(rf"({re.escape(GAP)}|\.+)", text))


def plain_text(element: ET.Element) -> str:
    """All text of an element: gaps of known size as dots, others as signs; comments left out."""
    out = element.text or ""
    for c in element:
        name = local(c)
        if name == "gap":
            quantity = c.get("quantity", "")
            out += "." * int(quantity) if quantity.isdigit() else GAP
        elif name:
            out += plain_text(c)
        out += c.tail or ""
    return out


def _text(element: ET.Element | None) -> str:
    return "" if element is None else "".join(element.itertext()).strip()


def _file_id(root: ET.Element, fallback: str) -> str:
    ids = find_all(root, "idno")
    chosen = next((i for i in ids if i.get("type") == "filename"), ids[0] if ids else None)
    return _text(chosen) or fallback


def editions(path: str, root: ET.Element) -> Iterator[dict]:
    """The blocks of an EpiDoc edition: those within an edition, in a language that is kept, and long enough."""
    parent = {c: p for p in root.iter() for c in p}

    def above(e: ET.Element | None) -> Iterator[ET.Element]:
        while e is not None:
            yield e
            e = parent.get(e)

    hgv = next((_text(i).split(" ")[0] for i in find_all(root, "idno") if i.get("type") == "HGV"), None)
    title, material = first(root, "title"), first(root, "material")
    common = {"path": path, "file_id": _file_id(root, "unknown"), "title": (title.text or "") if title is not None else "", "hgv": hgv or None}
    common["material"] = material.text.lower() if material is not None and material.text else None
    kept = []
    for ab in find_all(root, "ab"):
        if not any(local(e) == "div" and e.get("type") == "edition" for e in above(parent.get(ab))):
            continue
        language = next((e.get(XML_LANG) for e in above(ab) if e.get(XML_LANG) is not None), None) or by_script("".join(ab.itertext()))
        if language in EDITION_LANGUAGES and len("".join(ab.itertext())) >= SHORTEST_EDITION:
            kept.append((ab, language))
    for n, (ab, language) in enumerate(kept, 1):
        converter = Editions()
        try:
            text, error = converter.convert(ab), "; ".join(converter.errors) or None
        except ValueError as e:
            text, error = None, str(e)
        yield common | {"language": language, "block_index": n, "training_text": text, "error": error}


def by_script(text: str) -> str:
    """Language by the script of most letters; a stand-in for a detector."""
    counts = {"grc": len(re.findall("[Ͱ-ϡἀ-῿]", text)), "cop": len(re.findall("[Ϣ-ϯⲀ-⳿]", text)), "la": len(re.findall("[A-Za-z]", text)), "ara": len(re.findall("[؀-ۿ]", text))}
    best = max(counts, key=counts.get)
    return best if counts[best] else "unknown"


def paragraphs(path: str, root: ET.Element) -> Iterator[dict]:
    """The blocks of any TEI text: paragraphs, blocks and verses, else divisions, else the body."""
    body = first(root, "body")
    if body is None:
        return
    title, material, language = first(root, "title"), first(root, "material"), first(root, "language")
    common = {"path": path, "file_id": _file_id(root, os.path.basename(path)), "title": _text(title) or "unknown", "material": (_text(material) or "unknown").lower(), "hgv": None}
    common["language"] = (language.get("ident") if language is not None else None) or root.get(XML_LANG) or LANGUAGE
    for n, block in enumerate(find_all(body, "p", "ab", "l") or find_all(body, "div") or [body], 1):
        text = re.sub(r"\s+", " ", plain_text(block)).strip()
        if len(text) >= SHORTEST_BLOCK:
            yield common | {"block_index": n, "training_text": text, "error": None}


#: A piece of markup; and an attribute.
MARKUP = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<![^>]*>|<(?P<end>/?)(?P<name>[A-Za-z_][\w.-]*(?::[\w.-]+)?)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([A-Za-z_][\w.-]*(?::[\w.-]+)?)\s*=\s*(\"[^\"<]*\"|'[^'<]*')")


def mended(content: bytes) -> str:
    """Markup made well-formed: characters and signs that may not stand there escaped or left out, tags closed in their order, stray ends dropped."""
    text = re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", content.decode("utf-8", "replace")).lstrip("\ufeff")
    plain = lambda t: re.sub(r"&(?!(?:#\d+|#x[0-9a-fA-F]+|amp|lt|gt|quot|apos);)", "&amp;", t)
    free = lambda t: plain(t).replace("<", "&lt;").replace("]]>", "]]&gt;")
    out, open_, done, started = [], [], 0, False
    for m in MARKUP.finditer(text):
        if open_:
            out.append(free(text[done : m.start()]))
        done = m.end()
        name = m["name"]
        if name is None:
            out += [m[0]] if open_ and m[0].startswith(("<!--", "<![CDATA[")) and "--" not in m[0][4:-3] else []
        elif m["end"]:
            if name in open_:
                while open_[-1] != name:
                    out.append(f"</{open_.pop()}>")
                out.append(f"</{open_.pop()}>")
        elif open_ or not started:
            attributes = {k: v for k, v in ATTRIBUTE.findall(m["rest"])}
            out.append(f"<{name}" + "".join(f" {k}={plain(v)}" for k, v in attributes.items()) + ("/>" if m["empty"] else ">"))
            open_ += [] if m["empty"] else [name]
            started = True
    if open_:
        out.append(free(text[done:]))
    return "".join((*out, *(f"</{name}>" for name in reversed(open_))))


def tree(content: bytes) -> tuple[ET.Element | None, str | None]:
    """(root, error): the root also of a file that had to be mended, null where nothing helps."""
    try:
        return ET.fromstring(content), None
    except (ET.ParseError, LookupError, ValueError) as e:
        try:
            return ET.fromstring(mended(content)), f"mended: {e}"
        except ET.ParseError:
            return None, str(e)


def parsed(files: DataFrame, walk: Callable[[str, ET.Element], Iterator[dict]]) -> DataFrame:
    """Rows of RAW for each block of files(path, content); a file that had to be mended, or can't be parsed, gives a row with its error too."""
    names = [c.split(" ")[0] for c in RAW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                root, error = tree(bytes(content or b""))
                rows += list(walk(path, root)) if root is not None else []
                rows += [{"path": path, "error": error}] if error else []
            out = pd.DataFrame(rows, columns=names)
            out["block_index"] = out["block_index"].astype("Int32")
            yield out.astype(object).where(out.notna(), None)

    return files.mapInPandas(run, RAW)


def corpus_of(path: Column) -> Column:
    """Corpus of an EpiDoc file by its folder."""
    out = F.lit("unknown")
    for part, name in reversed(CORPUS_PATHS.items()):
        out = F.when(path.contains(part), name).otherwise(out)
    return out


def file_corpus(path: Column) -> Column:
    """Corpus of a TEI file: its name up to the first dot, numbered works of one collection together."""
    name = F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1)
    return F.when(name.rlike(r"^tlg\d+"), "tlg").otherwise(name)


def data_root(path: Column) -> Column:
    """The part of a path before the children of its idp.data folder, with the slash; empty where there is no such folder."""
    return F.regexp_extract(path, r"^(.*/)?idp\.data/", 0)


def hgv_path(hgv: Column, root: Column) -> Column:
    """Place of an HGV metadata file: folders of a thousand numbers below root."""
    number = F.regexp_extract(hgv, r"^\d+", 0)
    return F.when(number != "", F.concat(root, F.lit("/HGV_meta_EpiDoc/HGV"), F.ceil(number.cast("int") / 1000).cast("string"), F.lit("/"), hgv, F.lit(".xml")))


def materials(files: DataFrame) -> DataFrame:
    """(hgv, hgv_material) of HGV metadata files; of a number that occurs twice the first material by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                root, _ = tree(bytes(content or b""))
                found = _text(first(root, "material")) if root is not None else ""
                if found:
                    rows.append((os.path.splitext(os.path.basename(path))[0], found.lower()))
            yield pd.DataFrame(rows, columns=["hgv", "hgv_material"])

    return files.mapInPandas(run, "hgv string, hgv_material string").groupBy("hgv").agg(F.min("hgv_material").alias("hgv_material"))


def with_material(own: DataFrame, hgv: DataFrame) -> DataFrame:
    """own(hgv, material, ...) with a material for every row: its own, else that of hgv(hgv, hgv_material), else unknown.

    Only rows that need a material and have a number are joined.
    """
    asks = F.coalesce(F.col("hgv").isNotNull() & F.col("material").isNull(), F.lit(False))
    found = own.filter(asks).join(hgv, "hgv", "left").withColumn("material", F.col("hgv_material")).select(own.columns)
    return found.unionByName(own.filter(~asks)).withColumn("material", F.coalesce("material", F.lit("unknown")))


def blocks(raw: DataFrame, corpus: Column, hgv: DataFrame | None = None) -> DataFrame:
    """Anonymous blocks of parsed files: identifiers, material (the block's own, else by HGV number, else unknown) and masked cases."""
    own = raw.filter(F.col("training_text").isNotNull()).withColumn("corpus_id", corpus)
    own = own.withColumn("material", F.coalesce("material", F.lit("unknown"))) if hgv is None else with_material(own, hgv)
    id_ = F.concat_ws("/", "corpus_id", "file_id", F.col("block_index").cast("string"))
    cases = F.transform(mask_cases(F.col("training_text")), lambda c: F.struct(c["case_index"].alias("case_index"), F.concat_ws("/", F.col("id"), c["case_index"].cast("string")).alias("id"), c["test_case"].alias("test_case")))
    own = own.withColumn("id", id_).withColumn("test_cases", cases)
    return own.select("corpus_id", "file_id", "block_index", "id", "title", "material", "language", "training_text", "test_cases")


def errors(raw: DataFrame) -> DataFrame:
    """Log rows of what went wrong."""
    return raw.filter(F.col("error").isNotNull()).select(F.current_timestamp().alias("time"), F.lit("tei").alias("name"), F.lit("ERROR").alias("level"), F.col("error").alias("message"), F.col("path").alias("pathname"))


def read_epidoc(spark: SparkSession, folder: str, hgv_folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of a folder of EpiDoc files, materials joined from a folder of HGV metadata."""
    raw = parsed(scan(spark, folder), editions)
    return blocks(raw, corpus_of(F.col("path")), materials(scan(spark, hgv_folder)) if hgv_folder else None), errors(raw)


def read_tei(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of a folder of TEI files, without masked cases."""
    raw = parsed(scan(spark, folder), paragraphs)
    none = F.array().cast("array<struct<case_index:int,id:string,test_case:string>>")
    return blocks(raw, file_corpus(F.col("path"))).withColumn("test_cases", none), errors(raw)
