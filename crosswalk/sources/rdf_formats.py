"""RDF/XML and JSON-LD as triples in the form of :mod:`crosswalk.sources.rdf`, and files of any of the formats by their endings.

RDF/XML is read from XML events by a stack of nodes and properties, which alternate; a file is never held as a tree. JSON-LD is expanded by its own context;
contexts elsewhere are refused, as nothing is fetched. Blank nodes are named apart for each file.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswalk.sources.rdf import RDF, TRIPLE, XSD, Turtle, frames

NAMES = [x.split()[0] for x in TRIPLE.split(", ")]
_XML = "{http://www.w3.org/XML/1998/namespace}"
#: attributes of RDF/XML that are no properties
_SYNTAX = {f"{{{RDF}}}{x}" for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "bagID", "aboutEach")}
ENDINGS = {"owl": "xml", "rdf": "xml", "xml": "xml", "ttl": "turtle", "n3": "turtle", "nt": "turtle", "jsonld": "json-ld"}


class _Blanks:
    """Names of a file's blank nodes."""

    def __init__(self, graph: str):
        self.salt, self.n, self.named = hashlib.sha1(graph.encode()).hexdigest()[:8], 0, {}

    def new(self) -> tuple:
        self.n += 1
        return f"_:{self.salt}n{self.n}", "bnode"

    def called(self, label: str) -> tuple:
        return f"_:{self.salt}b{label}", "bnode"


def _literal(value: str, datatype: str | None, lang: str | None) -> tuple:
    return (value, "literal", RDF + "langString", lang.lower()) if lang and not datatype else (value, "literal", datatype or XSD + "string", None)


def _triple(graph: str, s: tuple, p: str, o: tuple) -> tuple:
    return graph, s[0], s[1], p, o[0], o[1], *(o[2:] if o[1] == "literal" else (None, None))


def _address(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def rdf_xml(text: str, graph: str, base: str = "") -> Iterator[tuple]:
    """Triples of an RDF/XML document. Nodes and properties alternate on a stack; what a property holds decides its object when it ends."""
    blanks = _Blanks(graph)
    frames: list[dict] = []
    skip: list[str] = []

    def at(tag: str) -> str:
        return f"{{{RDF}}}{tag}"

    def subject(a: dict, base: str) -> tuple:
        if at("about") in a:
            return urljoin(base, a[at("about")]), "iri"
        if at("ID") in a:
            return urljoin(base, "#" + a[at("ID")]), "iri"
        return blanks.called(a[at("nodeID")]) if at("nodeID") in a else blanks.new()

    def attributes(node: tuple, a: dict, lang: str | None) -> Iterator[tuple]:
        for k, v in a.items():
            if k == at("type"):
                yield _triple(graph, node, RDF + "type", (urljoin(base, v), "iri"))
            elif k not in _SYNTAX and not k.startswith(_XML) and k.startswith("{"):
                yield _triple(graph, node, _address(k), _literal(v, None, lang))

    def held(frame: dict, o: tuple) -> Iterator[tuple]:
        """A property's object, and the statement about it where the property has an id."""
        t = _triple(graph, frame["s"], frame["p"], o)
        yield t
        if frame["id"]:
            me = (urljoin(frame["base"], "#" + frame["id"]), "iri")
            yield _triple(graph, me, RDF + "type", (RDF + "Statement", "iri"))
            for p, x in (("subject", frame["s"]), ("predicate", (frame["p"], "iri")), ("object", o)):
                yield _triple(graph, me, RDF + p, x)

    for event, e in ElementTree.iterparse(io.BytesIO(text.encode("utf-8")), ("start", "end")):
        top = frames[-1] if frames else None
        if event == "start":
            if skip or top and top["kind"] == "property" and top["parse"] == "Literal":
                skip.append(e.tag)
                continue
            a = dict(e.attrib)
            own = {"lang": a.get(_XML + "lang", top["lang"] if top else None) or None, "base": urljoin(top["base"] if top else base, a.get(_XML + "base", ""))}
            if top is None and e.tag == at("RDF"):
                frames.append({"kind": "root"} | own)
            elif top is None or top["kind"] == "root" or top["kind"] == "property" and top["parse"] != "Resource":
                node = subject(a, own["base"])
                if e.tag != at("Description"):
                    yield _triple(graph, node, RDF + "type", (_address(e.tag), "iri"))
                yield from attributes(node, a, own["lang"])
                if top and top["kind"] == "property":
                    top["objects"].append(node)
                frames.append({"kind": "node", "s": node, "li": 0} | own)
            else:
                if top["kind"] == "property":  # its content is that of a node without a name
                    node, counter = top["objects"][0], top
                else:
                    node, counter = top["s"], top
                name = _address(e.tag)
                if e.tag == at("li"):
                    counter["li"] += 1
                    name = f"{RDF}_{counter['li']}"
                frame = {"kind": "property", "s": node, "p": name, "parse": a.get(at("parseType")), "datatype": a.get(at("datatype")), "id": a.get(at("ID")), "objects": [], "li": 0, "attributes": a} | own
                if at("resource") in a:
                    frame["objects"].append((urljoin(own["base"], a[at("resource")]), "iri"))
                elif at("nodeID") in a:
                    frame["objects"].append(blanks.called(a[at("nodeID")]))
                elif frame["parse"] == "Resource":
                    frame["objects"].append(blanks.new())
                elif frame["parse"] is None and any(k not in _SYNTAX and not k.startswith(_XML) and k.startswith("{") for k in a):
                    frame["objects"].append(blanks.new())
                frames.append(frame)
            continue
        if skip:
            skip.pop()
            continue
        frame = frames.pop()
        if frame["kind"] == "property":
            if frame["parse"] == "Literal":
                inner = (e.text or "") + "".join(ElementTree.tostring(x, encoding="unicode") for x in e)
                yield from held(frame, (inner, "literal", RDF + "XMLLiteral", None))
            elif frame["parse"] == "Collection":
                cells = [blanks.new() for _ in frame["objects"]]
                for k, (cell, o) in enumerate(zip(cells, frame["objects"], strict=True)):
                    yield _triple(graph, cell, RDF + "first", o)
                    yield _triple(graph, cell, RDF + "rest", cells[k + 1] if k + 1 < len(cells) else (RDF + "nil", "iri"))
                yield from held(frame, cells[0] if cells else (RDF + "nil", "iri"))
            elif frame["objects"]:
                yield from held(frame, frame["objects"][0])
                if frame["parse"] is None:
                    yield from attributes(frame["objects"][0], frame["attributes"], frame["lang"])
            else:
                yield from held(frame, _literal(e.text or "", frame["datatype"], frame["lang"]))
        if frame["kind"] == "node" and not (frames and frames[-1].get("parse") == "Literal"):
            e.clear()


class JsonLd:
    """Triples of a JSON-LD document: contexts with prefixes, terms, types, languages and containers; nested nodes, lists, sets, graphs and reverse properties."""

    def __init__(self, text: str, graph: str, base: str = ""):
        self.graph, self.blanks, self.out = graph, _Blanks(graph), []
        self.document = json.loads(text)
        self.start = {"@base": base, "@vocab": None, "@language": None, "terms": {}}

    def parse(self) -> list[tuple]:
        for x in self.document if isinstance(self.document, list) else [self.document]:
            self.node(x, self.start)
        return self.out

    def context(self, c: dict, given) -> dict:
        for one in given if isinstance(given, list) else [given]:
            if one is None:
                c = dict(self.start)
                continue
            if isinstance(one, str):
                raise ValueError(f"{self.graph}: the context {one!r} is elsewhere")
            c = {**c, "terms": dict(c["terms"])}
            for k in ("@vocab", "@language"):
                if k in one:
                    c[k] = one[k]
            if "@base" in one:
                c["@base"] = urljoin(c["@base"], one["@base"] or "")
            for term, d in one.items():
                if not term.startswith("@"):
                    c["terms"][term] = d if isinstance(d, dict) or d is None else {"@id": d}
        return c

    def address(self, c: dict, name: str, vocab: bool, depth: int = 0) -> str | None:
        """The whole address of a name; None for a term that means nothing."""
        if name.startswith("@") or depth > 20:
            return name
        terms = c["terms"]
        if vocab and name in terms:
            d = terms[name]
            if d is None or d.get("@id", name) is None:
                return None
            target = d.get("@id", d.get("@reverse", name))
            if target != name:
                return self.address(c, target, True, depth + 1)
        prefix, colon, rest = name.partition(":")
        if colon:
            if prefix == "_":
                return self.blanks.called(rest)[0]
            d = terms.get(prefix)
            if rest.startswith("//") or not d or not d.get("@id"):
                return name
            return self.address(c, d["@id"], True, depth + 1) + rest
        if vocab:
            return None if c["@vocab"] is None else c["@vocab"] + name
        return urljoin(c["@base"], name)

    def reference(self, c: dict, name: str, vocab: bool = False) -> tuple | None:
        a = self.address(c, name, vocab) or (urljoin(c["@base"], name) if vocab else None)
        return None if a is None else (a, "bnode" if a.startswith("_:") else "iri")

    def add(self, s: tuple, p: str, o: tuple | None) -> None:
        if o is not None:
            self.out.append(_triple(self.graph, s, p, o))

    def node(self, x: dict, c: dict) -> tuple | None:
        c = self.context(c, x["@context"]) if "@context" in x else c
        words = {k: self.address(c, k, True) for k in x}
        by = {w: x[k] for k, w in words.items() if w and w.startswith("@")}
        me = self.reference(c, by["@id"]) if isinstance(by.get("@id"), str) else self.blanks.new()
        for t in _many(by.get("@type", [])):
            self.add(me, RDF + "type", self.reference(c, t, True))
        for inner in _many(by.get("@graph", [])):
            self.node(inner, c)
        for k, values in by.get("@reverse", {}).items():
            for v in _many(values):
                self.add(self.value(v, c, {}), self.address(c, k, True), me)
        for k, p in words.items():
            if p is None or p.startswith("@") or ":" not in p:
                continue
            d = c["terms"].get(k) or {}
            container = d.get("@container")
            v = x[k]
            if "@reverse" in d:
                for one in _many(v):
                    self.add(self.value(one, c, d), p, me)
            elif container == "@list":
                self.add(me, p, self.list(_many(v), c, d))
            elif container == "@language" and isinstance(v, dict):
                for lang, texts in v.items():
                    for text in _many(texts):
                        self.add(me, p, _literal(text, None, lang if lang != "@none" else None))
            elif container in ("@index", "@id") and isinstance(v, dict):
                for one in v.values():
                    for y in _many(one):
                        self.add(me, p, self.value(y, c, d))
            else:
                for one in _many(v):
                    self.add(me, p, self.value(one, c, d))
        return me

    def list(self, values: Iterable, c: dict, d: dict) -> tuple:
        items = [o for v in values if (o := self.value(v, c, d)) is not None]
        cells = [self.blanks.new() for _ in items]
        for k, (cell, o) in enumerate(zip(cells, items, strict=True)):
            self.add(cell, RDF + "first", o)
            self.add(cell, RDF + "rest", cells[k + 1] if k + 1 < len(cells) else (RDF + "nil", "iri"))
        return cells[0] if cells else (RDF + "nil", "iri")

    def value(self, v, c: dict, d: dict) -> tuple | None:
        if v is None:
            return None
        if isinstance(v, dict):
            own = {self.address(c, k, True): x for k, x in v.items()}
            if "@value" in own:
                x = own["@value"]
                kind = own.get("@type")
                return None if x is None else self.plain(x, self.address(c, kind, True) if kind else None, own.get("@language"))
            if "@list" in own:
                return self.list(_many(own["@list"]), c, d)
            return self.node(v, c)
        kind = d.get("@type")
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            return self.reference(c, v, kind == "@vocab")
        return self.plain(v, self.address(c, kind, True) if kind and not kind.startswith("@") else None, d["@language"] if "@language" in d else c["@language"])

    @staticmethod
    def plain(x, datatype: str | None, lang: str | None) -> tuple:
        if isinstance(x, bool):
            return _literal("true" if x else "false", datatype or XSD + "boolean", None)
        if isinstance(x, int | float):
            if isinstance(x, int) or math.isfinite(x) and x == int(x) and abs(x) < 1e21 and datatype != XSD + "double":
                return _literal(str(int(x)), datatype or XSD + "integer", None)
            mantissa, _, power = f"{x:.15E}".partition("E")
            mantissa = mantissa.rstrip("0")
            return _literal(f"{mantissa + '0' if mantissa.endswith('.') else mantissa}E{int(power)}", datatype or XSD + "double", None)
        return _literal(str(x), datatype, lang)


def _many(v) -> list:
    """A value as a list; sets within it are opened."""
    out = []
    for x in v if isinstance(v, list) else [v]:
        out += _many(x["@set"]) if isinstance(x, dict) and "@set" in x else [x]
    return out


def parse(text: str, graph: str, form: str) -> Iterable[tuple]:
    """Triples of a text in a format: xml, turtle or json-ld."""
    text = text.removeprefix("﻿")
    return rdf_xml(text, graph, graph) if form == "xml" else JsonLd(text, graph, graph).parse() if form == "json-ld" else Turtle(text, graph).parse()


def triples(spark: SparkSession, paths: str | list[str], rows: int = 10_000) -> DataFrame:
    """Distinct triples of files in the format that their endings say; other endings are RDF/XML. A file is read by one task, and its triples leave it ``rows`` at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.col("path").alias("graph"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for graph, content in zip(pdf["graph"], pdf["content"], strict=True):
                part = []
                for t in parse(bytes(content).decode("utf-8-sig"), graph, ENDINGS.get(graph.rpartition(".")[2].lower(), "xml")):
                    part.append(t)
                    if len(part) == rows:
                        yield pd.DataFrame(part, columns=NAMES)
                        part = []
                yield pd.DataFrame(part, columns=NAMES)

    return files.mapInPandas(run, TRIPLE).dropDuplicates()


def parse_column(texts: DataFrame, form: str, text: str = "text", graph: str = "graph") -> DataFrame:
    """Distinct triples of texts in one format, one a row, each with the name of its graph. A null text has none."""
    return texts.select(text, graph).mapInPandas(lambda batches: frames(batches, text, graph, lambda x, g: parse(x, g, form)), TRIPLE).dropDuplicates()
