"""RDF/XML and JSON-LD against Turtle that says the same; blank nodes are compared by what hangs on them."""

import pytest

from crosswalk.sources import rdf_formats
from crosswalk.sources.rdf import Turtle

XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:x="http://e.test/ns#" xml:base="http://e.test/ns">
  <owl:Class rdf:about="#Permit" x:code="P1">
    <rdfs:label xml:lang="EN">Permit &amp; more</rdfs:label><rdfs:label>Permit</rdfs:label>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#number"/><owl:cardinality rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">1</owl:cardinality></owl:Restriction></rdfs:subClassOf>
    <owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="http://e.test/ns#A"/><owl:Class rdf:about="http://e.test/ns#B"/></owl:unionOf>
    <x:part rdf:parseType="Resource"><x:size>3</x:size><x:of rdf:nodeID="k"/></x:part>
  </owl:Class>
  <rdf:Description rdf:nodeID="k"><x:name>kay</x:name></rdf:Description>
  <rdf:Bag rdf:ID="bag"><rdf:li>one</rdf:li><rdf:li rdf:resource="#two"/></rdf:Bag>
  <x:Thing rdf:about="http://e.test/t"><x:short x:a="1" x:b="2"/><x:empty/><x:list rdf:parseType="Collection"/></x:Thing>
</rdf:RDF>"""
TURTLE = """@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix x: <http://e.test/ns#> .
x:Permit a owl:Class ; x:code "P1" ; rdfs:label "Permit & more"@en, "Permit" ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty x:number ; owl:cardinality 1 ] ; owl:unionOf ( x:A x:B ) ; x:part [ x:size "3" ; x:of _:k ] .
x:B a owl:Class . _:k x:name "kay" . x:bag a rdf:Bag ; rdf:_1 "one" ; rdf:_2 x:two . <http://e.test/t> a x:Thing ; x:short [ x:a "1" ; x:b "2" ] ; x:empty "" ; x:list () .
"""
JSON = """{"@context": {"@vocab": "http://e.test/ns#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "x": "http://e.test/ns#",
  "label": {"@id": "rdfs:label", "@container": "@language"}, "unionOf": {"@id": "owl:unionOf", "@type": "@id", "@container": "@list"}, "onProperty": {"@id": "owl:onProperty", "@type": "@vocab"},
  "within": {"@reverse": "x:of"}, "id": "@id", "nothing": null},
 "@graph": [
  {"id": "x:Permit", "@type": "owl:Class", "code": "P1", "label": {"en": "Permit & more", "@none": "Permit"}, "rdfs:subClassOf": {"@type": "owl:Restriction", "onProperty": "number", "owl:cardinality": 1}, "unionOf": ["x:A", "x:B"], "nothing": 3},
  {"@id": "_:k", "name": "kay", "within": {"size": {"@value": "3"}, "@reverse": {"part": {"@id": "x:Permit"}}}},
  {"@id": "x:B", "@type": ["owl:Class"]}, {"@id": "x:bag", "@type": "rdf:Bag", "rdf:_1": "one", "rdf:_2": {"@id": "x:two"}},
  {"@id": "http://e.test/t", "@type": "Thing", "short": {"a": "1", "b": "2"}, "empty": "", "list": {"@list": []}}]}"""


def shape(triples):
    """Triples with each blank node written as all that hangs on it."""
    by = {}
    for _, s, _, p, o, kind, datatype, lang in triples:
        by.setdefault(s, []).append((p, o, kind, datatype, lang))

    def write(node, seen=()):
        if node in seen:
            return "again"
        return tuple(sorted((p, repr(write(o, (*seen, node))) if k == "bnode" else o, k, str(d), str(lang)) for p, o, k, d, lang in by.get(node, [])))

    return sorted((s if not s.startswith("_:") else "blank", write(s)) for s in by)


def test_twins():
    want = shape(set(Turtle(TURTLE, "g").parse()))
    assert shape(set(rdf_formats.rdf_xml(XML, "g"))) == want
    assert shape(set(rdf_formats.JsonLd(JSON, "g").parse())) == want


def test_details():
    xml = lambda body: sorted(rdf_formats.rdf_xml(f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://e.test/ns#" xml:lang="fr">{body}</rdf:RDF>', "g", "http://base.test/d"))
    assert [t[1:] for t in xml('<rdf:Description rdf:about=""><x:p>un</x:p><x:p xml:lang="">two</x:p></rdf:Description>')] == [("http://base.test/d", "iri", "http://e.test/ns#p", "two", "literal", "http://www.w3.org/2001/XMLSchema#string", None), ("http://base.test/d", "iri", "http://e.test/ns#p", "un", "literal", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "fr")]
    (t,) = xml('<rdf:Description rdf:about="a"><x:p rdf:parseType="Literal">m <b>n</b> o</x:p></rdf:Description>')
    assert t[4] == "m <b>n</b> o" and t[6].endswith("XMLLiteral")
    told = xml('<rdf:Description rdf:about="a"><x:p rdf:ID="s" rdf:resource="b"/></rdf:Description>')
    assert {(t[1], t[3].rpartition("#")[2], t[4].rpartition("#")[2]) for t in told} == {("http://base.test/a", "p", "http://base.test/b"), ("http://base.test/d#s", "type", "Statement"), ("http://base.test/d#s", "subject", "http://base.test/a"), ("http://base.test/d#s", "predicate", "p"), ("http://base.test/d#s", "object", "http://base.test/b")}
    (one,) = rdf_formats.rdf_xml('<x:T xmlns:x="http://e.test/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" rdf:about="u"/>', "g", "http://b.test/")
    assert one[1:6] == ("http://b.test/u", "iri", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e.test/T", "iri")
    ld = lambda text: {(t[1], t[3], t[4], t[6] and t[6].rpartition("#")[2], t[7]) for t in rdf_formats.JsonLd(text, "g", "http://b.test/").parse()}
    assert ld('{"@context": {"@vocab": "v:", "@language": "de", "d": {"@id": "v:d", "@type": "v:day"}}, "@id": "i", "t": ["x", true, 2, 2.5, null, {"@value": "y", "@language": "EN"}, {"@set": ["z"]}], "d": "1.1."}') == {
        ("http://b.test/i", "v:t", "x", "langString", "de"), ("http://b.test/i", "v:t", "true", "boolean", None), ("http://b.test/i", "v:t", "2", "integer", None), ("http://b.test/i", "v:t", "2.5E0", "double", None),
        ("http://b.test/i", "v:t", "y", "langString", "en"), ("http://b.test/i", "v:t", "z", "langString", "de"), ("http://b.test/i", "v:d", "1.1.", "v:day", None)}
    with pytest.raises(ValueError, match="elsewhere"):
        ld('{"@context": "http://e.test/context.json"}')
    with pytest.raises(Exception, match="mismatched|not well-formed|no element"):
        list(rdf_formats.rdf_xml("<a><b></a>", "g"))


def test_files_by_ending(spark, tmp_path):
    for name, text in (("a.owl", XML), ("b.ttl", TURTLE), ("c.jsonld", JSON), ("d.unknown", XML), ("e.nt", "<http://e.test/s> <http://e.test/p> \"v\" .\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    t = rdf_formats.triples(spark, str(tmp_path), rows=7).collect()
    by = {}
    for r in t:
        by.setdefault(r["graph"].rpartition("/")[2], []).append(tuple(r))
    assert shape(by["a.owl"]) == shape(by["b.ttl"]) == shape(by["c.jsonld"]) == shape(by["d.unknown"]) and len(by["e.nt"]) == 1
    texts = spark.createDataFrame([(XML, "g"), (None, "h")], "text string, graph string")
    assert shape([tuple(r) for r in rdf_formats.parse_column(texts, "xml").collect()]) == shape(by["b.ttl"])
