"""Shapes against triples: components, paths, logic and classes, each with what must fail and what must not."""

import pytest

from crosswalk.operators import shacl
from crosswalk.sources.rdf import parse_text

HEAD = """@prefix x: <http://e.test/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
"""
DATA = HEAD + """
x:Boss rdfs:subClassOf x:Person . x:Chief rdfs:subClassOf x:Boss .
x:a a x:Person ; x:name "Ann" ; x:age 30 ; x:knows x:b, x:c ; x:code "A-1" ; x:rank "low" .
x:b a x:Chief ; x:name "Bob", "Rob"@en, "Bert"@en ; x:age "old" ; x:knows x:z ; x:code "b1" ; x:rank "odd" ; x:email "b@e" .
x:c a x:Person ; x:age -1 ; x:knows "text" ; x:parent x:a ; x:phone "1" ; x:email "c@e" .
x:z x:name "thing" . x:d a x:Dog ; x:owner x:b . x:e a x:Dog ; x:owner x:a, x:d . x:f x:next x:g . x:g x:next x:h . x:h x:next x:f ; x:end "yes" .
"""


def failures(spark, shapes, data=DATA):
    got = shacl.validate(parse_text(spark, data), parse_text(spark, HEAD + shapes, "shapes"))
    short = lambda v: v and v.replace("http://e.test/", "")
    return sorted((short(r["focus"]), short(r["path"]), short(r["value"]), r["component"], r["severity"]) for r in got.collect()), got


CASES = {
    "counts": ("x:S a sh:NodeShape ; sh:targetClass x:Person ; sh:property [ sh:path x:name ; sh:minCount 1 ; sh:maxCount 2 ; sh:severity sh:Warning ] .", [("b", "name", None, "maxCount", "warning"), ("c", "name", None, "minCount", "warning")]),
    "datatype and limits": ("x:S a sh:NodeShape ; sh:targetClass x:Person ; sh:property [ sh:path x:age ; sh:datatype xsd:integer ; sh:minInclusive 0 ] .", [("b", "age", "old", "datatype", "error"), ("b", "age", "old", "minInclusive", "error"), ("c", "age", "-1", "minInclusive", "error")]),
    "class with subclasses": ("x:S sh:targetClass x:Person ; sh:property [ sh:path x:knows ; sh:class x:Person ] .", [("b", "knows", "z", "class", "error"), ("c", "knows", "text", "class", "error")]),
    "node kind": ("x:S sh:targetClass x:Person ; sh:property [ sh:path x:knows ; sh:nodeKind sh:BlankNodeOrIRI ] .", [("c", "knows", "text", "nodeKind", "error")]),
    "pattern and length": ('x:S sh:targetSubjectsOf x:code ; sh:property [ sh:path x:code ; sh:pattern "^[A-Z]-" ; sh:flags "s" ; sh:minLength 3 ] .', [("b", "code", "b1", "minLength", "error"), ("b", "code", "b1", "pattern", "error")]),
    "in": ('x:S sh:targetObjectsOf x:knows ; sh:property [ sh:path x:rank ; sh:in ("low" "high" x:b) ] .', [("b", "rank", "odd", "in", "error")]),
    "has value": ("x:S sh:targetClass x:Person ; sh:property [ sh:path x:knows ; sh:hasValue x:b ] .", [("b", "knows", None, "hasValue", "error"), ("c", "knows", None, "hasValue", "error")]),
    "unique languages": ("x:S sh:targetClass x:Person ; sh:property [ sh:path x:name ; sh:uniqueLang true ] .", [("b", "name", None, "uniqueLang", "error")]),
    "inverse path": ("x:S sh:targetClass x:Person ; sh:property [ sh:path [ sh:inversePath x:owner ] ; sh:minCount 1 ; sh:class x:Dog ] .", [("c", "^owner", None, "minCount", "error")]),
    "sequence path": ("x:S sh:targetClass x:Dog ; sh:property [ sh:path ( x:owner x:knows ) ; sh:class x:Person ] .", [("d", "owner/knows", "z", "class", "error")]),
    "alternative path": ("x:S sh:targetClass x:Person ; sh:property [ sh:path [ sh:alternativePath ( x:email x:phone ) ] ; sh:minCount 1 ; sh:maxCount 1 ] .", [("a", "email|phone", None, "minCount", "error"), ("c", "email|phone", None, "maxCount", "error")]),
    "paths of any length": ('x:S sh:targetNode x:f, x:d ; sh:property [ sh:path ( [ sh:zeroOrMorePath x:next ] x:end ) ; sh:minCount 1 ] ; sh:property [ sh:path [ sh:oneOrMorePath x:next ] ; sh:minCount 3 ] ; sh:property [ sh:path [ sh:zeroOrOnePath x:next ] ; sh:maxCount 1 ] .', [("d", "(next)*/end", None, "minCount", "error"), ("d", "(next)+", None, "minCount", "error"), ("f", "(next)?", None, "maxCount", "error")]),
    "inverse of a sequence": ("x:S sh:targetNode x:z, x:d ; sh:property [ sh:path [ sh:inversePath ( x:owner x:knows ) ] ; sh:hasValue x:d ] .", [("d", "^owner/knows", None, "hasValue", "error")]),
    "or": ("x:S sh:targetClass x:Person ; sh:or ( [ sh:property [ sh:path x:email ; sh:minCount 1 ] ] [ sh:property [ sh:path x:code ; sh:pattern \"^A\" ] ; sh:property [ sh:path x:code ; sh:minCount 1 ] ] ) .", []),
    "or that fails": ("x:S sh:targetClass x:Person ; sh:or ( [ sh:path x:phone ; sh:minCount 1 ] [ sh:path x:code ; sh:pattern \"^A\" ; sh:minCount 1 ] ) .", [("b", None, "b", "or", "error")]),
    "and, not": ("x:S sh:targetClass x:Person ; sh:and ( [ sh:path x:age ; sh:maxCount 1 ] [ sh:path x:name ; sh:minCount 1 ] ) ; sh:not [ sh:path x:parent ; sh:minCount 1 ] .", [("c", None, "c", "and", "error"), ("c", None, "c", "not", "error")]),
    "xone": ("x:S sh:targetClass x:Person ; sh:xone ( [ sh:path x:phone ; sh:minCount 1 ] [ sh:path x:email ; sh:minCount 1 ] ) .", [("a", None, "a", "xone", "error"), ("c", None, "c", "xone", "error")]),
    "node and nested properties": ("x:S sh:targetClass x:Dog ; sh:property [ sh:path x:owner ; sh:node x:P ; sh:property [ sh:path x:name ; sh:minCount 1 ] ] . x:P a sh:NodeShape ; sh:class x:Person .", [("d", "name", None, "minCount", "error"), ("e", "owner", "d", "node", "error")]),
    "equals, disjoint": ("x:S sh:targetNode x:b, x:a ; sh:property [ sh:path x:name ; sh:disjoint x:rank ; sh:equals x:nick ] .", [("a", "name", "Ann", "equals", "error"), ("b", "name", "Bert", "equals", "error"), ("b", "name", "Bob", "equals", "error"), ("b", "name", "Rob", "equals", "error")]),
    "closed": ("x:S sh:targetNode x:h, x:z ; sh:closed true ; sh:ignoredProperties ( x:end ) ; sh:property [ sh:path x:next ; sh:minCount 0 ] .", [("z", None, "thing", "closed", "error")]),
    "implicit class, deactivated": ("x:Dog a owl:Class, sh:NodeShape ; sh:property x:Off , [ sh:path x:owner ; sh:maxCount 1 ] . x:Off sh:path x:name ; sh:minCount 1 ; sh:deactivated true . x:T sh:targetClass x:Dog ; sh:deactivated true ; sh:class x:Person .", [("e", "owner", None, "maxCount", "error")]),
}


def test_components(spark):
    """All cases are one shapes graph; a result belongs to the case whose shape leads to the one that failed."""
    text = HEAD + "".join(shapes.replace("x:S ", f"x:S{k} ").replace("x:Off", f"x:Off{k}").replace("x:P ", f"x:P{k} ") for k, (shapes, _) in enumerate(CASES.values()))
    shapes = parse_text(spark, text, "shapes")
    graph, case = shacl.ShapeGraph(shapes.collect()), {}

    def below(k, name):
        case[name] = k
        for _, _, m in graph.shapes[name].members:
            below(k, m)

    for k in range(len(CASES)):
        root = f"http://e.test/S{k}" if f"http://e.test/S{k}" in graph.shapes else "http://e.test/Dog"
        below(k, root)
    found = {k: [] for k in range(len(CASES))}
    short = lambda v: v and v.replace("http://e.test/", "")
    for r in shacl.validate(parse_text(spark, DATA), shapes).collect():
        found[case[r["shape"]]].append((short(r["focus"]), short(r["path"]), short(r["value"]), r["component"], r["severity"]))
    for k, (name, (_, want)) in enumerate(CASES.items()):
        assert sorted(found[k], key=repr) == sorted(want, key=repr), name


def test_refused_and_empty(spark):
    with pytest.raises(ValueError, match="itself"):
        failures(spark, "x:S sh:targetClass x:Person ; sh:property x:P . x:P sh:path x:knows ; sh:node x:S .")
    data = parse_text(spark, DATA)
    assert shacl.validate(data, data.where("false")).count() == 0 and shacl.validate(data, data.where("false")).columns == shacl.RESULT
    assert failures(spark, CASES["counts"][0], HEAD + 'x:q x:name "n" .')[0] == []
