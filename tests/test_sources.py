from pyspark.sql import functions as F

from crosswalk.sinks import emit, tables
from crosswalk.sources import extract, models, rdf

TURTLE = """@prefix x: <http://example.test/ns#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
x:Permit a owl:Class ; rdfs:label "Permit"@en , "Permit" ; rdfs:comment "A permission." ; rdfs:subClassOf x:Record .
x:Record a owl:Class ; rdfs:label "Record" .
x:issuedBy a owl:ObjectProperty ; rdfs:domain x:Permit ; rdfs:range x:Office .
x:number a owl:DatatypeProperty ; rdfs:domain x:Permit , x:Record ; rdfs:range xsd:string .
x:PermitShape a sh:NodeShape ; sh:targetClass x:Permit ; sh:property [ sh:path x:number ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ] .
[] rdfs:member ( x:Permit 3 2.5 true ) .
"""
CSV = [("Permit", None, None, None, "A permission."), (None, "number", "string", "1", "Element# 4\nThe number."), (None, "issuedBy", "(Office)", "0..1", "User Story: who gave it"), (None, "<note>", "string", None, None), (None, "record", "Record", "0..*", None), ("Record", None, None, None, None), (None, "permit", "Permit", "*", None), (None, "at", "dateTime", "1", None)]
XML = """<Model><Class id="nc.PermitType"><Name>PermitType</Name><DefinitionText>A permission.</DefinitionText><ExtensionOfClass ref="structures.ObjectType"/>
<HasProperty><DatatypeProperty ref="nc.Number"/><MinOccursQuantity>0</MinOccursQuantity><MaxOccursQuantity>unbounded</MaxOccursQuantity></HasProperty></Class></Model>"""
NAMES = {"x": "http://example.test/ns#"}


def test_turtle(spark):
    t = rdf.parse_text(spark, TURTLE)
    assert t.where("p like '%#first'").count() == 4 and t.where("o_lang = 'en'").count() == 1 and t.where("o_datatype like '%#decimal' and o = '2.5'").count() == 1
    same = rdf.parse_text(spark, TURTLE + "x:Record a owl:Class .")
    assert same.count() == t.count()
    assert rdf.file_roles(t).first()["role"] == "ontology"


def test_files_are_read_as_a_whole(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix x: <http://e.test/> .\nx:a x:p 'it''s' .".replace("''", "\\'"))
    (tmp_path / "b.nt").write_text('<http://e.test/a> <http://e.test/p> "two\\nlines" .\n')
    got = rdf.triples(spark, str(tmp_path)).orderBy("o").collect()
    assert [r["o"] for r in got] == ["it's", "two\nlines"]


def test_extraction(spark):
    t = rdf.parse_text(spark, TURTLE)
    p = {r["qname"]: r for r in extract.properties(t, NAMES).collect()}
    assert p["x:number"]["domain"] == ["x:Permit", "x:Record"] and p["x:number"]["range"] == [rdf.XSD + "string"] and p["x:issuedBy"]["range"] == ["x:Office"]
    assert {r["iri"][-6:]: r["label"] for r in extract.best_label(t).collect()} == {"Permit": "Permit", "Record": "Record"}
    assert extract.shapes(t, NAMES).select("class", "path", "min", "max", "datatype").first()[:4] == ("x:Permit", "x:number", 1, 1)


def test_tabular_model(spark):
    got = {(r["class"], r["attribute"]): r for r in models.csv_model(spark.createDataFrame([(*r, i) for i, r in enumerate(CSV)], "class string, attribute string, type string, multiplicity string, definition string, pos long")).collect()}
    assert got["Permit", "issuedBy"]["kind"] == "object" and got["Permit", "record"]["kind"] == "datatype" and got["Record", "permit"]["kind"] == "object"
    assert ("Permit", "<note>") not in got and got["Record", "at"]["range"] == "xs:string"


def test_csv_file(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_bytes(("﻿" + ",".join(models.CSV_COLUMNS) + '\nA,,,,"two\nlines"\n,x,int,1,\n').encode())
    assert [r["attribute"] for r in models.csv_rows(spark, str(f)).orderBy("pos").collect()] == [None, "x"]


def test_xml(spark, tmp_path):
    (tmp_path / "m.xml").write_text(XML)
    r = models.cmf_types(spark, str(tmp_path / "m.xml")).first()
    assert (r["qname"], r["base"], r["properties"][0]["property"], r["properties"][0]["max"]) == ("nc:PermitType", "structures:ObjectType", "nc:Number", "unbounded")


def test_listing(spark, tmp_path):
    for p in ("ontology/a.ttl", "seed-data/b.ttl", "x/My_Workflow.ttl", "README.md", "in.csv", "z.bin"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert {r["path"]: r["category"] for r in models.listing(spark, str(tmp_path)).collect()} == {"ontology/a.ttl": "ontology", "seed-data/b.ttl": "seed_data", "x/My_Workflow.ttl": "workflows", "README.md": "docs", "in.csv": "input_csv", "z.bin": "other"}


def test_sinks(spark, tmp_path):
    t = rdf.parse_text(spark, TURTLE).where("s_kind = 'iri' and o_kind <> 'bnode'")
    emit.write_lines(emit.named_graph(t, "http://e.test/g", {"x": "http://e.test/"}), str(tmp_path / "g"), ["section", "key"])
    text = [r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert text[0].startswith("@prefix") and text[-1] == "}"
    again = rdf.parse_text(spark, "\n".join(text[2:-1]))
    assert again.drop("graph").exceptAll(t.drop("graph")).count() == 0 and again.count() == t.count()
    nodes = spark.createDataFrame([("a'b", "C")], "id string, label string")
    lits = spark.createDataFrame([("a'b", "n", "3", rdf.XSD + "int")], "id string, name string, value string, datatype string")
    edges = spark.createDataFrame([("a'b", "C", "x:hasPart", "a'b", "C")], "src string, src_label string, type string, dst string, dst_label string")
    lines = [r["line"] for r in emit.seed_statements(nodes, lits, edges).orderBy("section").collect()]
    assert lines[0] == "CREATE (:C {id: 'a\\'b', n: 3});" and "[:HAS_PART]" in lines[1]
    rows = spark.createDataFrame([("A/b",), ("a?b",), ("c",)], "n string")
    assert len({r["file"].lower() for r in tables.file_names(rows, "n").collect()}) == 3
    assert tables.resume(rows, None, "n", str(tmp_path / "r")) == 3
    assert tables.resume(rows, spark.read.parquet(str(tmp_path / "r")).withColumn("status", F.lit("evaluated")), "n", str(tmp_path / "r")) == 0


def test_stream(spark, tmp_path):
    from crosswalk.streaming.latest import keep_latest

    for k, part in enumerate(([(1, 1, "a"), (2, 1, "x")], [(1, 2, "b")])):
        spark.createDataFrame(part, "key int, seq int, v string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    log = spark.readStream.schema("key int, seq int, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = keep_latest(log, "key", ["seq"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    assert sorted(map(tuple, spark.read.parquet(str(last)).select("key", "v").collect())) == [(1, "b"), (2, "x")]
