"""Operators that SQL can't express, or whose errors and edges matter, row by row."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from crosswalk.functions import values
from crosswalk.operators import active, catalog, decide, documents, graph, lineage, native, reports, review, search, verify
from crosswalk.sinks import emit, package
from crosswalk.sources import exchange, models, rdf


def test_chains_of_any_length(spark):
    n = 5000
    e = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    # a long cycle beside it, with a tail that leads in
    c = spark.range(100).select((F.col("id") + 10_000).alias("node"), F.when(F.col("id") == 99, F.lit(10_000)).otherwise(F.col("id") + 10_001).alias("parent"))
    c = c.unionByName(spark.createDataFrame([(20_000, 10_000), (20_001, 20_001)], "node long, parent long"))
    got = graph.chains(e.where(F.col("id") % 1 == 0).unionByName(c))
    sizes = {r["node"]: r["n"] for r in got.where("node in (0, 70, 4999, 10000, 10050, 20000, 20001)").select("node", F.size("chain").alias("n")).collect()}
    assert sizes == {0: 0, 70: 70, 4999: 4999, 10000: 99, 10050: 99, 20000: 100, 20001: 0}
    kept = graph.nearest_kept(got.where("node = 4999"), spark.range(1, 5000).withColumnRenamed("id", "node"))
    assert kept.first()["nearest"] == 0
    assert graph.root_first(got.where("node = 3")).first()["chain"] == [0, 1, 2, 3]


def test_ancestors_of_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", None)], "node string, parent string")
    got = graph.ancestors(e).groupBy("node").agg(F.sort_array(F.collect_list("ancestor")).alias("a"))
    assert dict((r["node"], r["a"]) for r in got.collect()) == {"a": ["b", "c", "d"], "b": ["a", "c", "d"], "c": ["a", "b", "d"], "d": ["a", "b", "c"]}


def test_rationales_and_new_names(spark):
    c = spark.createDataFrame([("s:A", "T"), ("s:B", "T")], "concept string, target string")
    p = spark.createDataFrame([("s:A", "s:x", "t:x"), ("s:A", "s:y", None), ("s:B", "s:x", "t:x")], "concept string, name string, target string")
    t = spark.createDataFrame([], "type string, property string")
    got = {r["concept"]: (r["action"], r["rationale"]) for r in decide.resolve(c, p, t, augmenting=False).collect()}
    assert got["s:B"] == ("reuse", "All 1 source properties have equivalents in the target ontology.") and got["s:A"][0] == "extend" and got["s:A"][1].startswith("1 of 2 source properties")
    assert [r[0] for r in p.orderBy("concept", "name").select(decide.new_property_name(F.col("name"), F.col("target"))).collect()] == [None, "y", None]


def test_numbers_without_a_single_task(spark):
    d = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("k"))
    got = lineage.numbered(d, ["k"], "n").collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(k, k + 1) for k in range(1000)]


def test_literals(spark):
    rows = spark.createDataFrame([(" +007 ", "integer"), ("-0", "integer"), ("1", "boolean"), (" False", "boolean"), (" 1.5 ", "double"), ("x", "boolean"), (None, "string")], "v string, t string")
    assert [r[0] for r in rows.select(values.cypher_literal(F.col("v"), F.concat(F.lit(values.XSD), "t"))).collect()] == ["7", "0", "true", "false", "1.5", "'x'", None]
    assert spark.range(1).select(values.round_even(F.lit(0.0625), 3), values.round_even(F.lit(2.5), 0)).first()[:] == (0.062, 2.0)


def test_namespaces_by_longest_base(spark):
    t = spark.createDataFrame([("http://a/b#x",), ("http://a/y",), ("http://a/",), ("urn:z",), (None,)], "term string")
    n = spark.createDataFrame([("a", "http://a/"), ("b", "http://a/b#"), ("c", "http://a/b#")], "prefix string, base string")
    assert {r["term"]: r["prefix"] for r in catalog.longest_prefix(t, n).collect()} == {"http://a/b#x": "b", "http://a/y": "a", "http://a/": None, "urn:z": None, None: None}


def test_reachable_properties(spark):
    t = spark.createDataFrame([("A", "B", "object"), ("B", "A", "object"), ("C", None, "object"), ("V", None, "simple_value"), ("structures:ObjectType", None, "object")], "qname string, base string, pattern string")
    d = spark.createDataFrame([("A", "a", "q:a", "C"), ("B", "b", "q:b", "V"), ("C", "c", "q:c", "A"), ("C", "a", "q:a2", "missing"), ("V", "v", "q:v", None), ("structures:ObjectType", "r", "q:r", None)], "type string, name string, qualified string, qualifiedType string")
    got = {r["name"]: (r["qualified"], r["depth"], r["via"], r["path"]) for r in native.reachable_properties(t, d, 2).where("type = 'A'").collect()}
    assert got == {"a": ("q:a", 0, "A", "a"), "b": ("q:b", 0, "B", "b"), "c": ("q:c", 1, "C", "a/c")}
    assert native.default_base(t) == "structures:ObjectType" and native.default_base(t.limit(0)) is None
    assert {r["qname"] for r in native.terminal_types(t).collect()} == {"V", "structures:ObjectType"}
    assert native.reachable_properties(t.limit(0), d, 2).count() == 0


def test_augmentations_and_assembly(spark):
    t = spark.createDataFrame([("nc:CaseType", None), ("j:CaseAugmentationType", None), ("j:LostAugmentationType", None)], "qname string, base string")
    m = spark.createDataFrame([("j:CaseAugmentationType", "CaseJudge"), ("j:CaseAugmentationType", "CaseAugmentationPoint"), ("nc:CaseType", "CaseTitle")], "type string, name string")
    assert native.augmentation_map(t, m).collect()[0].asDict(True) == {"base": "nc:CaseType", "augmentations": [{"augmentation": "j:CaseAugmentationType", "properties": ["CaseJudge"]}]}
    assert {r["qname"]: r["properties"] for r in native.assemble(t, m).collect()}["j:LostAugmentationType"] == []


def test_search_over_kept_indexes(spark, tmp_path):
    embed = documents.hashed(32)
    e = spark.createDataFrame([("t:Person", "Person", "a human being", "type", ""), ("t:Car", "Car", "a vehicle on four wheels", "type", ""), ("t:Empty", "", "", "type", "")], "id string, label string, definition string, kind string, context string")
    v = documents.vectors(e, embed)
    assert all(r[0] == pytest.approx(1.0) for r in v.select(search.inner_product(F.col("vec"), F.col("vec"))).collect())
    documents.write_index(v, str(tmp_path), "demo-1.0", "types")
    kept = documents.read_index(spark, str(tmp_path), "demo-1.0", "types")
    assert documents.search_one(spark, "vehicle with wheels", kept, embed, 1).first()["t"] == "t:Car"
    c = spark.createDataFrame([("s:Automobile", "a vehicle on wheels", ["s:Thing"])], "qname string, definition string, superClasses array<string>")
    p = spark.createDataFrame([("s:Automobile", None, "human", "a human being"), ("s:Automobile", "x:own", "own", "")], "concept string, qname string, name string, definition string")
    assert documents.search_types(c, kept, embed, 1).first()["t"] == "t:Car"
    assert documents.search_types(c, kept, embed, 1, F.col("id") != "t:Car").first()["t"] != "t:Car"
    assert {r["q"] for r in documents.search_properties(c, p, kept, embed, 1).collect()} == {"s:human", "x:own"}
    assert documents.delete_index(spark, str(tmp_path), "demo-1.0") and not documents.delete_index(spark, str(tmp_path), "demo-1.0")
    assert documents.name_and_version("a-b-1.0") == ("a-b", "1.0") and documents.safe("../x") == ".._x"
    with pytest.raises(ValueError):
        documents.safe("..")


MODEL = """<Model xmlns="http://m.test/" xmlns:structures="http://s.test/"><Namespace structures:id="nc"><NamespaceURI>http://nc.test/</NamespaceURI></Namespace>
<Class structures:id="nc.A"><Name>A</Name><Namespace structures:ref="nc"/><ExtensionOfClass structures:ref="nc.B"/><HasProperty><Property structures:ref="nc.p"/><MinOccursQuantity>0</MinOccursQuantity><MaxOccursQuantity>1</MaxOccursQuantity></HasProperty></Class>
<Class structures:id="nc.B"><Name>B</Name><Namespace structures:ref="nc"/></Class><Class structures:id="nc.Z"><Name>Z</Name><Namespace structures:ref="nc"/></Class>
<DatatypeProperty structures:id="nc.p"><Name>p</Name><Namespace structures:ref="nc"/><Datatype structures:ref="xs.string"/></DatatypeProperty></Model>"""


def test_reference_models(spark, tmp_path):
    (tmp_path / "ref.cmf.gz").write_bytes(gzip.compress(MODEL.encode()))
    m = exchange.reference_model(spark, str(tmp_path), "ref.cmf.gz")
    assert exchange.reference_model(spark, str(tmp_path), "ref.cmf.gz") is m
    with pytest.raises(ValueError):
        exchange.reference_model(spark, str(tmp_path / "sub"), "../ref.cmf.gz")
    assert {tuple(r) for r in exchange.class_identities(m).collect()} == {("http://nc.test/", x) for x in "ABZ"}
    assert exchange.properties(m).first()["containingTypes"] == ["nc:A"] and exchange.index(m).count() == 5
    # the same model with another prefix is the same, one with another property is a conflict
    other = spark.createDataFrame([(MODEL.replace('"nc.', '"x.').replace('"nc"', '"x"'),)], "xml string")
    assert exchange.conflicts(m.unionByName(exchange.components(other))).count() == 0
    with pytest.raises(ValueError, match="http://nc.test/ A"):
        exchange.index(m.unionByName(exchange.components(other.withColumn("xml", F.replace("xml", F.lit("<MaxOccursQuantity>1"), F.lit("<MaxOccursQuantity>2"))))))
    local = exchange.components(spark.createDataFrame([('<Model><Class id="my.C"><Name>C</Name><SubClassOf ref="nc.A"/></Class></Model>',)], "xml string"))
    assert {r["id"] for r in exchange.completed(local, m).collect()} == {"my.C", "nc.A", "nc.B", "nc.p", "nc"}
    assert {r["id"] for r in exchange.completed(local, m, ["nc.A"]).collect()} == {"my.C"}
    assert {r["ref"] for r in exchange.unbound(m).collect()} == {"xs.string"} and exchange.builtin(spark).where("id = 'xs.string'").count() == 1
    with pytest.raises(Exception, match="(?i)parse|mismatched|syntax|not well-formed|unclosed"):
        exchange.components(spark.createDataFrame([("<Model><Class>",)], "xml string")).collect()


def test_pages_and_tables_from_elsewhere(spark, tmp_path):
    def fetch(url):
        page = int(url.rsplit("=", 1)[1])
        return {"content": [{"qname": f"t{page}_{k}"} for k in range(3)], "last": page == 2}

    assert exchange.paged(spark, "http://x.test/?page={page}", "qname string", fetch).count() == 9
    with pytest.raises(Exception, match="gone"):
        exchange.paged(spark, "http://x.test/?page={page}", "qname string", lambda url: (_ for _ in ()).throw(OSError("gone")), tries=2, wait=0).collect()
    (tmp_path / "t.csv").write_text("A,B\n1,2\n")
    df, lost = exchange.checked_csv(spark, str(tmp_path / "t.csv"), ["A", "C"])
    assert df.count() == 1 and lost == ["C"]


def test_code_lists(spark):
    whole = '<CodeList><Identification><ShortName>Colors</ShortName></Identification><ColumnSet><Column Id="k1"><CanonicalUri>urn:x:name</CanonicalUri></Column><Column Id="k2"><CanonicalUri>urn:x:code</CanonicalUri></Column></ColumnSet><SimpleCodeList><Row><Value ColumnRef="k1"><SimpleValue>Red</SimpleValue></Value><Value ColumnRef="k2"><SimpleValue>R</SimpleValue></Value></Row><Row><Value ColumnRef="k2"><SimpleValue>B</SimpleValue></Value></Row></SimpleCodeList></CodeList>'
    broken = whole[: whole.index("<Row><Value ColumnRef=\"k2\"><SimpleValue>B")] + "<Row><Value"
    got = exchange.genericode(spark.createDataFrame([(whole,), (broken,), (None,)], "xml string")).collect()
    assert [tuple(r) for r in got] == [("Colors", "R", "Red"), ("Colors", "B", None), ("Colors", "R", "Red")]


def test_lines_of_triples(spark, tmp_path):
    text = '# note\n<http://e/a> <http://e/p> "two\\nlines \\u00e9 \\"q\\"" .\n_:x <http://e/p> _:x .\n<http://e/a> <http://e/q> "1"^^<http://www.w3.org/2001/XMLSchema#int> . # end\n\n<http://e/a> <http://e/l> "hallo"@DE .\n<http://e/a> <http://e/l> "hallo"@DE .\n'
    (tmp_path / "a.nt").write_text(text)
    a, b = rdf.ntriples(spark, str(tmp_path / "a.nt")), rdf.triples(spark, str(tmp_path / "a.nt"))
    assert a.columns == b.columns
    key = lambda df: sorted((r["p"], r["o"] if r["o_kind"] != "bnode" else "b", r["s_kind"], r["o_kind"], r["o_datatype"], r["o_lang"]) for r in df.collect())
    assert key(a) == key(b) and len(key(a)) == 4
    (tmp_path / "bad.nt").write_text("<http://e/a> nonsense .\n")
    with pytest.raises(Exception, match="no statement"):
        rdf.ntriples(spark, str(tmp_path / "bad.nt")).collect()


def test_graphs_of_a_manifest(spark):
    texts = spark.createDataFrame([("p/a.ttl", "@prefix x: <http://e/> . x:a x:p 1 ."), ("p/all.ttl", "@prefix x: <http://e/> . x:a x:p 1 ."), ("p/none.ttl", None)], "graph string, text string")
    m = spark.createDataFrame([("a.ttl", "ontology"), ("all.ttl", "aggregate")], "path string, role string")
    assert [r["role"] for r in rdf.manifest_graphs(rdf.parse_column(texts), m).collect()] == ["ontology"]


def test_broken_xml_is_an_error(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<Model><Class id='a'><Name>A</Class></Model>")
    with pytest.raises(Exception):
        models.cmf_types(spark, str(tmp_path / "m.xml")).collect()


def test_saving_and_resetting(spark):
    log = spark.createDataFrame([(4, "a")], "id int, concept string")
    d = spark.createDataFrame([("b", "reuse", "T", "why"), ("a", "extend", None, "why")], "concept string, action string, target string, rationale string")
    p = spark.createDataFrame([("b", "y", "reuse-property", "t", "accepted"), ("b", "x", "create-property", None, "accepted"), ("b", "z", "create-property", None, "pending-review")], "concept string, name string, action string, target string, reviewStatus string")
    got = {r["id"]: (r["concept"], [x["name"] for x in r["propertyDecisions"]]) for r in review.saved(log, d, p).collect()}
    assert got == {5: ("a", []), 6: ("b", ["x", "y"])}
    assert review.reset(d, d.where("concept = 'a'").drop("rationale")).collect()[0].asDict() == {"concept": "a", "action": "extend", "target": None, "rationale": None}
    changes = spark.createDataFrame([("a", None)], "concept string, target string")
    rows = spark.createDataFrame([("a", "T"), ("b", "U")], "concept string, target string")
    assert dict(map(tuple, review.upsert(rows, changes, "concept").collect())) == {"a": "T", "b": "U"}
    assert dict(map(tuple, review.upsert(rows, changes, "concept", nulls=True).collect())) == {"a": None, "b": "U"}


def test_requests_and_observations(spark):
    r = spark.createDataFrame([], "id int, name string, why string, status string, created_at string, completed_at string")
    r = review.requested(review.requested(r, "one", "w", "2024-01-01"), "two", "w", "2024-01-02")
    done = review.completed(r, 1, "2024-01-03")
    assert [(x["id"], x["status"]) for x in review.by_status(done).collect()] == [(2, "pending"), (1, "completed")] and review.by_status(done, "pending").count() == 1
    assert review.completed(done, 1, "2024-09-09").where("id = 1").first()["completed_at"] == "2024-01-03"
    with pytest.raises(ValueError):
        review.completed(done, 9, "x")
    assert review.observation(3, "bug", "search", "slow", "now")[6] == "pipeline"
    for bad in (("x", "nowhere"), (" ", "pipeline")):
        with pytest.raises(ValueError):
            review.observation(3, "bug", "search", bad[0], "now", target=bad[1])


def test_review_actions(spark):
    c = spark.createDataFrame([("a", "T"), ("b", "U")], "concept string, target string")
    p = spark.createDataFrame([("a", "x", "t:x", "reuse-property", False, "pending-review", None), ("b", "y", None, "create-property", False, "pending-review", None)], "concept string, name string, target string, action string, confidenceExplicit boolean, reviewStatus string, confidence string")
    has = spark.createDataFrame([("T", "t:x"), ("W", "t:x")], "type string, property string")
    m = decide.resolve(c, p, has, "Base").withColumn("reviewStatus", F.lit("pending-review"))
    m1, p1 = review.dispatch("approve", m, p, concepts=c.where("concept = 'a'"))
    assert {r["concept"]: r["reviewStatus"] for r in m1.collect()} == {"a": "accepted", "b": "pending-review"} and p1.where("reviewStatus = 'accepted'").count() == 1
    m2, _ = review.dispatch("change_target", m, p, changes=spark.createDataFrame([("b", "W")], "concept string, target string"), target_properties=has, default_base="Base")
    got = {r["concept"]: (r["target"], r["action"], r["baseType"]) for r in m2.collect()}
    assert got == {"a": ("T", "reuse", None), "b": ("W", "extend", "W")}
    with pytest.raises(ValueError):
        review.dispatch("dance", m, p)
    stages = spark.createDataFrame([(1, "completed"), (2, "pending"), (3, "pending")], "number int, status string")
    assert review.may_start(stages, 2) and not review.may_start(stages, 3)


def test_extension_catalog(spark):
    m = spark.createDataFrame([("s:A", "extend", "accepted", "T", "AType", "T", None, None), ("s:B", "augment", "accepted", "T", None, None, "TAug", "T"), ("s:C", "extend", "pending-review", "T", "CType", "T", None, None)], "concept string, action string, reviewStatus string, target string, extensionType string, baseType string, augmentationType string, augmentsType string")
    d = spark.createDataFrame([("s:A", "s:x", "create-property", "accepted", None), ("s:A", "s:y", "reuse-property", "accepted", "t:y"), ("s:B", "s:z", "create-property", "pending", None)], "concept string, property string, action string, status string, target string")
    cls = spark.createDataFrame([("s:A", "http://s/A"), ("s:B", "http://s/B")], "qname string, iri string")
    has = spark.createDataFrame([("s:A", "s:x"), ("s:B", "s:z")], "class string, property string")
    known = spark.createDataFrame([("s:x",)], "qname string")
    got = {r["concept"]: (r["name"], r["properties"], r["baseType"]) for r in verify.extension_catalog(m, d, cls, has, known, "http://x/").collect()}
    assert got == {"s:A": ("AType", ["s:x"], "T"), "s:B": ("TAug", [], "T")}
    with pytest.raises(ValueError, match="s:A.*s:B: s:z"):
        verify.extension_catalog(m, d, cls.where("qname = 's:B'"), has.where("class = 's:A'"), known, "http://x/")


def test_stages_and_packages(spark):
    f = spark.createDataFrame([("a.ttl", 5, "ontology"), ("README.md", 0, "docs")], "path string, size int, category string")
    assert {r["check"]: r["status"] for r in verify.verify(6, f, ["a.ttl", "README.md", "lost"], "package").collect()} == {"package:a.ttl": "pass", "package:README.md": "fail", "package:lost": "fail"}
    assert verify.verify(1, f).first()["status"] == "pass" and verify.verify(2, f.limit(0)).first()["status"] == "fail"
    with pytest.raises(ValueError):
        verify.verify(9)
    n = spark.createDataFrame([("a.ttl", 3, 0)], "path string, n int, classes int")
    code = lambda files, read: [r["code"] for r in verify.input_findings(files, read).collect()]
    assert code(f.limit(0), n) == ["IV-010"] and code(f.where("path = 'README.md'"), n) == ["IV-020"] and code(f, n.limit(0)) == ["IV-030"] and code(f, n) == ["IV-040"] and code(f, n.withColumn("classes", F.lit(1))) == []
    assert verify.validated_files(f).count() == 1 and {r["key"] for r in verify.package_warnings(f).collect()} == {"shapes", "vocab"}
    model = spark.createDataFrame([("Class", "a"), ("Class", "b")], "kind string, id string")
    want = spark.createDataFrame([("Class", 2), ("Namespace", 1)], "kind string, n long")
    assert {r["check"]: r["status"] for r in verify.model_counts(model, want).collect()} == {"model-count:Class": "pass", "model-count:Namespace": "fail"}
    assert verify.conformance(model.limit(0), model.withColumn("deactivated", F.lit(False))).first()["status"] == "pass"


def test_reports(spark):
    m = spark.createDataFrame([("a", "reuse", "accepted", "best-guess", "h", "2024-01-01"), ("b", None, "pending-review", None, None, "never")], "concept string, action string, reviewStatus string, confidence string, targetDefinitionHash string, reviewedAt string")
    e = spark.createDataFrame([(1.5,), (0.5,)], "entropy double")
    got = reports.coherence(m, m, e, None).first()
    assert (got["classTotal"], got["classBestGuess"], got["hashes"], got["entropy"]["before"], got["entropy"]["after"]) == (2, 1, 1, 2.0, None) and reports.coherence(m, m).first()["entropy"] is None
    assert reports.evidence(m, m).first()[:2] == (1, 1)
    v = reports.version_manifest(m, "1.0.0", "demo").first()
    assert (v["conceptCount"], v["mappingStats"], v["totalDurationSeconds"]) == (2, {"reuse": 1, "unknown": 1}, None)
    f = spark.createDataFrame([("x_agency_package/a", 1), ("x_agency_package/b", 2), ("other/c", 3), ("top", 4)], "path string, size int")
    assert [tuple(r) for r in reports.source_packages(f).collect()] == [("x_agency_package", 2)] and {r["folder"]: r["size"] for r in reports.listing_total(f).collect()}[""] == 4
    c = spark.createDataFrame([("pass",), ("fail",)], "status string")
    t = spark.createDataFrame([(1, 2.5)], "stage int, seconds double")
    assert {r["section"] for r in reports.run_results(m, m, c, f, t).collect()} == {"class", "property", "check", "files", "seconds"}


def test_artifacts(spark):
    b = spark.createDataFrame([("core", 1, "k", "a ."), ("extensions", 1, "k", "a ."), ("extensions", 2, "l", "b .")], "file string, section int, key string, line string")
    files = {r["file"]: r["n"] for r in package.ontology_files(b).groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert files == {"core": 1, "extensions": 2, "combined": 2, "all": 2}
    s = spark.createDataFrame([("B", True), ("A", True), ("C", False)], "label string, hasStatus boolean")
    assert [r["key"] for r in package.status_index(s).collect()] == ["A"]
    p = spark.createDataFrame([("s:x", "object", "say \"hi\""), ("s:y", "datatype", "")], "qname string, kind string, label string")
    assert [r["line"] for r in package.global_properties(p, "edge").orderBy("key").collect()] == ['edge:x a owl:ObjectProperty ; rdfs:label "say \\"hi\\"" .', "edge:y a owl:DatatypeProperty ."]
    assert package.dropped(package.references(spark.createDataFrame([("z:a",)], "term string"), s.select(F.lit("q").alias("prefix")), s.select(F.lit("q:a").alias("term"), F.lit("u").alias("uri")))).first()["key"] == "z:a"
    assert set(package.sparql_templates("http://e/")) == {"list-classes", "find-instances", "describe-entity", "entity-subgraph"}
    q = spark.createDataFrame([(k, t) for k, t in package.sparql_templates("http://e/").items()], "path string, text string")
    assert {r["status"] for r in verify.query_files(q).collect()} == {"pass"}
    d = spark.createDataFrame([("new", 1), ("new", 2), ("current", 3)], "status string, key int")
    assert {r["line"] for r in package.change_impact(d).collect()} == {"- new: 2 (1, 2)", "- current: 1"}
    assert package.readme(spark.createDataFrame([("a", 1)], "path string, size int"), "T").count() == 2
    aug = spark.createDataFrame([("edge:p", "datatype", None, "nc:T")], "property string, kind string, range string, augmentedType string")
    assert package.augmentation_properties(aug).first()["line"] == "edge:p a owl:DatatypeProperty ; rdfs:domain nc:T ."


def test_exchange_models_are_read_back(spark):
    classes = spark.createDataFrame([("nc:A", "extend", "nc:B", "a & <b>"), ("nc:B", "reuse", None, None), ("nc:C", "exclude", None, None)], "qname string, action string, base string, definition string")
    props = spark.createDataFrame([("nc:p", "datatype", ["http://www.w3.org/2001/XMLSchema#date"], ""), ("nc:p", "datatype", ["http://www.w3.org/2001/XMLSchema#date"], ""), ("nc:o", "object", ["nc:C"], "")], "qname string, kind string, range array<string>, definition string")
    ranged = props.withColumn("range", package.resolved_range(F.col("kind"), F.col("range"), F.when(F.col("kind") == "object", F.lit("nc:B"))))
    members = spark.createDataFrame([("nc:A", "nc:p"), ("nc:A", "nc:p"), ("nc:A", "nc:o")], "class string, property string")
    bounds = spark.createDataFrame([("nc:A", "nc:p", 1, None)], "class string, property string, min int, max int")
    ns = package.model_namespaces(spark.createDataFrame([("nc:A",), ("zz:q",)], "term string"), spark.createDataFrame([("nc", "http://nc/")], "prefix string, uri string"))
    comp = package.model_classes(classes).unionByName(package.model_properties(ranged)).unionByName(ns)
    has = package.model_associations(members, bounds)
    back = exchange.components(package.model_xml(comp, has))
    a = exchange.types(back).where("qname = 'nc:A'").first()
    assert (a["definition"], a["base"], sorted(map(tuple, a["properties"]))) == ("a & <b>", "nc:B", [("nc:o", "0", "unbounded"), ("nc:p", "1", "unbounded")])
    assert {r["qname"]: r["range"] for r in exchange.properties(back).collect()} == {"nc:p": "xs:date", "nc:o": "nc:B"} and back.where("kind = 'Namespace'").first()["uri"] == "http://nc/"
    assert json.loads(package.model_json(comp, has).where("id = 'nc.A'").first()["json"])["base"] == "nc.B"
    r = package.model_restrictions(spark.createDataFrame([("Color", "R", "Red"), ("Color", "R", "Red"), ("Color", "B", None)], "scheme string, value string, label string")).first()
    assert r["id"] == "ColorCodeSimpleType" and [x["value"] for x in r["values"]] == ["B", "R"]
    rec = spark.createDataFrame([("nc.A", "nc.p", "0", "1", None)] * 2, "class string, property string, min string, max string, code string")
    assert package.model_augmentations(rec).count() == 1


def test_strict_schemas():
    s = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {}}}}, "c": {"anyOf": [{"type": "object", "properties": {}}]}}}
    got = exchange.strict_schema(s)
    assert got["required"] == ["a", "c"] and got["properties"]["a"]["items"]["additionalProperties"] is False and got["properties"]["c"]["anyOf"][0]["required"] == [] and "required" not in s


def test_active_edges(spark):
    m = spark.createDataFrame([("a", "exclude", "pending-review", "T"), ("b", "reuse", "pending-review", "T"), ("c", "extend", "accepted", None), ("d", None, None, None)], "concept string, action string, status string, target string")
    assert [r["qname"] for r in active.active(m).collect()] == ["c"]
    cls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("d", "a")], "qname string, parent string")
    assert {r["qname"]: r["stands"] for r in active.redirected(cls, m).collect()} == {"a": "b", "b": "b", "c": "c", "d": "d"}
    w = emit.query_templates(spark.createDataFrame([("A", 1, 0)], "label string, n_values int, n_relations int"))
    assert w.count() == 3
