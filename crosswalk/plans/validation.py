"""Queries on shapes, graph patterns, pruned search, canonical documents and source formats, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.functions import names, naming, values
from crosswalk.operators import graph, policy, quality, shacl, vector_index
from crosswalk.plans.tables import MODEL_SQL, matrix, model, table, vectors
from crosswalk.sources import extract, rdf_formats
from crosswalk.sources.rdf import parse_column, parse_text

QUERIES, SQL = {}, {}
_MODEL = "WITH " + MODEL_SQL
XSD, RDF = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def trade(spark, d: str) -> DataFrame:
    """Customers, orders, nations and regions as triples: s, p, o, o_kind and o_datatype."""
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    node = lambda prefix, key: F.concat(F.lit(f"x:{prefix}"), F.col(key).cast("string"))
    link = lambda df, s, p, to: df.select(s.alias("s"), F.lit(p).alias("p"), to.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    text = lambda df, s, p, of, kind: df.select(s.alias("s"), F.lit(p).alias("p"), of.cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(XSD + kind).alias("o_datatype"))
    cs, os_, ns = node("c", "c_custkey"), node("o", "o_orderkey"), node("n", "n_nationkey")
    parts = [
        link(c, cs, RDF + "type", F.lit("x:Customer")), link(c, cs, "x:nation", node("n", "c_nationkey")), text(c, cs, "x:segment", F.col("c_mktsegment"), "string"), text(c, cs, "x:balance", F.col("c_acctbal"), "double"),
        link(o, os_, RDF + "type", F.lit("x:Order")), link(o, os_, "x:customer", node("c", "o_custkey")), text(o, os_, "x:status", F.col("o_orderstatus"), "string"), text(o, os_, "x:priority", F.col("o_orderpriority"), "string"),
        link(n, ns, RDF + "type", F.when(F.col("n_nationkey") % 5 == 0, "x:Island").otherwise("x:Nation")), link(n, ns, "x:region", node("r", "n_regionkey")),
        spark.createDataFrame([("x:Nation", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "x:Place", "iri", None)], "s string, p string, o string, o_kind string, o_datatype string"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: what the trade must be like
SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix x: <x:> .
x:CustomerShape a sh:NodeShape ; sh:targetClass x:Customer ;
 sh:property [ sh:path x:balance ; sh:datatype xsd:double ; sh:minInclusive 0 ; sh:severity sh:Warning ] ;
 sh:property [ sh:path x:nation ; sh:class x:Place ; sh:minCount 1 ] ;
 sh:property [ sh:path [ sh:inversePath x:customer ] ; sh:minCount 1 ; sh:maxCount 20 ] ;
 sh:property [ sh:path ( x:nation x:region ) ; sh:in ( x:r0 x:r1 x:r2 ) ] ;
 sh:or ( [ sh:path x:segment ; sh:in ( "BUILDING" "MACHINERY" ) ] [ sh:path x:balance ; sh:minExclusive 5000 ] ) .
x:OrderShape a sh:NodeShape ; sh:targetClass x:Order ;
 sh:property [ sh:path x:priority ; sh:pattern "^[1-4]-" ] ;
 sh:not [ sh:path ( x:customer x:segment ) ; sh:hasValue "HOUSEHOLD" ] ;
 sh:node [ sh:property [ sh:path [ sh:alternativePath ( x:status x:note ) ] ; sh:in ( "O" "F" ) ] ] .
"""


@query("""WITH c AS (SELECT *, 'x:c' || c_custkey AS s FROM customer), o AS (SELECT *, 'x:o' || o_orderkey AS s FROM orders), n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT s AS focus, 'x:balance' AS path, 'minInclusive' AS component, 'warning' AS severity FROM c WHERE c_acctbal < 0
UNION ALL SELECT s, 'x:nation', 'class', 'error' FROM c WHERE c_nationkey % 5 = 0
UNION ALL SELECT 'x:c' || c_custkey, '^x:customer', CASE WHEN n < 1 THEN 'minCount' ELSE 'maxCount' END, 'error' FROM n WHERE n < 1 OR n > 20
UNION ALL SELECT s, 'x:nation/x:region', 'in', 'error' FROM c JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey > 2
UNION ALL SELECT s, '', 'or', 'error' FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal <= 5000
UNION ALL SELECT s, 'x:priority', 'pattern', 'error' FROM o WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
UNION ALL SELECT o.s, '', 'not', 'error' FROM o JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'HOUSEHOLD'
UNION ALL SELECT s, '', 'node', 'error' FROM o WHERE o_orderstatus NOT IN ('O', 'F')""")
def shape_violations(spark, d):
    return shacl.validate(trade(spark, d), parse_text(spark, SHAPES, "shapes")).select("focus", F.coalesce("path", F.lit("")).alias("path"), "component", "severity")


@query("""WITH s AS (SELECT q.vec_id AS q, t.vec_id AS t, round(list_inner_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings t WHERE q.vec_id % 10 = 0 AND t.vec_id % 10 <> 0)
SELECT q, t, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS rank FROM s) WHERE rank <= 5""")
def vector_topk_indexed(spark, d):
    q, t = vectors(spark, d)
    return vector_index.search(vector_index.build(t, 16), q, 5)


_DOC = """WITH p AS (SELECT 'http://e.test/part#P' || p_partkey AS s, * FROM part)
SELECT s, 'type' AS p, 'Part' AS o, 'iri' AS kind, NULL AS datatype, NULL AS lang FROM p UNION ALL SELECT s, 'name', p_name, 'literal', 'langString', 'en' FROM p
UNION ALL SELECT s, 'size', p_size::VARCHAR, 'literal', 'integer', NULL FROM p UNION ALL SELECT s, 'brand', 'http://e.test/brand/' || replace(p_brand, '#', '-'), 'iri', NULL, NULL FROM p"""


def _short(t: DataFrame) -> DataFrame:
    last = lambda c: F.regexp_extract(c, "([^#/]*)$", 1)
    return t.select("s", last("p").alias("p"), F.when(F.col("p").endswith("#type"), last("o")).otherwise(F.col("o")).alias("o"), F.col("o_kind").alias("kind"), last("o_datatype").alias("datatype"), F.col("o_lang").alias("lang"))


@query(_DOC)
def xml_statements(spark, d):
    p = table(spark, d, "part")
    s = lambda c: F.col(c).cast("string")
    safe = F.replace(F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    node = F.concat(F.lit('<x:Part rdf:about="#P'), s("p_partkey"), F.lit('"><x:name xml:lang="en">'), safe, F.lit(f'</x:name><x:size rdf:datatype="{XSD}integer">'), s("p_size"), F.lit('</x:size><x:brand rdf:resource="http://e.test/brand/'), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit('"/></x:Part>'))
    head = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:x="http://e.test/ns#" xml:base="http://e.test/part">'
    # a document for each thousand parts, so that one is small however many there are
    texts = p.groupBy(F.floor(F.col("p_partkey") / 1000).cast("string").alias("graph")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(node), ""), F.lit("</rdf:RDF>")).alias("text"))
    return _short(rdf_formats.parse_column(texts, "xml"))


@query(_DOC)
def json_statements(spark, d):
    p = table(spark, d, "part").repartition("p_partkey")  # a small file is one task's, and parsing is the work
    context = F.lit('{"@vocab": "http://e.test/ns#", "xsd": "' + XSD + '", "size": {"@type": "xsd:integer"}, "name": {"@language": "en"}, "brand": {"@type": "@id"}, "part": "http://e.test/part#"}')
    own = F.to_json(F.struct(F.concat(F.lit("part:P"), F.col("p_partkey").cast("string")).alias("@id"), F.lit("Part").alias("@type"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.concat(F.lit("http://e.test/brand/"), F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand")))
    return _short(rdf_formats.parse_column(p.select(F.concat(F.lit('{"@context": '), context, F.lit(', "@graph": ['), own, F.lit("]}")).alias("text"), F.col("p_partkey").cast("string").alias("graph")), "json-ld"))


@query("""WITH s AS (SELECT s_suppkey, ',"check":' || CASE WHEN s_suppkey % 3 = 0 THEN '1' ELSE '2' END AS x, s_name, s_nationkey FROM supplier)
SELECT s_suppkey, '{"name":"' || s_name || '","nation":' || s_nationkey || '}' AS canonical, sha256('{"k":"name"}"' || s_name || '",{"k":"nation"}' || s_nationkey) AS digest FROM s""")
def document_digests(spark, d):
    s = table(spark, d, "supplier")
    name, nation, made = F.concat(F.lit('"name": "'), "s_name", F.lit('"')), F.concat(F.lit('"nation": '), F.col("s_nationkey").cast("string")), F.concat(F.lit('"made": '), F.col("s_suppkey").cast("string"))
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("{ "), name, F.lit(" , "), made, F.lit(","), nation, F.lit("}"))).otherwise(F.concat(F.lit("{"), nation, F.lit(","), name, F.lit(", "), made, F.lit(" }")))
    plain = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("{"), name, F.lit(","), nation, F.lit("}"))).otherwise(F.concat(F.lit("{"), nation, F.lit(","), name, F.lit("}")))
    return s.select("s_suppkey", values.canonical_json(plain).alias("canonical"), values.document_digest(text, ("made",)).alias("digest"))


@query("""WITH f AS (SELECT 'in ' || n_name || ': ' || s_name || ' is broken' AS details FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 <> 0), c AS (SELECT s_name AS concept FROM supplier UNION ALL SELECT n_name FROM nation)
SELECT 'shape' AS "check", concept, 'look at its shape' AS recommendation FROM f JOIN c ON contains(details, concept)""")
def feedback_routes(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    text = F.concat(F.lit("in "), F.col("n_name"), F.lit(": "), F.col("s_name"), F.lit(" is broken"))
    checks = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.lit("shape").alias("check"), F.when(F.col("s_suppkey") % 3 == 0, "pass").otherwise("fail").alias("status"), text.alias("details"))
    return quality.routing(checks, s.select(F.col("s_name").alias("concept")).unionByName(n.select(F.col("n_name").alias("concept"))), {"shape": "look at its shape"})


@query("""WITH w AS (SELECT 'b' || o_orderkey AS node, o_custkey, o_orderkey FROM orders)
SELECT node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM w""")
def anonymous_numbers(spark, d):
    o = table(spark, d, "orders")
    t = o.select(F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("s"), F.lit("bnode").alias("s_kind"), F.lit("x:of").alias("p"), F.concat(F.lit("x:c"), F.col("o_custkey").cast("string")).alias("o"), F.lit("iri").alias("o_kind"))
    return graph.blank_names(t).select("node", F.substring_index("name", "_", -1).cast("long").alias("n"))


# decisions on targets: a nation's name is a class, customers' segments and suppliers' names are not

_POLICY = """n AS (SELECT 'http://e.test/r' || n_regionkey || '/' AS ns, n_name AS name, 'r' || n_regionkey AS prefix FROM nation WHERE n_nationkey % 6 <> 0),
s AS (SELECT 'c' || c_custkey AS concept, c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN '[undecided]' WHEN c_custkey % 2 = 0 THEN 'http://e.test/r' || n_regionkey || '/' || n_name ELSE 'r' || n_regionkey || ':' || n_name END AS target,
 'r' || n_regionkey || ':' || n_name AS canonical, n_nationkey % 6 <> 0 AS ok, n_nationkey = 7 AS root FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _policy(spark, d) -> tuple[DataFrame, policy.Policy]:
    n = table(spark, d, "nation")
    space = F.concat(F.lit("http://e.test/r"), F.col("n_regionkey").cast("string"), F.lit("/"))
    prefix = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    p = policy.Policy(n.where("n_nationkey % 6 <> 0").select(space.alias("namespace"), F.col("n_name").alias("name")), n.select(prefix.alias("prefix"), space.alias("base")).distinct(), n.where("n_nationkey = 7").select(space.alias("namespace"), F.col("n_name").alias("name")))
    c = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey") % 11
    target = F.when(k == 0, None).when(k == 1, "[undecided]").when(F.col("c_custkey") % 2 == 0, F.concat(space, "n_name")).otherwise(F.concat(prefix, F.lit(":"), "n_name"))
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("concept"), target.alias("target"), F.col("c_custkey").alias("k"), F.concat(prefix, F.lit(":"), "n_name").alias("canonical")), p


@query(f"WITH {_POLICY} SELECT concept, CASE WHEN k % 11 < 2 THEN target ELSE canonical END AS target, true AS accepted FROM s WHERE ok OR k % 11 < 2 UNION ALL SELECT concept, target, false FROM s WHERE NOT ok AND k % 11 >= 2")
def canonical_class_targets(spark, d):
    picked, p = _policy(spark, d)
    kept, rejected = policy.canonical_targets(picked.select("concept", "target"), p)
    return kept.withColumn("accepted", F.lit(True)).unionByName(rejected.select("concept", "target", F.lit(False).alias("accepted")))


@query(f"""WITH {_POLICY}, m AS (SELECT *, CASE k % 4 WHEN 0 THEN 'reuse' WHEN 1 THEN 'extend' WHEN 2 THEN 'augment' ELSE 'exclude' END AS action FROM s),
f AS (SELECT concept, action, target, 'target' AS field, ok, root, 0 AS pos FROM m WHERE action <> 'exclude' AND k % 11 >= 2
 UNION ALL SELECT concept, action, canonical, CASE action WHEN 'extend' THEN 'baseType' ELSE 'augmentsType' END, ok, root, 1 FROM m WHERE action IN ('extend', 'augment'))
SELECT concept, target, string_agg(field, '/' ORDER BY pos) AS fields, CASE WHEN NOT any_value(ok) THEN 'not-a-class' ELSE 'root-only-extends' END AS reason FROM f WHERE NOT ok OR (root AND action <> 'extend') GROUP BY concept, target""")
def invalid_class_targets(spark, d):
    picked, p = _policy(spark, d)
    k = F.col("k") % 4
    m = picked.withColumn("action", F.when(k == 0, "reuse").when(k == 1, "extend").when(k == 2, "augment").otherwise("exclude"))
    return policy.invalid_targets(m.select("concept", "action", "target", F.when(k == 1, F.col("canonical")).alias("baseType"), F.when(k == 2, F.col("canonical")).alias("augmentsType")), p)


_CASCADE = _MODEL + """, to_ AS (SELECT concept, CASE WHEN pos % 10 = 0 THEN NULL ELSE 'nc:1Type' END AS target FROM concepts WHERE pos % 5 = 0),
b2 AS (SELECT p.concept, CASE WHEN p.target IS NULL OR p.target = '[undecided]' THEN 'not_found' WHEN h.type IS NOT NULL THEN 'on_target' ELSE 'elsewhere' END AS bucket FROM props p JOIN to_ c USING (concept) LEFT JOIN has h ON h.type = c.target AND h.property = p.target),
c2 AS (SELECT t.concept, t.target, count(*) FILTER (bucket = 'elsewhere') AS e, count(*) FILTER (bucket = 'not_found') AS n FROM to_ t LEFT JOIN b2 USING (concept) GROUP BY ALL),
d2 AS (SELECT *, CASE WHEN target IS NULL THEN 'extend' WHEN e + n = 0 THEN 'reuse' WHEN e >= n THEN 'augment' ELSE 'extend' END AS action FROM c2)"""


@query(f"""{_CASCADE} SELECT concept, target, action, 'pending-review' AS "reviewStatus", 'target-type-change-cascade' AS "ruleId", CASE WHEN target IS NULL THEN '' ELSE 'About nc:1Type' END AS "targetDefinition",
 CASE WHEN target IS NOT NULL THEN substr(sha256('About nc:1Type'), 1, 16) END AS "targetDefinitionHash", CASE WHEN target IS NOT NULL THEN 'Label of nc:1Type' END AS "targetLabel" FROM d2
UNION ALL SELECT concept, target, action, "reviewStatus", NULL, NULL, NULL, NULL FROM matrix WHERE pos % 5 <> 0""")
def target_cascade(spark, d):
    concepts, _, has = model(spark, d)
    m, p = matrix(spark, d)
    none = F.lit(None).cast("string")
    m = m.withColumns(dict.fromkeys(("ruleId", "targetDefinition", "targetDefinitionHash", "targetLabel"), none))
    to = concepts.where("pos % 5 = 0").select("concept", F.when(F.col("pos") % 10 != 0, "nc:1Type").alias("target"))
    catalog = has.select(F.col("type").alias("key")).distinct().select("key", F.concat(F.lit("Label of "), "key").alias("label"), F.concat(F.lit("About "), "key").alias("definition"))
    got, _ = policy.cascade(m, to, p.withColumn("reviewStatus", F.lit("accepted")), has, catalog, default_base="structures:ObjectType")
    return got.select("concept", "target", "action", "reviewStatus", "ruleId", "targetDefinition", "targetDefinitionHash", "targetLabel")


@query(f"{_MODEL} SELECT concept, name, CASE action WHEN 'reuse-property' THEN 'reuse-property requires target' ELSE 'human-must-decide: must be resolved' END AS issue FROM pm WHERE action = 'human-must-decide'")
def property_decision_issues(spark, d):
    return policy.property_issues(matrix(spark, d)[1])


@query(f"""{_MODEL}, e AS (SELECT concept, CASE WHEN pos % 4 = 0 THEN 'reuse' ELSE action END AS action, action AS was, target FROM matrix)
SELECT concept, issue FROM (SELECT concept, CASE WHEN action = 'reuse' AND target IS NULL THEN 'reuse requires target' END AS issue FROM e
 UNION ALL SELECT concept, unnest(CASE WHEN action = 'reuse' AND was = 'extend' THEN ['reuse should not have extensionType', 'reuse should not have baseType'] WHEN action = 'reuse' AND was = 'augment' THEN ['reuse should not have augmentationType', 'reuse should not have augmentsType'] ELSE [] END) FROM e) WHERE issue IS NOT NULL""")
def class_decision_issues(spark, d):
    return policy.class_issues(matrix(spark, d)[0].withColumn("action", F.when(F.col("pos") % 4 == 0, "reuse").otherwise(F.col("action"))))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, md5(l_suppkey::VARCHAR) AS o, CASE WHEN l_partkey % 3 = 0 THEN md5('x' || l_suppkey) WHEN l_partkey % 7 = 0 THEN NULL ELSE md5(l_suppkey::VARCHAR) END AS n FROM lineitem WHERE l_linenumber < 6)
SELECT DISTINCT l_orderkey AS concept, l_linenumber || '_' || l_partkey || '_' || l_suppkey AS name, 'old ' || l_suppkey AS old_definition, 'new ' || l_suppkey AS new_definition FROM l WHERE l_linenumber > 1 AND n IS NOT NULL AND n <> o""")
def stale_property_definitions(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("concept"), F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey").alias("name"), "l_linenumber", "l_partkey", F.col("l_suppkey").cast("string").alias("s"), F.lit(0).alias("pos"))
    old = l.where("l_linenumber < 6").select("concept", "name", F.md5("s").alias("hash"), F.concat(F.lit("old "), "s").alias("definition"), "pos")
    now = F.when(F.col("l_partkey") % 3 == 0, F.md5(F.concat(F.lit("x"), "s"))).when(F.col("l_partkey") % 7 != 0, F.md5("s"))
    return policy.stale_properties(old, l.where("l_linenumber > 1").select("concept", "name", now.alias("hash"), F.concat(F.lit("new "), "s").alias("definition"), "pos"))


# names and values

_SLUG = "regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9_.-]+', '-', 'g'), '^[^A-Za-z_]+', ''), '-+$', '')"


@query(f"""WITH c AS (SELECT c_custkey, replace(c_name, '#', ' ') AS org, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' (' || c_nationkey || ')' ELSE '' END AS src FROM customer),
s AS (SELECT *, coalesce(nullif({_SLUG.format('org')}, ''), 'org') AS o, coalesce(nullif({_SLUG.format('src')}, ''), 'source') AS s FROM c)
SELECT c_custkey, o || '_' || s || '_edge_package' AS package, org || '_' || src || '_agency_package' AS agency_package, 'http://' || o || '.gov/' || s || '/edge#' AS edge_namespace, s || '-edge-core.ttl' AS core_file, s || '-edge:' AS edge_prefix, org || ' ' || upper(src) AS label FROM s""")
def package_names(spark, d):
    c = table(spark, d, "customer")
    org = F.replace("c_name", F.lit("#"), F.lit(" "))
    src = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")"))).otherwise(""))
    return c.select("c_custkey", naming.package_names(org, src, F.lit("niem")).alias("n")).select("c_custkey", "n.package", "n.agency_package", "n.edge_namespace", "n.core_file", "n.edge_prefix", "n.label")


@query(f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN ' ' ELSE p_name || '_' || p_brand END AS src, CASE WHEN p_size % 5 = 0 THEN 'own' END AS given FROM part),
s AS (SELECT *, {_SLUG.format("replace(replace(lower(trim(src)), ' ', '-'), '_', '-')")} AS slug FROM p)
SELECT p_partkey, coalesce(given, nullif(slug, ''), 'src') AS prefix, 'urn:' || coalesce(nullif(slug, ''), 'src') || '-model' AS uri FROM s""")
def source_namespaces(spark, d):
    src = F.when(F.col("p_size") % 4 == 0, None).when(F.col("p_size") % 4 == 1, " ").otherwise(F.concat_ws("_", "p_name", "p_brand"))
    prefix, uri = naming.source_namespace(src, F.when(F.col("p_size") % 5 == 0, "own"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", prefix.alias("prefix"), uri.alias("uri"))


@query("""WITH s AS (SELECT DISTINCT 'n' || n_nationkey AS prefix, 'http://s.test/' || n_nationkey AS uri FROM nation), t AS (SELECT 'n' || s_nationkey AS prefix, min('http://' || CASE WHEN s_nationkey % 2 = 0 THEN 's' ELSE 't' END || '.test/' || s_nationkey) AS uri FROM supplier GROUP BY s_nationkey)
SELECT s.prefix, CASE WHEN t.uri <> s.uri THEN 'source_' || s.prefix ELSE s.prefix END AS emitted, s.uri FROM s LEFT JOIN t USING (prefix) WHERE s.prefix <> 'n3'""")
def prefix_bindings(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    own = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(":")).alias("prefix"), F.concat(F.lit("http://s.test/"), F.col("n_nationkey").cast("string")).alias("uri"))
    key = F.col("s_nationkey")
    to = s.select(F.concat(F.lit("n"), key.cast("string")).alias("prefix"), F.concat(F.lit("http://"), F.when(key % 2 == 0, "s").otherwise("t"), F.lit(".test/"), key.cast("string")).alias("uri")).distinct()
    return naming.namespace_bindings(own, to, "n3", "x-edge:")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'src:' || s_name WHEN 1 THEN 'src:' || s_name WHEN 2 THEN 'A & ' || s_name ELSE 'other:' || s_name END AS name FROM supplier""")
def repaired_names(spark, d):
    k = F.col("s_suppkey") % 4
    said = F.when(k == 0, F.col("s_name")).when(k == 1, F.concat(F.lit("src&#58;"), "s_name")).when(k == 2, F.concat(F.lit("A &amp; "), "s_name")).otherwise(F.concat(F.lit("other:"), "s_name"))
    return table(spark, d, "supplier").select("s_suppkey", naming.repaired(said, F.concat(F.lit("src:"), "s_name")).alias("name"))


@query("""SELECT 'http://e.test/ns#S' || s_suppkey AS iri, CASE WHEN s_nationkey % 2 = 0 THEN 'plain ' || s_name || '|' || s_name ELSE s_name END AS labels FROM supplier""")
def other_labels(spark, d):
    s = table(spark, d, "supplier")
    line = F.concat(F.lit("x:S"), F.col("s_suppkey").cast("string"), F.lit(' s:altLabel "'), "s_name", F.lit('"@en-US , "nicht"@de , '), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit('"plain '), "s_name", F.lit('"'))).otherwise(F.concat(F.lit('"'), "s_name", F.lit('"@en'))), F.lit(" .\n"))
    head = "@prefix x: <http://e.test/ns#> . @prefix s: <http://www.w3.org/2004/02/skos/core#> .\n"
    texts = s.groupBy(F.floor(F.col("s_suppkey") / 1000).cast("string").alias("graph")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(line), "")).alias("text"))
    return extract.alternative_labels(parse_column(texts)).select("iri", F.array_join(F.reverse(F.sort_array("labels")), "|").alias("labels"))


@query("""WITH u AS (SELECT page_id, url, url || '#P' || page_id AS full_, 'p' || page_id % 7 || ':Name' || page_id || 'Type' AS q FROM pages)
SELECT page_id, regexp_matches(lower(url), '^(https?://|urn:)') AS full_iri, string_split(q, ':')[-1] AS after_last, regexp_extract(q, '^[^:]*:(.*)$', 1) AS after_first, string_split(full_, '#')[-1] AS after_hash,
 url || CASE WHEN regexp_matches(url, '[/#:]$') THEN '' ELSE '/' END || 'X' AS component, 'p' || page_id % 7 || ':bare' AS qualified, CASE WHEN page_id % 7 IN (1, 2) THEN q ELSE 'edge:Name' || page_id || 'Type' END AS created,
 replace(q, ':', '.') AS id, q AS back, 'http://n.test#C' AS class_iri, 'http://n.test#C.' || page_id AS property_iri, CASE WHEN page_id % 2 = 0 THEN 'run' || page_id END AS org FROM u""")
def name_functions(spark, d):
    p = table(spark, d, "pages").withColumns({"id_": F.col("page_id").cast("string"), "seven": (F.col("page_id") % 7).cast("string")})
    q, url = F.concat(F.lit("p"), "seven", F.lit(":Name"), "id_", F.lit("Type")), F.col("url")
    run = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("run"), "id_", F.lit("_20260101_x"))).otherwise(F.concat(F.lit("run"), "id_"))
    return p.select(
        "page_id", names.is_full_iri(url).alias("full_iri"), names.after_last_colon(q).alias("after_last"), names.after_first_colon(q).alias("after_first"), names.after_hash_or_slash(F.concat(url, F.lit("#P"), "id_")).alias("after_hash"),
        names.component_iri(url, F.lit("X")).alias("component"), names.qualified_target_property(F.lit("bare"), q).alias("qualified"), names.created_property_qname(q, "p0", ["p0", "p1", "p2"], "edge").alias("created"),
        names.qname_to_id(q).alias("id"), names.id_to_qname(names.qname_to_id(q)).alias("back"), names.class_iri("http://n.test/", F.lit("C")).alias("class_iri"), names.property_iri("http://n.test#", F.lit("C"), F.col("id_")).alias("property_iri"), names.org_of_run(run).alias("org"),
    )


@query(r"""WITH o AS (SELECT o_orderkey, o_orderstatus AS st, o_totalprice AS price, o_orderdate AS t, o_orderpriority AS pr, (o_orderkey % 400)::INT AS secs FROM orders)
SELECT o_orderkey, pr || ' told' AS definition, CASE st WHEN 'O' THEN 0 ELSE 1 END AS language, CASE st WHEN 'O' THEN 'Violation' WHEN 'F' THEN 'Warning' ELSE 'Info' END AS severity, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
 t AS parsed, CASE WHEN secs < 60 THEN secs || '.0s' ELSE secs // 60 || 'm ' || secs % 60 || 's' END AS duration, CASE st WHEN 'O' THEN 'xsd:date-to-iso8601' END AS transform, CASE st WHEN 'O' THEN (o_orderkey % 50)::VARCHAR WHEN 'F' THEN 'true' ELSE '''it\''s ' || pr || '''' END AS literal,
 CASE st WHEN 'O' THEN 'a,b' WHEN 'F' THEN 'c' ELSE '' END AS targets FROM o""")
def value_functions(spark, d):
    o = table(spark, d, "orders")
    st, secs = F.col("o_orderstatus"), F.col("o_orderkey") % 400
    pick = lambda a, b, c: F.when(st == "O", a).when(st == "F", b).otherwise(c)
    text = F.concat(F.lit("Element# 4\n  "), "o_orderpriority", F.lit("\nUser Story:\nUser Story: told"))
    stamp = values.stamp(F.col("o_orderdate"))
    raw = pick(F.concat(F.lit("+0"), (F.col("o_orderkey") % 50).cast("string")), F.lit("TRUE"), F.concat(F.lit("it's "), "o_orderpriority"))
    return o.select(
        "o_orderkey", values.clean_definition(text).alias("definition"), values.language_rank(pick(F.lit("EN"), F.lit("de"), F.lit("fr"))).alias("language"), values.shacl_severity(pick(F.lit(None).cast("string"), F.lit("http://www.w3.org/ns/shacl#Warning"), F.lit("http://www.w3.org/ns/shacl#Info"))).alias("severity"),
        stamp.alias("stamp"), values.parse_stamp(stamp).cast("timestamp_ntz").alias("parsed"), values.duration_text(secs).alias("duration"), values.date_transform(pick(F.lit(XSD + "date"), F.lit(XSD + "string"), F.lit("date time"))).alias("transform"),
        values.cypher_literal(raw, pick(F.lit(XSD + "integer"), F.lit(XSD + "boolean"), F.lit(XSD + "string"))).alias("literal"), F.array_join(values.shape_targets(pick(F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"), F.lit(None).cast("array<string>")), pick(F.lit("z"), F.lit("c"), F.lit(""))), ",").alias("targets"),
    )
