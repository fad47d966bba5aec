"""Queries on decisions, audits, catalogs and graphs, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswalk.functions import values
from crosswalk.operators import catalog, decide, graph, quality, review, summaries
from crosswalk.plans.tables import MODEL_SQL, matrix, model, table

QUERIES, SQL = {}, {}
_M = "WITH " + MODEL_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WHY = """CASE WHEN target IS NULL THEN 'No target type.' WHEN elsewhere + not_found = 0 THEN 'All ' || on_target || ' source properties have equivalents on the target type.'
 WHEN elsewhere >= not_found THEN 'Of ' || (on_target + elsewhere + not_found) || ' source properties: ' || concat_ws(', ', CASE WHEN on_target > 0 THEN on_target || ' already on the target type' END, elsewhere || ' found elsewhere in the ontology', CASE WHEN not_found > 0 THEN not_found || ' require creation' END) || '. Majority of unmatched properties exist in the ontology (' || elsewhere || ' of ' || (elsewhere + not_found) || ') — augment.'
 ELSE 'Of ' || (on_target + elsewhere + not_found) || ' source properties: ' || concat_ws(', ', CASE WHEN on_target > 0 THEN on_target || ' already on the target type' END, CASE WHEN elsewhere > 0 THEN elsewhere || ' found elsewhere in the ontology' END, not_found || ' require creation') || '. Majority of unmatched properties have no equivalent (' || not_found || ' of ' || (elsewhere + not_found) || ') — extend.' END"""
_SCAFFOLD = """CASE WHEN action = 'extend' THEN substr(concept, 5) || 'Type' END AS "extensionType", CASE WHEN action = 'extend' THEN coalesce(target, 'structures:ObjectType') END AS "baseType",
 CASE WHEN action = 'augment' THEN regexp_replace(substr(target, 4), 'Type$', '') || 'AugmentationType' END AS "augmentationType", CASE WHEN action = 'augment' THEN target END AS "augmentsType\""""


@query(f"{_M} SELECT concept, target, on_target, elsewhere, not_found, action, {_WHY} AS rationale, {_SCAFFOLD} FROM matrix")
def class_action_rule(spark, d):
    return decide.resolve(*model(spark, d), "structures:ObjectType").drop("pos")


@query(f"{_M} SELECT concept, name, target, action FROM pm")
def property_action_rule(spark, d):
    return matrix(spark, d)[1].select("concept", "name", "target", "action")


@query(_M.replace("'nc:' || substr(o_orderpriority, 1, 1) || 'Type' END AS target", "CASE WHEN o_orderkey % 5 = 0 THEN 'nc:1Type' ELSE 'nc:' || substr(o_orderpriority, 1, 1) || 'Type' END WHEN o_orderkey % 5 = 0 THEN 'nc:1Type' END AS target") + f" SELECT concept, target, action, on_target, elsewhere, not_found, CASE WHEN pos % 5 = 0 THEN 'target-change' END AS rule, {_SCAFFOLD} FROM matrix")
def target_change_cascade(spark, d):
    concepts, props, has = model(spark, d)
    changes = concepts.where("pos % 5 = 0").select("concept", F.lit("nc:1Type").alias("target"))
    return decide.retarget(concepts, changes, props, has, "structures:ObjectType").drop("rationale")


_SUMMARY = """(SELECT count(*) AS total, count(*) FILTER (action = 'reuse') AS reuse, count(*) FILTER (action = 'extend') AS extend, count(*) FILTER (action = 'augment') AS augment, count(*) FILTER (action = 'exclude') AS exclude, count(*) FILTER ("reviewStatus" = 'pending-review') AS pending FROM matrix),
 (SELECT count(*) AS properties, count(*) FILTER (action = 'reuse-property') AS reused, count(*) FILTER (action = 'create-property') AS created, count(*) FILTER (action = 'human-must-decide') AS undecided FROM pm)"""


@query(f"{_M} SELECT * FROM {_SUMMARY}")
def matrix_summary(spark, d):
    return summaries.matrix_summary(*matrix(spark, d))


@query(f"""{_M} SELECT * FROM {_SUMMARY}, (SELECT count(*) FILTER ("reviewStatus" = 'accepted') AS accepted, count(*) FILTER (confidence = 'best-guess') AS "bestGuess" FROM matrix), (SELECT count(DISTINCT concept) AS "openConcepts" FROM pm WHERE action = 'human-must-decide')""")
def post_review_summary(spark, d):
    return summaries.review_summary(*matrix(spark, d))


@query(f"{_M} SELECT action, coalesce(confidence, 'confident') AS confidence, count(*) AS n, 'class' AS kind FROM matrix GROUP BY ALL UNION ALL SELECT action, coalesce(confidence, 'confident'), count(*), 'property' FROM pm GROUP BY ALL")
def rotation_summary(spark, d):
    m, p = matrix(spark, d)
    return summaries.rotation(m, "class").unionByName(summaries.rotation(p, "property"))


@query(f"{_M} SELECT coalesce(action, 'unknown') AS action, count(*) AS n FROM matrix GROUP BY ALL")
def action_counts(spark, d):
    return summaries.by_action(matrix(spark, d)[0])


@query("SELECT count(h) AS hashes, count(DISTINCT h) AS distinct_hashes FROM (SELECT substr(sha256(text), 1, 16) AS h FROM documents)")
def codebook_digest(spark, d):
    return summaries.codebook(table(spark, d, "documents").select(values.definition_hash(F.col("text")).alias("h")), "h")


@query(f"""{_M}, s AS (SELECT * FROM {_SUMMARY}) SELECT 'error' AS severity, 'QG-002' AS code, 'matrix' AS key, 'actions ' || (reuse + extend + augment + exclude) || ' of ' || total AS message FROM s WHERE reuse + extend + augment + exclude <> total
 UNION ALL SELECT 'error', 'QG-001', 'matrix', 'empty matrix' FROM s WHERE total = 0 UNION ALL SELECT 'error', 'QG-003', 'matrix', 'decided ' || (reused + created) || ' of ' || properties FROM s WHERE reused + created <> properties""")
def quality_gates(spark, d):
    return quality.gates(matrix_summary(spark, d))




@query(f"""{_M}, m AS (SELECT *, {_SCAFFOLD} FROM matrix), m2 AS (SELECT * REPLACE (CASE WHEN pos % 10 <> 0 THEN "extensionType" END AS "extensionType", CASE WHEN pos % 9 = 0 AND target IS NOT NULL THEN 'nc:OtherType' ELSE "baseType" END AS "baseType") FROM m),
 n AS (SELECT m2.*, coalesce(k, 0) AS k, coalesce(r, 0) AS r, coalesce(u, 0) AS u FROM m2 LEFT JOIN (SELECT concept, count(*) AS k, count(*) FILTER (action = 'reuse-property') AS r, count(*) FILTER (action = 'human-must-decide') AS u FROM pm GROUP BY concept) USING (concept))
 SELECT 'warning' AS severity, 'GA-001' AS code, concept AS key, 'no source properties' AS message FROM n WHERE k = 0
 UNION ALL SELECT 'warning', 'GA-003', concept, 'augment reuses no property' FROM n WHERE action = 'augment' AND k > 0 AND r = 0
 UNION ALL SELECT 'error', 'GA-005', concept, 'scaffolding missing' FROM n WHERE action = 'extend' AND "extensionType" IS NULL
 UNION ALL SELECT 'error', 'GA-006', concept, u || ' properties undecided' FROM n WHERE u > 0
 UNION ALL SELECT 'error', 'GA-007', concept, 'scaffolding names another target' FROM n WHERE action = 'extend' AND target IS NOT NULL AND "baseType" IS DISTINCT FROM target""")
def audit_findings(spark, d):
    m, p = matrix(spark, d)
    m = m.withColumns({"extensionType": F.when(F.col("pos") % 10 != 0, F.col("extensionType")), "baseType": F.when((F.col("pos") % 9 == 0) & (F.col("action") == "extend") & F.col("target").isNotNull(), "nc:OtherType").otherwise(F.col("baseType"))})
    return quality.audit(m, p, p.groupBy("concept").agg(F.count("*").alias("n")))


@query("SELECT 'error' AS severity, 'unmapped' AS code, c_custkey::VARCHAR AS key, 'missing' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def mapping_completeness(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return quality.missing(o, c, "key", "unmapped")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unbound' WHEN substr(p_brand, 7, 1) NOT IN ('1', '3', CASE WHEN l_returnflag = 'R' THEN '4' ELSE '5' END) THEN 'incompatible' ELSE 'bound' END AS status FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 6 <> 0) ON p_partkey = l_partkey""")
def reference_binding(spark, d):
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ref"), F.array(F.lit("1"), F.lit("3"), F.when(F.col("l_returnflag") == "R", "4").otherwise("5")).alias("allowed"))
    parts = table(spark, d, "part").where("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("id"), F.substring("p_brand", 7, 1).alias("kind"))
    return quality.bindings(refs, parts).select("l_orderkey", "l_linenumber", "status")


@query("""WITH n AS (SELECT doc_id, substr(sha256(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE text END), 1, 16) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT d.doc_id AS key, d.doc_id AS target, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN d.doc_id % 4 <> 0 AND substr(sha256(d.text), 1, 16) <> n.h THEN 'changed' ELSE 'same' END AS status FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""")
def codebook_drift(spark, d):
    t = table(spark, d, "documents")
    mapped = t.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("target"), F.when(F.col("doc_id") % 4 != 0, values.definition_hash(F.col("text"))).alias("hash"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    return quality.drift(mapped, t.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("target"), values.definition_hash(text).alias("now")))


@query("""WITH c AS (SELECT conv_id || '/' || turn AS key, role, text, turn FROM conversations) SELECT 'error' AS severity, 'source' AS code, key, 'source differs' AS message FROM c WHERE role IS DISTINCT FROM CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END
 UNION ALL SELECT 'error', 'target', key, 'target was not offered' FROM c WHERE NOT coalesce(role IN ('user', 'assistant'), true) UNION ALL SELECT 'error', 'rationale', key, 'rationale is too short' FROM c WHERE coalesce(length(text), 0) < 20""")
def evaluation_validation(spark, d):
    c = table(spark, d, "conversations")
    return quality.evaluations(c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.col("role").alias("source"), F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("expected"), F.col("role").alias("target"), F.array(F.lit("user"), F.lit("assistant")).alias("candidates"), F.col("text").alias("rationale")))


@query("WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS p FROM part GROUP BY ALL) SELECT p_brand, string_agg(p_type, ',' ORDER BY p) AS domains FROM f GROUP BY p_brand")
def merge_domains(spark, d):
    return catalog.merge_domains(table(spark, d, "part"), "p_brand", "p_type", "p_partkey").withColumn("domains", F.array_join("domains", ","))


@query("SELECT l_partkey, l_returnflag, max(CASE WHEN l_linenumber > 1 THEN l_linenumber END) AS min, min(CASE WHEN l_quantity < 40 THEN l_quantity END) AS max FROM lineitem GROUP BY ALL")
def bounds_merge(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("min"), F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("max"))
    return catalog.merge_bounds(rows, ["l_partkey", "l_returnflag"])


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS facets FROM part GROUP BY p_brand")
def facets_grouped(spark, d):
    return catalog.facets(table(spark, d, "part"), "p_brand", "p_type")


@query("SELECT p_brand, count(DISTINCT p_name) AS n, array_to_string(list_sort(list_distinct(list(p_name)))[1:10], ',') AS members FROM part GROUP BY p_brand")
def namespace_summary(spark, d):
    return catalog.namespace_summary(table(spark, d, "part"), "p_brand", "p_name")


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY ALL ORDER BY n DESC, host LIMIT 1")
def primary_namespace(spark, d):
    return catalog.primary(table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")), "host")


@query("SELECT p_name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) >= 2")
def name_collisions(spark, d):
    return catalog.having_many(table(spark, d, "part"), "p_name", "p_partkey")


@query("SELECT n_regionkey, count(DISTINCT n_name) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey HAVING count(DISTINCT n_name) >= 2")
def shared_targets(spark, d):
    return catalog.having_many(table(spark, d, "nation"), "n_regionkey", "n_name")


@query("SELECT s_nationkey, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS first FROM supplier WHERE s_acctbal < 5000 GROUP BY s_nationkey HAVING count(DISTINCT s_suppkey) >= 2")
def consolidations(spark, d):
    return catalog.having_many(table(spark, d, "supplier").where("s_acctbal < 5000"), "s_nationkey", "s_suppkey")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_decision(spark, d):
    return decide.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("SELECT user_id, event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds, count(*) AS n FROM events GROUP BY ALL")
def stage_timings(spark, d):
    return summaries.stage_timings(table(spark, d, "events"), ["user_id", "event_type"], F.col("ts"), F.col("ts"))


@query("SELECT count(*) FILTER (quality = toxic) AS same, count(*) FILTER (quality <> toxic) AS different, count(*) FILTER (quality IS NULL OR toxic IS NULL) AS failed FROM labels")
def agreement_counts(spark, d):
    return summaries.agreement(table(spark, d, "labels"), "quality", "toxic")


_MULT = "CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN '0..' || p_size WHEN 4 THEN '1..*' ELSE 'many' END"


@query(f"SELECT p_partkey, {_MULT} AS text, CASE p_size % 6 WHEN 2 THEN p_size WHEN 4 THEN 1 ELSE 0 END AS min, CASE WHEN p_size % 6 IN (2, 3) THEN p_size END AS max FROM part")
def multiplicity_parse(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr("CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN '*' WHEN 2 THEN string(p_size) WHEN 3 THEN '0..' || p_size WHEN 4 THEN '1..*' ELSE 'many' END").alias("text"))
    lo, hi = values.multiplicity(F.col("text"))
    return rows.select("p_partkey", "text", lo.alias("min"), hi.alias("max"))


_SUFFIX = ["Type", "CodeType", "CodeSimpleType", "SimpleType", "AugmentationType", "AssociationType", "MetadataType", "AdapterType"]


@query("SELECT p_partkey, n AS name, CASE WHEN ends_with(n, 'AugmentationType') THEN 'augmentation' WHEN ends_with(n, 'AssociationType') THEN 'association' WHEN ends_with(n, 'MetadataType') THEN 'metadata' WHEN ends_with(n, 'AdapterType') THEN 'adapter' WHEN ends_with(n, 'CodeType') OR ends_with(n, 'SimpleType') THEN 'simple_value' ELSE 'object' END AS pattern FROM (SELECT p_partkey, p_name || list_value(" + ", ".join(f"'{s}'" for s in _SUFFIX) + ")[p_size % 8 + 1] AS n FROM part)")
def pattern_suffix(spark, d):
    n = F.concat("p_name", F.element_at(F.array(*[F.lit(s) for s in _SUFFIX]), (F.col("p_size") % 8 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", n.alias("name"), values.pattern_of(n).alias("pattern"))


_X = ["string", "int", "decimal", "boolean", "date", "dateTime", "gYear", "anyURI"]


@query("SELECT p_partkey, x AS type, CASE x WHEN 'int' THEN 'INTEGER' WHEN 'decimal' THEN 'FLOAT' WHEN 'boolean' THEN 'BOOLEAN' WHEN 'date' THEN 'DATE' WHEN 'dateTime' THEN 'DATETIME' ELSE 'STRING' END AS graph_type, 'xs.' || x AS xml_type, CASE x WHEN 'int' THEN 'xs:integer' WHEN 'decimal' THEN 'xs:decimal' WHEN 'boolean' THEN 'xs:boolean' WHEN 'date' THEN 'xs:date' ELSE 'xs:string' END AS tabular FROM (SELECT p_partkey, list_value(" + ", ".join(f"'{s}'" for s in _X) + ")[p_size % 8 + 1] AS x FROM part)")
def xsd_type_map(spark, d):
    x = F.element_at(F.array(*[F.lit(s) for s in _X]), (F.col("p_size") % 8 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", x.alias("type"))
    iri = F.concat(F.lit(values.XSD), "type")
    return rows.select("p_partkey", "type", values.graph_type(iri).alias("graph_type"), values.xml_datatype(iri).alias("xml_type"), values.tabular_type(F.col("type")).alias("tabular"))


_TREE = "WITH RECURSIVE c(node, up, d) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT node, up // 2, d + 1 FROM c WHERE up // 2 > 0 AND up // 2 IN (SELECT p_partkey FROM part))"


def _tree(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") >= 2, F.expr("p_partkey div 2")).alias("parent"))


@query(_TREE + ", t AS (SELECT node, string_agg(up::VARCHAR, '/' ORDER BY d) FILTER (d > 0) AS chain, max(d) AS depth FROM c GROUP BY node) SELECT node, coalesce(chain, '') AS chain, depth FROM t")
def inheritance_chain(spark, d):
    got = graph.chains(_tree(spark, d))
    return got.select("node", F.array_join(F.transform("chain", lambda x: x.cast("string")), "/").alias("chain"), F.size("chain").alias("depth"))


@query(_TREE + " SELECT node, nearest FROM (SELECT p_partkey AS node FROM part) LEFT JOIN (SELECT node, arg_min(up, d) AS nearest FROM c WHERE up NOT IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0) GROUP BY node) USING (node)")
def nearest_emitted_ancestor(spark, d):
    return graph.first_kept(_tree(spark, d), table(spark, d, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("node")))


@query("""SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1 FROM nation
 UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey, 2 FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def reachable_depth2(spark, d):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, s = (table(spark, d, x) for x in ("nation", "customer", "supplier"))
    e = n.select(k("r", "n_regionkey").alias("src"), k("n", "n_nationkey").alias("dst")).unionByName(c.select(k("n", "c_nationkey").alias("src"), k("c", "c_custkey").alias("dst"))).unionByName(s.select(k("n", "s_nationkey").alias("src"), k("s", "s_suppkey").alias("dst")))
    return graph.reachable(table(spark, d, "region").select(k("r", "r_regionkey").alias("root")), e, 2)


def _bipartite(spark, d):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    l = table(spark, d, "lineitem")
    return l.select(k("o", "l_orderkey").alias("src"), k("p", "l_partkey").alias("dst")).unionByName(l.select(k("p", "l_partkey").alias("src"), k("s", "l_suppkey").alias("dst")))


_E = "e AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("WITH RECURSIVE " + _E + ", w(node, h) AS (SELECT 'o37', 0 UNION SELECT u.dst, h + 1 FROM w JOIN u ON u.src = w.node WHERE h < 6) SELECT node, min(h) AS hops FROM w GROUP BY node")
def shortest_path_6(spark, d):
    return graph.shortest(_bipartite(spark, d), "o37", 6)


@query("WITH " + _E + ", n AS (SELECT 'o37' AS node UNION SELECT dst FROM u WHERE src = 'o37') SELECT src, dst FROM e WHERE src IN (SELECT node FROM n) OR dst IN (SELECT node FROM n)")
def subgraph_2hop(spark, d):
    return graph.subgraph(_bipartite(spark, d), "o37", 2)


def _triples(spark, d):
    n, r, s = (table(spark, d, x) for x in ("nation", "region", "supplier"))
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda df, s_, p, o: df.select(s_.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    out = t(n, k("n", "n_nationkey"), "rdf:type", F.lit("Nation"))
    for x in (t(n, k("n", "n_nationkey"), "rdfs:label", F.col("n_name")), t(n, k("n", "n_nationkey"), "in", k("r", "n_regionkey")), t(r, k("r", "r_regionkey"), "rdf:type", F.lit("Region")), t(r, k("r", "r_regionkey"), "rdfs:label", F.col("r_name")), t(s, k("s", "s_suppkey"), "rdf:type", F.lit("Supplier")), t(s, k("s", "s_suppkey"), "in", k("n", "s_nationkey"))):
        out = out.unionByName(x)
    return out


_T = "t AS (SELECT 'n' || n_nationkey AS s, 'rdf:type' AS p, 'Nation' AS o FROM nation UNION SELECT 'n' || n_nationkey, 'rdfs:label', n_name FROM nation UNION SELECT 'n' || n_nationkey, 'in', 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'rdf:type', 'Region' FROM region UNION SELECT 'r' || r_regionkey, 'rdfs:label', r_name FROM region UNION SELECT 's' || s_suppkey, 'rdf:type', 'Supplier' FROM supplier UNION SELECT 's' || s_suppkey, 'in', 'n' || s_nationkey FROM supplier)"


@query("WITH " + _T + " SELECT s, p, o FROM t WHERE s = 'n3' OR o = 'n3'")
def neighborhood(spark, d):
    return graph.neighbourhood(_triples(spark, d), "n3")


@query("WITH " + _T + " SELECT a.s, l.o AS label FROM t a LEFT JOIN t l ON l.s = a.s AND l.p = 'rdfs:label' WHERE a.p = 'rdf:type' AND a.o = 'Nation'")
def find_by_type(spark, d):
    return graph.instances(_triples(spark, d), "Nation")


@query("SELECT DISTINCT l_returnflag AS type, l_linestatus AS src, p_brand AS dst FROM lineitem JOIN part ON p_partkey = l_partkey")
def relationships_distinct(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return graph.relationships(l.select(F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("src"), F.col("p_brand").alias("dst")))


@query("SELECT DISTINCT l_partkey AS property, p_brand AS owner FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (l_returnflag = 'R' OR l_quantity > 30) AND p_size > 10")
def property_owner_union(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 10").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lambda cond: l.where(cond).select(F.col("l_partkey").alias("property"), F.col("p_brand").alias("owner"))
    return catalog.owners(rows("l_returnflag = 'R'"), rows("l_quantity > 30"))


@query("""WITH d AS (SELECT DISTINCT l_partkey AS name, s_nationkey AS prefix, s_suppkey AS pos, s_name AS definition FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), u AS (SELECT p_partkey AS use, p_partkey AS name, p_size % 25 AS prefix FROM part)
SELECT use, definition FROM (SELECT use, definition, row_number() OVER (PARTITION BY use ORDER BY (d.prefix IS NOT DISTINCT FROM u.prefix) DESC, pos) AS k FROM u LEFT JOIN d USING (name)) WHERE k = 1""")
def best_match_definition(spark, d):
    defs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    defs = defs.select(F.col("l_partkey").alias("name"), F.col("s_nationkey").alias("prefix"), F.col("s_name").alias("definition"), F.col("s_suppkey").alias("pos"))
    uses = table(spark, d, "part").select(F.col("p_partkey").alias("use"), F.col("p_partkey").alias("name"), (F.col("p_size") % 25).alias("prefix"))
    return catalog.best_definition(uses, defs).select("use", "definition")


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE n_name END, ''), r_name) AS parent, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def enrich_left_joins(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    own = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("n_name"))
    return c.select("c_custkey", F.coalesce(F.nullif(own, F.lit("")), "r_name").alias("parent"), "n_name", "r_name")


@query("SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def concept_summary(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("items"))
    return table(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("items", F.lit("")).alias("items"))


@query(f"""{_M}, g AS (SELECT 'pending' AS code, concept AS key FROM matrix WHERE "reviewStatus" = 'pending-review' UNION ALL SELECT 'undecided', concept || '/' || name FROM pm WHERE action = 'human-must-decide'
 UNION ALL SELECT 'invalid-target', concept FROM matrix WHERE target = 'nc:5Type' UNION ALL SELECT 'missing-target', concept || '/' || name FROM pm WHERE action = 'reuse-property' AND target NOT IN (SELECT property FROM has)) SELECT code, count(*) AS n, min(key) AS first FROM g GROUP BY code""")
def review_exit_gate(spark, d):
    m, p = matrix(spark, d)
    has = model(spark, d)[2]
    ok = m.where("target is not null and target <> 'nc:5Type'").select(F.col("target").alias("name")).distinct()
    return decide.exit_gate(m, p, ok, has.select(F.col("property").alias("key")).distinct()).groupBy("code").agg(F.count("*").alias("n"), F.min("key").alias("first"))


@query(f"""{_M} SELECT concept, name, CASE WHEN concept IN (SELECT concept FROM matrix WHERE pos % 2 = 0) AND action <> 'human-must-decide' THEN 'accepted' ELSE 'pending-review' END AS "reviewStatus",
 CASE WHEN concept IN (SELECT concept FROM matrix WHERE pos % 2 = 0) AND action <> 'human-must-decide' AND NOT guess THEN 'confident' ELSE confidence END AS confidence FROM pm""")
def accept_properties(spark, d):
    m, p = matrix(spark, d)
    p = p.withColumns({"reviewStatus": F.lit("pending-review"), "confidenceExplicit": F.col("guess")})
    return review.accept_properties(p, m.where("pos % 2 = 0")).select("concept", "name", "reviewStatus", "confidence")


@query("SELECT p_brand, p_type, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1")
def source_entries_first(spark, d):
    return catalog.first_by(table(spark, d, "part").select("p_brand", "p_type", "p_name", "p_partkey"), ["p_brand", "p_type"], "p_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unfinished_keys(spark, d):
    done = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return review.unfinished(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, "o_custkey")


