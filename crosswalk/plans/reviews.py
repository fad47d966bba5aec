"""Queries on reviews, joins of names and counts that no other query has, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswalk.operators import catalog, decide, evaluate, graph, review, summaries
from crosswalk.plans.tables import MODEL_SQL, matrix, model, table

QUERIES, SQL = {}, {}
_M = "WITH " + MODEL_SQL


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _s(*parts):
    """Text of columns (at odd places) between literals."""
    return F.concat(*[F.lit(p) if i % 2 == 0 else (F.col(p) if isinstance(p, str) else p).cast("string") for i, p in enumerate(parts)])


@query("""WITH t AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'a:T' || p_partkey // 3 || 'AugmentationType' ELSE 'n' || p_size || ':T' || p_partkey // 3 || CASE WHEN p_partkey % 3 = 2 AND p_size % 2 = 0 THEN 'AugmentationPoint' ELSE 'Type' END END AS qname FROM part)
SELECT a.qname AS augmentation, min(b.qname) AS base FROM t a JOIN t b ON split_part(b.qname, ':', 2) = replace(split_part(a.qname, ':', 2), 'AugmentationType', 'Type') WHERE a.qname LIKE '%AugmentationType' GROUP BY 1""")
def augmentation_bases(spark, d):
    k = F.expr("p_partkey div 3")
    own = _s("n", "p_size", ":T", k, "")
    name = F.when(F.col("p_partkey") % 3 == 0, _s("a:T", k, "AugmentationType")).otherwise(F.concat(own, F.when((F.col("p_partkey") % 3 == 2) & (F.col("p_size") % 2 == 0), "AugmentationPoint").otherwise("Type")))
    return catalog.augmentation_bases(table(spark, d, "part").select(name.alias("qname")))


@query("""WITH t AS (SELECT 'nc:C' || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'CodeSimpleType' WHEN 2 THEN 'CodeType' WHEN 3 THEN 'SimpleType' ELSE 'Other' END AS qname, 'C' || s_suppkey AS name, s_suppkey % 5 AS r FROM supplier
 UNION ALL SELECT 'nc:C' || s_suppkey || 'SimpleType', 'C' || s_suppkey, 3 FROM supplier WHERE s_suppkey % 7 = 0)
SELECT name, arg_min(qname, r) AS qname FROM t WHERE r < 4 GROUP BY name""")
def codelist_types(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 5
    suffix = F.when(k == 0, "").when(k == 1, "CodeSimpleType").when(k == 2, "CodeType").when(k == 3, "SimpleType").otherwise("Other")
    types = s.select(F.concat(_s("nc:C", "s_suppkey", ""), suffix).alias("qname")).unionByName(s.where("s_suppkey % 7 = 0").select(_s("nc:C", "s_suppkey", "SimpleType").alias("qname")))
    return catalog.codelist_types(s.select(_s("C", "s_suppkey", "").alias("name")), types)


@query("""WITH p AS (SELECT DISTINCT s_nationkey AS concept, 'p' || s_suppkey % 3 || ':n' || s_suppkey % 20 AS qname, 'n' || s_suppkey % 20 AS local FROM supplier), o AS (SELECT concept, local, min(qname) AS qname FROM p GROUP BY ALL HAVING count(*) = 1),
r AS (SELECT DISTINCT s_nationkey AS concept, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_suppkey % 20 ELSE 'p' || s_suppkey % 4 || ':n' || s_suppkey % 20 END AS ref FROM supplier)
SELECT r.concept, r.ref, coalesce(p.qname, o.qname) AS qname FROM r LEFT JOIN p ON p.concept = r.concept AND p.qname = r.ref LEFT JOIN o ON o.concept = r.concept AND o.local = r.ref""")
def property_references(spark, d):
    s = table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_suppkey") % 20
    props = s.select(F.col("s_nationkey").alias("concept"), _s("p", k % 3, ":n", n, "").alias("qname"))
    refs = s.select(F.col("s_nationkey").alias("concept"), F.when(k % 2 == 0, _s("n", n, "")).otherwise(_s("p", k % 4, ":n", n, "")).alias("ref")).distinct()
    return catalog.unique_locals(refs, props)


@query("SELECT l_orderkey, l_suppkey, count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def decision_conflicts(spark, d):
    return catalog.conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])


@query("""WITH t AS (SELECT 'c:' || c_custkey AS qname, 'N' || c_custkey % 700 AS name, c_nationkey % 3 = 0 AS own, c_nationkey % 2 = 0 AS clean FROM customer),
r AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY own DESC, clean DESC, qname) AS k FROM t)
SELECT qname, CASE WHEN n = 1 OR (k = 1 AND own) THEN name ELSE name || '_' || substr(sha1(qname), 1, 8) END AS label FROM r""")
def graph_labels(spark, d):
    c = table(spark, d, "customer").select(_s("c:", "c_custkey", "").alias("qname"), _s("N", F.col("c_custkey") % 700, "").alias("name"), (F.col("c_nationkey") % 3 == 0).alias("own"), (F.col("c_nationkey") % 2 == 0).alias("clean"))
    return catalog.graph_labels(c).select("qname", "label")


@query(f"""{_M}, n AS (SELECT c.concept, c.target, count(*) FILTER (bucket <> 'not_found') AS f, count(*) FILTER (bucket = 'not_found') AS n FROM concepts c LEFT JOIN bucketed b USING (concept) GROUP BY ALL)
SELECT concept, CASE WHEN target IS NULL THEN 'extend' WHEN n = 0 THEN 'reuse' ELSE 'extend' END AS action, CASE WHEN target IS NULL THEN 'structures:ObjectType' WHEN n > 0 THEN target END AS "baseType" FROM n""")
def plain_actions(spark, d):
    return decide.resolve(*model(spark, d), "structures:ObjectType", augmenting=False).select("concept", "action", "baseType")


@query(f"""{_M} SELECT concept, CASE WHEN pos % 6 = 0 THEN 'accepted' ELSE "reviewStatus" END AS "reviewStatus" FROM matrix""")
def accepted_concepts(spark, d):
    m = matrix(spark, d)[0]
    return review.accept(m, m.where("pos % 6 = 0").select("concept")).select("concept", "reviewStatus")


@query(f"""{_M}, open AS (SELECT DISTINCT concept FROM pm WHERE action = 'human-must-decide') SELECT concept, CASE WHEN action <> 'exclude' THEN 'accepted' ELSE "reviewStatus" END AS "reviewStatus" FROM matrix WHERE concept NOT IN (SELECT concept FROM open)""")
def approved_matrix(spark, d):
    m, p = matrix(spark, d)
    open_ = p.where("action = 'human-must-decide'").select("concept").distinct()
    return review.approve_all(m.join(open_, "concept", "left_anti"), p.join(open_, "concept", "left_anti")).select("concept", "reviewStatus")


@query(f"""{_M} SELECT concept, name, CASE WHEN guess THEN 'create-property' ELSE action END AS action, CASE WHEN guess THEN NULL ELSE target END AS target, CASE WHEN guess THEN 'accepted' ELSE 'pending-review' END AS status FROM pm""")
def decided_properties(spark, d):
    _, props, has = model(spark, d)
    p = matrix(spark, d)[1].withColumn("reviewStatus", F.lit("pending-review"))
    first = p.where("guess").select("concept", "name", F.lit("reuse-property").alias("action"), F.lit("nc:nowhere").alias("target"), F.lit(1).alias("seq"))
    last = first.select("concept", "name", F.lit("create-property").alias("action"), F.lit(None).cast("string").alias("target"), F.lit(2).alias("seq"))
    return review.decide_property(p, first.unionByName(last), has.select(F.col("property").alias("key")).distinct()).select("concept", "name", "action", "target", F.col("reviewStatus").alias("status"))


@query("""SELECT o_orderkey, o_orderkey % 9 AS number, CASE WHEN o_orderkey % 9 >= 5 THEN 'pending' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 9 < 5 THEN o_totalprice END AS completed_at FROM orders""")
def reopened_stages(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).alias("number"), F.lit("completed").alias("status"), F.col("o_totalprice").alias("completed_at"))
    return review.reopen(o, 5)


@query(f"""{_M}, own AS (SELECT concept, string_agg(name, ',' ORDER BY name) AS names FROM pm WHERE guess GROUP BY concept) SELECT 100 + row_number() OVER (ORDER BY concept) AS id, concept, coalesce(names, '') AS names FROM matrix LEFT JOIN own USING (concept)""")
def saved_log(spark, d):
    m, p = matrix(spark, d)
    log = table(spark, d, "region").agg((F.max("r_regionkey") * 0 + 100).alias("id"))
    kept = p.withColumn("reviewStatus", F.when(F.col("guess"), "accepted"))
    got = review.saved(log, m.select("concept", "action", "target", "rationale"), kept)
    return got.select(F.col("id").cast("long").alias("id"), "concept", F.array_join(F.transform("propertyDecisions", lambda x: x["name"]), ",").alias("names"))


@query("""SELECT count(*) AS types, count(*) FILTER (p_size % 3 <> 0) AS with_base, count(*) FILTER (p_size % 2 = 0) AS with_properties, count(*) FILTER (p_size % 5 = 0) AS with_facets, count(*) FILTER (p_size % 7 = 0) AS with_chain FROM part""")
def type_counts(spark, d):
    some = lambda n: F.when(F.col("p_size") % n == 0, F.array("p_name"))
    p = table(spark, d, "part").select(F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("base"), some(2).alias("properties"), some(5).alias("facets"), some(7).alias("chain"))
    return summaries.catalog_stats(p)


@query("""SELECT count(*) FILTER (o_orderstatus = 'O') AS passed, count(*) FILTER (o_orderstatus <> 'O' AND o_orderkey % 2 = 0) AS failed, count(*) FILTER (o_orderstatus <> 'O' AND o_orderkey % 2 = 1) AS warned FROM orders""")
def check_summary(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "pass").otherwise("fail").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "error").otherwise("warning").alias("severity"))
    return summaries.checks(o)


@query("SELECT o_orderstatus AS status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS percent FROM orders GROUP BY 1")
def evaluation_progress(spark, d):
    return evaluate.progress(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


@query("""WITH s AS (SELECT s_nationkey AS doc, s_suppkey AS pos, 'd' || s_suppkey % 10 AS id, 'q:' || s_suppkey AS qname FROM supplier), c AS (SELECT doc, id, arg_max(qname, pos) AS q FROM s GROUP BY ALL), e AS (SELECT c_custkey, c_nationkey AS doc, 'd' || c_custkey % 12 AS t FROM customer)
SELECT c_custkey, coalesce(q, t) AS target, CASE WHEN q <> t THEN t END AS label FROM e LEFT JOIN c ON c.doc = e.doc AND c.id = e.t""")
def targets_by_display(spark, d):
    e = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("doc"), _s("d", F.col("c_custkey") % 12, "").alias("target"))
    own = table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("pos"), _s("d", F.col("s_suppkey") % 10, "").alias("id"), _s("q:", "s_suppkey", "").alias("qname"))
    return decide.display_to_qname(e, own).select("c_custkey", "target", "label")


@query("""SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN 'About ' || n_name ELSE c_name END AS definition, substr(sha256(CASE WHEN n_nationkey % 2 = 0 THEN 'About ' || n_name ELSE c_name END), 1, 16) AS hash FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def target_definitions(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    e = c.select("c_custkey", _s("n", "c_nationkey", "").alias("target"), F.col("c_name").alias("definition"))
    known = n.where("n_nationkey % 2 = 0").select(_s("n", "n_nationkey", "").alias("key"), F.concat(F.lit("About "), "n_name").alias("definition"))
    return decide.with_hashes(e, known).select("c_custkey", F.col("targetDefinition").alias("definition"), F.col("targetDefinitionHash").alias("hash"))


@query("""SELECT 'x:c' || c_custkey AS s, CASE WHEN c_custkey % 4 = 0 THEN 'x:A' ELSE 'x:Customer' END AS class, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_custkey::VARCHAR ELSE 'x:c' || c_custkey END AS identifier FROM customer""")
def seed_nodes(spark, d):
    c = table(spark, d, "customer").withColumn("s", _s("x:c", "c_custkey", ""))
    of = lambda p, o, kind: c.select("s", F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind")).where("o is not null")
    t = of("rdf:type", F.lit("x:Customer"), "iri").unionByName(of("rdf:type", F.when(F.col("c_custkey") % 4 == 0, "x:A"), "iri")).unionByName(of("identifier", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), "literal"))
    t = t.unionByName(of("x:custNumber", F.when(F.col("c_custkey") % 3 != 2, F.col("c_custkey").cast("string")), "literal")).unionByName(of("x:segment", F.col("c_mktsegment"), "literal")).unionByName(of("rdf:type", F.lit("x:Unused"), "iri"))
    classes = c.limit(1).select(F.explode(F.array(F.lit("x:A"), F.lit("x:Customer"))).alias("class"))
    return graph.seed_nodes(t, classes).select("s", "class", "identifier")
