"""Queries that read models made of the given tables in the formats that sources have."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswalk.functions.names import id_to_qname
from crosswalk.plans.tables import table
from crosswalk.sources import extract, models, rdf

QUERIES, SQL = {}, {}
HEAD = """@prefix x: <http://example.test/ns#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
"""
NAMES = {"x": "http://example.test/ns#"}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])


def _documents(rows, line, key: str):
    """A document for each thousand rows, so that one is small however many there are."""
    return rows.groupBy(F.floor(F.col(key) / 1000).cast("string").alias("graph")).agg(F.concat(F.lit(HEAD), F.array_join(F.collect_list(line), "")).alias("text"))


@query("SELECT 'x:S' || s_suppkey AS qname, s_name AS label, 'Of nation ' || s_nationkey AS comment, 'x:N' || s_nationkey AS parents FROM supplier")
def rdf_extract_classes(spark, d):
    s = table(spark, d, "supplier")
    line = _text("x:S", "s_suppkey", ' a owl:Class ; rdfs:label "', "s_name", '"@en , "', "s_name", '" ; rdfs:comment "Of nation ', "s_nationkey", '" ; rdfs:subClassOf x:N', "s_nationkey", " .\n[] rdfs:member ( x:S", "s_suppkey", " 3 2.5 true ) .\n")
    return extract.classes(rdf.parse_column(_documents(s, line, "s_suppkey")), NAMES).select("qname", "label", "comment", F.array_join("subClassOf", ",").alias("parents"))


@query("SELECT 'x:S' || s_suppkey AS class, 'x:p' || s_nationkey AS path, 1 AS min, s_nationkey + 1 AS max, 'http://www.w3.org/2001/XMLSchema#string' AS datatype, s_suppkey % 2 = 0 AS deactivated FROM supplier")
def rdf_shapes(spark, d):
    s = table(spark, d, "supplier").withColumns({"most": F.col("s_nationkey") + 1, "off": (F.col("s_suppkey") % 2 == 0).cast("string")})
    line = _text("x:Shape", "s_suppkey", " a sh:NodeShape ; sh:targetClass x:S", "s_suppkey", " ; sh:deactivated ", "off", " ; sh:property [ sh:path x:p", "s_nationkey", " ; sh:minCount 1 ; sh:maxCount ", "most", " ; sh:datatype xsd:string ] .\n")
    return extract.shapes(rdf.parse_column(_documents(s, line, "s_suppkey")), NAMES).select("class", "path", "min", "max", "datatype", "deactivated")


@query("""SELECT r_name AS class, n_name AS attribute, CASE WHEN n_nationkey % 3 = 0 THEN 'object' ELSE 'datatype' END AS kind, CASE n_nationkey % 3 WHEN 0 THEN 'Office' WHEN 1 THEN 'xs:integer' ELSE 'xs:string' END AS range, 1 AS min FROM nation JOIN region ON r_regionkey = n_regionkey""")
def csv_model_inventory(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    none = F.lit(None).cast("string")
    k = F.col("n_nationkey") % 3
    heads = r.select(F.col("r_name").alias("class"), none.alias("attribute"), none.alias("type"), none.alias("multiplicity"), none.alias("definition"), (F.col("r_regionkey").cast("long") * 1_000_000).alias("pos"))
    rows = n.select(none.alias("class"), F.col("n_name").alias("attribute"), F.when(k == 0, "(Office)").when(k == 1, "int").otherwise("string").alias("type"), F.lit("1").alias("multiplicity"), F.lit("Element# 4\nA nation.").alias("definition"), (F.col("n_regionkey").cast("long") * 1_000_000 + F.col("n_nationkey") + 1).alias("pos"))
    return models.csv_model(heads.unionByName(rows)).select("class", "attribute", "kind", "range", "min")


@query("SELECT 'nc:C' || c_custkey AS qname, c_name AS definition, 'structures:ObjectType' AS base, 'nc:P' || c_nationkey AS property, '0' AS min, 'unbounded' AS max FROM customer")
def xml_catalog_types(spark, d):
    c = table(spark, d, "customer")
    text = _text('<Model><Class id="nc.C', "c_custkey", '"><DefinitionText>', "c_name", '</DefinitionText><ExtensionOfClass ref="structures.ObjectType"/><HasProperty><DatatypeProperty ref="nc.P', "c_nationkey", '"/><MinOccursQuantity>0</MinOccursQuantity><MaxOccursQuantity>unbounded</MaxOccursQuantity></HasProperty></Class></Model>')
    schema = "Class struct<_id:string,DefinitionText:string,ExtensionOfClass:struct<_ref:string>,HasProperty:array<struct<DatatypeProperty:struct<_ref:string>,MinOccursQuantity:string,MaxOccursQuantity:string>>>"
    m = c.select(F.from_xml(text, schema).alias("m")).select("m.Class.*").withColumn("p", F.explode_outer("HasProperty"))
    return m.select(id_to_qname(F.col("_id")).alias("qname"), F.col("DefinitionText").alias("definition"), id_to_qname(F.col("ExtensionOfClass._ref")).alias("base"), id_to_qname(F.col("p.DatatypeProperty._ref")).alias("property"), F.col("p.MinOccursQuantity").alias("min"), F.col("p.MaxOccursQuantity").alias("max"))
