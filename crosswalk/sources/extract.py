"""Source models from triples: classes, properties, shapes, codelists, and catalogs of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.values import language_rank, shacl_severity
from crosswalk.operators.catalog import first_by
from crosswalk.operators.lineage import cut
from crosswalk.sources.rdf import RDF, XSD

RDFS, OWL, SH, SKOS = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/ns/shacl#", "http://www.w3.org/2004/02/skos/core#"
DC = "http://purl.org/dc/elements/1.1/description"


def of_type(t: DataFrame, type_: str, blank: bool = False) -> DataFrame:
    """Subjects (iri) of a type, without blank nodes unless asked for."""
    hit = t.where((F.col("p") == RDF + "type") & (F.col("o") == type_))
    return (hit if blank else hit.where("s_kind = 'iri'")).select(F.col("s").alias("iri")).distinct()


def one(t: DataFrame, predicate: str, name: str) -> DataFrame:
    """iri and the least value of a predicate."""
    return t.where(F.col("p") == predicate).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias(name))


def many(t: DataFrame, predicate: str, name: str, only: Column | None = None) -> DataFrame:
    hit = t.where(F.col("p") == predicate)
    return (hit.where(only) if only is not None else hit).groupBy(F.col("s").alias("iri")).agg(F.sort_array(F.collect_set("o")).alias(name))


def qname(iri: Column, namespaces: dict[str, str]) -> Column:
    """prefix:name by the first namespace (of ``namespaces``, IRI by prefix, in order) that fits, else the IRI."""
    out = None
    for prefix, base in namespaces.items():
        hit = F.concat(F.lit(prefix + ":"), F.substr(iri, F.lit(len(base) + 1)))
        out = F.when(iri.startswith(base), hit) if out is None else out.when(iri.startswith(base), hit)
    return out.otherwise(iri) if out is not None else iri


def _all(x: str, namespaces: dict[str, str]) -> Column:
    return F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda i: qname(i, namespaces))


def classes(t: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """iri, qname, label, comment and parents of every named class."""
    c = of_type(t, OWL + "Class").join(one(t, RDFS + "label", "label"), "iri", "left").join(one(t, RDFS + "comment", "comment"), "iri", "left")
    c = c.join(many(t, RDFS + "subClassOf", "parents", F.col("o_kind") == "iri"), "iri", "left")
    return c.select("iri", qname(F.col("iri"), namespaces).alias("qname"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("comment", F.lit("")).alias("comment"), _all("parents", namespaces).alias("subClassOf"))


def properties(t: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """Object and datatype properties with domains and ranges; a datatype's ranges stay IRIs."""
    out = None
    for kind, type_ in (("object", "ObjectProperty"), ("datatype", "DatatypeProperty")):
        p = of_type(t, OWL + type_).join(one(t, RDFS + "label", "label"), "iri", "left").join(one(t, RDFS + "comment", "comment"), "iri", "left")
        p = p.join(many(t, RDFS + "domain", "domain", F.col("o_kind") == "iri"), "iri", "left").join(many(t, RDFS + "range", "range", F.col("o_kind") == "iri" if kind == "object" else None), "iri", "left")
        none = F.array().cast("array<string>")
        p = p.select(F.lit(kind).alias("kind"), "iri", qname(F.col("iri"), namespaces).alias("qname"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("comment", F.lit("")).alias("comment"), _all("domain", namespaces).alias("domain"), (_all("range", namespaces) if kind == "object" else F.coalesce("range", none)).alias("range"))
        out = p if out is None else out.unionByName(p)
    return out


def codelists(t: DataFrame) -> DataFrame:
    """Concept schemes with their concepts; labels are rdfs:label, '' without one."""
    label = one(t, RDFS + "label", "label")
    within = t.where(F.col("p") == SKOS + "inScheme").select(F.col("s").alias("iri"), F.col("o").alias("scheme"))
    concepts = within.join(label, "iri", "left").groupBy("scheme").agg(F.sort_array(F.collect_list(F.struct("iri", F.coalesce("label", F.lit("")).alias("label")))).alias("concepts"))
    return of_type(t, SKOS + "ConceptScheme").join(label, "iri", "left").join(concepts, F.col("iri") == F.col("scheme"), "left").select("iri", F.coalesce("label", F.lit("")).alias("label"), F.coalesce(F.size("concepts"), F.lit(0)).alias("conceptCount"), "concepts")


def shapes(t: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """A row for each property constraint of each shape: shape, class, path, min, max, datatype, deactivated, severity. A path that is no IRI is null.

    Triples are made once and what shapes need of them is kept. No table is sent whole: Spark takes parsed triples for much smaller than they are.
    """
    p, o = F.col("p"), F.col("o")
    values = {"minCount": "min", "maxCount": "max", "datatype": "datatype", "class": "value_class", "severity": "severity"}
    node, off = (p == RDF + "type") & (o == SH + "NodeShape"), (p == SH + "deactivated") & (o == "true")
    path = (p == SH + "path") & (F.col("o_kind") == "iri")
    own = off | path | p.isin([SH + x for x in values])
    kept = cut(t.where(node | own | p.isin(SH + "property", SH + "targetClass")).select("s", "p", "o", "o_kind"))
    link = kept.where(p == SH + "property").select(F.col("s").alias("shape"), o.alias("iri"))
    of_iri = kept.where(own).groupBy(F.col("s").alias("iri")).agg(F.min(F.when(path, o)).alias("path"), *[F.min(F.when(p == SH + x, o)).alias(name) for x, name in values.items()], F.bool_or(off).alias("off_iri"))
    of_shape = kept.where(node | off).groupBy(F.col("s").alias("shape")).agg(F.bool_or(node).alias("is_shape"), F.bool_or(off).alias("off_shape")).where("is_shape")
    target = kept.where(p == SH + "targetClass").select(F.col("s").alias("shape"), o.alias("class"))
    out = link.join(of_iri.hint("merge"), "iri", "left").join(of_shape.hint("merge"), "shape").join(target.hint("merge"), "shape", "left")
    return out.select("shape", qname(F.col("class"), namespaces).alias("class"), qname(F.col("path"), namespaces).alias("path"), F.when(F.col("path").isNull(), "expression").otherwise("path").alias("pathKind"), F.col("min").cast("int").alias("min"), F.col("max").cast("int").alias("max"), "datatype", qname(F.col("value_class"), namespaces).alias("valueClass"), (F.coalesce("off_shape", F.lit(False)) | F.coalesce("off_iri", F.lit(False))).alias("deactivated"), shacl_severity(F.col("severity")).alias("severity"))


def best_label(t: DataFrame) -> DataFrame:
    """iri and its label, one without language or in English before others."""
    return first_by(t.where(F.col("p") == RDFS + "label"), ["s"], language_rank(F.col("o_lang")), "o").select(F.col("s").alias("iri"), F.col("o").alias("label"))


def alternative_labels(t: DataFrame) -> DataFrame:
    """iri and its distinct skos:altLabel texts in order, those without language or in English."""
    own = t.where((F.col("p") == SKOS + "altLabel") & (F.col("o_kind") == "literal") & (F.coalesce(F.lower("o_lang"), F.lit("")).isin("", "en", "en-us")))
    return own.groupBy(F.col("s").alias("iri")).agg(F.sort_array(F.collect_set("o")).alias("labels"))


def best_definition(t: DataFrame) -> DataFrame:
    """iri and its trimmed definition: skos:definition (not 'NULL'), else rdfs:comment, else dc:description."""
    rank = F.when(F.col("p") == SKOS + "definition", 0).when(F.col("p") == RDFS + "comment", 1).when(F.col("p") == DC, 2)
    d = t.withColumn("rank", rank).withColumn("d", F.trim("o")).where("rank is not null and d <> '' and not (rank = 0 and d = 'NULL')")
    return first_by(d, ["s"], "rank", "d").select(F.col("s").alias("iri"), F.col("d").alias("definition"))


def catalog_types(t: DataFrame, namespaces: dict[str, str]) -> DataFrame:
    """Target classes outside of W3C's namespaces, with label, definition, parents and chain-free base."""
    c = of_type(t, OWL + "Class").where(~F.col("iri").startswith("http://www.w3.org/"))
    parents = many(t.where(~F.col("o").startswith(OWL)), RDFS + "subClassOf", "parents", F.col("o_kind") == "iri")
    c = c.join(best_label(t), "iri", "left").join(best_definition(t), "iri", "left").join(parents, "iri", "left")
    return c.select("iri", qname(F.col("iri"), namespaces).alias("qname"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("definition", F.lit("")).alias("definition"), _all("parents", namespaces).alias("parents"))


def primary_namespace(cls: DataFrame) -> DataFrame:
    from crosswalk.functions.names import namespace_of

    return cls.groupBy(namespace_of(F.col("iri")).alias("namespace")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "namespace")


__all__ = ["XSD", "alternative_labels", "best_definition", "best_label", "catalog_types", "classes", "codelists", "many", "of_type", "one", "primary_namespace", "properties", "qname", "shapes"]
