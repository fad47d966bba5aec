"""Artifacts of a package: ontologies by file, shapes, code lists, exchange models, manifests and reports, as rows of lines or of XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.names import is_full_iri, kebab, qname_to_id, split_capitals
from crosswalk.functions.values import xml_datatype
from crosswalk.operators.catalog import first_by
from crosswalk.sinks.emit import _t, turtle_term

CORE, EXTENSIONS, ALL, COMBINED = "core", "extensions", "all", "combined"


def file_of(action: Column) -> Column:
    """The ontology file that a class's block belongs to: reused ones to the core, the others to the extensions."""
    return F.when(action == "reuse", CORE).when(action.isin("extend", "augment"), EXTENSIONS)


def ontology_files(blocks: DataFrame) -> DataFrame:
    """Blocks (file, section, key, line) of core and extensions with what the other files hold: ``combined`` every line once, ``all`` two imports."""
    both = blocks.where(F.col("file").isin(CORE, EXTENSIONS)).select(F.lit(COMBINED).alias("file"), "section", "key", "line").distinct()
    imports = blocks.sparkSession.createDataFrame([(ALL, 0, f, f"<> owl:imports <{f}.ttl> .") for f in (CORE, EXTENSIONS)], "file string, section int, key string, line string")
    return blocks.select("file", "section", "key", "line").unionByName(both).unionByName(imports)


def prefixes_used(terms: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Distinct prefixes (prefix, uri) of the qualified names among terms (term); full IRIs and names of unknown prefixes have none."""
    used = terms.where((F.instr("term", ":") > 0) & ~is_full_iri(F.col("term"))).select(F.substring_index("term", ":", 1).alias("prefix")).distinct()
    return used.join(namespaces.select("prefix", "uri"), "prefix").select("prefix", "uri")


def references(terms: DataFrame, bound: DataFrame, uris: DataFrame) -> DataFrame:
    """How each term (term) is written: a full IRI in brackets, a name as it is if its prefix is bound (prefix), else its IRI (term, uri) in brackets, else null, which drops it."""
    got = terms.withColumn("prefix", F.substring_index("term", ":", 1)).join(bound.select("prefix", F.lit(True).alias("__bound")).distinct(), "prefix", "left").join(uris.select("term", "uri").dropDuplicates(["term"]), "term", "left")
    ref = F.when(is_full_iri(F.col("term")), _t("<", F.col("term"), ">")).when(F.col("__bound"), F.col("term")).when(F.col("uri").isNotNull(), _t("<", F.col("uri"), ">"))
    return got.select("term", ref.alias("ref"))


def dropped(refs: DataFrame) -> DataFrame:
    """Warnings for terms that could not be written."""
    return refs.where("ref is null").select(F.lit("warning").alias("severity"), F.lit("REF-001").alias("code"), F.col("term").alias("key"), F.lit("no prefix and no address").alias("message")).distinct()


def augmentation_properties(properties: DataFrame) -> DataFrame:
    """Declared properties (property, kind, range, augmentedType) of augmented classes, with the augmented type as domain."""
    kind = F.when(F.col("kind") == "object", "owl:ObjectProperty").otherwise("owl:DatatypeProperty")
    line = _t(F.col("property"), " a ", kind, " ; rdfs:domain ", F.col("augmentedType"), F.when(F.col("range").isNotNull(), _t(" ; rdfs:range ", F.col("range"))).otherwise(""), " .")
    return properties.select(F.lit(EXTENSIONS).alias("file"), F.lit(3).alias("section"), F.col("property").alias("key"), line.alias("line")).distinct()


def global_properties(properties: DataFrame, prefix: str) -> DataFrame:
    """Properties (qname, kind, label) that no class owns, declared under ``prefix`` without a domain."""
    name = F.concat(F.lit(prefix + ":"), F.substring_index("qname", ":", -1))
    kind = F.when(F.col("kind") == "object", "owl:ObjectProperty").otherwise("owl:DatatypeProperty")
    none = F.lit(None).cast("string")
    label = F.when(F.coalesce("label", F.lit("")) != "", _t(" ; rdfs:label ", turtle_term(F.col("label"), F.lit("literal"), none, none))).otherwise("")
    return properties.select(F.lit(CORE).alias("file"), F.lit(4).alias("section"), name.alias("key"), _t(name, " a ", kind, label, " .").alias("line")).dropDuplicates(["key"])


def shape_blocks(constraints: DataFrame) -> DataFrame:
    """A shape for each class (class) with its constraints (path, min, max, datatype, valueClass): the largest minimum and smallest maximum of a path; paths of several terms, as a list, are alternatives.

    ``paths``: the terms that a source property was emitted as. Shapes of classes with one name get a number from the second on.
    """
    c = constraints.groupBy("class", "paths").agg(F.max("min").alias("min"), F.min("max").alias("max"), F.min("datatype").alias("datatype"), F.min("valueClass").alias("valueClass"))
    path = F.when(F.size("paths") == 1, F.element_at("paths", 1)).otherwise(_t("[ sh:alternativePath ( ", F.array_join("paths", " "), " ) ]"))
    part = lambda col, name: F.when(F.col(col).isNotNull(), _t(f" ; sh:{name} ", F.col(col))).otherwise("")
    prop = _t("[ sh:path ", path, part("min", "minCount"), part("max", "maxCount"), part("datatype", "datatype"), part("valueClass", "class"), " ]")
    from pyspark.sql import Window

    shape = c.groupBy("class").agg(F.sort_array(F.collect_list(prop)).alias("props"))
    local = F.concat(F.substring_index("class", ":", -1), F.lit("Shape"))
    n = F.row_number().over(Window.partitionBy(local).orderBy("class"))
    named = shape.withColumn("name", F.when(n == 1, local).otherwise(F.concat(local, F.lit("_"), n.cast("string"))))
    line = _t("edge:", F.col("name"), " a sh:NodeShape ; sh:targetClass ", F.col("class"), " ; sh:property ", F.array_join("props", " , "), " .")
    return named.select(F.lit("shapes").alias("file"), F.lit(1).alias("section"), F.col("class").alias("key"), line.alias("line"))


def shared_target_shapes(targets: DataFrame, constraints: DataFrame) -> DataFrame:
    """For a target that several classes (target, class) are mapped to, one shape that a node meets by meeting all constraints of one of them; a class without constraints is a branch that everything meets."""
    from crosswalk.operators.catalog import having_many

    shared = having_many(targets, "target", "class").select("target")
    each = targets.join(shared, "target", "left_semi").join(constraints.select("class", "line"), "class", "left")
    branch = each.groupBy("target", "class").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    text = F.when(F.size("lines") == 0, F.lit("[ ]")).otherwise(_t("[ sh:and ( ", F.array_join("lines", " "), " ) ]"))
    got = branch.withColumn("text", text).groupBy("target").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    return got.select(F.lit("shapes").alias("file"), F.lit(2).alias("section"), F.col("target").alias("key"), _t("[] a sh:NodeShape ; sh:targetClass ", F.col("target"), " ; sh:or ( ", F.array_join("texts", " "), " ) .").alias("line"))


def codelist_blocks(values: DataFrame) -> DataFrame:
    """Code lists (scheme, value, label) as schemes and concepts, each once."""
    none = F.lit(None).cast("string")
    q = lambda c: turtle_term(c, F.lit("literal"), none, none)
    s = values.select(F.lit("codelists").alias("file"), F.lit(1).alias("section"), F.col("scheme").alias("key"), _t(F.col("scheme"), " a skos:ConceptScheme .").alias("line")).distinct()
    v = first_by(values, ["scheme", "value"], "label")
    c = v.select(F.lit("codelists").alias("file"), F.lit(2).alias("section"), F.concat_ws("/", "scheme", "value").alias("key"), _t(F.col("scheme"), "_", F.col("value"), " a skos:Concept ; skos:inScheme ", F.col("scheme"), " ; skos:prefLabel ", q(F.coalesce("label", "value")), " .").alias("line"))
    return s.unionByName(c)


def role_codelists(excluded: DataFrame) -> DataFrame:
    """A code list for each parent (parent) of several excluded classes (class): they are consolidated into it and tell their role by a value, named after them."""
    from crosswalk.operators.catalog import having_many

    parents = having_many(excluded, "parent", "class").select("parent")
    local = F.substring_index("class", ":", -1)
    e = excluded.join(parents, "parent", "left_semi")
    return e.select(F.concat(F.substring_index("parent", ":", -1), F.lit("RoleCode")).alias("scheme"), kebab(local).alias("value"), F.trim(split_capitals(local, " ")).alias("label")).distinct()


def codelist_mappings(schemes: DataFrame, types: DataFrame) -> DataFrame:
    """Code lists (name) and the type each is mapped to; null where none fits."""
    from crosswalk.operators.catalog import codelist_types

    return schemes.select("name").distinct().join(codelist_types(schemes, types), "name", "left").select("name", F.col("qname").alias("target"))


# exchange models: components as rows, and their XML


def model_classes(classes: DataFrame) -> DataFrame:
    """Classes (qname, action, base, definition) of an exchange model: extended ones have a base, reused ones are declared as references, excluded ones are none."""
    kept = classes.where(F.col("action").isin("reuse", "extend"))
    return kept.select(F.lit("Class").alias("kind"), qname_to_id(F.col("qname")).alias("id"), F.substring_index("qname", ":", -1).alias("name"), F.coalesce("definition", F.lit("")).alias("definition"), F.when(F.col("action") == "extend", qname_to_id(F.col("base"))).alias("base"))


def model_namespaces(terms: DataFrame, namespaces: DataFrame) -> DataFrame:
    return prefixes_used(terms, namespaces).select(F.lit("Namespace").alias("kind"), F.col("prefix").alias("id"), F.col("prefix").alias("name"), F.lit("").alias("definition"), F.col("uri").alias("base"))


def resolved_range(kind: Column, ranges: Column, stands: Column) -> Column:
    """An object's first range, or what stands for it; a datatype's first XSD range as xs.name, else xs.string."""
    xsd = F.try_element_at(F.filter(ranges, lambda r: r.contains("XMLSchema#") | r.startswith("xs:")), F.lit(1))
    return F.when(kind == "object", qname_to_id(F.coalesce(stands, F.try_element_at(ranges, F.lit(1))))).otherwise(F.coalesce(xml_datatype(xsd), F.lit("xs.string")))


def model_properties(properties: DataFrame) -> DataFrame:
    """Properties (qname, kind, range, definition), declared once each whatever classes have them; the first in order of range counts."""
    kind = F.when(F.col("kind") == "object", "ObjectProperty").otherwise("DatatypeProperty")
    rows = properties.select(kind.alias("kind"), qname_to_id(F.col("qname")).alias("id"), F.substring_index("qname", ":", -1).alias("name"), F.coalesce("definition", F.lit("")).alias("definition"), F.col("range").alias("base"))
    return first_by(rows, ["id"], F.col("base").asc_nulls_last(), "kind", "definition")


def model_associations(members: DataFrame, bounds: DataFrame) -> DataFrame:
    """(class, property, min, max): what each class has, once, with its bounds (class, property, min, max), else 0 to unbounded."""
    got = members.select("class", "property").distinct().join(bounds, ["class", "property"], "left")
    return got.select(qname_to_id(F.col("class")).alias("class"), qname_to_id(F.col("property")).alias("property"), F.coalesce(F.col("min").cast("string"), F.lit("0")).alias("min"), F.coalesce(F.col("max").cast("string"), F.lit("unbounded")).alias("max"))


def model_augmentations(rows: DataFrame) -> DataFrame:
    """Augmentation records (class, property, min, max, code), each once, in order."""
    return rows.select("class", "property", "min", "max", "code").distinct().orderBy("class", "property", "min", "max", "code")


def model_restrictions(values: DataFrame) -> DataFrame:
    """Restrictions of code lists (scheme, value, label) with their sorted values."""
    each = F.struct("value", F.coalesce("label", F.lit("")).alias("label"))
    return values.groupBy(F.concat(F.col("scheme"), F.lit("CodeSimpleType")).alias("id")).agg(F.sort_array(F.collect_set(each)).alias("values"))


def xml_text(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def model_xml(components: DataFrame, associations: DataFrame, group: str | None = None) -> DataFrame:
    """An exchange model as XML text: components (kind, id, name, definition, base) in order of kind and id, classes with their properties (class, property, min, max).

    ``group``: a column by which both are cut into models of their own; without it there is one.
    """
    by = [group] if group else []
    prop = _t("<HasProperty><Property ref=\"", xml_text(F.col("property")), '"/><MinOccursQuantity>', F.col("min"), "</MinOccursQuantity><MaxOccursQuantity>", F.col("max"), "</MaxOccursQuantity></HasProperty>")
    has = associations.groupBy(*by, F.col("class").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(prop)), "").alias("props"))
    c = components.join(has, [*by, "id"], "left")
    el = lambda name, col: F.when(F.coalesce(col, F.lit("")) != "", _t(f"<{name}>", xml_text(col), f"</{name}>")).otherwise("")
    k = F.col("kind")
    ref = F.when(k == "Class", "ExtensionOfClass").when(k == "ObjectProperty", "Class").when(k == "DatatypeProperty", "Datatype")
    base = F.when(F.col("base").isNull(), "").when(k == "Namespace", _t("<NamespaceURI>", xml_text(F.col("base")), "</NamespaceURI>")).otherwise(_t("<", ref, ' ref="', xml_text(F.col("base")), '"/>'))
    text = _t("<", k, ' id="', xml_text(F.col("id")), '">', el("Name", F.col("name")), el("DefinitionText", F.col("definition")), base, F.when(k == "Class", F.coalesce("props", F.lit(""))).otherwise(""), "</", k, ">")
    place = F.array_position(F.array(*[F.lit(x) for x in ("Namespace", "Class", "ObjectProperty", "DatatypeProperty")]), k)
    rows = c.select(*by, F.struct(place.alias("place"), F.col("id").alias("id"), text.alias("text")).alias("x"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "")
    return (rows.groupBy(*by) if by else rows).agg(_t("<Model>", whole, "</Model>").alias("xml"))


def model_json(components: DataFrame, associations: DataFrame) -> DataFrame:
    """The same model's components as one JSON text each."""
    has = associations.groupBy(F.col("class").alias("id")).agg(F.sort_array(F.collect_list(F.struct("property", "min", "max"))).alias("properties"))
    return components.join(has, "id", "left").select("kind", "id", F.to_json(F.struct("id", "name", "definition", "base", "properties")).alias("json"))


# statements, queries and reports


def status_index(classes: DataFrame) -> DataFrame:
    """At most one index on a status property: of the first class (label, hasStatus) that has one."""
    first = classes.where("hasStatus").orderBy("label").limit(1)
    return first.select(F.lit(4).alias("section"), F.col("label").alias("key"), _t("CREATE INDEX ", kebab(F.col("label")), "_status IF NOT EXISTS FOR (n:", F.col("label"), ") ON (n.status);").alias("line"))


#: graph query templates by what they find
FIND = {
    "find-by-identifier": "MATCH (n) WHERE $label IN labels(n) AND n.identifier = $identifier RETURN n;",
    "find-by-value": "MATCH (n) WHERE $label IN labels(n) AND n[$property] = $value RETURN n;",
    "node-with-relations": "MATCH (n {identifier: $identifier}) OPTIONAL MATCH (n)-[r]-(m) RETURN n, collect(DISTINCT {type: type(r), node: m}) AS relations;",
    "shortest-path": "MATCH p = shortestPath((a {identifier: $from})-[*..6]-(b {identifier: $to})) RETURN p;",
    "subgraph": "MATCH p = (n {identifier: $identifier})-[*0..2]-() RETURN p;",
}


def sparql_templates(namespace: str) -> dict[str, str]:
    """Query texts over the emitted graph, by name; what is to be filled in begins with $."""
    head = f"PREFIX edge: <{namespace}>\nPREFIX owl: <http://www.w3.org/2002/07/owl#>\nPREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n"
    return {
        "list-classes": head + "SELECT ?class ?label ?comment WHERE { ?class a owl:Class . OPTIONAL { ?class rdfs:label ?label } OPTIONAL { ?class rdfs:comment ?comment } } ORDER BY ?label",
        "find-instances": head + "SELECT ?s ?label WHERE { ?s a $class . OPTIONAL { ?s rdfs:label ?label } }",
        "describe-entity": head + "SELECT ?p ?o WHERE { $entity ?p ?o }",
        "entity-subgraph": head + "CONSTRUCT { $entity ?p ?o . ?s ?q $entity } WHERE { { $entity ?p ?o } UNION { ?s ?q $entity } }",
    }


def loader_config(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a loader reads (order, kind, name, rows): nodes (label) before edges (type), by name."""
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("rows")).select(F.lit(1).alias("order"), F.lit("node").alias("kind"), "name", "rows")
    return n.unionByName(edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("rows")).select(F.lit(2).alias("order"), F.lit("edge").alias("kind"), "name", "rows")).orderBy("order", "name")


def change_impact(diff: DataFrame) -> DataFrame:
    """A Markdown line for each kind of change (status) with how many keys (key) it has and the first ten of them."""
    g = diff.groupBy("status").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set(F.col("key").cast("string"))), 1, 10).alias("some"))
    return g.select(F.col("status").alias("key"), _t("- ", F.col("status"), ": ", F.col("n"), F.when(F.col("status") != "current", _t(" (", F.array_join("some", ", "), ")")).otherwise("")).alias("line"))


def readme(files: DataFrame, title: str) -> DataFrame:
    """A Markdown text of a package: its title, and each file (path, size) by folder."""
    head = files.sparkSession.createDataFrame([(0, "", f"# {title}")], "section int, key string, line string")
    return head.unionByName(files.select(F.lit(1).alias("section"), F.col("path").alias("key"), _t("- `", F.col("path"), "` (", F.col("size"), " bytes)").alias("line")))
