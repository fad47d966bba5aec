"""Active classes: which source classes are emitted, what properties they carry and declare, and under whose identity.

Tables: classes (qname, iri, label, comment, parent), mappings (concept, action, status, target), properties (qname, iri, kind, domain, range),
shapes (class, path, valueClass, datatype, deactivated), decisions (concept, property, action, target, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswalk.functions.names import is_full_iri
from crosswalk.functions.values import real_target
from crosswalk.operators.catalog import owners
from crosswalk.operators.decide import emitted_action
from crosswalk.operators.graph import first_kept

EMITTED = ("reuse", "extend", "augment")


def active(mappings: DataFrame) -> DataFrame:
    """(qname, action, target) of the classes that are emitted."""
    act = emitted_action(F.col("action"), F.col("status"))
    return mappings.select(F.col("concept").alias("qname"), act.alias("action"), "target").where(F.col("action").isin(*EMITTED))


def declared(properties: DataFrame) -> DataFrame:
    """Properties (qname) that the source itself declares."""
    return properties.select("qname").distinct()


def evaluated(shapes: DataFrame) -> DataFrame:
    """Constraints that count: a shape that is not deactivated, whatever its severity."""
    return shapes.where(~F.coalesce("deactivated", F.lit(False)) & F.col("class").isNotNull() & F.col("path").isNotNull())


def shape_only(shapes: DataFrame, properties: DataFrame) -> DataFrame:
    """(class, path) of properties that only a shape names."""
    return evaluated(shapes).select("class", "path").distinct().join(declared(properties), F.col("path") == F.col("qname"), "left_anti")


def shape_only_kinds(shapes: DataFrame, properties: DataFrame) -> DataFrame:
    """(class, path, valueClass, datatype, object) of properties that only shapes name: what the class's first shape that says so gives; object if any shape gives the path a class."""
    s = evaluated(shapes).join(shape_only(shapes, properties), ["class", "path"], "left_semi").withColumn("pos", F.coalesce(F.col("pos"), F.lit(0)) if "pos" in shapes.columns else F.lit(0))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("pos", c)))[c].alias(c)
    each = s.groupBy("class", "path").agg(first("valueClass"), first("datatype"))
    return each.withColumn("object", F.max(F.col("valueClass").isNotNull()).over(Window.partitionBy("path")))


def domains(properties: DataFrame) -> DataFrame:
    return properties.select(F.col("qname").alias("property"), F.explode("domain").alias("owner"))


def assigned(properties: DataFrame, shapes: DataFrame, act: DataFrame) -> DataFrame:
    """(property, owner): the active classes among a declared property's domains and the targets of shapes that constrain it."""
    targets = evaluated(shapes).select(F.col("path").alias("property"), F.col("class").alias("owner")).join(declared(properties), F.col("property") == F.col("qname"), "left_semi")
    return owners(domains(properties), targets).join(act.select(F.col("qname").alias("owner")), "owner", "left_semi").select("property", "owner")


def owned(properties: DataFrame, shapes: DataFrame, act: DataFrame) -> DataFrame:
    """(class, property, kind) of what each active class carries and the source declares."""
    own = assigned(properties, shapes, act).join(properties.select(F.col("qname").alias("property"), "kind"), "property")
    return own.select(F.col("owner").alias("class"), "property", "kind").distinct()


def accepted_reuse(decisions: DataFrame) -> DataFrame:
    """(class, property, target) of decisions that put a property on a target's."""
    hit = (F.col("action") == "reuse-property") & (F.col("status") == "accepted") & real_target(F.col("target"))
    return decisions.where(hit).select(F.col("concept").alias("class"), "property", "target").distinct()


def declared_by_class(own: DataFrame, decisions: DataFrame) -> DataFrame:
    """What a class carries less what accepted decisions took from targets: the terms that it declares."""
    return own.join(accepted_reuse(decisions), ["class", "property"], "left_anti")


def unassigned(properties: DataFrame, shapes: DataFrame, act: DataFrame, primary: str) -> DataFrame:
    """Declared properties of the primary prefix that no active class owns; these are declared on their own."""
    left = properties.join(assigned(properties, shapes, act).select(F.col("property").alias("qname")), "qname", "left_anti")
    return left.where(F.col("qname").startswith(primary + ":"))


def redirected(classes: DataFrame, mappings: DataFrame) -> DataFrame:
    """(qname, stands): each class and the class that stands for it: itself, or for an excluded one its nearest ancestor that is not."""
    out = mappings.where(emitted_action(F.col("action"), F.col("status")) == "exclude").select(F.col("concept").alias("node"))
    near = first_kept(classes.select(F.col("qname").alias("node"), F.col("parent")), out)
    return near.select(F.col("node").alias("qname"), F.coalesce("nearest", "node").alias("stands"))


def active_properties(classes: DataFrame, mappings: DataFrame, properties: DataFrame, shapes: DataFrame, codelist_range: str = "skos:Concept") -> DataFrame:
    """(class, property, kind, range) of every active class: values with their first range or a string, relationships to the active class that stands for their first range.

    Properties that only shapes name are in it, as the class's shape has them. A relationship without range, to a class that is not active, or to a code list is left out.
    """
    act = active(mappings)
    first = properties.select(F.col("qname").alias("property"), F.try_element_at("range", F.lit(1)).alias("range"))
    own = owned(properties, shapes, act).join(first, "property", "left")
    extra = shape_only_kinds(shapes, properties).join(act.select(F.col("qname").alias("class")), "class", "left_semi")
    kind = F.when(F.col("valueClass").isNotNull(), "object").otherwise("datatype")
    extra = extra.select("class", F.col("path").alias("property"), kind.alias("kind"), F.coalesce("valueClass", "datatype").alias("range"))
    both = own.select("class", "property", "kind", "range").unionByName(extra)
    values = both.where("kind = 'datatype'").withColumn("range", F.coalesce("range", F.lit("xsd:string")))
    to = both.where((F.col("kind") == "object") & F.col("range").isNotNull()).join(redirected(classes, mappings).select(F.col("qname").alias("range"), "stands"), "range", "left")
    to = to.withColumn("range", F.coalesce("stands", "range")).where(F.col("range") != codelist_range).join(act.select(F.col("qname").alias("range")), "range", "left_semi")
    return values.unionByName(to.select("class", "property", "kind", "range")).distinct()


def emitting_identities(uses: DataFrame, owner_rows: DataFrame, act: DataFrame, declared_rows: DataFrame) -> DataFrame:
    """(context, leaf, property, owner, action): under which class a shape's property (context, leaf, property) was emitted.

    The emitting leaf or else the context, if it owns the property; else every owner; else the context for a property that the source doesn't
    declare; else none, which is emitted as reuse is.

    Owners are looked up before a use meets all of them, so only uses that have none of their own are multiplied, and no such row is dealt again.
    """
    u, pairs, acts = uses.distinct(), owner_rows.select("property", "owner").distinct(), act.select(F.col("qname").alias("owner"), "action").distinct()
    has = lambda c: pairs.select("property", F.col("owner").alias(c), F.lit(True).alias(f"__{c}"))
    flags = declared_rows.select(F.col("qname").alias("property"), F.lit(True).alias("known"), F.lit(False).alias("owned")).unionByName(pairs.select("property", F.lit(False).alias("known"), F.lit(True).alias("owned")))
    flags = flags.groupBy("property").agg(F.max("known").alias("__known"), F.max("owned").alias("__owned"))
    looked = u.join(has("leaf"), ["property", "leaf"], "left").join(has("context"), ["property", "context"], "left").join(flags, "property", "left")
    own, owned_ = F.when(F.col("__leaf"), F.col("leaf")).when(F.col("__context"), F.col("context")), F.coalesce("__owned", F.lit(False))
    looked = looked.select("context", "leaf", "property", own.alias("own"), owned_.alias("owned"), F.coalesce("__known", F.lit(False)).alias("known"))
    # at most one owner, or all owners of the property
    one = looked.where("own is not null or not owned").select("context", "leaf", "property", F.coalesce("own", F.when(~F.col("known"), F.col("context"))).alias("owner")).join(acts, "owner", "left")
    many = looked.where("own is null and owned").select("context", "leaf", "property").join(pairs.join(acts, "owner", "left"), "property")
    return one.select("context", "leaf", "property", "owner", F.when(F.col("owner").isNull(), "reuse").otherwise(F.col("action")).alias("action")).unionByName(many.select("context", "leaf", "property", "owner", "action"))


def undeclared_paths(paths: DataFrame, subjects: DataFrame, namespaces: list[str]) -> DataFrame:
    """Shape paths (term) in the package's own namespaces that no subject (term) of its ontologies declares."""
    own = F.lit(False)
    for n in namespaces:
        own = own | F.col("term").startswith(n)
    return paths.where(own).select("term").distinct().join(subjects.select("term").distinct(), "term", "left_anti")


def source_namespaces(namespace_map: DataFrame, augmenting: DataFrame) -> DataFrame:
    """(prefix, uri) of the primary map (prefix, uri) and of augmenting namespaces, which override it; prefixes lose their colon."""
    bare = lambda df, rank: df.select(F.regexp_replace("prefix", ":+$", "").alias("prefix"), "uri", F.lit(rank).alias("rank"))
    both = bare(namespace_map, 1).unionByName(bare(augmenting, 0))
    return both.groupBy("prefix").agg(F.min(F.struct("rank", "uri"))["uri"].alias("uri"))


def term_iri(terms: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Terms (term) with iri: a full one as it is, a prefixed one in its namespace, null for a prefix that none declares."""
    got = terms.withColumn("prefix", F.substring_index("term", ":", 1)).join(namespaces, "prefix", "left")
    return got.withColumn("iri", F.when(is_full_iri(F.col("term")), F.col("term")).otherwise(F.concat("uri", F.expr("substring(term, length(prefix) + 2)")))).drop("prefix", "uri")


def augmenting_properties(properties: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Augmenting namespaces (prefix, uri) with the properties (qname, iri) that begin with them, sorted, and their number."""
    from crosswalk.operators.catalog import longest_prefix

    hit = longest_prefix(properties.select(F.col("iri").alias("term"), "qname"), namespaces.select("prefix", F.col("uri").alias("base"))).where("prefix is not null")
    got = hit.groupBy("prefix").agg(F.sort_array(F.collect_set("qname")).alias("properties"))
    n = F.coalesce(F.size("properties"), F.lit(0))
    return namespaces.join(got, "prefix", "left").withColumns({"propertyCount": n, "properties": F.coalesce("properties", F.array().cast("array<string>"))})


def workflow_models(states: DataFrame, transitions: DataFrame, models: DataFrame) -> DataFrame:
    """Workflow models (iri, label, appliesTo) with their states (model, iri, label) and transitions (model, iri, from, to, trigger), sorted, and the numbers of both."""
    s = states.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("iri", "label"))).alias("states"))
    t = transitions.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("iri", "from", "to", "trigger"))).alias("transitions"))
    got = models.join(s.withColumnRenamed("model", "iri"), "iri", "left").join(t.withColumnRenamed("model", "iri"), "iri", "left")
    return got.withColumns({"stateCount": F.coalesce(F.size("states"), F.lit(0)), "transitionCount": F.coalesce(F.size("transitions"), F.lit(0))})


def vocabulary(classes: DataFrame, shapes: DataFrame, prefixes: DataFrame, schemes: DataFrame) -> DataFrame:
    """What a package speaks of, as rows (part, key, member): classes, the properties its shapes give each class, prefixes and values of labelled code lists."""
    row = lambda df, part, key, member: df.select(F.lit(part).alias("part"), key.alias("key"), member.alias("member"))
    none = F.lit(None).cast("string")
    out = row(classes, "class", none, F.col("qname")).unionByName(row(evaluated(shapes), "property", F.col("class"), F.col("path"))).unionByName(row(prefixes, "namespace", none, F.col("prefix")))
    return out.unionByName(row(schemes.where(_has("label")), "codelist", F.col("label"), F.col("value"))).distinct()


def _has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def fuzzy_classes(refs: DataFrame, classes: DataFrame) -> DataFrame:
    """References (ref) to class names (name): the equal one, else the first whose letters are the same without case and any s."""
    fold = lambda c: F.replace(F.lower(c), F.lit("s"), F.lit(""))
    c = classes.select("name").distinct()
    loose = c.groupBy(fold(F.col("name")).alias("__key")).agg(F.min("name").alias("__loose"))
    got = refs.join(c, F.col("ref") == F.col("name"), "left").withColumn("__key", fold(F.col("ref"))).join(loose, "__key", "left")
    return got.withColumn("name", F.coalesce("name", "__loose")).drop("__key", "__loose")


def inventory_counts(classes: DataFrame, properties: DataFrame, shapes: DataFrame, schemes: DataFrame) -> DataFrame:
    """One row: how many classes, properties of either kind, constraints and code lists a source has."""
    rows = (
        classes.select(F.lit("classes").alias("k")).unionByName(properties.select(F.when(F.col("kind") == "object", "objectProperties").otherwise("datatypeProperties").alias("k")))
        .unionByName(shapes.select(F.lit("constraints").alias("k"))).unionByName(schemes.select(F.lit("codelists").alias("k")))
    )
    names = ("classes", "objectProperties", "datatypeProperties", "constraints", "codelists")
    return rows.agg(*[F.count_if(F.col("k") == n).alias(n) for n in names])


def decision_marks(decisions: DataFrame) -> DataFrame:
    """Of each concept, how many properties are reused, created and open."""
    n = lambda a: F.count_if(F.col("action") == a)
    return decisions.groupBy("concept").agg(n("reuse-property").alias("r"), n("create-property").alias("c"), n("human-must-decide").alias("open"))
