"""Catalogs of a native model: which types are in, what they inherit and reach, and their properties by name and namespace.

Types are rows (qname, base, pattern, ...), definitions of properties rows (type, name, qualified, qualifiedType, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.operators.catalog import first_by
from crosswalk.operators.graph import chains

# Categories and patterns of types that a native catalog takes, prefixes that it leaves out, and the one type it adds.
CATEGORIES = ("core", "domain")
LEFT_OUT = ("mo", "usmtf")
PATTERNS = ("object", "augmentation", "association", "complex_value", "simple_value", "simple_list", "simple_union", "metadata")
VALUE_PATTERNS = ("complex_value", "simple_value", "simple_list", "simple_union")
ROOT_TYPE = "structures:ObjectType"


def prefix_of(qname: Column) -> Column:
    return F.when(F.instr(qname, ":") > 0, F.substring_index(qname, ":", 1)).otherwise("")


def included_namespaces(namespaces: DataFrame, extra: tuple[str, ...] = (ROOT_TYPE,)) -> DataFrame:
    """Namespaces (prefix, category) whose types are taken: of a wanted category and not left out, and, as extra, those of single added types."""
    wanted = F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)) & ~F.col("prefix").isin(*LEFT_OUT)
    added = F.col("prefix").isin(*[x.split(":")[0] for x in extra])
    return namespaces.withColumn("extra", ~wanted & added).where(wanted | added)


def included_types(types: DataFrame, namespaces: DataFrame, extra: tuple[str, ...] = (ROOT_TYPE,)) -> DataFrame:
    """Types (qname, pattern, deprecated) of included namespaces with a wanted pattern; of an extra one only the types named. Deprecated ones are out."""
    n = included_namespaces(namespaces, extra).select("prefix", "extra")
    got = types.withColumn("prefix", prefix_of(F.col("qname"))).join(n, "prefix").where(~F.coalesce("deprecated", F.lit(False)))
    wanted = F.when(F.col("extra"), F.col("qname").isin(*extra)).otherwise(F.coalesce(F.col("pattern").isin(*PATTERNS), F.lit(False)))
    return got.where(wanted).select(*types.columns)


def terminal_types(types: DataFrame) -> DataFrame:
    """Types (qname) that composition does not go on from: values, and the root type whether it is listed or not."""
    root = types.sparkSession.createDataFrame([(ROOT_TYPE,)], "qname string")
    return types.where(F.col("pattern").isin(*VALUE_PATTERNS)).select("qname").unionByName(root).distinct()


def lineage(types: DataFrame) -> DataFrame:
    """(qname, of, step): every type with itself (0) and each of its ancestors that is a listed type, nearest first."""
    c = chains(types.select(F.col("qname").alias("node"), F.col("base").alias("parent")))
    steps = c.select(F.col("node").alias("qname"), F.posexplode(F.concat(F.array("node"), "chain")).alias("step", "of"))
    return steps.join(types.select(F.col("qname").alias("of")).distinct(), "of", "left_semi").select("qname", "of", "step")


def type_properties(types: DataFrame, members: DataFrame, definitions: DataFrame) -> DataFrame:
    """(type, property): what each type has itself or from its ancestors, by qualified name where a definition (type, name, qualified) gives one, else by the bare one of ``members`` (type, name)."""
    own = members.select("type", "name").join(definitions.select("type", "name", "qualified"), ["type", "name"], "left")
    named = own.select(F.col("type").alias("of"), F.coalesce(F.nullif("qualified", F.lit("")), F.col("name")).alias("property"))
    return lineage(types).join(named, "of").select(F.col("qname").alias("type"), "property").distinct()


def reachable_properties(types: DataFrame, definitions: DataFrame, depth: int = 2) -> DataFrame:
    """Properties (type, name, qualified, qualifiedType, depth, via, path) that a type has, inherits at no cost, or reaches through the types of its properties at one more each.

    Each type is entered at its least depth, and a name counts once, at its least; ties go to the first via and path in order. Composition ends at value types, the root type and types that are not listed.
    """
    from crosswalk.operators.lineage import cut, dealt, sent

    up = cut(lineage(types).select("qname", "of"))
    ends = terminal_types(types)
    d = definitions.select("type", "name", "qualified", "qualifiedType").distinct()
    step = d.where("qualifiedType is not null").join(ends.select(F.col("qname").alias("qualifiedType")), "qualifiedType", "left_anti").select(F.col("type").alias("of"), F.col("name").alias("by"), "qualifiedType")
    # few types are types of properties, and each of them is entered by many
    onto = sent(cut(up.join(step.select(F.col("qualifiedType").alias("qname")).distinct(), "qname", "left_semi")))
    join_path = lambda p, n: F.when(p == "", n).otherwise(F.concat(p, F.lit("/"), n))
    seen = front = up.select(F.col("qname").alias("type"), "of", F.lit("").alias("path"), F.lit(0).alias("depth"))
    for k in range(1, depth + 1):
        entered = front.join(step, "of").select("type", F.col("qualifiedType").alias("qname"), join_path(F.col("path"), F.col("by")).alias("path"))
        grown = entered.join(onto, "qname").groupBy("type", "of").agg(F.min("path").alias("path")).withColumn("depth", F.lit(k))
        front = cut(grown.join(seen.select("type", "of"), ["type", "of"], "left_anti"))
        seen = seen.unionByName(front)
    found = seen.join(d.withColumnRenamed("type", "of"), "of").withColumn("path", join_path(F.col("path"), F.col("name")))
    # rows of a task are sorted, so their number is bound
    best = first_by(dealt(found, seen.count(), "type", "name"), ["type", "name"], "depth", "of", "path", "qualified")
    return best.select("type", "name", "qualified", "qualifiedType", "depth", F.col("of").alias("via"), "path")


def cardinality_map(rows: DataFrame) -> DataFrame:
    """Bounds (type, name, min, max as text, pos) as a map a type: no number is a least of 0, nothing is unbounded; of repeated names the last counts, and of those at the same pos the first by ``at``, if rows have it. Rows without type or name are left out."""
    text, tie = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))), ["at"] if "at" in rows.columns else []
    lo = F.when(text("min").rlike(r"^\d+$"), text("min").cast("int")).otherwise(0)
    hi = F.when(F.col("max").isNull(), "unbounded").otherwise(text("max"))
    some = rows.select(text("type").alias("type"), text("name").alias("name"), F.struct(lo.alias("min"), hi.alias("max")).alias("bounds"), "pos", *tie).where("type <> '' and name <> ''")
    # the greatest pos, not a number being the greatest, then the least at
    first = F.when(F.col("pos").isNotNull(), F.struct(~F.isnan("pos"), -F.col("pos"), *tie))
    last = some.groupBy("type", "name").agg((F.min_by("bounds", first) if tie else F.max_by("bounds", "pos")).alias("bounds"))
    return last.groupBy("type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "bounds")))).alias("cardinalities"))


def property_lookup(rows: DataFrame) -> DataFrame:
    """Properties (qualified, definition, qualifiedType, abstract, pos) by their name without prefix, each with its list in order."""
    local, some = F.substring_index("qualified", ":", -1), rows.where("coalesce(qualified, '') <> ''")
    each = F.struct("pos", "qualified", prefix_of(F.col("qualified")).alias("prefix"), "definition", "qualifiedType", "abstract")
    return some.groupBy(local.alias("name")).agg(F.array_sort(F.collect_list(each)).alias("properties"))


def property_index(properties: DataFrame, members: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """Properties (qualified, definition, qualifiedType) by prefix, sorted by name, with the types (type, property) that contain each, and their number."""
    within = members.groupBy(F.col("property").alias("qualified")).agg(F.sort_array(F.collect_set("type")).alias("containingTypes"))
    p = properties.withColumns({"prefix": prefix_of(F.col("qualified")), "name": F.substring_index("qualified", ":", -1)})
    p = (p.where(F.col("prefix").isin(*prefixes)) if prefixes else p).join(within, "qualified", "left")
    each = F.struct("name", "qualified", "definition", "qualifiedType", F.coalesce("containingTypes", F.array().cast("array<string>")).alias("containingTypes"))
    return p.groupBy("prefix").agg(F.array_sort(F.collect_list(each)).alias("properties"), F.count("*").cast("int").alias("propertyCount"))


def enrich(types: DataFrame, attributes: DataFrame, facets: DataFrame, cardinalities: DataFrame) -> DataFrame:
    """Types (qname, base, ...) with their attributes (qname, parent, contentStyle), facets (qname, facets) and cardinalities (type, cardinalities) where there are some; a parent that isn't empty overrides the base."""
    out = types.join(attributes, "qname", "left").join(facets, "qname", "left").join(cardinalities.withColumnRenamed("type", "qname"), "qname", "left")
    return out.withColumn("base", F.coalesce(F.nullif("parent", F.lit("")), "base")).drop("parent")


def assemble(types: DataFrame, members: DataFrame) -> DataFrame:
    """Catalog rows: types with their sorted properties, chain of ancestors and its length."""
    own = members.groupBy(F.col("type").alias("qname")).agg(F.sort_array(F.collect_set("name")).alias("properties"))
    c = chains(types.select(F.col("qname").alias("node"), F.col("base").alias("parent"))).withColumnRenamed("node", "qname")
    none = F.array().cast("array<string>")
    return types.join(own, "qname", "left").join(c, "qname", "left").withColumns({"properties": F.coalesce("properties", none), "inheritanceChain": F.col("chain")}).drop("chain")


def default_base(types: DataFrame) -> str | None:
    """The root type, if it is listed."""
    return ROOT_TYPE if not types.where(F.col("qname") == ROOT_TYPE).isEmpty() else None


def patterns_seen(types: DataFrame) -> DataFrame:
    """Patterns that occur, with their number of types."""
    return types.where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n"))


def augmentation_map(types: DataFrame, members: DataFrame) -> DataFrame:
    """Base types with the augmentation types that add to them and what these add, without the augmentation point."""
    from crosswalk.operators.catalog import augmentation_bases

    bases = augmentation_bases(types.select("qname"))
    adds = members.where(~F.col("name").endswith("AugmentationPoint")).groupBy(F.col("type").alias("augmentation")).agg(F.sort_array(F.collect_set("name")).alias("properties"))
    each = bases.join(adds, "augmentation", "left").select("base", F.struct("augmentation", F.coalesce("properties", F.array().cast("array<string>")).alias("properties")).alias("x"))
    return each.groupBy("base").agg(F.sort_array(F.collect_list("x")).alias("augmentations"))
