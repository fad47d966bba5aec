"""Catalogs and models: priority joins, groupings, definition quality, bounds, names that collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def best_definition(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """For each use (use, name, prefix), the definition (name, prefix, definition, pos) of that name in the same prefix, else the first."""
    d = definitions.select("name", F.col("prefix").alias("dprefix"), "definition", "pos")
    both = uses.join(d, "name", "left").withColumn("same", F.col("dprefix").eqNullSafe(F.col("prefix")).cast("int"))
    return first_by(both, ["use"], F.desc("same"), "pos").drop("same")


def longest_prefix(terms: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Terms (term) with the namespace (prefix, base) of the longest base that they begin with and go beyond; ties by prefix.

    A term is cut to each length that a base has, and the cuts are joined with the bases, so no term is compared with every base.
    """
    sizes = F.broadcast(namespaces.agg(F.collect_set(F.length("base")).alias("__sizes"), F.lit(1).alias("__one")))  # one row
    cuts = F.transform(F.filter("__sizes", lambda n: n < F.length("term")), lambda n: F.substr("term", F.lit(1), n))
    named = first_by(namespaces.select("prefix", "base"), ["base"], "prefix")
    hit = terms.select("term").distinct().withColumn("__one", F.lit(1)).join(sizes, "__one").select("term", F.explode(cuts).alias("base")).join(named, "base")
    return terms.join(first_by(hit, ["term"], F.desc(F.length("base")), "prefix"), "term", "left").select(*terms.columns, "prefix", "base")


def containing(types: DataFrame) -> DataFrame:
    """Types that contain each property, from rows (type, property): sorted and distinct."""
    return types.groupBy("property").agg(F.sort_array(F.collect_set("type")).alias("types"))


def augmentation_bases(types: DataFrame) -> DataFrame:
    """Augmentation types (qname) with the first type whose local name is theirs without 'Augmentation'."""
    local = F.substring_index("qname", ":", -1)
    t = types.withColumn("local", local)
    augs = t.where(F.col("local").endswith("AugmentationType")).select(F.col("qname").alias("augmentation"), F.regexp_replace("local", "AugmentationType$", "Type").alias("key"))
    bases = t.where(~F.col("local").endswith("AugmentationType") & ~F.col("local").endswith("AugmentationPoint")).groupBy(F.col("local").alias("key")).agg(F.min("qname").alias("base"))
    return augs.join(bases, "key").select("augmentation", "base")


def codelist_types(codelists: DataFrame, types: DataFrame) -> DataFrame:
    """Codelists (name) with the first type there is of their name, name + CodeSimpleType, CodeType or SimpleType."""
    tries = F.transform(F.array(*[F.lit(s) for s in ("", "CodeSimpleType", "CodeType", "SimpleType")]), lambda s: F.concat(F.col("name"), s))
    asked = codelists.select("name", F.posexplode(tries).alias("rank", "local"))
    found = asked.join(types.select("qname", F.substring_index("qname", ":", -1).alias("local")), "local")
    return first_by(found, ["name"], "rank", "qname").select("name", "qname")


def definition_quality(rows: DataFrame, group: list[str], shortest: int = 5) -> DataFrame:
    """Total, missing, coverage in percent and mean length of definitions (definition, pos) of each group, and texts that occur more than once."""
    has = F.coalesce(F.length(F.trim("definition")) > 0, F.lit(False))
    return rows.groupBy(*group).agg(
        F.count("*").alias("total"), F.count_if(~has).alias("missing"), F.round(100.0 * F.count_if(has) / F.greatest(F.count("*"), F.lit(1)), 1).alias("coverage"),
        F.round(F.avg(F.when(has, F.length("definition")))).cast("long").alias("mean_length"),
    )


def duplicate_definitions(rows: DataFrame) -> DataFrame:
    return rows.where("definition is not null").groupBy("definition").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")


def facets(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), ",").alias("facets"))


def merge_domains(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Distinct values of each key in the order they first occur."""
    first = rows.groupBy(key, value).agg(F.min(pos).alias("p"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", value))), lambda x: x[value]).alias("domains"))


def merge_bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The largest minimum and smallest maximum of each key; nulls don't bind."""
    return rows.groupBy(*keys).agg(F.max("min").alias("min"), F.min("max").alias("max"))


def having_many(rows: DataFrame, key: str, member: str, least: int = 2) -> DataFrame:
    """Keys with at least ``least`` distinct members: colliding names, shared targets, consolidated parents."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(member).alias("n"), F.min(member).alias("first")).where(F.col("n") >= least)


def namespace_summary(rows: DataFrame, prefix: str, member: str, most: int = 10) -> DataFrame:
    """Members of each prefix: how many, and the first ``most`` of them."""
    return rows.groupBy(prefix).agg(F.count_distinct(member).alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set(member)), 1, most), ",").alias("members"))


def primary(rows: DataFrame, namespace: str) -> DataFrame:
    """The namespace that most rows have, ties by name."""
    return rows.groupBy(namespace).agg(F.count("*").alias("n")).orderBy(F.desc("n"), namespace).limit(1)


def owners(*sources: DataFrame) -> DataFrame:
    """Distinct (property, owner) rows of several sources."""
    out = sources[0].select("property", "owner")
    for s in sources[1:]:
        out = out.unionByName(s.select("property", "owner"))
    return out.distinct()


def unique_locals(refs: DataFrame, properties: DataFrame) -> DataFrame:
    """References (concept, ref) resolved to qualified names (concept, qname): equal, or else by a local name that only one of the concept's has."""
    p = properties.select("concept", "qname", F.substring_index("qname", ":", -1).alias("local")).distinct()
    once = p.withColumn("k", F.count("*").over(Window.partitionBy("concept", "local"))).where("k = 1").select("concept", F.col("local").alias("ref"), F.col("qname").alias("by_local"))
    exact = p.select("concept", F.col("qname").alias("ref"), F.col("qname").alias("equal"))
    return refs.join(exact, ["concept", "ref"], "left").join(once, ["concept", "ref"], "left").select("concept", "ref", F.coalesce("equal", "by_local").alias("qname"))


def conflicts(decisions: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys whose rows differ in ``fields``; equal ones are one decision."""
    return decisions.groupBy(*keys).agg(F.count_distinct(F.struct(*fields)).alias("n")).where("n > 1")


def type_directory(types: DataFrame, length: int = 120, most: int = 8) -> DataFrame:
    """One line of text for each type (qname, definition, properties): cut definition and first properties, '-' without any."""
    clean: Column = F.substring(F.regexp_replace(F.coalesce("definition", F.lit("")), r"[|\n]", " "), 1, length)
    props = F.array_join(F.slice(F.coalesce("properties", F.array().cast("array<string>")), 1, most), ", ")
    return types.select("qname", F.concat_ws(" | ", "qname", clean, F.coalesce(F.nullif(props, F.lit("")), F.lit("-"))).alias("line")).orderBy("qname")


def graph_labels(terms: DataFrame, fold=None) -> DataFrame:
    """Distinct names (qname, name, own: may keep its name, clean: needed no change): of terms that meet, one keeps its name and the others get a hash of theirs."""
    same = fold(F.col("name")) if fold else F.col("name")
    t = terms.dropDuplicates(["qname"]).withColumn("same", same)
    w = Window.partitionBy("same")
    rank = F.row_number().over(w.orderBy(F.desc(F.col("own").cast("int")), F.desc(F.col("clean").cast("int")), "qname"))
    keeps = (F.count("*").over(w) == 1) | ((rank == 1) & F.col("own"))
    return t.withColumn("label", F.when(keeps, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.substring(F.sha1(F.col("qname").cast("binary")), 1, 8)))).drop("same")
