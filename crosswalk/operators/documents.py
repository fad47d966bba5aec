"""Search documents: entries of catalogs and sources, their vectors, kept indexes, and a document of candidates for every source term."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswalk.functions.names import after_last_colon, safe_filename
from crosswalk.operators.native import prefix_of
from crosswalk.operators.search import embedding_text, number_duplicates, score_floor, top_k

ENTRY = ("id", "label", "definition", "kind", "context")


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column:
        """A vector (array of double) of length 1 of a text."""


def hashed(dims: int = 64) -> Embedder:
    """An embedder that needs no model: words are hashed to ``dims`` places and counted, with the sign of another hash. A text without words is a vector of zeros."""

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        placed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dims)).cast("int").alias("at"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("by")))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.aggregate(F.filter(placed, lambda p: p["at"] == k), F.lit(0.0), lambda s, p: s + p["by"]))
        size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: F.when(size > 0, x / size).otherwise(0.0))

    return embed


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def type_entries(types: DataFrame, eligible: Column | None = None, most: int = 10) -> DataFrame:
    """Entries of catalog types (qname, label, definition, base, pattern, inheritanceChain, properties): no augmentations, only eligible ones that have a label or a definition. The context names base, pattern, path and first properties, by label where there is one."""
    kept = types.where((F.coalesce("pattern", F.lit("")) != "augmentation") & (_some("label") | _some("definition")))
    kept = kept.where(eligible) if eligible is not None else kept
    shown = types.where(_some("label")).select(F.col("qname").alias("base"), F.col("label").alias("base_label"))
    none = F.array().cast("array<string>")
    chain, props = F.coalesce("inheritanceChain", none), F.slice(F.coalesce("properties", none), 1, most)
    got = kept.join(shown.dropDuplicates(["base"]), "base", "left")
    context = F.concat_ws(
        ". ",
        F.when(_some("base"), F.concat(F.lit("Extends "), F.coalesce("base_label", "base"))), F.when(_some("pattern"), F.concat(F.lit("Pattern: "), F.col("pattern"))),
        F.when(F.size(chain) > 1, F.concat(F.lit("Path: "), F.array_join(F.concat(chain, F.array(F.coalesce(F.nullif("label", F.lit("")), "qname"))), "/"))),
        F.when(F.size(props) > 0, F.concat(F.lit("Properties: "), F.array_join(props, ", "))),
    )
    return got.select(F.col("qname").alias("id"), "label", "definition", F.lit("type").alias("kind"), context.alias("context"))


def property_entries(properties: DataFrame, most: int = 10) -> DataFrame:
    """Entries of catalog properties (qualified, label, definition, qualifiedType, abstract, containingTypes): not abstract, with a label or a definition."""
    kept = properties.where(~F.coalesce("abstract", F.lit(False)) & (_some("label") | _some("definition")))
    within = F.slice(F.coalesce("containingTypes", F.array().cast("array<string>")), 1, most)
    context = F.concat_ws(". ", F.when(_some("qualifiedType"), F.concat(F.lit("Type: "), F.col("qualifiedType"))), F.when(F.size(within) > 0, F.concat(F.lit("Used in: "), F.array_join(within, ", "))))
    return kept.select(F.col("qualified").alias("id"), "label", "definition", F.lit("property").alias("kind"), context.alias("context"))


def source_types(concepts: DataFrame) -> DataFrame:
    """Entries of source concepts (qname, definition, superClasses), whose context is what they descend from; their labels are not used."""
    return concepts.select(F.col("qname").alias("id"), F.lit(None).cast("string").alias("label"), "definition", F.lit("type").alias("kind"), F.array_join(F.coalesce("superClasses", F.array().cast("array<string>")), "; ").alias("context"))


def property_id(concept: Column, qname: Column, name: Column) -> Column:
    """A property's declared qualified name, else its name under its concept's prefix, if that has one."""
    prefix = prefix_of(concept)
    return F.coalesce(F.nullif(qname, F.lit("")), F.when(prefix != "", F.concat(prefix, F.lit(":"), name)).otherwise(name))


def source_properties(concepts: DataFrame, properties: DataFrame) -> DataFrame:
    """Entries of source properties (concept, qname, name, definition) with their concept and its definition as context."""
    p = properties.join(concepts.select(F.col("qname").alias("concept"), F.col("definition").alias("about")), "concept")
    context = F.concat(F.lit("Property of "), F.col("concept"), F.lit(". "), F.coalesce("about", F.lit("")))
    return p.select("concept", property_id(F.col("concept"), F.col("qname"), F.col("name")).alias("id"), F.lit(None).cast("string").alias("label"), "definition", F.lit("property").alias("kind"), context.alias("context"))


def vectors(entries: DataFrame, embed: Embedder) -> DataFrame:
    return entries.withColumn("vec", embed(embedding_text(F.col("id"), F.col("label"), F.col("definition"), F.col("context"))))


def write_index(index: DataFrame, root: str, name: str, kind: str) -> str:
    """Keeps an index (id, vec, ...) as a table of its name and kind, in place of an older one."""
    path = f"{root.rstrip('/')}/name={safe(name)}/kind={safe(kind)}"
    index.write.mode("overwrite").parquet(path)
    return path


def safe(name: str) -> str:
    """A name that is one folder below another, whatever it holds."""
    out = "".join(c if c.isalnum() or c in "-_." else "_" for c in name)
    if out.strip(".") == "":
        raise ValueError(f"no name of an index: {name!r}")
    return out


def read_index(spark: SparkSession, root: str, name: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/name={safe(name)}/kind={safe(kind)}")


def delete_index(spark: SparkSession, root: str, name: str) -> bool:
    """Deletes both kinds of an index; whether there was one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/name={safe(name)}")
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def index_listing(index: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """Indexes with how many vectors they hold, and of how many dimensions."""
    return index.groupBy(name, kind).agg(F.count("*").alias("vectors"), F.max(F.size("vec")).alias("dims"))


def name_and_version(index_name: str) -> tuple[str, str]:
    """The catalog that an index is of: cut at the last hyphen."""
    name, _, version = index_name.rpartition("-")
    return (name, version) if name else (index_name, "")


def search_types(concepts: DataFrame, index: DataFrame, embed: Embedder, k: int = 12, eligible: Column | None = None) -> DataFrame:
    """Candidates (q, t, score, rank) of every concept in one search; types that are not eligible are left out before ranks are given."""
    return top_k(vectors(source_types(concepts), embed), index, k, eligible)


def search_properties(concepts: DataFrame, properties: DataFrame, index: DataFrame, embed: Embedder, k: int = 12) -> DataFrame:
    """Candidates (concept, q, t, score, rank) of every property of every concept; every indexed property may be one."""
    own = vectors(source_properties(concepts, properties), embed).withColumn("key", F.to_json(F.struct("concept", "id")))
    found = top_k(own.select(F.col("key").alias("id"), "vec"), index, k)
    return own.select("concept", F.col("id").alias("qname"), F.col("key").alias("q")).distinct().join(found, "q").select("concept", F.col("qname").alias("q"), "t", "score", "rank")


def search_one(spark: SparkSession, text: str, index: DataFrame, embed: Embedder, k: int = 12, eligible: Column | None = None) -> DataFrame:
    """Candidates of a single text."""
    return top_k(spark.createDataFrame([("query", text)], "id string, text string").select("id", embed(F.col("text")).alias("vec")), index, k, eligible).drop("q")


def candidates(found: DataFrame, entries: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(q, candidates): what is left at ``ratio`` of each query's best score, in order, with repeated display names numbered, and without scores and ranks.

    ``entries``: id, label, definition of what can be found; the display name is the label, or else the id.
    """
    kept = score_floor(found, ratio).join(entries.select(F.col("id").alias("t"), F.coalesce(F.nullif("label", F.lit("")), F.col("id").cast("string")).alias("name"), "definition"), "t")
    each = F.struct(F.col("rank").alias("pos"), F.col("display").alias("id"), F.col("t").alias("qname"), "definition")
    listed = number_duplicates(kept, ["q"], "name", ["rank"]).groupBy("q").agg(F.array_sort(F.collect_list(each)).alias("c"))
    return listed.select("q", F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["qname"].alias("qname"), x["definition"].alias("definition"))).alias("candidates"))


def type_documents(concepts: DataFrame, listed: DataFrame) -> DataFrame:
    """A pending document (status, kind, source, candidates, file) for each concept (qname, localName, definition, superClasses); one without candidates has none."""
    source = F.struct("qname", F.coalesce("localName", F.lit("")).alias("localName"), F.coalesce("definition", F.lit("")).alias("definition"), "superClasses")
    got = concepts.join(listed, F.col("qname") == F.col("q"), "left")
    return got.select(F.lit("pending").alias("status"), F.lit("type").alias("kind"), source.alias("source"), _listed(listed).alias("candidates"), safe_filename(F.col("qname")).alias("file"))


def property_documents(properties: DataFrame, concepts: DataFrame, listed: DataFrame) -> DataFrame:
    """A pending document for each property (concept, qname, name, definition, range) with its concept's definition; ``listed`` has candidates by concept and q."""
    about = concepts.select(F.col("qname").alias("concept"), F.col("definition").alias("parentDefinition"))
    p = properties.withColumn("q", property_id(F.col("concept"), F.col("qname"), F.col("name"))).join(about, "concept", "left").join(listed, ["concept", "q"], "left")
    source = F.struct(F.col("q").alias("qname"), "name", F.coalesce("definition", F.lit("")).alias("definition"), "range", F.col("concept").alias("parentType"), F.coalesce("parentDefinition", F.lit("")).alias("parentDefinition"))
    file = safe_filename(F.concat_ws(".", "concept", "q"))
    return p.select(F.lit("pending").alias("status"), F.lit("property").alias("kind"), source.alias("source"), _listed(listed).alias("candidates"), file.alias("file"))


def _listed(listed: DataFrame) -> Column:
    return F.coalesce("candidates", F.array().cast(dict(listed.dtypes)["candidates"]))


def requalified(old: DataFrame, declared: DataFrame) -> DataFrame:
    """Older documents (parent, qname) with the name (parent, qname) that the source declares now: the only one of the parent with the same local name, which is the only old one of it too; others keep theirs."""
    def only(df: DataFrame, name: str) -> DataFrame:
        local = df.select("parent", F.col("qname").alias(name), after_last_colon(F.col("qname")).alias("local")).distinct()
        return local.groupBy("parent", "local").agg(F.min(name).alias(name), F.count("*").alias("n")).where("n = 1").drop("n")

    pairs = only(old, "was").join(only(declared, "now"), ["parent", "local"]).select("parent", F.col("was").alias("qname"), "now")
    return old.join(pairs, ["parent", "qname"], "left").withColumn("qname", F.coalesce("now", "qname")).drop("now")


def attached(types: DataFrame, properties: DataFrame) -> DataFrame:
    """Evaluated types (qname, ...) with their evaluated properties (parentType, qname, ...) as a sorted list; a type without any has an empty one, properties of no evaluated type are left out."""
    own = [c for c in properties.columns if c != "parentType"]
    lists = properties.groupBy(F.col("parentType").alias("qname")).agg(F.sort_array(F.collect_list(F.struct("qname", *[c for c in own if c != "qname"]))).alias("properties"))
    return types.join(lists, "qname", "left").withColumn("properties", F.coalesce("properties", F.array().cast(dict(lists.dtypes)["properties"])))
