"""Tabular, XML and JSON models, and listings of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswalk.functions.values import clean_definition, is_primitive, multiplicity, tabular_type

CSV_COLUMNS = ("Model Class", "Model Attribute", "Model Type", "Model Multiplicity", "Model Definition")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A model table with quoted texts over several lines and a byte-order mark; pos is the order of rows (a model is one small file)."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.removeprefix("﻿").strip() for c in raw.columns])
    lost = set(CSV_COLUMNS) - set(raw.columns)
    if lost:
        raise ValueError(f"columns are missing: {sorted(lost)}")
    names = dict(zip(CSV_COLUMNS, ("class", "attribute", "type", "multiplicity", "definition"), strict=True))
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in names.items()], F.monotonically_increasing_id().alias("pos"))


def csv_model(rows: DataFrame, strict_types: bool = False) -> DataFrame:
    """Attributes of a model: class, attribute, kind (object or datatype), range, min, max, definition.

    A row without an attribute declares a class. Attributes in angle brackets are notes. '(X)' refers to class X; so does a type
    that is a class declared before the row. With ``strict_types`` a class that is declared later counts too.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    decl = rows.where(text("class") != "").groupBy("class").agg(F.min("pos").alias("since")).select(F.col("class").alias("known"), "since")
    owner = F.last(F.nullif("class", F.lit("")), ignorenulls=True).over(Window.orderBy("pos"))
    attrs = rows.withColumn("owner", owner).where((text("attribute") != "") & ~text("attribute").startswith("<"))
    ref = F.nullif(F.regexp_extract(text("type"), r"^\((.+)\)$", 1), F.lit(""))
    a = attrs.withColumn("ref", ref).join(decl, F.col("type") == F.col("known"), "left")
    seen = F.col("known").isNotNull() & (F.lit(strict_types) | (F.col("since") <= F.col("pos")))
    object_ = F.col("ref").isNotNull() | (seen & ~is_primitive(F.col("type")))
    lo, hi = multiplicity(text("multiplicity"))
    return a.select(F.col("owner").alias("class"), "attribute", F.when(object_, "object").otherwise("datatype").alias("kind"), F.when(object_, F.coalesce("ref", "type")).otherwise(tabular_type(F.col("type"))).alias("range"), lo.alias("min"), hi.alias("max"), clean_definition(F.col("definition")).alias("definition"), "pos")


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """Elements of an XML model as rows; a broken element is an error, not a lost row."""
    r = spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).load(path)


CMF_CLASS = "_id string, Name string, DefinitionText string, ExtensionOfClass struct<_ref:string>, HasProperty array<struct<Property:struct<_ref:string>,DatatypeProperty:struct<_ref:string>,ObjectProperty:struct<_ref:string>,MinOccursQuantity:string,MaxOccursQuantity:string>>"


def cmf_types(spark: SparkSession, path: str) -> DataFrame:
    """Classes of a model file: qname, definition, base and its properties with bounds, which stay text."""
    from crosswalk.functions.names import id_to_qname

    rows = xml_rows(spark, path, "Class", CMF_CLASS).where("_id is not null")
    prop = lambda x: F.coalesce(x["Property"]["_ref"], x["DatatypeProperty"]["_ref"], x["ObjectProperty"]["_ref"])
    props = F.transform(F.coalesce("HasProperty", F.array().cast(dict(rows.dtypes)["HasProperty"])), lambda x: F.struct(id_to_qname(prop(x)).alias("property"), x["MinOccursQuantity"].alias("min"), x["MaxOccursQuantity"].alias("max")))
    return rows.select(id_to_qname(F.col("_id")).alias("qname"), F.coalesce("DefinitionText", F.lit("")).alias("definition"), id_to_qname(F.col("ExtensionOfClass._ref")).alias("base"), props.alias("properties"))


def genericode(spark: SparkSession, path: str) -> DataFrame:
    """Values of a code list file: a row for each Row element, with its cells in order."""
    rows = xml_rows(spark, path, "Row", "Value array<struct<_ColumnRef:string,SimpleValue:string>>")
    return rows.select(F.transform("Value", lambda v: v["SimpleValue"]).alias("cells"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a folder with their file names, in their order."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def role_of(path: Column) -> Column:
    """A package file's category by folder, name and ending; the first rule that fits."""
    parent, name = F.element_at(F.concat(F.array(F.lit("")), F.split(path, "/")), -2), F.substring_index(path, "/", -1)
    ttl = name.endswith(".ttl")
    return (
        F.when((parent == "ontology") & ttl, "ontology").when((parent == "shapes") & ttl, "shapes").when((parent == "vocab") & ttl, "vocab")
        .when(parent.contains("seed") & ttl, "seed_data").when(name.endswith(".jsonld"), "contexts").when(F.lower(name).contains("workflow") & ttl, "workflows")
        .when(name.rlike(r"\.(md|txt|pdf)$"), "docs").when(parent.isin("input", "") & name.endswith(".csv"), "input_csv").otherwise("other")
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), size, category and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split("://")[-1].lstrip("/") + "/"
    rel = F.substring_index(F.col("path"), root, -1)
    return files.select(rel.alias("path"), F.col("length").alias("size"), role_of(rel).alias("category"), F.sha2("content", 256).alias("digest"))


def catalogs(paths: DataFrame) -> DataFrame:
    """Names and versions of catalog files (path)."""
    pattern = r"([^/]+)_reference_catalog_([^/]+)\.json$"
    hit = paths.where(F.col("path").rlike(pattern)).select(F.regexp_extract("path", pattern, 1).alias("name"), F.regexp_extract("path", pattern, 2).alias("version"))
    return hit.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions"))


def type_directory(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a type directory: qname, definition, properties; comments are left out."""
    cells = F.split("value", r" \| ")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.trim(cells[0]).alias("qname"), F.get(cells, 1).alias("definition"), F.split(F.get(cells, 2), ", ").alias("properties"))
