"""Names that a package derives from its organisation, source and target; prefixes of sources; and repairs of what evaluators give back."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.names import nz, slugify_ncname

#: prefixes that every package binds, fixed values; a null address is one of its own
RESERVED = {
    "ext": None, "owl": "http://www.w3.org/2002/07/owl#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "xs": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#", "sh": "http://www.w3.org/ns/shacl#", "dcterms": "http://purl.org/dc/terms/",
}
#: namespaces of one source
MOST_NAMESPACES = 10_000


def source_prefix(declared: DataFrame, classes: DataFrame) -> DataFrame:
    """inventory and prefix: the declared one (inventory, prefix) without colons at its end, else that of the first class (inventory, qname, pos); empty without either."""
    first = classes.groupBy("inventory").agg(F.min_by(F.split_part("qname", F.lit(":"), F.lit(1)), "pos").alias("__first"))
    both = declared.join(first, "inventory", "left")
    return both.select("inventory", F.coalesce(nz(F.rtrim(F.col("prefix"), F.lit(":"))), F.col("__first"), F.lit("")).alias("prefix"))


def namespace_bindings(source: DataFrame, target: DataFrame, primary: str, edge_prefix: str) -> DataFrame:
    """prefix, emitted and uri of every source namespace (prefix, uri) but the primary one. Where a target (prefix, uri), the package or the standard has the prefix for another address, it is emitted as source_<prefix>, with _2 and so on if that is taken."""
    rows = source.select(F.rtrim(F.col("prefix"), F.lit(":")).alias("prefix"), "uri").groupBy("prefix").agg(F.max("uri").alias("uri")).orderBy("prefix").limit(MOST_NAMESPACES + 1).collect()
    taken = target.select(F.rtrim(F.col("prefix"), F.lit(":")).alias("prefix"), "uri").limit(MOST_NAMESPACES + 1).collect()
    if max(len(rows), len(taken)) > MOST_NAMESPACES:
        raise ValueError(f"more than {MOST_NAMESPACES} namespaces")
    reserved = {r["prefix"]: r["uri"] for r in taken} | {edge_prefix.rstrip(":"): None} | RESERVED
    occupied, out = {*reserved, *(r["prefix"] for r in rows)}, []
    for prefix, uri in rows:
        emitted, n = prefix, 1
        if prefix in reserved and reserved[prefix] != uri:
            emitted = f"source_{prefix}"
            while emitted in occupied:
                n += 1
                emitted = f"source_{prefix}_{n}"
            occupied.add(emitted)
        if prefix != primary:
            out.append((prefix, emitted, uri))
    return source.sparkSession.createDataFrame(out, "prefix string, emitted string, uri string")


def source_namespace(source: Column, prefix: Column, uri: Column) -> tuple[Column, Column]:
    """Prefix and address of a tabular source: the given ones, else those of its name, else src."""
    dashed = F.translate(F.lower(F.trim(F.coalesce(source, F.lit("")))), " _", "--")
    slug = F.when(dashed == "", F.lit("")).otherwise(slugify_ncname(dashed, ""))
    return F.coalesce(nz(prefix), nz(slug), F.lit("src")), F.coalesce(nz(uri), F.concat(F.lit("urn:"), F.coalesce(nz(slug), F.lit("src")), F.lit("-model")))


def package_names(organization: Column, source: Column, target: Column) -> Column:
    """A struct of all that a package is called: its name, namespaces, files, prefix, label and description."""
    org, src = slugify_ncname(organization, "org"), slugify_ncname(source, "source")
    space = F.concat(F.lit("http://"), org, F.lit(".gov/"), src)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.struct(
        join(org, "_", src, "_edge_package").alias("package"), join(organization, "_", source, "_agency_package").alias("agency_package"), join(space, "/edge#").alias("edge_namespace"), join(space, "/ext#").alias("extension_namespace"),
        join(src, "-edge").alias("file_prefix"), join(src, "-edge-core.ttl").alias("core_file"), join(src, "-edge.trig").alias("trig_file"), join(src, "-model").alias("model_stem"), join(src, "-edge:").alias("edge_prefix"),
        join(F.initcap(F.replace(organization, F.lit("_"), F.lit(" "))), " ", F.upper(source)).alias("label"), join(target, "-aligned edge ontology for ", source).alias("description"),
    )


def _unescaped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Character references of a text decoded; null stays null."""
    return F.pandas_udf(_unescaped, "string")(c)


def repaired(actual: Column, expected: Column) -> Column:
    """What an evaluator called a source, decoded; the expected name where only its prefix is missing."""
    plain = F.when(F.instr(actual, "&") > 0, unescape(actual)).otherwise(actual)
    bare = F.regexp_extract(expected, r"^[^:]*:([\s\S]*)$", 1)
    return F.when((F.instr(expected, ":") > 0) & (plain == bare), expected).otherwise(plain)


def settings(defaults: dict, state: str | None) -> dict:
    """The defaults with what the thresholds of a run's state (JSON text) say for the same keys; other keys, and a state that is no JSON object, change nothing."""
    try:
        given = json.loads(state or "{}")
        own = given.get("thresholds", {}) if isinstance(given, dict) else {}
    except json.JSONDecodeError:
        own = {}
    return defaults | {k: v for k, v in own.items() if k in defaults} if isinstance(own, dict) else dict(defaults)
