"""Exchange models (XML), paged listings and reference models: components as rows, their identities, and what they refer to."""

from __future__ import annotations

import os
import time
import urllib.request
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswalk.functions.names import id_to_qname
from crosswalk.functions.values import XSD

KINDS = ("Namespace", "Class", "ObjectProperty", "DatatypeProperty", "Datatype", "Restriction", "Union", "List")
COMPONENT = "kind string, id string, name string, uri string, definition string, base string, refs array<string>, members array<struct<property:string,min:string,max:string>>, augmentations array<struct<class:string,property:string,min:string,max:string,code:string>>, values array<struct<value:string,definition:string>>, signature string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _components(text: str) -> list[tuple]:
    """The components of one model; an element without id is none, broken XML is an error."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(text)
    uris = {}
    for e in root:
        if _local(e.tag) == "Namespace":
            uris[_attr(e, "id")] = next((c.text for c in e if _local(c.tag) == "NamespaceURI"), None)

    def find(e, *names: str) -> str | None:
        return next(((c.text or "").strip() for c in e if _local(c.tag) in names), None)

    def ref(e, *names: str) -> str | None:
        return next((_attr(c, "ref") for c in e if _local(c.tag) in names), None)

    def signature(e) -> tuple:
        # prefixes are aliases: a reference stands for the namespace's address and the name
        def named(r: str | None) -> str | None:
            prefix, _, rest = (r or "").partition(".")
            return f"{uris[prefix]}#{rest}" if prefix in uris else r

        own = sorted((_local(k), named(v) if _local(k) == "ref" else v) for k, v in e.attrib.items() if _local(k) not in ("id", "nil"))
        return _local(e.tag), tuple(own), (e.text or "").strip(), tuple(signature(c) for c in e)

    out = []
    for e in root:
        ident = _attr(e, "id")
        if ident is None:
            continue
        members, augmented, values = [], [], []
        for c in e.iter():
            if _local(c.tag) == "HasProperty":
                p = ref(c, "Property", "ObjectProperty", "DatatypeProperty")
                if p:
                    members.append((p, find(c, "MinOccursQuantity"), find(c, "MaxOccursQuantity")))
            elif _local(c.tag) == "AugmentationRecord":
                augmented.append((ref(c, "Class"), ref(c, "Property", "ObjectProperty", "DatatypeProperty"), find(c, "MinOccursQuantity"), find(c, "MaxOccursQuantity"), find(c, "GlobalClassCode")))
            elif _local(c.tag) in ("EnumerationFacet", "Enumeration"):
                values.append((find(c, "FacetValue", "StringValue"), find(c, "DefinitionText")))
        prefix = ident.partition(".")[0]
        uri = find(e, "NamespaceURI") if _local(e.tag) == "Namespace" else uris.get(ref(e, "Namespace") or prefix)
        refs = sorted({r for c in e.iter() if c is not e and (r := _attr(c, "ref"))})
        base = ref(e, "ExtensionOfClass", "SubClassOf", "RestrictionBase", "Class", "Datatype")
        out.append((_local(e.tag), ident, find(e, "Name") or "", uri, find(e, "DefinitionText", "DocumentationText") or "", base, refs, members, augmented, values, repr(signature(e))))
    return out


def components(models: DataFrame, xml: str = "xml", key: str | None = None) -> DataFrame:
    """Components of models, one text a row: kind, id, name, the address of the namespace, definition, base, all references, and what a class holds. ``key``: a column to keep."""
    keep = [key] if key else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in COMPONENT.replace("<property:string,min:string,max:string>", "").replace("<class:string,property:string,min:string,max:string,code:string>", "").replace("<value:string,definition:string>", "").split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            got = pd.DataFrame(rows, columns=[*keep, *names])
            for c, fields in (("members", ("property", "min", "max")), ("augmentations", ("class", "property", "min", "max", "code")), ("values", ("value", "definition"))):
                got[c] = [[dict(zip(fields, x, strict=True)) for x in v] for v in got[c]]
            return got

        rows = []
        for pdf in batches:
            for k, t in zip(pdf[key] if keep else [None] * len(pdf), pdf[xml], strict=True):
                for c in _components(t) if t is not None else ():
                    rows.append((*([k] if keep else []), *c))
                    if len(rows) == 2000:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    head = f"{key} {dict(models.dtypes)[key]}, " if key else ""
    return models.select(*keep, xml).mapInPandas(run, head + COMPONENT)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Components of model files, gzipped or not; each is read whole by one task."""
    return components(spark.read.text(path, wholetext=True).withColumnRenamed("value", "xml"))


_CACHE: dict[tuple[str, int], DataFrame] = {}


def reference_model(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A reference model's components, read again only when its file has changed; a name that leads out of the folder is an error."""
    path = os.path.realpath(os.path.join(folder, name))
    if os.path.commonpath([path, os.path.realpath(folder)]) != os.path.realpath(folder):
        raise ValueError(f"{name!r} is not in the folder of reference models")
    key = path, os.stat(path).st_mtime_ns
    if key not in _CACHE:
        for old in [k for k in _CACHE if k[0] == path]:
            _CACHE.pop(old).unpersist()
        _CACHE[key] = read_models(spark, f"file://{path}").persist()
    return _CACHE[key]


def types(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Classes: qname, definition, base and their properties with bounds, which stay text."""
    props = F.transform("members", lambda m: F.struct(id_to_qname(m["property"]).alias("property"), m["min"].alias("min"), m["max"].alias("max")))
    return found.where("kind = 'Class'").select(*keys, id_to_qname(F.col("id")).alias("qname"), "definition", id_to_qname(F.col("base")).alias("base"), props.alias("properties"))


def properties(found: DataFrame) -> DataFrame:
    """Properties (qname, kind, definition, range) with the sorted classes that have them."""
    p = found.where("kind in ('ObjectProperty', 'DatatypeProperty')").select(id_to_qname(F.col("id")).alias("qname"), F.when(F.col("kind") == "ObjectProperty", "object").otherwise("datatype").alias("kind"), "definition", id_to_qname(F.col("base")).alias("range"))
    within = found.where("kind = 'Class'").select(id_to_qname(F.col("id")).alias("class"), F.explode("members").alias("m"))
    by = within.groupBy(id_to_qname(F.col("m.property")).alias("qname")).agg(F.sort_array(F.collect_set("class")).alias("containingTypes"))
    return p.join(by, "qname", "left").withColumn("containingTypes", F.coalesce("containingTypes", F.array().cast("array<string>")))


def augmentations(found: DataFrame) -> DataFrame:
    """Augmented classes with what is added to each: property, bounds and code, as sorted structs; records of no class are left out."""
    each = found.select(F.explode("augmentations").alias("a")).where("a.class is not null")
    one = F.struct(id_to_qname(F.col("a.property")).alias("property"), F.col("a.min").alias("min"), F.col("a.max").alias("max"), F.col("a.code").alias("code"))
    return each.groupBy(id_to_qname(F.col("a.class")).alias("class")).agg(F.sort_array(F.collect_set(one)).alias("augmentations"))


def codelists(found: DataFrame) -> DataFrame:
    """Values (qname, value, definition) of restrictions."""
    return found.select(id_to_qname(F.col("id")).alias("qname"), F.explode("values").alias("v")).select("qname", "v.value", "v.definition")


def identity(kind: Column, uri: Column, name: Column) -> Column:
    """What a component is, whatever its prefix: its namespace's address, and its name unless it is the namespace."""
    return F.when(kind == "Namespace", F.array(uri)).otherwise(F.array(uri, name))


def class_identities(found: DataFrame) -> DataFrame:
    """Distinct (uri, name) of native classes; datatypes are none."""
    return found.where("kind = 'Class'").select("uri", "name").distinct()


def conflicts(found: DataFrame) -> DataFrame:
    """Ids that are declared twice (id), and identities whose declarations differ (id: null)."""
    twice = found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("name"))
    differ = found.where("kind <> 'Namespace'").groupBy("uri", "name").agg(F.count_distinct("signature").alias("n")).where("n > 1").select(F.lit(None).cast("string").alias("id"), "uri", "name")
    return twice.unionByName(differ)


def index(found: DataFrame) -> DataFrame:
    """Components by identity; conflicts are an error that names some of them."""
    bad = conflicts(found).limit(5).collect()
    if bad:
        raise ValueError("conflicting declarations: " + ", ".join(r["id"] or f"{r['uri']} {r['name']}" for r in bad))
    return found.withColumn("identity", identity(F.col("kind"), F.col("uri"), F.col("name")))


#: names of XSD types that models refer to as xs.name: fixed values
XSD_TYPES = "anyURI base64Binary boolean byte date dateTime decimal double duration float gDay gMonth gMonthDay gYear gYearMonth hexBinary int integer language long negativeInteger nonNegativeInteger nonPositiveInteger normalizedString positiveInteger short string time token unsignedByte unsignedInt unsignedLong unsignedShort".split()


def builtin(spark: SparkSession) -> DataFrame:
    """The XSD namespace and its types as components."""
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([("Namespace", "xs", "")] + [("Datatype", f"xs.{n}", n) for n in XSD_TYPES], "kind string, id string, name string")
    return rows.select("kind", "id", "name", F.lit(XSD.rstrip("#")).alias("uri"), F.lit("").alias("definition"), none.alias("base"), F.when(F.col("kind") == "Datatype", F.array(F.lit("xs"))).otherwise(F.array().cast("array<string>")).alias("refs"))


def completed(local: DataFrame, reference: DataFrame, roots: list[str] = ()) -> DataFrame:
    """Ids (id) of all components that a model needs: its own, and those of the reference that references lead to, one from the other; references of classes to implicit ``roots`` don't count.

    Ids of both are those of one set of prefixes. A reference that neither has is not in the result.
    """
    from crosswalk.operators.graph import closure

    both = local.select("id", "refs").unionByName(reference.select("id", "refs"))
    edges = both.select("id", F.explode("refs").alias("ref")).where(~F.col("ref").isin(*(roots or [""])))
    return closure(local.select("id"), edges).join(both.select("id").distinct(), "id", "left_semi")


def unbound(found: DataFrame) -> DataFrame:
    """References (id, ref) that no component of the model answers."""
    return found.select("id", F.explode("refs").alias("ref")).join(found.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select("id", "ref")


# listings that come in pages, and tables from elsewhere


def fetch_json(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310 - the caller names the address
        return json.load(r)


def paged(spark: SparkSession, url: str, schema: str, fetch: Callable[[str], dict] = fetch_json, size: int = 100, tries: int = 3, wait: float = 2.0) -> DataFrame:
    """The items of a listing ({page} and {size} in ``url``), page after page until one says that it is the last; a page that fails is asked for ``tries`` times.

    Pages hang on each other's last flag, so one task reads them in turn; items are rows of ``schema`` as soon as their page is there.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _ in pdf["id"]:
                page, last = 0, False
                while not last:
                    for left in range(tries - 1, -1, -1):
                        try:
                            got = fetch(url.format(page=page, size=size))
                            break
                        except Exception:
                            if not left:
                                raise
                            time.sleep(wait)
                    yield pd.DataFrame({"json": [json.dumps(x) for x in got.get("content", [])]})
                    last, page = bool(got.get("last", True)), page + 1

    return spark.range(1, numPartitions=1).mapInPandas(run, "json string").select(F.from_json("json", schema).alias("x")).select("x.*")


def checked_csv(spark: SparkSession, path: str, expected: list[str]) -> tuple[DataFrame, list[str]]:
    """A table with a header, and which expected columns it lacks: these are a warning, not an error."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.removeprefix("﻿").strip() for c in df.columns])
    return df, sorted(set(expected) - set(df.columns))


def genericode(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """Values (list, code, name) of code lists, a text a row: columns are found by their canonical address or id that ends in code or name, else the first is the code and the second the name.

    A text that breaks off is read as far as its rows are whole.
    """
    def rows(text: str) -> list[tuple]:
        from xml.etree import ElementTree

        parser, name, columns, row, out = ElementTree.XMLPullParser(["start", "end"]), None, {}, {}, []
        try:
            parser.feed(text)
            events = list(parser.read_events())
        except ElementTree.ParseError:
            events = []
            try:
                for e in parser.read_events():
                    events.append(e)
            except ElementTree.ParseError:
                pass
        ref, order, canon = None, [], {}
        for kind, e in events:
            tag = _local(e.tag)
            if kind == "start" and tag == "Value":
                ref = e.get("ColumnRef")
            elif kind == "start" and tag == "Column":
                order.append(e.get("Id"))
            elif kind == "end" and tag == "CanonicalUri" and order:
                canon[order[-1]] = (e.text or "").lower()
            elif kind == "end" and tag == "ShortName" and name is None:
                name = (e.text or "").strip()
            elif kind == "end" and tag == "SimpleValue":
                row[ref or str(len(row))] = (e.text or "").strip()
            elif kind == "end" and tag == "Row":
                if not columns:
                    ids = order or list(row)
                    pick = lambda w: next((i for i in ids if (canon.get(i) or (i or "").lower()).endswith(w)), None)  # noqa: E731, B023
                    columns = {"code": pick("code") or (ids[0] if ids else None), "name": pick("name") or (ids[1] if len(ids) > 1 else None)}
                out.append((name, row.get(columns["code"]), row.get(columns["name"])))
                row = {}
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for t in pdf[xml] if t is not None for r in rows(t)], columns=["list", "code", "name"])

    return texts.select(xml).mapInPandas(run, "list string, code string, name string")


# vector indexes and evaluators' schemas


def strict_schema(node):
    """A JSON schema in which every object allows no other keys than its own and requires all of them."""
    if isinstance(node, list):
        return [strict_schema(x) for x in node]
    if not isinstance(node, dict):
        return node
    out = {k: strict_schema(v) for k, v in node.items()}
    if out.get("type") == "object" and isinstance(out.get("properties"), dict):
        out |= {"additionalProperties": False, "required": sorted(out["properties"])}
    return out
