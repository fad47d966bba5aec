"""Values: fingerprints, types, cardinalities, labels, literals, times and entropy. Every function takes and gives columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Data types of tabular models, and of the graph and XML targets.
TABULAR_TYPES = {
    "string": "xs:string", "date": "xs:date", "bool": "xs:boolean", "boolean": "xs:boolean", "amount": "xs:decimal", "float": "xs:float", "double": "xs:double",
    "int": "xs:integer", "integer": "xs:integer", "short": "xs:short", "long": "xs:long", "byte": "xs:byte", "dateTime": "xs:dateTime", "time": "xs:time",
    "duration": "xs:duration", "decimal": "xs:decimal", "id": "xs:string",
}
GRAPH_TYPES = {
    "string": "STRING", "anyURI": "STRING", "normalizedString": "STRING", "integer": "INTEGER", "int": "INTEGER", "long": "INTEGER", "nonNegativeInteger": "INTEGER",
    "positiveInteger": "INTEGER", "decimal": "FLOAT", "float": "FLOAT", "double": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "dateTime": "DATETIME",
}
# Fixed values too, tried in this order: endings of type names and the patterns they mean.
PATTERN_SUFFIXES = (
    ("AugmentationType", "augmentation"), ("AssociationType", "association"), ("MetadataType", "metadata"), ("AdapterType", "adapter"),
    ("CodeSimpleType", "simple_value"), ("CodeType", "simple_value"), ("SimpleType", "simple_value"),
)
XSD = "http://www.w3.org/2001/XMLSchema#"
UNDECIDED = "[undecided]"


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def definition_hash(d: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256; null stays null, an empty text is hashed."""
    return F.substring(F.sha2(d.cast("binary"), 256), 1, 16)


def real_target(t: Column) -> Column:
    """Whether a target is set and decided."""
    return F.coalesce((t != "") & (t != UNDECIDED), F.lit(False))


def tabular_type(t: Column) -> Column:
    """The XSD type of a tabular one, looked up in lower case as models are read; dateTime thus falls to xs:string."""
    return lookup(TABULAR_TYPES, F.lower(t), "xs:string")


def is_primitive(t: Column) -> Column:
    return F.coalesce(t.isin(list(TABULAR_TYPES)), F.lit(False))


def graph_type(iri: Column) -> Column:
    return lookup(GRAPH_TYPES, F.coalesce(F.replace(iri, F.lit(XSD), F.lit("")), F.lit("")), "STRING")


def xml_datatype(iri: Column) -> Column:
    """xs.name of an XSD IRI or of xs:name, else xs.string."""
    return F.when(iri.startswith("xs:"), F.concat(F.lit("xs."), F.substr(iri, F.lit(4)))).when(iri.startswith(XSD), F.concat(F.lit("xs."), F.replace(iri, F.lit(XSD), F.lit("")))).otherwise(F.lit("xs.string"))


def pattern_of(name: Column) -> Column:
    """A type's pattern by the first suffix that its name has, else object."""
    out = None
    for suffix, pattern in PATTERN_SUFFIXES:
        out = F.when(name.endswith(suffix), pattern) if out is None else out.when(name.endswith(suffix), pattern)
    return out.otherwise("object")


def multiplicity(m: Column) -> tuple[Column, Column]:
    """Least and most (null: unbounded) of '', '*', 'n' and 'a..b'; other text is 0 to unbounded, but a bound that is no number is an error."""
    t = F.trim(m)
    ranged, number = F.instr(t, "..") > 0, t.rlike(r"^[+-]?\d+$")
    lo_text, hi_text = F.split_part(t, F.lit(".."), F.lit(1)), F.regexp_extract(t, r"^[\s\S]*?\.\.([\s\S]*)$", 1)
    lo = F.when(ranged, F.when(ranged, lo_text).cast("int")).when(number, F.when(number, t).cast("int")).otherwise(0)
    hi = F.when(ranged, F.when(ranged & (hi_text != "*"), hi_text).cast("int")).when(number, F.when(number, t).cast("int"))
    return F.coalesce(lo, F.lit(0)), hi


def clean_definition(d: Column) -> Column:
    """Lines trimmed and joined by spaces, without element numbers and story markers; a story's own text stays."""
    lines = F.transform(F.split(F.coalesce(d, F.lit("")), "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: ~x.startswith("Element#") & (x != "User Story:"))
    told = F.transform(kept, lambda x: F.when(x.startswith("User Story: "), F.trim(F.substr(x, F.lit(13)))).otherwise(x))
    return F.trim(F.array_join(F.filter(told, lambda x: x != ""), " "))


def entropy(n: Column) -> Column:
    """Bits of a choice among ``n``; 0 for one or none."""
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.log2(n))


def cypher_text(s: Column) -> Column:
    out = s
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cypher_literal(value: Column, datatype: Column) -> Column:
    """Numbers and booleans bare where their form is valid, other values quoted."""
    kind, bare = graph_type(datatype), F.regexp_replace(value, r"^\s+|\s+$", "")
    whole, real = bare.rlike(r"^[+-]?\d+$"), bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    digits = F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    truth = F.lower(bare)
    out = F.when((kind == "INTEGER") & whole, F.when(digits == "-0", "0").otherwise(digits)).when((kind == "FLOAT") & real, bare)
    out = out.when((kind == "BOOLEAN") & truth.isin("true", "1"), "true").when((kind == "BOOLEAN") & truth.isin("false", "0"), "false")
    return out.otherwise(F.concat(F.lit("'"), cypher_text(value), F.lit("'")))


def round_even(c: Column, digits: int) -> Column:
    """Rounds a number's shortest decimal form, halves to the even digit."""
    return F.bround(c, digits)


def language_rank(lang: Column) -> Column:
    """0 for labels without language or in English, 1 for others."""
    return F.when(F.coalesce(F.lower(lang), F.lit("")).isin("", "en", "en-us"), 0).otherwise(1)


def shacl_severity(node: Column) -> Column:
    return F.coalesce(F.replace(node, F.lit("http://www.w3.org/ns/shacl#"), F.lit("")), F.lit("Violation"))


def shape_targets(targets: Column, target: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(targets, none)) > 0, targets).when(F.coalesce(target, F.lit("")) != "", F.array(target)).otherwise(none)


def stamp(t: Column) -> Column:
    """A time as UTC text to the second."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_stamp(s: Column) -> Column:
    """A time from text, without offset as UTC; null where it is none."""
    return F.try_to_timestamp(s)


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).otherwise(F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))


def date_transform(xsd: Column) -> Column:
    return F.when(F.replace(xsd, F.lit(XSD), F.lit("")).isin("date", "dateTime"), F.lit("xsd:date-to-iso8601"))


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of every object in order and no white space between; null if it is no JSON. Numbers stay as they are written but for zeros that say nothing."""
    return F.to_json(F.try_parse_json(text))


def document_digest(text: Column, without: tuple[str, ...] = ()) -> Column:
    """SHA-256 of an object's canonical text without some of its own keys, so neither the order of keys nor these change it; null if it is no object."""
    members = F.from_json(text, "map<string, variant>")
    kept = F.map_filter(members, lambda k, v: ~k.isin(*without)) if without else members
    parts = F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(F.to_json(F.struct(k.alias("k"))), F.coalesce(F.to_json(F.element_at(kept, k)), F.lit("null"))))
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.sha2(F.array_join(parts, ","), 256))
