"""Names and identifiers: prefixed names, IRIs, cases, graph and file names. Every function takes and gives columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nz(c: Column) -> Column:
    """Null in place of an empty string."""
    return F.nullif(c, F.lit(""))


def is_full_iri(term: Column) -> Column:
    """Whether a term carries a scheme of its own; false for null."""
    return F.coalesce(F.lower(term).rlike(r"^(https?://|urn:)"), F.lit(False))


def local_name(term: Column) -> Column:
    """Of an IRI what follows the last of # / : (the whole if that is empty); of a prefixed name what follows the first colon."""
    last = F.regexp_extract(term, r"([^#/:]*)$", 1)
    return F.when(is_full_iri(term), F.coalesce(nz(last), term)).when(F.instr(term, ":") > 0, F.regexp_extract(term, r"^[^:]*:([\s\S]*)$", 1)).otherwise(term)


def after_last_colon(term: Column) -> Column:
    return F.substring_index(term, ":", -1)


def after_first_colon(term: Column) -> Column:
    return F.when(F.instr(term, ":") > 0, F.regexp_extract(term, r"^[^:]*:([\s\S]*)$", 1)).otherwise(term)


def after_hash_or_slash(uri: Column) -> Column:
    return F.when(F.instr(uri, "#") > 0, F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def namespace_of(iri: Column) -> Column:
    """Through the last #, else the last /, else the whole."""
    return F.when(F.instr(iri, "#") > 0, F.regexp_extract(iri, r"^(.*#)", 1)).when(F.instr(iri, "/") > 0, F.regexp_extract(iri, r"^(.*/)", 1)).otherwise(iri)


def component_iri(namespace: Column, name: Column) -> Column:
    """Namespace and name; joined by nothing after / # or :, else by : for urn: and / for the rest."""
    gap = F.when(namespace.rlike(r"[/#:]$"), F.lit("")).when(F.lower(namespace).startswith("urn:"), F.lit(":")).otherwise(F.lit("/"))
    return F.concat(namespace, gap, name)


def qualified_target_property(prop: Column, class_target: Column) -> Column:
    """A bare property name takes the prefix of its class's target."""
    bare = (F.instr(prop, ":") == 0) & (F.instr(class_target, ":") > 0)
    return F.when(bare, F.concat(F.split_part(class_target, F.lit(":"), F.lit(1)), F.lit(":"), prop)).otherwise(prop)


def created_property_qname(prop: Column, primary_prefix: str, bound: list[str], edge_prefix: str) -> Column:
    """Own prefix where it is bound and not the primary one; otherwise the package's."""
    own = F.split_part(prop, F.lit(":"), F.lit(1))
    minted = is_full_iri(prop) | (F.instr(prop, ":") == 0) | (own == primary_prefix) | ~own.isin(bound or [""])
    return F.when(minted, F.concat(F.lit(edge_prefix + ":"), local_name(prop))).otherwise(prop)


def slugify_ncname(value: Column, fallback: str = "x") -> Column:
    """Runs of other characters become one hyphen, a bad start goes; ``fallback`` if nothing is left."""
    dashed = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9_.-]+", "-")
    return F.coalesce(nz(F.regexp_replace(F.regexp_replace(dashed, r"^[^A-Za-z_]+", ""), r"-+$", "")), F.lit(fallback))


def snake(name: Column) -> Column:
    """An underscore before each capital that follows a lower-case letter or digit."""
    return F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")


def relationship_type(prop: Column) -> Column:
    return F.upper(snake(local_name(prop)))


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2"))


def split_capitals(name: Column, by: str) -> Column:
    """``by`` before every capital but a leading one."""
    return F.regexp_replace(name, r"(?<!^)([A-Z])", by + "$1")


def graph_identifier(text: Column) -> Column:
    """Every character but letters, digits and _ becomes _, and a leading digit is put after one."""
    clean = F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike(r"^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def graph_name(qname: Column, primary_prefix: str) -> Column:
    """Local name in the primary namespace, prefix_local in another, ns<hash>_local for an IRI."""
    local, prefix = local_name(qname), F.split_part(qname, F.lit(":"), F.lit(1))
    prefixed = (F.instr(qname, ":") > 0) & ~is_full_iri(qname)
    namespace = F.substring(qname, F.lit(1), F.length(qname) - F.length(local))
    text = F.when(prefixed & (prefix == primary_prefix), local).when(prefixed, F.concat(prefix, F.lit("_"), local)).otherwise(F.concat(F.lit("ns"), F.substring(F.sha1(namespace.cast("binary")), 1, 6), F.lit("_"), local))
    return graph_identifier(text)


def edge_class_name(qname: Column) -> Column:
    return F.concat(local_name(qname), F.lit("Type"))


def augmentation_type_name(target: Column) -> Column:
    return F.concat(F.regexp_replace(after_last_colon(target), r"Type$", ""), F.lit("AugmentationType"))


def id_to_qname(cmf_id: Column) -> Column:
    """The first dot becomes a colon."""
    return F.regexp_replace(cmf_id, r"^([^.]*)\.", "$1:")


def qname_to_id(qname: Column) -> Column:
    return F.regexp_replace(qname, r"^([^:]*):", "$1.")


def class_iri(namespace: str, name: Column) -> Column:
    return F.concat(F.lit(namespace.rstrip("#/") + "#"), name)


def property_iri(namespace: str, class_name: Column, name: Column) -> Column:
    return F.concat(F.lit(namespace.rstrip("#/") + "#"), class_name, F.lit("."), name)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


# Fixed values, tried in this order: the address forms that name an organisation and a source.
ADDRESS_FORMS = (
    r"^https?://data\.([^.]+)\.[^/]+/ontology/([^/#]+)",
    r"^https?://([^.]+)\.[^/]+/ontology/([^/#]+)",
    r"^https?://([^.]+)\.[^/]+/([^/#]+)",
)


def org_and_source(uri: Column) -> tuple[Column, Column, Column]:
    """Organisation, source and confidence read from a namespace: four patterns, the first that fits."""
    u = F.regexp_replace(uri, r"[#/]+$", "")
    tries = tuple(zip(ADDRESS_FORMS, ("high", "high", "medium"), strict=True))
    parts = F.filter(F.split(u, "/"), lambda p: (p != "") & ~p.contains(":") & ~p.contains("."))
    n = F.size(parts)
    org, source, how = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("none")
    has = nz(uri).isNotNull()
    org, source = F.when(has & (n >= 2), F.try_element_at(parts, F.lit(-2))), F.when(has & (n >= 1), F.try_element_at(parts, F.lit(-1)))
    how = F.when(has & (n >= 1), F.lit("low")).otherwise(F.lit("none"))
    for pattern, name in reversed(tries):
        fits = F.coalesce(u.rlike(pattern), F.lit(False))
        org = F.when(fits, F.regexp_extract(u, pattern, 1)).otherwise(org)
        source = F.when(fits, F.regexp_extract(u, pattern, 2)).otherwise(source)
        how = F.when(fits, F.lit(name)).otherwise(how)
    return org, source, how


def org_of_run(directory: Column) -> Column:
    """What stands before _YYYYMMDD in a run folder's name."""
    return nz(F.regexp_extract(directory, r"^(.+?)_\d{8}", 1))
