"""Checks on stages, packages and inputs: each gives rows (check, status, details), status pass or fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.values import real_target


def check(totals: DataFrame, name: str, ok: Column, details: Column, severity: str = "error") -> DataFrame:
    """A check on one row of totals."""
    return totals.select(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status"), F.lit(severity).alias("severity"), details.cast("string").alias("details"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("0")) for p in parts])


def inventory_stage(files: DataFrame) -> DataFrame:
    """Stage 1: the source has files."""
    n = files.agg(F.count("*").alias("n"))
    return check(n, "source_inventory_nonempty", F.col("n") > 0, _text(F.col("n"), " files"))


def concept_stage(classes: DataFrame) -> DataFrame:
    """Stage 2: the source has classes."""
    n = classes.agg(F.count("*").alias("n"))
    return check(n, "concept_inventory_nonempty", F.col("n") > 0, _text(F.col("n"), " classes"))


def alignment_stage(entries: DataFrame) -> DataFrame:
    """Stage 3: entries (concept, action, rationale, target) are there, have action and reason, and aim at no abstract type."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    abstract = F.coalesce(F.col("target").rlike("(Abstract|AugmentationPoint)$"), F.lit(False))
    n = entries.agg(F.count("*").alias("n"), F.count_if(~some("action") | ~some("rationale")).alias("bad"), F.count_if(abstract).alias("abstract"))
    return _all([
        check(n, "alignment_entry_count", F.col("n") > 0, _text(F.col("n"), " entries")),
        check(n, "alignment_entries_complete", F.col("bad") == 0, _text(F.col("bad"), " incomplete entries")),
        check(n, "no_abstract_targets", F.col("abstract") == 0, _text(F.col("abstract"), " abstract targets")),
    ])


def matrix_stage(summary: DataFrame, matrix: DataFrame) -> DataFrame:
    """Stage 4: the summary's totals (total, reuse, extend, augment, exclude) are those of the matrix."""
    n = matrix.agg(F.count("*").alias("n")).crossJoin(summary)  # one row each
    acted = F.col("reuse") + F.col("extend") + F.col("augment") + F.col("exclude")
    return _all([
        check(n, "matrix_summary_counts", F.col("total") == F.col("n"), _text("totalConcepts=", F.col("total"), ", mappings=", F.col("n"))),
        check(n, "matrix_action_counts_sum", acted == F.col("total"), _text("actionCounts sum=", acted, ", totalConcepts=", F.col("total"))),
    ])


def review_stage(matrix: DataFrame, properties: DataFrame, log: DataFrame) -> DataFrame:
    """Stage 5: nothing is pending or open, and the log has a decision (concept) for every concept."""
    pending = matrix.agg(F.count_if((F.col("reviewStatus") == "pending-review") & (F.col("action") != "exclude")).alias("pending"), F.count("*").alias("n"))
    open_ = properties.agg(F.count_if(F.col("action") == "human-must-decide").alias("open"))
    lost = matrix.select("concept").join(log.select("concept"), "concept", "left_anti").agg(F.count("*").alias("lost"))
    n = pending.crossJoin(open_).crossJoin(lost)  # one row each
    return _all([
        check(n, "review_complete", F.col("pending") == 0, _text(F.col("pending"), " pending")),
        check(n, "properties_decided", F.col("open") == 0, _text(F.col("open"), " undecided properties")),
        check(n, "decision_log_complete", F.col("lost") == 0, _text(F.col("lost"), " concepts without a decision")),
    ])


def files_stage(files: DataFrame, required: list[str], name: str) -> DataFrame:
    """Stages 6 to 8: each required path is there and not empty; a check for each."""
    want = files.sparkSession.createDataFrame([(p,) for p in required], "path string")
    got = want.join(files.select("path", "size"), "path", "left")
    return got.select(F.concat(F.lit(f"{name}:"), F.col("path")).alias("check"), F.when(F.col("size") > 0, "pass").otherwise("fail").alias("status"), F.lit("error").alias("severity"), F.coalesce(F.concat(F.col("size").cast("string"), F.lit(" bytes")), F.lit("missing")).alias("details"))


#: stages and their verifiers, in order; a stage may be given another one
VERIFIERS: dict[int, Callable[..., DataFrame]] = {1: inventory_stage, 2: concept_stage, 3: alignment_stage, 4: matrix_stage, 5: review_stage, 6: files_stage, 7: files_stage, 8: files_stage}


def verify(stage: int, *tables, verifiers: dict[int, Callable[..., DataFrame]] = VERIFIERS) -> DataFrame:
    """The checks of a stage; an unknown stage is an error."""
    if stage not in verifiers:
        raise ValueError(f"no stage {stage}")
    return verifiers[stage](*tables).withColumn("stage", F.lit(stage))


def extension_count(extensions: DataFrame, matrix: DataFrame) -> DataFrame:
    """Package check 4: as many extensions as the matrix extends and augments, or more."""
    n = extensions.agg(F.count("*").alias("n")).crossJoin(matrix.agg(F.count_if(F.col("action").isin("extend", "augment")).alias("want")))  # one row each
    return check(n, "extension-catalog-count", F.col("n") >= F.col("want"), _text(F.col("n"), " extensions cataloged, ", F.col("want"), " extend+augment actions"))


def decision_count(log: DataFrame, mapped: DataFrame) -> DataFrame:
    """Package check 5: as many decisions as mapped concepts, or more."""
    n = log.agg(F.count("*").alias("n")).crossJoin(mapped.agg(F.count_distinct("concept").alias("want")))  # one row each
    return check(n, "decision-log-count", F.col("n") >= F.col("want"), _text(F.col("n"), " decisions for ", F.col("want"), " mapped concepts"))


def statement_files(lines: DataFrame) -> DataFrame:
    """Package check 6: each graph file (path, line) has a line that is neither empty nor a comment."""
    told = (F.trim("line") != "") & ~F.ltrim("line").startswith("//")
    n = lines.groupBy("path").agg(F.count_if(told).alias("n"))
    return n.select(F.concat(F.lit("graph-file:"), F.col("path")).alias("check"), F.when(F.col("n") > 0, "pass").otherwise("fail").alias("status"), F.lit("error").alias("severity"), _text(F.col("n"), " statements").alias("details"))


def query_files(queries: DataFrame) -> DataFrame:
    """Package check 7: each query text (path, text) names a form and has its braces in pairs; one with parameters ($x) is passed over."""
    form = F.col("text").rlike(r"(?i)\b(select|construct|ask|describe)\b")
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    ok = form & (count("{") == count("}")) & (count("{") > 0) & (count("(") == count(")"))
    rest = queries.where(~F.col("text").rlike(r"\$[A-Za-z_]"))
    return rest.select(F.concat(F.lit("query:"), F.col("path")).alias("check"), F.when(ok, "pass").otherwise("fail").alias("status"), F.lit("error").alias("severity"), F.when(ok, "well formed").otherwise("malformed").alias("details"))


def conformance(violations: DataFrame, shapes: DataFrame) -> DataFrame:
    """Package checks 1 and 2: every shape that counts is met; violations (severity, code, key) of any severity of a deactivated shape don't arise."""
    n = violations.agg(F.count("*").alias("n")).crossJoin(shapes.agg(F.count_if(~F.coalesce("deactivated", F.lit(False))).alias("shapes")))  # one row each
    return check(n, "shapes-conform", F.col("n") == 0, _text(F.col("n"), " violations of ", F.col("shapes"), " constraints"))


def model_counts(model: DataFrame, expected: DataFrame) -> DataFrame:
    """Package check 11: an exchange model has as many components (kind, id) of each kind as expected (kind, n)."""
    got = expected.join(model.groupBy("kind").agg(F.count_distinct("id").alias("have")), "kind", "left")
    return got.select(F.concat(F.lit("model-count:"), F.col("kind")).alias("check"), F.when(F.coalesce("have", F.lit(0)) == F.col("n"), "pass").otherwise("fail").alias("status"), F.lit("error").alias("severity"), _text(F.col("have"), " of ", F.col("n")).alias("details"))


def input_findings(files: DataFrame, statements: DataFrame, endings: tuple[str, ...] = (".ttl", ".nt", ".rdf", ".owl", ".xml", ".n3", ".jsonld")) -> DataFrame:
    """Why an input package can't be worked on, the first reason only: no files, no RDF files, none that gives statements (path, n), no classes in them; no row if it can.

    ``files``: path; ``statements``: path, n (statements) and classes, of the files that could be read.
    """
    rdf = F.lit(False)
    for e in endings:
        rdf = rdf | F.lower("path").endswith(e)
    n = files.agg(F.count("*").alias("files"), F.count_if(rdf).alias("rdf")).crossJoin(statements.agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)).alias("read"), F.coalesce(F.sum("classes"), F.lit(0)).alias("classes")))  # one row each
    code = F.when(F.col("files") == 0, "IV-010").when(F.col("rdf") == 0, "IV-020").when(F.col("read") == 0, "IV-030").when(F.col("classes") == 0, "IV-040")
    said = F.when(F.col("files") == 0, F.lit("the package is empty")).when(F.col("rdf") == 0, F.lit("no RDF files")).when(F.col("read") == 0, F.lit("no file could be read")).otherwise(F.lit("no classes"))
    return n.select(F.lit("error").alias("severity"), code.alias("code"), F.lit("package").alias("key"), said.alias("message")).where("code is not null")


def validated_files(files: DataFrame, outputs: tuple[str, ...] = ("governance/version-manifest.json", "governance/lineage-manifest.json", "governance/change-impact.md", "README.md")) -> DataFrame:
    """Files (path) that a package's checks cover: all but those that are made after them."""
    return files.where(~F.col("path").isin(*outputs))


def package_warnings(files: DataFrame, wanted: tuple[str, ...] = ("ontology", "shapes", "vocab")) -> DataFrame:
    """Warnings for categories (category) of which a package has no file."""
    want = files.sparkSession.createDataFrame([(w,) for w in wanted], "category string")
    return want.join(files.select("category"), "category", "left_anti").select(F.lit("warning").alias("severity"), F.lit("PM-001").alias("code"), F.col("category").alias("key"), F.lit("no files").alias("message"))


def unresolved_extensions(matrix: DataFrame, decisions: DataFrame, classes: DataFrame, class_properties: DataFrame) -> DataFrame:
    """What an extension catalog can't name: accepted extended or augmented concepts without a class, and their created properties (concept, property) that the class doesn't have."""
    ours = matrix.where(F.col("action").isin("extend", "augment") & (F.col("reviewStatus") == "accepted")).select("concept")
    lost = ours.join(classes.select(F.col("qname").alias("concept")), "concept", "left_anti").select("concept", F.lit(None).cast("string").alias("property"))
    made = decisions.where(~((F.col("action") == "reuse-property") & (F.col("status") == "accepted") & real_target(F.col("target"))))
    made = made.join(ours, "concept", "left_semi").join(lost.select("concept"), "concept", "left_anti").select("concept", "property")
    astray = made.join(class_properties.select(F.col("class").alias("concept"), "property"), ["concept", "property"], "left_anti")
    return lost.unionByName(astray)


def extension_catalog(matrix: DataFrame, decisions: DataFrame, classes: DataFrame, class_properties: DataFrame, declared: DataFrame, namespace: str) -> DataFrame:
    """Accepted extended and augmented concepts with the name and IRI of what they add, its base, and the properties that are declared for it; anything that can't be named is an error that lists all of it."""
    lost = unresolved_extensions(matrix, decisions, classes, class_properties).orderBy("concept", "property").limit(20).collect()
    if lost:
        raise ValueError("can't be named: " + "; ".join(r["concept"] + (f": {r['property']}" if r["property"] else "") for r in lost))
    taken = F.coalesce((F.col("action") == "reuse-property") & (F.col("status") == "accepted") & real_target(F.col("target")), F.lit(False))
    made = decisions.where(~taken).join(declared.select(F.col("qname").alias("property")), "property", "left_semi")
    props = made.groupBy("concept").agg(F.sort_array(F.collect_set("property")).alias("properties"))
    ours = matrix.where(F.col("action").isin("extend", "augment") & (F.col("reviewStatus") == "accepted"))
    name = F.when(F.col("action") == "augment", F.col("augmentationType")).otherwise(F.col("extensionType"))
    base = F.coalesce(F.when(F.col("action") == "augment", F.col("augmentsType")).otherwise(F.col("baseType")), "target")
    got = ours.join(props, "concept", "left").join(classes.select(F.col("qname").alias("concept"), F.col("iri").alias("sourceConceptIRI")), "concept")
    return got.select("concept", name.alias("name"), F.concat(F.lit(namespace), name).alias("extensionIRI"), base.alias("baseType"), F.coalesce("properties", F.array().cast("array<string>")).alias("properties"), "sourceConceptIRI")
