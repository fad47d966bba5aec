"""Matrices as they are written, and reports on runs: reshaping with defaults, manifests, metrics, listings and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.operators.summaries import by_action, codebook, matrix_summary

#: columns that a matrix entry always has, and what stands where there is nothing; and those that it has only where they were given
ENTRY_DEFAULTS = {"sourceConcept": None, "sourceDefinition": "", "sourcePath": "", "action": "pending", "actionRationale": "", "targetType": None, "targetTypeLabel": None, "targetDefinition": "", "targetPath": "", "rationale": ""}
ENTRY_CARRIED = ("targetDefinitionHash", "extensionType", "baseType", "augmentationType", "augmentsType")
PROPERTY_DEFAULTS = {"sourceProperty": "", "sourceDefinition": "", "sourcePath": "", "action": "create-property", "targetProperty": None, "targetPropertyLabel": None, "targetDefinition": "", "targetPath": "", "rationale": ""}
PROPERTY_CARRIED = ("newPropertyName", "targetDefinitionHash")


def _reshaped(rows: DataFrame, keys: list[str], defaults: dict[str, str | None], carried: tuple[str, ...]) -> DataFrame:
    def value(name: str, default: str | None) -> Column:
        if name not in rows.columns:
            return F.lit(default).cast("string").alias(name)
        return (F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))).alias(name)

    return rows.select(*keys, *[value(n, d) for n, d in defaults.items()], *[c for c in carried if c in rows.columns], F.lit("pending-review").alias("reviewStatus"))


def matrix_entries(alignment: DataFrame) -> DataFrame:
    """Alignment entries as matrix entries: every column of ``ENTRY_DEFAULTS``, those of ``ENTRY_CARRIED`` that there are, and a pending review."""
    return _reshaped(alignment, [], ENTRY_DEFAULTS, ENTRY_CARRIED)


def matrix_properties(properties: DataFrame) -> DataFrame:
    """Properties (sourceConcept, propertyAction, ...) of alignment entries as those of matrix entries."""
    named = properties.withColumnRenamed("propertyAction", "action") if "propertyAction" in properties.columns else properties
    return _reshaped(named, ["sourceConcept"], PROPERTY_DEFAULTS, PROPERTY_CARRIED)


def coherence(matrix: DataFrame, properties: DataFrame, entropy: DataFrame | None = None, residual: DataFrame | None = None) -> DataFrame:
    """One row: classes and properties by action and confidence, the codebook's digest, and the entropy before and after review, null where neither was measured.

    A best guess is one; every other confidence is confident.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        n = by_action(df, "").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias(f"{name}Actions"))
        guess = F.count_if(F.col("confidence") == "best-guess")
        return n.crossJoin(df.agg(F.count("*").alias(f"{name}Total"), guess.alias(f"{name}BestGuess"), (F.count("*") - guess).alias(f"{name}Confident")))  # one row each

    digest = codebook(matrix, "targetDefinitionHash") if "targetDefinitionHash" in matrix.columns else matrix.agg(F.lit(0).cast("long").alias("hashes"), F.lit(0).cast("long").alias("distinct_hashes"))
    out = side(matrix, "class").crossJoin(side(properties, "property")).crossJoin(digest)
    if entropy is None and residual is None:
        return out.withColumn("entropy", F.lit(None).cast("struct<before:double,after:double>"))
    one = lambda df, c: F.lit(None).cast("double") if df is None else F.lit(df.agg(F.coalesce(F.sum(c), F.lit(0.0))).first()[0])
    return out.withColumn("entropy", F.struct(one(entropy, "entropy").alias("before"), one(residual, "residual").alias("after")))


def evidence(matrix: DataFrame, properties: DataFrame) -> DataFrame:
    """How much review a matrix holds: decided classes, decided properties and rows with a time of review that is one; rows whose status is unknown are left out."""
    known = ("pending-review", "accepted", "changed", "rejected")
    done = lambda df, name: df.where(F.col("reviewStatus").isin(*known)).agg(F.count_if(F.col("reviewStatus") != "pending-review").alias(name), F.count(F.try_to_timestamp("reviewedAt")).alias(f"{name}Timed"))
    return done(matrix, "classes").crossJoin(done(properties, "properties"))  # one row each


def review_state(matrix: DataFrame, properties: DataFrame) -> DataFrame:
    """One row of counters: concepts, accepted, pending, excluded, and properties that are open or best guesses."""
    m = matrix.agg(F.count("*").alias("concepts"), F.count_if(F.col("reviewStatus") == "accepted").alias("accepted"), F.count_if((F.col("reviewStatus") == "pending-review") & (F.col("action") != "exclude")).alias("pending"), F.count_if(F.col("action") == "exclude").alias("excluded"))
    p = properties.agg(F.count_if(F.col("action") == "human-must-decide").alias("openProperties"), F.count_if(F.col("confidence") == "best-guess").alias("guessedProperties"))
    return m.crossJoin(p)  # one row each


def review_stats(rows: DataFrame) -> DataFrame:
    """Rows by action and confidence; none given is unset."""
    return rows.groupBy(F.coalesce("action", F.lit("unknown")).alias("action"), F.coalesce("confidence", F.lit("unset")).alias("confidence")).agg(F.count("*").alias("n"))


def stage_metrics(matrix: DataFrame, properties: DataFrame) -> DataFrame:
    """One line of text on a matrix, as a run prints it."""
    s = matrix_summary(matrix, properties)
    part = lambda c, name: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {name}")))
    return s.select(F.concat(F.col("total").cast("string"), F.lit(" concepts ("), F.concat_ws(", ", *[part(c, c) for c in ("reuse", "extend", "augment", "exclude")]), F.lit("), "), F.col("properties").cast("string"), F.lit(" properties")).alias("line"))


def listing_total(files: DataFrame) -> DataFrame:
    """Files (path, size) and their size together, by the folder they are in."""
    folder = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def runs(states: DataFrame) -> DataFrame:
    """Runs (run) that have states (run, number, status), the newest name first, with their stage: the highest completed one."""
    done = F.coalesce(F.max(F.when(F.col("status") == "completed", F.col("number"))), F.lit(0))
    return states.where("number is not null").groupBy("run").agg(done.alias("stage"), F.count("*").alias("stages")).orderBy(F.desc("run"))


def source_packages(files: DataFrame, endings: tuple[str, ...] = ("_agency_package",)) -> DataFrame:
    """Folders (first part of path) whose name has a package's ending, with how many files they hold."""
    name = F.substring_index("path", "/", 1)
    fits = F.lit(False)
    for e in endings:
        fits = fits | name.endswith(e)
    return files.where((F.instr("path", "/") > 0) & fits).groupBy(name.alias("package")).agg(F.count("*").alias("files"))


def in_action_order(rows: DataFrame) -> DataFrame:
    """Adds place: reuse, augment and extend first, then other actions by name."""
    order = F.array(F.lit("reuse"), F.lit("augment"), F.lit("extend"))
    at = F.array_position(order, F.col("action"))
    return rows.withColumn("place", F.when(at > 0, at).otherwise(4).cast("int")).orderBy("place", "action", "concept")


def filtered(rows: DataFrame, status: str | None = None, action: str | None = None) -> DataFrame:
    """Rows of a review status and an action; none asked for is any."""
    out = rows.where(F.col("reviewStatus") == status) if status else rows
    return out.where(F.col("action") == action) if action else out


def review_items(matrix: DataFrame, marks: DataFrame) -> DataFrame:
    """A line of text for each concept of a review: name, target, action, and how many of its properties are reused, created and open (r/c/!)."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    got = matrix.join(marks, "concept", "left")
    line = F.concat(F.col("concept"), F.lit(" -> "), F.coalesce("target", F.lit("(none)")), F.lit(" ["), F.coalesce("action", F.lit("unknown")), F.lit("] "), n("r"), F.lit("r/"), n("c"), F.lit("c/"), n("open"), F.lit("!"))
    return got.select("concept", "action", line.alias("line"))


def alignment_report(entries: DataFrame, target: str, version: str) -> DataFrame:
    """One row that heads a report: target, how many entries and how many of each action."""
    n = by_action(entries, "pending").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias("actionCounts"), F.coalesce(F.sum("n"), F.lit(0)).alias("totalConcepts"))
    return n.select(F.lit(target).alias("targetOntology"), F.lit(version).alias("targetVersion"), F.lit("semantic").alias("matchingMethod"), "totalConcepts", "actionCounts")


def version_manifest(matrix: DataFrame, version: str, source: str, timings: DataFrame | None = None) -> DataFrame:
    """One row: version, source, concepts, actions, and the seconds of all stages (seconds), null without any."""
    n = by_action(matrix, "unknown").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias("mappingStats"), F.coalesce(F.sum("n"), F.lit(0)).alias("conceptCount"))
    took = F.lit(None).cast("double") if timings is None else F.lit(timings.agg(F.sum("seconds")).first()[0]).cast("double")
    return n.select(F.lit(version).alias("currentVersion"), F.lit(f"{source}@1.0").alias("sourcePackageVersion"), "conceptCount", "mappingStats", took.alias("totalDurationSeconds"))


def lineage(files: DataFrame, matrix: DataFrame) -> DataFrame:
    """Generated files (path) with what they were made from: all targets and concepts of the matrix, and the artifacts of the step before. Files of other folders are left out."""
    one = matrix.agg(F.sort_array(F.collect_set(F.nullif("target", F.lit("")))).alias("targetReferences"), F.sort_array(F.collect_set("concept")).alias("mappingEntries"), F.lit(1).alias("__one"))
    folder = F.substring_index("path", "/", 1)
    before = F.when(folder == "ontology", F.array(F.lit("mappings/mapping-matrix.json"))).when(folder == "cmf", F.array(F.lit("ontology/"))).when(folder == "shapes", F.array(F.lit("mappings/mapping-matrix.json"))).when(folder == "kg", F.array(F.lit("mappings/mapping-matrix.json"), F.lit("ontology/")))
    got = files.withColumn("dependsOn", before).where("dependsOn is not null").withColumn("__one", F.lit(1)).join(one, "__one")
    refs = F.when(folder.isin("ontology", "cmf"), F.col("targetReferences"))
    return got.select("path", "dependsOn", refs.alias("targetReferences"), "mappingEntries")


def run_results(matrix: DataFrame, properties: DataFrame, checks: DataFrame, files: DataFrame, timings: DataFrame) -> DataFrame:
    """Rows (section, key, value) on a run: review by action and confidence, checks by status, files by folder, seconds by stage."""
    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    out = row(review_stats(matrix), "class", F.concat_ws("/", "action", "confidence"), F.col("n"))
    for df, section, key, value in (
        (review_stats(properties), "property", F.concat_ws("/", "action", "confidence"), F.col("n")),
        (checks.groupBy("status").agg(F.count("*").alias("n")), "check", F.col("status"), F.col("n")),
        (listing_total(files), "files", F.col("folder"), F.col("size")),
        (timings, "seconds", F.col("stage").cast("string"), F.col("seconds")),
    ):
        out = out.unionByName(row(df, section, key, value))
    return out
