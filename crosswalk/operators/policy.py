"""Which targets a class may have, what a new target changes, and whether decisions are whole.

A reference model, where one is installed, names the classes (namespace, name) that may be targets; namespaces (prefix, base) bind its addresses to prefixes. Where
there is none, every target may be. Targets that are missing or undecided always pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.values import UNDECIDED, definition_hash, real_target
from crosswalk.operators.catalog import longest_prefix
from crosswalk.operators.decide import resolve

#: what names a cascade in a matrix, a fixed output value
CASCADE = "target-type-change-cascade"


@dataclass
class Policy:
    """classes (namespace, name), or None without a reference model; namespaces (prefix, base); roots (namespace, name) that can only be bases."""

    classes: DataFrame | None
    namespaces: DataFrame
    roots: DataFrame | None = None

    def judged(self, targets: DataFrame) -> DataFrame:
        """Distinct targets (target) with canonical, their prefixed form, eligible and root."""
        asked = targets.select("target").distinct()
        if self.classes is None:
            return asked.select("target", F.col("target").alias("canonical"), F.lit(True).alias("eligible"), F.lit(False).alias("root"))
        full = F.col("target").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://|^urn:")
        iris = longest_prefix(asked.where(full).withColumnRenamed("target", "term"), self.namespaces)
        iris = iris.select(F.col("term").alias("target"), F.coalesce(F.concat("prefix", F.lit(":"), F.expr("substring(term, length(base) + 1)")), F.col("term")).alias("canonical"))
        named = iris.unionByName(asked.where(~full).withColumn("canonical", F.col("target")))
        parts = named.withColumns({"prefix": F.substring_index("canonical", ":", 1), "name": F.expr("substring(canonical, instr(canonical, ':') + 1)")}).join(self.namespaces.withColumnRenamed("base", "namespace"), "prefix", "left")
        of = lambda df, name: df.select("namespace", "name").distinct().withColumn(name, F.lit(True))
        out = parts.join(of(self.classes, "__class"), ["namespace", "name"], "left")
        out = out.join(of(self.roots, "__root"), ["namespace", "name"], "left") if self.roots is not None else out.withColumn("__root", F.lit(None).cast("boolean"))
        root = F.coalesce("__root", F.lit(False))
        return out.select("target", "canonical", (F.coalesce("__class", F.lit(False)) | root).alias("eligible"), root.alias("root"))


def _free(target: Column) -> Column:
    return target.isNull() | (target == UNDECIDED)


def canonical_targets(selections: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Selections (concept, target, ...) with their targets in prefixed form, and those that the policy rejects (concept, target, message), all together. Nothing is put in a rejected one's place."""
    judged = policy.judged(selections.where(~_free(F.col("target")))).select(F.col("target").alias("__t"), "canonical", "eligible")
    both = selections.join(judged, F.col("target") == F.col("__t"), "left").withColumn("__ok", F.coalesce("eligible", F.lit(True)))
    kept = both.where("__ok").withColumn("target", F.coalesce("canonical", "target")).select(*selections.columns)
    message = F.concat(F.lit("Target '"), F.col("target"), F.lit("' is not a class of the reference model."))
    return kept, both.where("not __ok").select("concept", "target", message.alias("message"))


def checked_targets(selections: DataFrame, policy: Policy, shown: int = 20) -> DataFrame:
    """As the first of :func:`canonical_targets`; an error that names the first ``shown`` rejections, and how many there are, if there is any."""
    kept, rejected = canonical_targets(selections, policy)
    rejected = rejected.cache()
    try:
        if n := rejected.count():
            raise ValueError(f"{n} targets are rejected: " + "; ".join(f"{r['concept']}: {r['message']}" for r in rejected.orderBy("concept").limit(shown).collect()))
    finally:
        rejected.unpersist()
    return kept


#: the fields of an entry that name classes, by action
FIELDS = {"reuse": ("target",), "extend": ("target", "baseType"), "augment": ("target", "augmentsType")}


def invalid_targets(matrix: DataFrame, policy: Policy) -> DataFrame:
    """concept, target, fields and reason of every class that an entry (concept, action, target, baseType, augmentsType) names and may not: not-a-class, or root-only-extends for a root that is reused or augmented.

    One row for each target of a concept, whatever the number of its fields that hold it.
    """
    cases = F.lit(None).cast("array<struct<field:string,target:string>>")
    for action, fields in FIELDS.items():
        cases = F.when(F.col("action") == action, F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("target")) for f in fields])).otherwise(cases)
    held = matrix.select("concept", "action", F.posexplode(cases).alias("pos", "x")).select("concept", "action", "pos", "x.*").where(~_free(F.col("target")))
    by = held.groupBy("concept", "action", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field"))), lambda x: x["field"]), "/").alias("fields"))
    judged = by.join(policy.judged(by), "target")
    reason = F.when(~F.col("eligible"), "not-a-class").when(F.col("root") & (F.col("action") != "extend"), "root-only-extends")
    return judged.select("concept", "target", "fields", reason.alias("reason")).where("reason is not null")


def cascade(matrix: DataFrame, changes: DataFrame, properties: DataFrame, target_properties: DataFrame, catalog: DataFrame, policy: Policy | None = None, default_base: str | None = None, augmenting: bool = True) -> tuple[DataFrame, DataFrame]:
    """The matrix and the properties after new targets (concept, target): changed entries are resolved anew, and wait for review again with their properties.

    ``matrix`` has concept, target, reviewStatus, ruleId, targetDefinition, targetDefinitionHash and targetLabel besides what :func:`resolve` gives; ``catalog`` has key, label and
    definition. A changed entry's definition, its hash and label are the new target's: an empty definition, and no hash and label where the catalog has none. Other entries stay as they are.
    A target that the policy rejects is an error that names all that are rejected.
    """
    to = checked_targets(changes.select("concept", "target"), policy) if policy else changes.select("concept", "target")
    known = catalog.groupBy(F.col("key").alias("target")).agg(F.min_by(F.struct("label", "definition"), F.coalesce("definition", F.lit(""))).alias("__new"))
    moved = resolve(matrix.select("concept").join(to, "concept"), properties.join(to.select("concept"), "concept", "left_semi").select("concept", "name", "target"), target_properties, default_base, augmenting)
    moved = moved.join(known, "target", "left").withColumns({
        "targetDefinition": F.coalesce("__new.definition", F.lit("")), "targetDefinitionHash": definition_hash(F.col("__new.definition")), "targetLabel": F.nullif("__new.label", F.lit("")),
        "reviewStatus": F.lit("pending-review"), "ruleId": F.lit(CASCADE),
    })
    rest = matrix.join(to.select("concept"), "concept", "left_anti")
    fresh = {c: F.col(c) for c in moved.columns if c in matrix.columns}
    kept = moved.join(matrix.select("concept", *[c for c in matrix.columns if c not in moved.columns]), "concept").select(*[fresh.get(c, F.col(c)) for c in matrix.columns])
    touched = properties.join(to.select("concept", F.lit(True).alias("__to")), "concept", "left")
    status = F.when(F.col("__to"), F.lit("pending-review")).otherwise(F.col("reviewStatus"))
    return rest.unionByName(kept), touched.withColumn("reviewStatus", status).select(*properties.columns)


def refingerprint(properties: DataFrame, catalog: DataFrame) -> DataFrame:
    """Properties with the definition of their decided target and its hash taken from the catalog (key, definition); without a decided target both are null."""
    known = catalog.groupBy(F.col("key").alias("target")).agg(F.min("definition").alias("__definition"))
    got = properties.join(known, "target", "left")
    now = F.when(real_target(F.col("target")), F.col("__definition"))
    return got.withColumns({"targetDefinition": now, "targetDefinitionHash": definition_hash(now)}).select(*dict.fromkeys([*properties.columns, "targetDefinition", "targetDefinitionHash"]))


def stale_properties(old: DataFrame, new: DataFrame) -> DataFrame:
    """Properties (concept, name, hash, definition) of concepts in both versions whose hashes are known in both and differ; properties of one version only are not stale. Of repeated ones the last by pos counts."""
    last = lambda df, side: df.groupBy("concept", "name").agg(F.max_by(F.struct("hash", "definition"), "pos").alias(side))
    both = last(old, "o").join(last(new, "n"), ["concept", "name"])
    return both.where("o.hash is not null and n.hash is not null and o.hash <> n.hash").select("concept", "name", F.col("o.definition").alias("old_definition"), F.col("n.definition").alias("new_definition"))


#: what a class decision of each action needs and may not have
NEEDS = {"reuse": ("target",), "extend": ("extensionType", "baseType"), "augment": ("target", "augmentationType", "augmentsType"), "exclude": ()}
BANS = {"reuse": ("extensionType", "baseType", "augmentationType", "augmentsType"), "extend": ("augmentationType", "augmentsType"), "augment": ("extensionType", "baseType"), "exclude": ()}


def class_issues(entries: DataFrame) -> DataFrame:
    """concept and issue of every class decision that lacks what its action needs or has what it may not; empty texts are none."""
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    tests = [F.when((F.col("action") == a) & ~some(c), F.lit(f"{a} requires {c}")) for a, cs in NEEDS.items() for c in cs]
    tests += [F.when((F.col("action") == a) & some(c), F.lit(f"{a} should not have {c}")) for a, cs in BANS.items() for c in cs]
    return entries.select("concept", F.explode(F.array_compact(F.array(*tests))).alias("issue"))


def property_issues(properties: DataFrame) -> DataFrame:
    """concept, name and issue of every property decision that is open, aims at nothing or is none that is known."""
    a = F.col("action")
    issue = F.when((a == "reuse-property") & ~real_target(F.col("target")), "reuse-property requires target").when(a == "human-must-decide", "human-must-decide: must be resolved")
    issue = issue.when(~F.coalesce(a.isin("reuse-property", "create-property", "human-must-decide"), F.lit(False)), F.concat(F.lit("unknown property action: "), F.coalesce(a, F.lit("none"))))
    return properties.select("concept", "name", issue.alias("issue")).where("issue is not null")
