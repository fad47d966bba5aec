"""Review as keyed updates: each takes a table and gives its next version; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.values import real_target
from crosswalk.operators.decide import latest
from crosswalk.operators.lineage import dealt


def upsert(rows: DataFrame, changes: DataFrame, key: str, nulls: bool = False) -> DataFrame:
    """Rows with the values of ``changes`` in place of their own, null ones only with ``nulls``; keys that only ``changes`` has are added. ``changes`` has a row a key."""
    own = [c for c in changes.columns if c != key]
    new = changes.select(key, F.lit(True).alias("__changed"), *[F.col(c).alias(f"__{c}") for c in own])
    both = rows.join(new, key, "full")
    value = lambda c: F.when(F.col("__changed"), F.col(f"__{c}")).otherwise(F.col(c)) if nulls else F.coalesce(f"__{c}", c)
    return both.select(*[value(c).alias(c) if c in own else F.col(c) for c in rows.columns])


def accept(matrix: DataFrame, concepts: DataFrame) -> DataFrame:
    """Accepts the named concepts (concept)."""
    return upsert(matrix, concepts.select("concept").distinct().withColumn("reviewStatus", F.lit("accepted")), "concept").join(matrix.select("concept"), "concept", "left_semi")


def undecided(action, target):
    """Everything but a created property and a reused one with a real target."""
    return ~((action == "create-property") | ((action == "reuse-property") & real_target(target)))


def accept_properties(properties: DataFrame, concepts: DataFrame, confidence: str = "confident") -> DataFrame:
    """Accepts the decided properties of the named concepts; a confidence that was set explicitly stays."""
    hit = properties.join(concepts.select("concept", F.lit(True).alias("__hit")).distinct(), "concept", "left")
    ready = F.coalesce("__hit", F.lit(False)) & ~undecided(F.col("action"), F.col("target"))
    explicit = F.coalesce("confidenceExplicit", F.lit(False))
    return hit.withColumns({"reviewStatus": F.when(ready, "accepted").otherwise(F.col("reviewStatus")), "confidence": F.when(ready & ~explicit, confidence).otherwise(F.col("confidence"))}).drop("__hit")


def approve_all(matrix: DataFrame, properties: DataFrame) -> DataFrame:
    """Accepts every pending concept; an error while any of them has undecided properties."""
    pending = matrix.where("reviewStatus = 'pending-review' and action <> 'exclude'")
    blockers = properties.where(undecided(F.col("action"), F.col("target"))).join(pending.select("concept"), "concept", "left_semi").select("concept").distinct().limit(6).collect()
    if blockers:
        raise ValueError("undecided properties: " + ", ".join(sorted(r["concept"] for r in blockers)[:5]))
    return accept(matrix, pending)


def decide_property(properties: DataFrame, decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Applies the latest decision (concept, name, action, target, seq) to each property; one that reuses what a non-empty catalog (key) lacks is an error. Decisions may be repeated."""
    rows = properties.count() + decisions.count()
    d = latest(dealt(decisions, rows, "concept", "name"), ["concept", "name"], ["seq"])
    lost = d.where((F.col("action") == "reuse-property") & real_target(F.col("target"))).join(catalog, d["target"] == catalog["key"], "left_anti").limit(6).collect()
    if lost and not catalog.isEmpty():
        raise ValueError("unknown targets: " + ", ".join(sorted(r["target"] for r in lost)))
    new = d.select("concept", "name", F.col("action").alias("__a"), F.col("target").alias("__t"), F.lit(True).alias("__d"))
    # dealt alike, so neither side is shuffled again
    both = dealt(properties, rows, "concept", "name").join(new, ["concept", "name"], "left")
    return both.withColumns({"action": F.coalesce("__a", "action"), "target": F.when(F.col("__d"), F.col("__t")).otherwise(F.col("target")), "reviewStatus": F.when(F.col("__d"), "accepted").otherwise(F.col("reviewStatus"))}).drop("__a", "__t", "__d")


def reopen(stages: DataFrame, number: int) -> DataFrame:
    """Stages from ``number`` on are pending again."""
    back = F.col("number") >= number
    return stages.withColumns({"status": F.when(back, "pending").otherwise(F.col("status")), "completed_at": F.when(~back, F.col("completed_at"))})


def progress(stages: DataFrame) -> DataFrame:
    """The highest completed stage and the next one."""
    done = F.coalesce(F.max(F.when(F.col("status") == "completed", F.col("number"))), F.lit(0))
    return stages.agg(done.alias("highest"), (done + 1).alias("next"))


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet, for writes that go on where they stopped."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def saved(log: DataFrame, decisions: DataFrame, properties: DataFrame) -> DataFrame:
    """New rows of a decision log: ``decisions`` (concept, action, target, rationale) numbered on from the last id, each with its accepted property decisions (concept, name, action, target) in order of name."""
    from crosswalk.operators.lineage import numbered

    last = F.lit(log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    own = properties.where("reviewStatus = 'accepted'").groupBy("concept").agg(F.sort_array(F.collect_list(F.struct("name", "action", "target"))).alias("propertyDecisions"))
    got = numbered(decisions, ["concept"], "id").withColumn("id", F.col("id") + last).join(own, "concept", "left")
    return got.withColumn("propertyDecisions", F.coalesce("propertyDecisions", F.array().cast(dict(own.dtypes)["propertyDecisions"])))


def reset(matrix: DataFrame, snapshot: DataFrame, key: str = "concept") -> DataFrame:
    """The matrix as the snapshot has it: rows of the snapshot alone, whatever was decided since; columns that only the matrix has are null."""
    kinds = dict(matrix.dtypes)
    return snapshot.select(*[F.col(c) if c in snapshot.columns else F.lit(None).cast(kinds[c]).alias(c) for c in matrix.columns])


def requested(requests: DataFrame, name: str, why: str, at) -> DataFrame:
    """Requests (id, name, why, status, created_at, completed_at) and one more, pending, with the next id."""
    last = requests.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    spark = requests.sparkSession
    one = spark.createDataFrame([(name, why)], "name string, why string").select((F.lit(last) + 1).cast(dict(requests.dtypes)["id"]).alias("id"), "name", "why", F.lit("pending").alias("status"), F.lit(at).cast(dict(requests.dtypes)["created_at"]).alias("created_at"), F.lit(None).cast(dict(requests.dtypes)["completed_at"]).alias("completed_at"))
    return requests.unionByName(one)


def completed(requests: DataFrame, ident: int, at) -> DataFrame:
    """Requests of which one is completed; an unknown id is an error, and one that is completed already stays as it is."""
    if requests.where(F.col("id") == ident).isEmpty():
        raise ValueError(f"no request {ident}")
    now = (F.col("id") == ident) & (F.col("status") == "pending")
    return requests.withColumns({"status": F.when(now, "completed").otherwise(F.col("status")), "completed_at": F.when(now, F.lit(at)).otherwise(F.col("completed_at"))})


def by_status(requests: DataFrame, status: str | None = None) -> DataFrame:
    """Requests of a status, the newest first; of any, pending ones first."""
    some = requests.where(F.col("status") == status) if status else requests
    return some.orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), F.desc("created_at"), F.desc("id"))


OBSERVED = ("pipeline", "catalog", "matrix", "package", "documentation")


def observation(stage: int, kind: str, component: str, text: str, at, target: str = "pipeline", impact: str = "low", workaround: str | None = None):
    """A row for the log of observations; an unknown target or an empty text is an error."""
    if target not in OBSERVED:
        raise ValueError(f"no target {target!r}")
    if not text.strip():
        raise ValueError("an observation says something")
    return (stage, kind, component, text, workaround, impact, target, at)


def may_start(stages: DataFrame, number: int) -> bool:
    """Whether a stage may start: every one before it is completed, as none may be jumped over."""
    return stages.where((F.col("number") < number) & (F.col("status") != "completed")).isEmpty()


def dispatch(action: str, matrix: DataFrame, properties: DataFrame, **given) -> tuple[DataFrame, DataFrame]:
    """Applies a review action by name and returns the new matrix and properties.

    approve (concepts), approve_all, change_target (changes, target_properties), resolve_property (decisions, catalog). An unknown action is an error.
    """
    from crosswalk.operators.decide import retarget

    if action == "approve":
        return accept(matrix, given["concepts"]), accept_properties(properties, given["concepts"])
    if action == "approve_all":
        done = approve_all(matrix, properties)
        return done, accept_properties(properties, done.where("reviewStatus = 'accepted'"))
    if action == "change_target":
        # only the changed concepts are resolved anew; the others' rows stay
        changed = retarget(matrix.select("concept", "target").join(given["changes"].select("concept"), "concept", "left_semi"), given["changes"], properties, given["target_properties"], given.get("default_base"))
        own = [c for c in matrix.columns if c in changed.columns and c != "concept"]
        return upsert(matrix, changed.select("concept", *own), "concept", nulls=True), properties
    if action == "resolve_property":
        return matrix, decide_property(properties, given["decisions"], given["catalog"])
    raise ValueError(f"no review action {action!r}")
