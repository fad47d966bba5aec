"""Rules about matrices, packages and evaluations. Each gives rows (severity, code, key, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.values import UNDECIDED


#: different lengths of names that details are cut by
MOST_LENGTHS = 1000


def finding(df: DataFrame, severity: str, code: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), key.cast("string").alias("key"), message.alias("message"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def gates(summary: DataFrame) -> DataFrame:
    """Findings on one row of totals: total, reuse, extend, augment, exclude, properties, reused, created."""
    acted = F.col("reuse") + F.col("extend") + F.col("augment") + F.col("exclude")
    decided = F.col("reused") + F.col("created")
    tests = F.array(
        F.when(F.col("total") == 0, F.struct(F.lit("QG-001").alias("code"), F.lit("empty matrix").alias("message"))),
        F.when(acted != F.col("total"), F.struct(F.lit("QG-002").alias("code"), _text("actions ", acted, " of ", F.col("total")).alias("message"))),
        F.when(decided != F.col("properties"), F.struct(F.lit("QG-003").alias("code"), _text("decided ", decided, " of ", F.col("properties")).alias("message"))),
    )
    return summary.select(F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("x")).select(F.lit("error").alias("severity"), "x.code", F.lit("matrix").alias("key"), "x.message")


def audit(matrix: DataFrame, properties: DataFrame, source_counts: DataFrame, target_name: str = "niem") -> DataFrame:
    """Generation audit of classes (concept, action, target, extensionType, baseType, augmentationType, augmentsType), their
    properties (concept, name, action) and source property counts (concept, n)."""
    own = properties.groupBy("concept").agg(F.count("*").alias("n_props"), F.count_if(F.col("action") == "reuse-property").alias("n_reuse"), F.count_if(F.col("action") == "human-must-decide").alias("n_open"))
    m = matrix.join(own, "concept", "left").join(source_counts.withColumnRenamed("n", "n_source"), "concept", "left")
    m = m.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_props", "n_reuse", "n_open", "n_source")}).where("action <> 'exclude'")
    key, act = F.col("concept"), F.col("action")
    extend, augment = act == "extend", act == "augment"
    lacks = (extend & F.col("extensionType").isNull()) | (augment & (F.col("augmentationType").isNull() | F.col("augmentsType").isNull()))
    extra = (~extend & F.col("extensionType").isNotNull()) | (~augment & F.col("augmentationType").isNotNull())
    astray = (augment & ~F.col("augmentsType").eqNullSafe(F.col("target"))) | (extend & F.col("target").isNotNull() & ~F.col("baseType").eqNullSafe(F.col("target")))
    tests = [
        ("warning", "GA-001", F.col("n_source") == 0, _text("no source properties")),
        ("error", "GA-002", augment & F.lit(not target_name.startswith("niem")), _text("augment needs a target that knows it")),
        ("warning", "GA-003", augment & (F.col("n_props") > 0) & (F.col("n_reuse") == 0), _text("augment reuses no property")),
        ("error", "GA-004", (F.col("n_source") > 0) & (F.col("n_props") == 0), _text(F.col("n_source"), " source properties, none mapped")),
        ("error", "GA-005", lacks | extra, F.when(lacks, F.lit("scaffolding missing")).otherwise(F.lit("scaffolding unexpected"))),
        ("error", "GA-006", F.col("n_open") > 0, _text(F.col("n_open"), " properties undecided")),
        ("error", "GA-007", astray, _text("scaffolding names another target")),
    ]
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"), t.alias("message"))) for s, k, c, t in tests])
    return m.select(key.cast("string").alias("key"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.severity", "x.code", "key", "x.message")


def evaluations(rows: DataFrame, least: int = 20) -> DataFrame:
    """Evaluations (key, source, expected, target, candidates, rationale) that name another source or a target that was not offered, or give too short a reason."""
    offered = F.array_contains("candidates", F.col("target")) | F.col("target").isNull() | (F.col("target") == UNDECIDED)
    tests = (
        ("source", ~F.col("source").eqNullSafe(F.col("expected")), "source differs"),
        ("target", ~F.coalesce(offered, F.lit(False)), "target was not offered"),
        ("rationale", F.coalesce(F.length("rationale"), F.lit(0)) < least, "rationale is too short"),
    )
    found = F.array(*[F.when(c, F.struct(F.lit(k).alias("code"), F.lit(t).alias("message"))) for k, c, t in tests])
    return rows.select("key", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(F.lit("error").alias("severity"), "x.code", F.col("key").cast("string").alias("key"), "x.message")


def decisions(rows: DataFrame) -> DataFrame:
    """Class decisions (concept, action, target, extensionType, augmentationType) that lack what their action needs or have what it forbids."""
    need = {"reuse": ["target"], "extend": ["extensionType"], "augment": ["target", "augmentationType"], "exclude": []}
    ban = {"reuse": ["extensionType", "augmentationType"], "extend": ["augmentationType"], "augment": ["extensionType"], "exclude": ["extensionType", "augmentationType"]}
    out = None
    for a in need:
        for cols, code, test in ((need[a], "missing", lambda c: c.isNull()), (ban[a], "forbidden", lambda c: c.isNotNull())):
            for c in cols:
                part = finding(rows.where((F.col("action") == a) & test(F.col(c))), "error", code, F.col("concept"), _text(f"{a}: {c}"))
                out = part if out is None else out.unionByName(part)
    return out.unionByName(finding(rows.where(~F.coalesce(F.col("action").isin(list(need)), F.lit(False))), "error", "unknown-action", F.col("concept"), F.coalesce("action", F.lit(""))))


def missing(have: DataFrame, want: DataFrame, key: str, code: str) -> DataFrame:
    """Keys of ``want`` that ``have`` lacks."""
    return finding(want.select(key).distinct().join(have.select(key).distinct(), key, "left_anti"), "error", code, F.col(key), F.lit("missing"))


def bindings(refs: DataFrame, model: DataFrame) -> DataFrame:
    """References (ref, allowed) without a component in ``model`` (id, kind), or of another kind."""
    got = refs.join(model, F.col("ref") == F.col("id"), "left")
    status = F.when(F.col("id").isNull(), "unbound").when(~F.array_contains("allowed", F.col("kind")), "incompatible").otherwise("bound")
    return got.withColumn("status", status)


def drift(mapped: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mapped targets (key, target, hash) against the catalog's hashes (target, now): missing even without a stored hash, changed only with one."""
    got = mapped.join(catalog.withColumn("__in", F.lit(True)), "target", "left")
    status = F.when(F.col("__in").isNull(), "missing").when(F.col("hash").isNotNull() & (F.col("hash") != F.col("now")), "changed").otherwise("same")
    return got.select("key", "target", status.alias("status"))


def shapes(instances: DataFrame, triples: DataFrame, constraints: DataFrame) -> DataFrame:
    """Violations of property constraints (class, path, min, max, datatype) by instances (s, class) and their triples (s, p, o, o_datatype). A null maximum is unbounded."""
    used = constraints.where(~F.coalesce("deactivated", F.lit(False)))
    pairs = instances.join(used, "class").join(triples.select(F.col("s"), F.col("p").alias("path"), "o", "o_datatype"), ["s", "path"], "left")
    n = pairs.groupBy("s", "path").agg(F.count("o").alias("n"), F.max("min").alias("lo"), F.min("max").alias("hi"), F.count_if(F.col("o").isNotNull() & F.col("datatype").isNotNull() & ~F.col("o_datatype").eqNullSafe(F.col("datatype"))).alias("bad"))
    tests = (("min-count", F.col("n") < F.col("lo")), ("max-count", F.col("n") > F.col("hi")), ("datatype", F.col("bad") > 0))
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests])
    return n.select(F.lit("error").alias("severity"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("code"), F.concat_ws(" ", "s", "path").alias("key"), F.col("n").cast("string").alias("message"))


def routing(checks: DataFrame, classes: DataFrame, advice: dict[str, str]) -> DataFrame:
    """Failed checks (check, status, details) with each concept that their details name, and what to do.

    Details are cut at each place by the lengths that concepts have, and the pieces joined with concepts, so nothing is compared with everything.
    Names of over ``MOST_LENGTHS`` different lengths are refused.
    """
    lengths = [r["n"] for r in classes.select(F.length("concept").alias("n")).where("n is not null").distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"names of more than {MOST_LENGTHS} lengths")
    failed = checks.where("status <> 'pass' and details is not null").withColumn("__row", F.monotonically_increasing_id())
    cut = failed.withColumn("__n", F.explode(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"))).where(F.col("__n") <= F.length("details"))
    cut = cut.withColumn("__at", F.explode(F.sequence(F.lit(1), F.length("details") - F.col("__n") + 1))).select("__row", "check", F.col("details").substr(F.col("__at"), F.col("__n")).alias("concept"))
    pairs = [F.lit(x) for kv in advice.items() for x in kv]
    to = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("check")), F.lit("review")) if pairs else F.lit("review")
    return cut.distinct().join(classes.select("concept"), "concept").select("check", "concept", to.alias("recommendation"))
