"""A whole alignment: candidates, evaluation, decision, audit, each a function of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.operators import decide, evaluate, quality, search, summaries


@dataclass
class Alignment:
    candidates: DataFrame
    entropy: DataFrame
    evaluations: DataFrame
    matrix: DataFrame
    findings: DataFrame


def align(sources: DataFrame, targets: DataFrame, properties: DataFrame, target_properties: DataFrame, judge=evaluate.first_candidate, k: int = 25, floor: float = 0.75, eligible=None, base: str | None = None) -> Alignment:
    """Aligns sources (id, vec) to targets (id, vec); properties are (concept, name, target) and target_properties (type, property).

    A target that was not among a source's candidates is a finding and leaves the concept without one.
    """
    found = search.score_floor(search.top_k(sources, targets, k, eligible), floor)
    listed = found.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"].cast("string")).alias("candidates"))
    asked = sources.select(F.col("id").alias("q")).join(listed, "q", "left").select(F.col("q").cast("string").alias("key"), F.col("q").cast("string").alias("source"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
    judged = evaluate.evaluate(asked, judge)
    checked = quality.evaluations(asked.join(judged, "key").withColumn("expected", F.col("source")))
    wrong = checked.where("code = 'target'").select("key").distinct().withColumn("__wrong", F.lit(True))
    concepts = judged.join(wrong, "key", "left").select(F.col("key").alias("concept"), F.when(F.col("__wrong").isNull(), F.col("target")).alias("target"))
    matrix = decide.resolve(concepts, properties, target_properties, base)
    own = properties.withColumn("action", decide.property_action(F.col("target")))
    audit = quality.audit(matrix, own, own.groupBy("concept").agg(F.count("*").alias("n")))
    return Alignment(found, summaries.candidate_entropy(found), judged, matrix, checked.unionByName(audit))
