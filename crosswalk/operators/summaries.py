"""Summaries of matrices, reviews and runs, and entropy of candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.values import entropy


def by_action(rows: DataFrame, default: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce("action", F.lit(default)).alias("action")).agg(F.count("*").alias("n"))


def candidate_entropy(found: DataFrame) -> DataFrame:
    """Candidates of each query and the bits of the choice among them, to 3 places."""
    return found.groupBy("q").agg(F.count("*").alias("candidates")).withColumn("entropy", F.round(entropy(F.col("candidates")), 3))


def entropy_total(each: DataFrame) -> DataFrame:
    """Items, their entropies' sum and mean, and how many have 4 bits or more. Items are rounded before they are added up."""
    return each.agg(F.count("*").alias("items"), F.round(F.sum("entropy"), 3).alias("total"), F.round(F.avg("entropy"), 3).alias("mean"), F.count_if(F.col("entropy") >= 4.0).alias("high"))


def residual(each: DataFrame, confidence: DataFrame) -> DataFrame:
    """What entropy is left after review: all of it for a best guess, none otherwise; no entropy counts 0, no confidence is confident. Of repeated keys the last counts."""
    c = confidence.groupBy("q").agg(F.max_by("confidence", "pos").alias("confidence"))
    got = c.join(each.select("q", "entropy"), "q", "left")
    before = F.coalesce("entropy", F.lit(0.0))
    return got.select("q", F.coalesce("confidence", F.lit("confident")).alias("confidence"), before.alias("before"), F.when(F.col("confidence") == "best-guess", before).otherwise(0.0).alias("residual"))


def matrix_summary(matrix: DataFrame, properties: DataFrame) -> DataFrame:
    """One row: classes by action and pending, properties by action."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    a = matrix.agg(F.count("*").alias("total"), *[count("action", x).alias(x) for x in ("reuse", "extend", "augment", "exclude")], count("reviewStatus", "pending-review").alias("pending"))
    b = properties.agg(F.count("*").alias("properties"), count("action", "reuse-property").alias("reused"), count("action", "create-property").alias("created"), count("action", "human-must-decide").alias("undecided"))
    return a.crossJoin(b)


def review_summary(matrix: DataFrame, properties: DataFrame) -> DataFrame:
    """matrix_summary with accepted concepts, best guesses and concepts whose properties are open."""
    open_ = properties.where("action = 'human-must-decide'").select("concept").distinct().agg(F.count("*").alias("openConcepts"))
    m = matrix.agg(F.count_if(F.col("reviewStatus") == "accepted").alias("accepted"), F.count_if(F.col("confidence") == "best-guess").alias("bestGuess"))
    return matrix_summary(matrix, properties).crossJoin(m).crossJoin(open_)


def rotation(rows: DataFrame, kind: str) -> DataFrame:
    """Rows by action and confidence; none given is confident."""
    return rows.groupBy(F.coalesce("action", F.lit("unknown")).alias("action"), F.coalesce("confidence", F.lit("confident")).alias("confidence")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))


def codebook(rows: DataFrame, hash_col: str) -> DataFrame:
    return rows.agg(F.count(hash_col).alias("hashes"), F.count_distinct(hash_col).alias("distinct_hashes"))


def stage_timings(rows: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """First start, last end and the seconds between of each key, null if negative."""
    secs = (F.unix_micros(F.max(end).cast("timestamp")) - F.unix_micros(F.min(start).cast("timestamp"))) / 1e6
    return rows.groupBy(*keys).agg(F.round(F.when(secs >= 0, secs), 3).alias("seconds"), F.count("*").alias("n"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How often two judgements agree, differ or are missing."""
    lost = F.col(a).isNull() | F.col(b).isNull()
    return pairs.agg(F.count_if(~lost & (F.col(a) == F.col(b))).alias("same"), F.count_if(~lost & (F.col(a) != F.col(b))).alias("different"), F.count_if(lost).alias("failed"))


def catalog_stats(types: DataFrame) -> DataFrame:
    """One row of counts of types (base, properties, facets, chain, pattern)."""
    some = lambda c: F.count_if(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0).alias(f"with_{c}")
    return types.agg(F.count("*").alias("types"), F.count_if(F.coalesce("base", F.lit("")) != "").alias("with_base"), some("properties"), some("facets"), some("chain"))


def checks(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if((F.col("status") != "pass") & (F.col("severity") == "error")).alias("failed"), F.count_if((F.col("status") != "pass") & (F.col("severity") == "warning")).alias("warned"))
