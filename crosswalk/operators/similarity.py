"""Set similarity of vocabularies, and differences between two versions of keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"type": 0.4, "property": 0.3, "namespace": 0.1, "codelist": 0.2}


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays as sets; 0 if both are empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / all_)


def pairs(members: DataFrame) -> DataFrame:
    """Jaccard, shared, only_a and only_b of every two vocabularies a < b, from distinct rows (vocab, member).

    Shared members are counted by joining on the member, so no array of members is built; pairs that share none are in it too.
    """
    m = members.select("vocab", "member").where("member is not null").distinct()
    size = members.select("vocab").distinct().join(m.groupBy("vocab").agg(F.count("*").alias("n")), "vocab", "left").select("vocab", F.coalesce("n", F.lit(0)).alias("n"))
    l, r = m.select(F.col("vocab").alias("a"), "member"), m.select(F.col("vocab").alias("b"), "member")
    both = l.join(r, "member").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    named = size.select(F.col("vocab").alias("a"), F.col("n").alias("na")).join(size.select(F.col("vocab").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    shared = F.coalesce("shared", F.lit(0))
    all_ = F.col("na") + F.col("nb") - shared
    return named.select("a", "b", shared.alias("shared"), (F.col("na") - shared).alias("only_a"), (F.col("nb") - shared).alias("only_b"), F.when(all_ == 0, 0.0).otherwise(shared / all_).alias("jaccard"))


def keyed_overlap(members: DataFrame) -> DataFrame:
    """Mean of the Jaccards over the keys that two vocabularies share, from distinct rows (vocab, key, member); 0 without shared keys."""
    m = members.distinct()
    n = m.groupBy("vocab", "key").agg(F.count("member").alias("n"))
    l, r = n.select(F.col("vocab").alias("a"), "key", F.col("n").alias("na")), n.select(F.col("vocab").alias("b"), "key", F.col("n").alias("nb"))
    keys = l.join(r, "key").where("a < b")
    both = m.select(F.col("vocab").alias("a"), "key", "member").join(m.select(F.col("vocab").alias("b"), "key", "member"), ["key", "member"]).where("a < b").groupBy("a", "b", "key").agg(F.count("*").alias("shared"))
    each = keys.join(both, ["a", "b", "key"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    j = F.when(F.col("na") + F.col("nb") - F.col("shared") == 0, 0.0).otherwise(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return each.groupBy("a", "b").agg(F.round(F.avg(j), 4).alias("average_jaccard"), F.count("*").alias("shared_keys"))


def scheme_overlap(members: DataFrame) -> DataFrame:
    """Jaccard of the code lists of every two vocabularies, rounded to 4 as it enters a composite, and how many they share, from rows (vocab, key, member)."""
    return pairs(members.select("vocab", F.col("key").alias("member")).distinct()).select("a", "b", F.round("jaccard", 4).alias("scheme_jaccard"), F.col("shared").alias("shared_schemes"))


def value_overlap(members: DataFrame) -> DataFrame:
    """For each code list that two vocabularies share: the Jaccard of its values, rounded to 4, and how many are shared and in each, from rows (vocab, key, member); a null member is a list without values."""
    m = members.select("vocab", "key", "member").distinct()
    n = m.groupBy("vocab", "key").agg(F.count("member").alias("n"))
    l, r = n.select(F.col("vocab").alias("a"), "key", F.col("n").alias("a_values")), n.select(F.col("vocab").alias("b"), "key", F.col("n").alias("b_values"))
    both = m.select(F.col("vocab").alias("a"), "key", "member").join(m.select(F.col("vocab").alias("b"), "key", "member"), ["key", "member"]).where("a < b").groupBy("a", "b", "key").agg(F.count("*").alias("shared_values"))
    each = l.join(r, "key").where("a < b").join(both, ["a", "b", "key"], "left").withColumn("shared_values", F.coalesce("shared_values", F.lit(0)))
    all_ = F.col("a_values") + F.col("b_values") - F.col("shared_values")
    return each.select("a", "b", "key", F.when(all_ == 0, 0.0).otherwise(F.round(F.col("shared_values") / all_, 4)).alias("value_jaccard"), "shared_values", "a_values", "b_values")


def composite(parts: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of scores (a, b, score) by name; a missing pair counts 0."""
    out = None
    for name, df in parts.items():
        p = df.select("a", "b", F.col("score").alias(name))
        out = p if out is None else out.join(p, ["a", "b"], "full")
    total = sum((F.coalesce(n, F.lit(0.0)) * weights[n] for n in parts), F.lit(0.0))
    return out.select("a", "b", F.round(total, 4).alias("composite"))


def staleness(old: DataFrame, new: DataFrame, key: str = "key", value: str = "hash") -> DataFrame:
    """Status of each key in two versions: new, dropped, stale (both hashes known and different) or current. Of repeated keys the last by pos counts."""
    last = lambda df, name: df.groupBy(key).agg(F.max_by(value, "pos").alias(name), F.lit(True).alias(f"in_{name}"))
    both = last(old, "old").join(last(new, "new"), key, "full")
    differs = F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "dropped").when(differs, "stale").otherwise("current")
    return both.select(key, status.alias("status"))


def digest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (path, digest) that are missing, changed or added; equal ones are left out."""
    a, b = old.select("path", F.col("digest").alias("a")), new.select("path", F.col("digest").alias("b"))
    status = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", status.alias("status")).where("status is not null")
